"""Deaths, population and rurality sources derived from the benchmark tables.

The driver's tables hold no vital records, so each line item is read as one
death record with raw, all-text codes (as the yearly death files deliver
them) and population is the part-size exposure of the same line items.
Every column is a deterministic function of the tables, so the work grows
with them:

* year / month: ship date; sex code: line status O → 1, F → 2, line 7 → 3
* regime code: customer segment (absent before 1997, as in early years)
* age code: quantity folded onto 26 codes; single age for population: 2·(quantity−1)
* occurrence department / municipality: customer nation / customer key;
  nation 0 is delivered blank, key 999 is the unknown municipality
* residence department / municipality: supplier nation / supplier key, missing
  for every 7th supplier
* cause code: ICD-9-like digits up to 1996, ICD-10-like letter codes after,
  missing for every 53rd part
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer with every column the deaths and the
    population need: the one fact join both derive from. Orders meet their
    customers first, so the line items move once, by order. Both joins are
    plain equi-joins: Spark broadcasts a side only when its measured size is
    under the broadcast threshold (AQE re-plans at run time) and
    sort-merges otherwise, with skewed keys split by AQE."""
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                             "l_linestatus", "l_shipdate")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment",   # a customer's codes are written once per customer, not once per record
        F.when(F.col("c_nationkey") == 0, F.lit("")).otherwise(_s(F.col("c_nationkey"))).alias("COD_DPTO"),
        _s(F.col("c_custkey") % 1000).alias("COD_MUNIC"))
    bought = o.join(c, o.o_custkey == c.c_custkey).drop("o_custkey")
    return l.join(bought, l.l_orderkey == bought.o_orderkey).drop("l_orderkey", "o_orderkey")


def _s(x: Column) -> Column:
    return x.cast("string")


def raw_deaths(spark: SparkSession, sf_dir: str, items: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """All-text death records in the yearly-file layout.

    ``spread`` covers what the ship years and codes leave out: the line number
    moves a third of the records 15 years back and a third 15 years on
    (1980-1986, 1995-2001, 2010-2016, so all age-code eras and both code
    revisions), ages use all 29 codes, supplier nation 24 is department 83,
    and every fourth department is written as a decimal (``5.0``)."""
    year = F.year("l_shipdate")
    dept = _s(F.col("s_nationkey"))
    if spread:
        year = year + (F.col("l_linenumber") % 3 - 1) * 15
        dept = (F.when(F.col("s_nationkey") == 24, F.lit("83"))
                 .when(F.col("s_nationkey") % 4 == 1, F.concat(dept, F.lit(".0"))).otherwise(dept))
    # as are a supplier's
    s = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", dept.alias("CODPTORE"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string")).otherwise(_s(F.col("s_suppkey") % 1000)).alias("CODMUNRE"))
    items = items if items is not None else line_items(spark, sf_dir)
    j = items.join(s, F.col("l_suppkey") == s.s_suppkey)
    qty = F.floor("l_quantity").cast("int")
    seg = F.col("c_mktsegment")
    icd9 = F.concat(F.lpad(_s((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1000), 3, "0"),
                    _s(F.col("l_linenumber") % 10))
    icd10 = F.concat(F.expr("chr(cast(65 + l_partkey % 26 as int))"),
                     F.lpad(_s(F.col("l_suppkey") % 100), 2, "0"),
                     _s(F.col("l_linenumber") % 10))
    return j.select(
        "COD_DPTO", "COD_MUNIC", "CODPTORE", "CODMUNRE",
        _s(year).alias("ANO"),
        _s(F.month("l_shipdate")).alias("MES"),
        F.when(F.col("l_linenumber") == 7, F.lit("3"))
         .when(F.col("l_linestatus") == "O", F.lit("1")).otherwise(F.lit("2")).alias("SEXO"),
        F.when(year <= 1996, F.lit(None).cast("string"))
         .when(seg.isin("BUILDING", "AUTOMOBILE"), F.lit("1"))
         .when(seg.isin("FURNITURE", "HOUSEHOLD"), F.lit("2"))
         .otherwise(F.lit("9")).alias("SEG_SOCIAL"),
        _s((qty - 1) % (29 if spread else 26) + 1).alias("GRU_ED1"),
        F.when(F.col("l_partkey") % 53 == 0, F.lit(None).cast("string"))
         .when(year <= 1996, icd9).otherwise(icd10).alias("C_BAS1"),
    )


def population_items(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Row-level exposure: one row per line item with municipality, year,
    sex, single age, insurance fields and its exposure N = part size."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    items = items if items is not None else line_items(spark, sf_dir)
    j = items.join(p, F.col("l_partkey") == p.p_partkey)
    seg = F.col("c_mktsegment")
    return j.select(
        F.concat(F.lpad(_s(F.col("c_nationkey")), 2, "0"),
                 F.lpad(_s(F.col("c_custkey") % 1000), 3, "0")).alias("COD_MPIO"),
        F.year("l_shipdate").alias("ANO"),
        F.when(F.col("l_linestatus") == "O", F.lit("Male")).otherwise(F.lit("Female")).alias("SEXO"),
        ((F.floor("l_quantity").cast("int") - 1) * 2).alias("EDAD"),
        F.when(seg.isin("BUILDING", "AUTOMOBILE"), F.lit("CONTRIBUTIVO"))
         .when(seg.isin("FURNITURE", "HOUSEHOLD"), F.lit("SUBSIDIADO"))
         .otherwise(F.lit("ESPECIAL")).alias("regime"),
        F.when(F.col("l_linestatus") == "O", F.lit("MASCULINO")).otherwise(F.lit("FEMENINO")).alias("sex"),
        F.col("p_size").cast("bigint").alias("N"),
    )


def population_cube(items: DataFrame) -> DataFrame:
    """Row-level exposure by year × sex × single age × insurance fields: some
    thousand cells whatever the data size, as partial sums before the exchange.
    The national and insured populations are re-sums of it. With the
    municipality in it, it would have nearly as many cells as there are rows."""
    return items.groupBy("ANO", "SEXO", "EDAD", "regime", "sex").agg(F.sum("N").alias("N"))


def popmpio_long(items: DataFrame) -> DataFrame:
    """Municipal population in long form ``COD_MPIO, ANO, SEXO, EDAD, N``. A
    map task's rows hardly share a cell, so they are dealt by municipality and
    year first and each task holds its own cells only."""
    return (items.select("COD_MPIO", "ANO", "SEXO", "EDAD", "N").repartition("COD_MPIO", "ANO")
            .groupBy("COD_MPIO", "ANO", "SEXO", "EDAD").agg(F.sum("N").alias("N")))


def popnac_long(cube: DataFrame) -> DataFrame:
    """National population ``ANO, SEXO, EDAD, N``."""
    return cube.groupBy("ANO", "SEXO", "EDAD").agg(F.sum("N").alias("N"))


def popbdua_raw(cube: DataFrame, first_year: int = 1997) -> DataFrame:
    """Insured population ``year (text), regime, sex, age, afil``."""
    return (cube.where(F.col("ANO") >= first_year)
                .groupBy(F.col("ANO").cast("string").alias("year"), "regime", "sex", F.col("EDAD").alias("age"))
                .agg(F.sum("N").alias("afil")))


def population_wide(cells: DataFrame) -> DataFrame:
    """Municipal projection sheet in its published wide layout: ids, ``AREA``
    and one column per sex × single age (``Hombres_<age>``,
    ``Mujeres_<age>``) plus a total column per sex. The headers are the ages
    that occur (one small job over the municipal cells, as a file's header
    is read before its rows); the sheet is one conditional aggregation and
    absent cells are 0 as in a published sheet. A row of it is a hundred sums,
    so cells are dealt by row first: a task holds its own rows, not all."""
    ages = sorted(r[0] for r in cells.select("EDAD").where(F.col("EDAD").isNotNull()).distinct().collect())
    sums = []
    for sex, label in (("Male", "Hombres"), ("Female", "Mujeres")):
        own = F.col("SEXO") == sex
        sums += [F.sum(F.when(own & (F.col("EDAD") == a), F.col("N")).otherwise(0)).alias(f"{label}_{a}") for a in ages]
        sums.append(F.sum(F.when(own, F.col("N")).otherwise(0)).alias(f"Total {label}"))
    return (cells.repartition("COD_MPIO", "ANO").groupBy("COD_MPIO", "ANO").agg(*sums)
            .withColumn("AREA", F.lit("Total")))


def rurality_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rurality source rows (``Municipaly, Municipali, Departam_1,
    Categoria_``) for every municipality code a customer or supplier can
    produce; the category follows the nation's region (the last region has
    no category). At most 25 × 1000 rows whatever the data size."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cat = (F.when(F.col("n_regionkey") == 0, F.lit("Ciudades y aglomeraciones"))
            .when(F.col("n_regionkey") == 1, F.lit("Intermedio"))
            .when(F.col("n_regionkey") == 2, F.lit("Rural"))
            .when(F.col("n_regionkey") == 3, F.lit("Rural Disperso")))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), (F.col("c_custkey") % 1000).alias("k"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), (F.col("s_suppkey") % 1000).alias("k"))
    codes = c.unionByName(s).distinct()
    j = codes.join(F.broadcast(n), codes.nk == n.n_nationkey)
    mun = (F.col("nk") * 1000 + F.col("k")).cast("int")
    return j.select(mun.alias("Municipaly"),
                    F.concat(F.lit("MPIO_"), mun.cast("string")).alias("Municipali"),
                    F.col("n_name").alias("Departam_1"),
                    cat.alias("Categoria_"))
