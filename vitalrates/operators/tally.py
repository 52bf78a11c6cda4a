"""One pass over death records for every count that starts at records.

Reports on codes need few columns each, and most distinct code tuples occur
very often. So raw codes are counted as tuples first and harmonised after
(H1-H4 run on tuples, not on records), and the strata that need several codes
of one record are counted beside them: all as grouping sets of one aggregate.
Spark expands each record once per set, combines on the map side, and moves
the counts in one exchange. A report that needs one set alone counts that set alone, with
the joins and columns it has a use for (:func:`tally_one`).

Every set is bounded by the code systems, not by the number of records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vitalrates.operators import harmonise as H
from vitalrates.sources.readers import conform

#: raw code columns as they are carried beside the harmonised ones
RAW = {"raw_year": "ANO", "raw_month": "MES", "raw_sex": "SEXO", "raw_regime": "SEG_SOCIAL", "raw_age": "GRU_ED1",
       "raw_cause": "C_BAS1", "raw_dpto": "COD_DPTO", "raw_mpio": "COD_MUNIC", "raw_dptore": "CODPTORE", "raw_mpiore": "CODMUNRE"}
#: code tuples that are counted before they are harmonised
TUPLES = {
    "age": ("raw_year", "raw_sex", "raw_age"),
    "cause": ("raw_year", "raw_regime", "raw_cause"),
    "person": ("raw_year", "raw_month", "raw_sex", "raw_regime"),
    "occurrence": ("raw_dpto", "raw_mpio"),
    "residence": ("raw_dptore", "raw_mpiore"),
}
PLACE = ("analysed", "year", "cause_ext", "cod_dptof", "cod_mpiof")
FLAGS = ("no_year", "no_sex", "no_age", "no_cause", "no_place", "no_region")


def quality_flags() -> dict[str, Column]:
    """What may be missing in a harmonised record."""
    missing = {"no_year": "year", "no_sex": "sex", "no_age": "age_group5", "no_cause": "cause", "no_place": "cod_mpiof"}
    return ({k: F.col(c).isNull() for k, c in missing.items()}
            | {"no_region": F.col("cod_mpiof").isNotNull() & F.col("region").isNull()})


def raw_codes(raw: DataFrame) -> dict[str, Column]:
    """The raw code columns; one that the input lacks is NULL."""
    have = [c.upper() for c in raw.columns]
    return {k: F.col(v) if v in have else F.lit(None).cast("string") for k, v in RAW.items()}


def places(raw: DataFrame, sexes: Sequence[str] = ("Male", "Female"), carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Raw records with harmonised codes, final geography and ``analysed``:
    does the record count in the analysis (known sex and age)?"""
    carry = carry or {}
    d = H.final_geography(H.clean_deaths(raw.withColumns(carry), carry=tuple(carry)))
    return d.withColumn("analysed", H.analysed(sexes))


def records(raw: DataFrame, regions: DataFrame, sexes: Sequence[str] = ("Male", "Female")) -> DataFrame:
    """:func:`places` with the raw codes, region and quality flags."""
    return H.attach_region(places(raw, sexes, raw_codes(raw)), regions).withColumns(quality_flags())


def tally(df: DataFrame, sets: Mapping[str, Sequence[str]], out: str = "n") -> DataFrame:
    """Counts of ``df`` by every set of columns, in one aggregate. A row
    belongs to one set (see :func:`pick`); columns outside it are NULL."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    return (df.groupingSets([list(s) for s in sets.values()], *columns)
            .agg(F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias(out)))


def tally_one(raw: DataFrame, regions: DataFrame, columns: Sequence[str], sexes: Sequence[str] = ("Male", "Female"),
              out: str = "n") -> DataFrame:
    """The same counts for one set: raw codes straight from the raw records,
    without harmonising one; places without the region join."""
    codes = raw_codes(raw)
    if set(columns) <= set(codes):
        df = raw.select(*[codes[c].alias(c) for c in columns])
    else:
        df = records(raw, regions, sexes) if set(columns) & {*FLAGS, *RAW, "region"} else places(raw, sexes)
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def pick(counts: DataFrame, sets: Mapping[str, Sequence[str]], name: str, out: str = "n") -> DataFrame:
    """The rows of one set of :func:`tally`, with its columns only."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    own = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in sets[name])
    return counts.where(F.col("set_id") == own).select(*sets[name], out)


def harmonised_tuples(tuples: DataFrame, out: str = "n") -> DataFrame:
    """Counted raw code tuples → silver columns with the count; codes outside
    the tuple are NULL."""
    raw = tuples.select(*[F.col(c).alias(RAW[c]) for c in tuples.columns if c in RAW], F.col(out).alias("__n"))
    raw = conform(raw, [*H.DEATH_COLUMNS, "__n"])
    return H.clean_deaths(raw, carry=("__n",)).withColumnRenamed("__n", out)


def resum(counts: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Counts by fewer keys."""
    return counts.groupBy(*keys).agg(F.sum(out).cast("bigint").alias(out))


def unmatched(places: DataFrame, regions: DataFrame, min_n: int = 10) -> DataFrame:
    """D1, G7 over counted places: municipality codes without a rurality row,
    their deaths of known cause and the years."""
    d = H.attach_region(places.where("analysed AND cause_ext IS NOT NULL"), regions).where(F.col("region").isNull())
    return (d.groupBy("cod_dptof", "cod_mpiof")
            .agg(F.sum("n").cast("bigint").alias("n"),
                 F.array_join(F.sort_array(F.collect_set(F.col("year").cast("string"))), ",").alias("years"))
            .where(F.col("n") >= min_n))


def observed(df: DataFrame, name: str = "quality") -> tuple[DataFrame, Observation]:
    """``df`` of :func:`records` with counters that fill while any later
    action reads it: records, analysed ones, and one counter per flag. No scan
    of their own; ``observation.get`` has them once the action is done."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if("analysed").alias("analysed"),
                      *[F.count_if(f).alias(f) for f in FLAGS]), seen
