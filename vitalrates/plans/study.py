"""The rates study: every derived table of the analysis as a lazy DataFrame.

Row-level work happens once: deaths are counted into a base cube (one
partial + final hash aggregate over the death records) and every stratified
count, life table and rate is derived from that cube or from the population
strata, which are themselves small. Tables that several others read are marked
for caching; marking runs nothing, and what an executor loses is computed
again from the inputs. Nothing is written unless the caller asks for it with
:meth:`Study.materialize`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.functions.bins import decade
from vitalrates.functions.frames import literal_frame
from vitalrates.functions.nulls import if_else, join_ns, safe_div, strict_sum
from vitalrates.functions.text import est_ci_text
from vitalrates.operators import counts as C
from vitalrates.operators import harmonise as H
from vitalrates.operators import population as P
from vitalrates.operators import standardise as S
from vitalrates.operators import tally as N
from vitalrates.operators.contrast import contrast_diff, ratio_limits
from vitalrates.operators.lifetable import life_table, life_table_e0, life_table_strata
from vitalrates.operators.yll import years_lost, yll_rate
from vitalrates.plans.config import StudyConfig


def stage(fn):
    """A derived table of bounded size (strata, never records) that several
    others read: built once per study and marked for caching."""
    name = fn.__name__

    def get(self):
        return self._marked(name, lambda: fn(self))
    get.__doc__ = fn.__doc__
    return property(get)


CUBE_DIMS = ("year", "sex", "age_group", "age_group5", "cause", "cause_ext", "ext_cause",
             "region", "cod_dptof", "regime")
#: reports on codes, places and quality, counted in one pass over the records
REPORTS = {**N.TUPLES, "place": N.PLACE, "quality": ("year", "analysed", *N.FLAGS)}
#: the same and the cube, for a stored pass. A lazy study keeps the cube apart: dozens of derived
#: tables repeat its plan, and in the wide one they would take Spark twice as long to plan
TALLIES = {**REPORTS, "cube": ("analysed", *CUBE_DIMS)}
#: base strata that a study under other parameters shares
BASE = ("cube", "popnac", "popmpio", "popbdua", "regions")
REGIME_LABELS = (("All people", "All people"), ("contr", "Contributory"), ("subs", "Subsidised"))


class Study:
    """Inputs: analysis-level deaths (after :func:`harmonise.analysis_deaths`),
    national and municipal population in long form (``ANO, SEXO, EDAD, N``
    [+ ``COD_MPIO``]), raw insured population, and the rurality dimension."""

    def __init__(self, deaths: DataFrame, popnac_long: DataFrame, popmpio_long: DataFrame,
                 popbdua_raw: DataFrame, regions: DataFrame, cfg: StudyConfig = StudyConfig()):
        self.spark: SparkSession = deaths.sparkSession
        self.cfg = cfg
        if "ext_cause" not in deaths.columns:
            deaths = H.map_ext_cause(deaths)
        self.deaths_tot = deaths
        self._popnac_long = popnac_long
        self._popmpio_long = popmpio_long
        self._popbdua_raw = popbdua_raw
        self._regions = regions
        self.silver: DataFrame | None = None
        self.raw: DataFrame | None = None
        self.counters: dict | None = None
        self._sets = REPORTS
        self._cached: list[str] = []
        self._base: Study | None = None

    def _marked(self, name: str, build) -> DataFrame:
        """A table marked for caching, and marked again if the session's cache
        was cleared since; else later tables would compute it once per use."""
        if self._base is not None and name in BASE and name in self._base._cached:
            return self._base._marked(name, build)
        if name not in self.__dict__:
            self.__dict__[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
            self._cached.append(name)
        else:
            self.remark(name)
        return self.__dict__[name]

    def remark(self, name: str | None = None) -> "Study":
        """Mark all tables for caching again if one (the first, unless named)
        no longer is."""
        name = name or next(iter(self._cached), None)
        if name in self._cached and self.__dict__[name].storageLevel == StorageLevel.NONE:
            for x in self._cached:
                if self.__dict__[x].storageLevel == StorageLevel.NONE:
                    self.__dict__[x].persist(StorageLevel.MEMORY_AND_DISK)
        return self

    # ------------------------------------------------------------ factories
    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str, cfg: StudyConfig | None = None, spread: bool = False) -> "Study":
        from vitalrates.plans import tpch
        from vitalrates.plans.config import TPCH
        cfg = cfg or TPCH
        raw = tpch.raw_deaths(spark, sf_dir, spread=spread)
        silver = H.clean_deaths(raw)
        regions = H.classify_region(tpch.rurality_source(spark, sf_dir))
        items = tpch.population_items(spark, sf_dir)
        cube = tpch.population_cube(items).persist(StorageLevel.MEMORY_AND_DISK)
        st = cls(cls.deaths_from_silver(silver, cfg), tpch.popnac_long(cube), tpch.popmpio_long(items),
                 tpch.popbdua_raw(cube, cfg.insured_years[0]), regions, cfg)
        st.__dict__["pop_cube"] = cube
        st._cached.append("pop_cube")
        st.silver, st.raw = silver, raw
        return st

    @classmethod
    def from_raw(cls, raw: DataFrame, popnac_long: DataFrame, popmpio_long: DataFrame, popbdua_raw: DataFrame,
                 regions: DataFrame, cfg: StudyConfig = StudyConfig()) -> "Study":
        """A study over raw yearly records: one pass over them counts all."""
        silver = H.clean_deaths(raw)
        st = cls(cls.deaths_from_silver(silver, cfg), popnac_long, popmpio_long, popbdua_raw, regions, cfg)
        st.silver, st.raw = silver, raw
        return st

    def with_config(self, **changes) -> "Study":
        """The same inputs and base strata under other parameters that do not
        touch them (thresholds, masked year, scales)."""
        from dataclasses import replace
        st = Study(self.deaths_tot, self._popnac_long, self._popmpio_long, self._popbdua_raw, self.regions,
                   replace(self.cfg, **changes))
        st.raw, st._sets = self.raw, self._sets
        for name in BASE:
            st.__dict__[name] = getattr(self, name)
        if "tally" in self.__dict__:
            st.__dict__["tally"] = self.__dict__["tally"]
        st._base = self
        return st

    @staticmethod
    def deaths_from_silver(silver: DataFrame, cfg: StudyConfig) -> DataFrame:
        """Silver death records → analysis level."""
        return H.analysis_deaths(silver, cfg.sexes)

    def materialize(self, root: str | None = None) -> "Study":
        """Store the row-level results on shared storage, once, because the
        caller asks for it: the harmonised deaths (partitioned by year) and the
        death cube. Later tables then plan over the stored copies. ``root``
        gives them fixed places, else each gets a new folder under
        ``spark.checkpoint.dir``. Call it before any derived table is used."""
        from vitalrates.sources.sinks import materialize, stored_deaths, write_deaths
        if self.silver is not None and root:
            write_deaths(self.silver, f"{root}/deaths_silver")
            self.silver = stored_deaths(self.spark, f"{root}/deaths_silver").select(*self.silver.columns)
            self.deaths_tot = self.deaths_from_silver(self.silver, self.cfg)
        elif self.silver is not None:
            self.silver = materialize(self.silver, "deaths_silver", partition_by=["year"])
            self.deaths_tot = self.deaths_from_silver(self.silver, self.cfg)
        place = f"{root}/cube" if root else None
        if self.raw is not None:
            # the counters fill while the counts are written: no pass of their own
            rows, seen = N.observed(N.records(self.raw, self.regions, self.cfg.sexes), f"quality-{id(self)}")
            self._sets = TALLIES
            self.__dict__["tally"] = materialize(N.tally(rows, TALLIES), "tally", path=f"{root}/tally" if root else None)
            self.counters = dict(seen.get)
            self.__dict__["cube"] = materialize(self.counted("cube").where("analysed").drop("analysed"), "cube", path=place)
        else:
            self.__dict__["cube"] = materialize(C.base_cube(H.attach_region(self.deaths_tot, self.regions), CUBE_DIMS), "cube", path=place)
        return self

    def unpersist(self) -> None:
        """Drop the cached strata."""
        for name in self._cached:
            self.__dict__.pop(name).unpersist()
        self._cached.clear()

    # ------------------------------------------------------------ base cube
    @stage
    def regions(self) -> DataFrame:
        """The municipality dimension; a municipality occurs once."""
        return self._regions

    @stage
    def tally(self) -> DataFrame:
        """All report counts that start at the records: one exchange over
        them. The pass that :meth:`materialize` stores; a lazy study counts a
        set when a report asks for it."""
        return N.tally(N.records(self.raw, self.regions, self.cfg.sexes), self._sets)

    def counted(self, name: str) -> DataFrame:
        """Counts by one set of :data:`REPORTS`; code tuples come harmonised.
        Picked from the stored tally, if there is one, else counted alone:
        all sets in one pass would write each record out seven times, with
        the columns of every set."""
        if self._sets is TALLIES:
            own = N.pick(self.tally, self._sets, name)
        else:
            own = self._marked(f"counted_{name}", lambda: N.tally_one(self.raw, self.regions, self._sets[name], self.cfg.sexes))
        return N.harmonised_tuples(own) if name in N.TUPLES else own

    @stage
    def cube(self) -> DataFrame:
        d = H.attach_region(self.deaths_tot, self.regions)
        return C.base_cube(d, CUBE_DIMS)

    def quality(self) -> DataFrame:
        """Data-quality counters by year (D1): records, analysed ones, and how
        many lack each field; from the same pass as the other reports."""
        q = self.counted("quality")
        count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).cast("bigint")
        return q.groupBy("year").agg(F.sum("n").cast("bigint").alias("records"), count("analysed").alias("analysed"),
                                     *[count(f).alias(f) for f in N.FLAGS])

    @cached_property
    def cube_cause(self) -> DataFrame:
        """Deaths with a known cause (analysis table 11)."""
        return self.cube.where(F.col("cause").isNotNull())

    # ------------------------------------------------------------ population
    @stage
    def popnac(self) -> DataFrame:
        return P.population_strata(self._popnac_long, {"year": "ANO", "sex": "SEXO"}, "EDAD", "N",
                                   bins=self.cfg.wide, extra_bins={"age_group5": self.cfg.abridged},
                                   year_col="year", year_range=self.cfg.years)

    @stage
    def popmpio(self) -> DataFrame:
        return P.population_strata(self._popmpio_long, {"cod_mpio": "COD_MPIO", "year": "ANO", "sex": "SEXO"},
                                   "EDAD", "N", bins=self.cfg.wide, year_col="year",
                                   year_range=(None, self.cfg.mpio_years[1]))

    @stage
    def popmpio_cells(self) -> DataFrame:
        """Municipal population by single age: the cells of its sheet."""
        return self._popmpio_long

    @stage
    def popbdua(self) -> DataFrame:
        return P.insured_population(self._popbdua_raw, (None, self.cfg.insured_years[1]), self.cfg.wide)

    @stage
    def popref(self) -> DataFrame:
        return P.standard_population(self.popnac, self.cfg.std_year)

    @cached_property
    def airp(self) -> DataFrame:
        return literal_frame(self.spark, self.cfg.wide.midpoints(), ["age_group", "AIRP"], ["string", "double"])

    @cached_property
    def age_starts(self) -> DataFrame:
        b = self.cfg.abridged
        return literal_frame(self.spark, [(lab, int(lo)) for lab, lo in zip(b.labels, b.lower)],
                             ["age_group5", "age_li"], ["string", "int"])

    def _nat(self, keys) -> DataFrame:
        return self.popnac.groupBy(*keys).agg(strict_sum("pop").alias("nj"))

    @cached_property
    def pop_region(self) -> DataFrame:
        return join_ns(self.popmpio, self.regions.select("cod_mpio", "region"), ["cod_mpio"], "left",
                       broadcast_right=True)

    # ------------------------------------------------------------ life tables
    def _life(self, by, pop, cube) -> DataFrame:
        strata = life_table_strata(pop, cube, by, self.age_starts)
        return life_table_e0(strata, by)

    def life_table(self, by: list[str], series: str | None = None) -> DataFrame:
        """Whole life tables by ``by`` (W4); ``series="sex"`` gives each sex its
        own separation factors (Q21)."""
        labels = {"Male": "male", "Female": "female"}
        return life_table(life_table_strata(self.popnac, self.cube, by, self.age_starts), by, series=series, labels=labels)

    @stage
    def lifeexp_sex(self) -> DataFrame:
        return self._life(["year", "sex"], self.popnac, self.cube)

    @stage
    def lifeexp(self) -> DataFrame:
        return self._life(["year"], self.popnac, self.cube)

    @stage
    def lifeexp_decade(self) -> DataFrame:
        w = self.cfg.decade_width
        pop = (self.popnac.groupBy("year", "age_group5").agg(strict_sum("pop").alias("pop"))
                   .withColumn("decade", decade(F.col("year"), w)))
        cube = self.cube.withColumn("decade", decade(F.col("year"), w))
        return self._life(["decade"], pop, cube)

    # ------------------------------------------------------------ counts
    def _mask(self) -> F.Column:
        c = self.cfg
        return (F.col("year") == c.mask_year) & H.is_in(F.col("age_group"), c.masked_groups)

    def _repair(self, counts, value, series, anchor_dom=None):
        c = self.cfg
        ag = am = None
        if anchor_dom is not None:
            name, dom = anchor_dom
            ag = C.grid(self.spark, {"year": [c.anchor_year], "age_group": list(c.masked_groups),
                                     "sex": list(c.sexes), name: dom})
            am = (F.col("year") == c.anchor_year) & H.is_in(F.col("age_group"), c.masked_groups)
        return C.mask_and_interpolate(counts, value, series, self._mask(), "year", c.interp_x,
                                      anchor_grid=ag, anchor_mask=am, anchor=c.anchor)

    def _grid(self, years, **doms) -> DataFrame:
        c = self.cfg
        return C.grid(self.spark, {"year": c.year_list(years), "age_group": list(c.wide.labels),
                                   "sex": list(c.sexes), **doms})

    def _causes_seen(self, col="cause") -> DataFrame:
        return self.cube_cause.select(col).distinct()

    @cached_property
    def ij_interp(self) -> DataFrame:
        """Counts by year × sex × cause_ext × age with the masked cells
        interpolated (before suppression)."""
        d = C.count_strata(self.cube_cause, ["year", "sex", "cause_ext", "age_group"], out="dij")
        return self._repair(d, "dij", ["sex", "cause_ext", "age_group"])

    @stage
    def d_ij(self) -> DataFrame:
        c = self.cfg
        d = C.suppress_small(self.ij_interp, "dij", c.min_count)
        return C.complete(d, self._grid(c.years, cause_ext=self._causes_seen("cause_ext")), "dij", 0.0)

    @stage
    def r_ij(self) -> DataFrame:
        return S.stratum_rates(self._nat(["year", "sex", "age_group"]), self.d_ij, self.popref,
                               ["year", "sex", "age_group"], "dij", "nj", "rij", "rij_std")

    @stage
    def d_j(self) -> DataFrame:
        d = C.resum(self.d_ij, ["year", "sex", "age_group"], "dij", "dj")
        return C.suppress_small(d, "dj", self.cfg.min_count)

    @stage
    def r_j(self) -> DataFrame:
        return S.stratum_rates(self._nat(["year", "sex", "age_group"]), self.d_j, self.popref,
                               ["year", "sex", "age_group"], "dj", "nj", "rj", "rj_std")

    @stage
    def d_regionj(self) -> DataFrame:
        c = self.cfg
        d = C.count_strata(self.cube_cause, ["year", "sex", "region", "age_group"], out="durj",
                           where=F.col("region").isNotNull())
        d = self._repair(d, "durj", ["sex", "region", "age_group"])
        d = C.suppress_small(d, "durj", c.min_count)
        return C.complete(d, self._grid(c.years, region=list(c.regions)), "durj", 0.0)

    @stage
    def r_regionj(self) -> DataFrame:
        keys = ["year", "sex", "region", "age_group"]
        pop = self.pop_region.groupBy(*keys).agg(strict_sum("pop").alias("nurj"))
        d = self.d_regionj.where(F.col("year") >= self.cfg.mpio_years[0])
        return S.stratum_rates(pop, d, self.popref, keys, "durj", "nurj", "rurj", "rurj_std")

    @stage
    def d_dptoj(self) -> DataFrame:
        d = C.count_strata(self.cube_cause.withColumnRenamed("cod_dptof", "cod_dpto"),
                           ["year", "sex", "cod_dpto", "age_group"], out="ddptoj",
                           where=F.col("cod_dpto").isNotNull())
        d = self._repair(d, "ddptoj", ["sex", "cod_dpto", "age_group"])
        return C.suppress_small(d, "ddptoj", self.cfg.min_count)

    @stage
    def r_dptoj(self) -> DataFrame:
        keys = ["year", "sex", "cod_dpto", "age_group"]
        pop = (self.popmpio.withColumn("cod_dpto", F.substring("cod_mpio", 1, 2))
                   .groupBy(*keys).agg(strict_sum("pop").alias("ndptoj")))
        d = self.d_dptoj.where(F.col("year") >= self.cfg.mpio_years[0])
        return S.stratum_rates(pop, d, self.popref, keys, "ddptoj", "ndptoj", "rdptoj", "rdptoj_std")

    def _regime_counts(self, keys, out) -> DataFrame:
        return C.count_strata(self.cube_cause, keys, out=out, where=F.col("regime").isNotNull())

    @stage
    def d_regimeij(self) -> DataFrame:
        c = self.cfg
        d = self._regime_counts(["year", "sex", "regime", "cause_ext", "age_group"], "dregij")
        d = C.suppress_small(d, "dregij", c.min_count)
        g = self._grid(c.regime_years, regime=list(c.regimes), cause_ext=self._causes_seen("cause_ext"))
        return C.complete(d, g, "dregij", 0)

    def _pop_regime(self, keys) -> DataFrame:
        return self.popbdua.groupBy(*keys).agg(strict_sum("afil").alias("nregj"))

    @stage
    def r_regimeij(self) -> DataFrame:
        keys = ["year", "sex", "age_group", "regime"]
        d = self.d_regimeij.where(F.col("year") >= self.cfg.insured_years[0])
        return S.stratum_rates(self._pop_regime(keys), d, self.popref, keys, "dregij", "nregj",
                               "rregij", "rregij_std")

    @stage
    def d_regimej(self) -> DataFrame:
        c = self.cfg
        d = self._regime_counts(["year", "sex", "regime", "age_group"], "dregj")
        d = C.suppress_small(d, "dregj", c.min_count)
        return C.complete(d, self._grid(c.regime_years, regime=list(c.regimes)), "dregj", 0)

    @stage
    def r_regimej(self) -> DataFrame:
        keys = ["year", "sex", "regime", "age_group"]
        d = self.d_regimej.where(F.col("year") >= self.cfg.insured_years[0])
        return S.stratum_rates(self._pop_regime(keys), d, self.popref, keys, "dregj", "nregj",
                               "rregj", "rregj_std")

    @staticmethod
    def _not_male_maternal(df: DataFrame) -> DataFrame:
        return df.where(~((F.col("sex") == "Male") & (F.col("cause") == "Maternal diseases")))

    @cached_property
    def i2j_interp(self) -> DataFrame:
        """Counts by year × sex × cause × age, masked cells interpolated after
        the zero anchor (before suppression)."""
        d = C.count_strata(self.cube_cause, ["year", "sex", "cause", "age_group"], out="dij")
        return self._repair(d, "dij", ["sex", "cause", "age_group"], ("cause", self._causes_seen("cause")))

    @stage
    def d_i2j(self) -> DataFrame:
        c = self.cfg
        d = C.suppress_small(self.i2j_interp, "dij", c.min_count)
        d = C.complete(d, self._grid(c.years, cause=self._causes_seen("cause")), "dij", 0.0)
        return self._not_male_maternal(d)

    @stage
    def r_i2j(self) -> DataFrame:
        return S.stratum_rates(self._nat(["year", "sex", "age_group"]), self.d_i2j, self.popref,
                               ["year", "sex", "age_group"], "dij", "nj", "rij", "rij_std")

    @stage
    def d_i3j(self) -> DataFrame:
        c = self.cfg
        keys = ["year", "sex", "ext_cause", "age_group"]
        a = C.count_strata(self.cube_cause, keys, out="dij", where=F.col("ext_cause").isNotNull())
        b = C.count_strata(self.cube_cause.where(F.col("cause") == H.EXTERNAL)
                               .withColumn("ext_cause", F.col("cause")), keys, out="dij")
        d = a.unionByName(b)
        d = self._repair(d, "dij", ["sex", "ext_cause", "age_group"], ("ext_cause", list(c.ext_causes)))
        d = C.suppress_small(d, "dij", c.min_count)
        return C.complete(d, self._grid(c.years, ext_cause=list(c.ext_causes)), "dij", 0.0)

    @stage
    def r_i3j(self) -> DataFrame:
        return S.stratum_rates(self._nat(["year", "sex", "age_group"]), self.d_i3j, self.popref,
                               ["year", "sex", "age_group"], "dij", "nj", "rij", "rij_std")

    @stage
    def d_regimei2j(self) -> DataFrame:
        c = self.cfg
        d = self._regime_counts(["year", "sex", "regime", "cause", "age_group"], "dregij")
        d = C.suppress_small(d, "dregij", c.min_count)
        g = self._grid(c.regime_years, regime=list(c.regimes), cause=self._causes_seen("cause"))
        return self._not_male_maternal(C.complete(d, g, "dregij", 0))

    @stage
    def r_regimei2j(self) -> DataFrame:
        keys = ["year", "sex", "age_group", "regime"]
        d = self.d_regimei2j.where(F.col("year") >= self.cfg.insured_years[0])
        return S.stratum_rates(self._pop_regime(keys), d, self.popref, keys, "dregij", "nregj",
                               "rregij", "rregij_std")

    # ------------------------------------------------------------ yearly standardised rates
    @cached_property
    def mrnac_sex(self) -> DataFrame:
        return S.standardise(self.r_j, ["year", "sex"], "rj", "rj_std", "d_std", "r_std", self.cfg.scale)

    @cached_property
    def mrnac_sex_ext(self) -> DataFrame:
        return S.standardise(self.r_ij, ["year", "sex", "cause_ext"], "rij", "rij_std", "di_std", "ri_std",
                             self.cfg.scale)

    @cached_property
    def mrur_sex(self) -> DataFrame:
        return S.standardise(self.r_regionj, ["year", "sex", "region"], "rurj", "rurj_std", "dur_std",
                             "rur_std", self.cfg.scale)

    @cached_property
    def mrregime_sex(self) -> DataFrame:
        return S.standardise(self.r_regimej, ["year", "sex", "regime"], "rregj", "rregj_std", "dreg_std",
                             "rreg_std", self.cfg.scale)

    # ------------------------------------------------------------ yearly YLL
    @cached_property
    def pop_nat_year_sex(self) -> DataFrame:
        return self.popnac.groupBy("year", "sex").agg(strict_sum("pop").alias("n"))

    @cached_property
    def yllnac_sex(self) -> DataFrame:
        return yll_rate(self.d_j, "dj", ["sex"], self.airp, self.lifeexp, self.pop_nat_year_sex,
                        "left", self.cfg.scale)

    @cached_property
    def yllnac_sex_excess(self) -> DataFrame:
        return contrast_diff(self.yllnac_sex, ["year"], "yll_std", "yll_excess", keep_levels=True)

    @cached_property
    def yllnac_sex_ext(self) -> DataFrame:
        return yll_rate(self.d_ij, "dij", ["sex", "cause_ext"], self.airp, self.lifeexp,
                        self.pop_nat_year_sex, "left", self.cfg.scale, pop_keys=["year", "sex"])

    @cached_property
    def yllnac_sex_ext_excess(self) -> DataFrame:
        return contrast_diff(self.yllnac_sex_ext, ["year", "cause_ext"], "yll_std", "yll_excess",
                             keep_levels=True)

    @cached_property
    def yllur_sex(self) -> DataFrame:
        pop = self.pop_region.groupBy("year", "sex", "region").agg(strict_sum("pop").alias("n"))
        return yll_rate(self.d_regionj, "durj", ["sex", "region"], self.airp, self.lifeexp, pop,
                        "right", self.cfg.scale)

    @cached_property
    def yllregime_sex(self) -> DataFrame:
        pop = self.popbdua.groupBy("year", "sex", "regime").agg(strict_sum("afil").alias("n"))
        return yll_rate(self.d_regimej, "dregj", ["sex", "regime"], self.airp, self.lifeexp, pop,
                        "right", self.cfg.scale)

    # ------------------------------------------------------------ decades
    def _period(self, rates, by, d, n, names):
        per_age, _ = S.standardise_by_period(rates, by, d, n, names, self.cfg.scale, self.cfg.decade_width)
        per_age = per_age.persist(StorageLevel.MEMORY_AND_DISK)
        self.__dict__[f"per_age_{names['smr']}"] = per_age
        self._cached.append(f"per_age_{names['smr']}")
        return per_age, S.standardise_by_period_total(per_age, by, names)[1]

    @cached_property
    def _smr_ij_i(self):
        return self._period(self.r_ij, ["sex", "cause_ext"], "dij", "nj",
                            dict(r="rij", d_std="dij_std", smr="SMRij", smr_tot="SMRi", d_std_tot="di_std"))

    smr_ij = property(lambda self: self._smr_ij_i[0])
    smr_i = property(lambda self: self._smr_ij_i[1])

    @cached_property
    def _smr_j_tot(self):
        return self._period(self.r_j, ["sex"], "dj", "nj",
                            dict(r="rj", d_std="dj_std", smr="SMRj", smr_tot="SMR", d_std_tot="d_std"))

    smr_j = property(lambda self: self._smr_j_tot[0])
    smr = property(lambda self: self._smr_j_tot[1])

    @cached_property
    def _smr_regimeij_i(self):
        return self._period(self.r_regimeij, ["sex", "regime", "cause_ext"], "dregij", "nregj",
                            dict(r="rregij", d_std="dregij_std", smr="SMRregij", smr_tot="SMRregi",
                                 d_std_tot="dregi_std"))

    smr_regimeij = property(lambda self: self._smr_regimeij_i[0])
    smr_regimei = property(lambda self: self._smr_regimeij_i[1])

    @cached_property
    def _smr_regimej_tot(self):
        return self._period(self.r_regimej, ["sex", "regime"], "dregj", "nregj",
                            dict(r="rregj", d_std="dregj_std", smr="SMRregj", smr_tot="SMRreg",
                                 d_std_tot="dreg_std"))

    smr_regimej = property(lambda self: self._smr_regimej_tot[0])
    smr_regime = property(lambda self: self._smr_regimej_tot[1])

    # ------------------------------------------------------------ decade YLL
    @stage
    def ylldec_agesex(self) -> DataFrame:
        return years_lost(self.smr_j, "dj", self.airp, self.lifeexp_decade, ["decade"], self.cfg.yll_scale)

    @cached_property
    def ylldec_sex(self) -> DataFrame:
        return (self.ylldec_agesex.groupBy("decade", "sex")
                    .agg(strict_sum("yearsll").alias("YLL"), strict_sum("SMRj").alias("SMR")))

    @stage
    def ylldec_agesex_ext(self) -> DataFrame:
        return years_lost(self.smr_ij, "dij", self.airp, self.lifeexp_decade, ["decade"], self.cfg.yll_scale)

    @cached_property
    def ylldec_sex_ext(self) -> DataFrame:
        return (self.ylldec_agesex_ext.groupBy("decade", "sex", "cause_ext")
                    .agg(strict_sum("yearsll").alias("YLL"), strict_sum("SMRij").alias("SMRi")))

    def excess(self, name: str) -> DataFrame:
        """The decade contrasts: deaths_sexage_excess, ylldec_sexage_excess,
        deaths_sex_excess, ylldec_sex_excess and their ``_ext`` versions."""
        spec = {
            "deaths_sexage_excess": (self.ylldec_agesex, ["decade", "age_group"], "SMRj", "deaths_excess"),
            "ylldec_sexage_excess": (self.ylldec_agesex, ["decade", "age_group"], "yearsll", "yll_excess"),
            "deaths_sex_excess": (self.ylldec_sex, ["decade"], "SMR", "deaths_excess"),
            "ylldec_sex_excess": (self.ylldec_sex, ["decade"], "YLL", "yll_excess"),
            "deaths_sexage_ext_excess": (self.ylldec_agesex_ext, ["decade", "age_group", "cause_ext"], "SMRij",
                                         "deaths_excess"),
            "ylldec_sexage_ext_excess": (self.ylldec_agesex_ext, ["decade", "age_group", "cause_ext"], "yearsll",
                                         "yll_excess"),
            "deaths_sex_ext_excess": (self.ylldec_sex_ext, ["decade", "cause_ext"], "SMRi", "deaths_excess"),
            "ylldec_sex_ext_excess": (self.ylldec_sex_ext, ["decade", "cause_ext"], "YLL", "yll_excess"),
        }
        df, ids, value, out = spec[name]
        return contrast_diff(df, ids, value, out, keep_levels=True)

    # ------------------------------------------------------------ department
    @stage
    def smr_dpto(self) -> DataFrame:
        c = self.cfg
        dom = self.cube_cause.select(F.col("cod_dptof").alias("cod_dpto")).distinct()
        g = self._grid(c.mpio_years, cod_dpto=dom)
        return S.standardise_sparse(self.r_dptoj, g, ["sex", "cod_dpto"], "ddptoj", "ndptoj",
                                    c.scale, c.decade_width)

    # ------------------------------------------------------------ figure datasets (F1)
    def figure(self, name: str) -> DataFrame:
        return getattr(self, f"_fig_{name}")()

    def _fig_1a(self):
        a = self.mrnac_sex.withColumn("cause_ext", F.lit("Overall"))
        b = self.mrnac_sex_ext.select("year", "sex", F.col("di_std").alias("d_std"),
                                      F.col("ri_std").alias("r_std"), "LCI", "UCI", "cause_ext")
        return a.unionByName(b, allowMissingColumns=True)

    def _fig_1b(self):
        a = self.yllnac_sex_excess.withColumn("cause_ext", F.lit("Overall"))
        return a.unionByName(self.yllnac_sex_ext_excess, allowMissingColumns=True)

    def _fig_1c(self):
        return self.mrregime_sex.withColumn(
            "regime2", if_else(F.col("regime") == "contr", F.lit("Contributory"), F.lit("Subsidised")))

    def _fig_1d(self):
        return self.mrur_sex

    def _fig_2(self):
        return self.r_ij.select("year", "sex", "cause_ext", "age_group",
                                (F.col("rij_std") * F.lit(self.cfg.scale)).alias("rate"))

    def _fig_s1(self):
        return self.lifeexp.withColumn("sex", F.lit("Both")).unionByName(self.lifeexp_sex)

    def _fig_s2(self):
        d = self.r_i2j.where(F.col("cause") != H.EXTERNAL)
        return contrast_diff(d, ["year", "age_group", "cause"], "rij_std", "smr_excess", scale=self.cfg.scale)

    def _fig_s3(self):
        return contrast_diff(self.r_i3j, ["year", "age_group", "ext_cause"], "rij_std", "smr_excess",
                             scale=self.cfg.scale)

    def _fig_s4(self):
        g = (self.r_regimei2j.groupBy("year", "sex", "regime", "cause")
                 .agg((strict_sum("rregij_std") * F.lit(self.cfg.scale)).alias("SMRregi")))
        return g.withColumn("regime2", if_else(F.col("regime") == "contr", F.lit("Contributory"),
                                               F.lit("Subsidised")))

    def _fig_props(self):
        return S.age_distribution(self.r_regimei2j, ["year", "cause", "regime", "sex"], "dregij")

    def _fig_s5_s8(self):
        """The four panels of the age-share figures (male/female × subsidised
        /contributory), one dataset with a panel label."""
        props = self._fig_props()
        panels = [("S5", "Male", "subs"), ("S6", "Male", "contr"), ("S7", "Female", "subs"), ("S8", "Female", "contr")]
        label = None
        for name, sex, reg in panels:
            cond = (F.col("sex") == sex) & (F.col("regime") == reg)
            label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
        return props.withColumn("panel", label).where(F.col("panel").isNotNull())

    def _fig_s9(self):
        w = contrast_diff(self.smr_dpto, ["decade", "cod_dpto"], "SMR", "smr_excess", keep_levels=True)
        w = w.fillna(0.0, subset=["Male", "Female"]).withColumn("smr_excess", F.col("Male") - F.col("Female"))
        return w.drop("Male", "Female")

    def _fig_s9_map(self):
        """Map attribute rows × decade contrasts: a declared many-to-many
        left join (J8) of the department label table with the figure S9
        data; departments without rates keep NULL decade and value."""
        labels = H.department_labels(self.regions)
        return join_ns(labels, self._fig_s9(), ["cod_dpto"], "left")

    # ------------------------------------------------------------ result tables
    def _relabel_regime(self, df):
        m = F.create_map(*[x for a, b in REGIME_LABELS for x in (F.lit(a), F.lit(b))])
        return df.withColumn("regime", m[F.col("regime")])

    #: column suffix → cause of the report columns
    REPORT_CAUSES = (("", "All"), ("_next", H.NON_EXTERNAL), ("_ext", H.EXTERNAL))

    @staticmethod
    def _side_by_side(sources, keys, values) -> DataFrame:
        """All parts of a report table in one grouping (J6): the sources are
        long frames (keys, ``cause_ext``, ``sex``, values) of at most one row
        per key, cause and sex, so one union and one conditional aggregation
        give every ``<value>_<cause>_<sex>`` cell. NULL keys group together,
        as null-safe joins would match them."""
        long = sources[0]
        for x in sources[1:]:
            long = long.unionByName(x)
        cells = [F.max(F.when((F.col("cause_ext") == cause) & (F.col("sex") == sex), F.col(v))).alias(f"{v}{suffix}_{sex}")
                 for suffix, cause in Study.REPORT_CAUSES for v in values for sex in ("Male", "Female")]
        return long.groupBy(*keys).agg(*cells)

    @classmethod
    def _contrasts(cls, sources, keys, limits: str = "reference") -> DataFrame:
        """Difference and ratio with limits per cause from long rows with
        ``est``, ``lo``, ``hi``. ``limits`` as in :func:`contrast_ratio`: the
        reference's swapped ones (SURVEY Q8) or those of the log ratio."""
        w = cls._side_by_side(sources, keys, ("est", "lo", "hi"))
        cols = []
        for s, _ in cls.REPORT_CAUSES:
            v = {f"{k}_{sex}": F.col(f"{k}{s}_{sex}") for k in ("est", "lo", "hi") for sex in ("Male", "Female")}
            low, high = ratio_limits(v, limits)
            cols += [(v["est_Male"] - v["est_Female"]).alias(f"dsmr{s}"),
                     safe_div(v["est_Male"], v["est_Female"]).alias(f"smr_ratio{s}" if not s else f"smr{s}"),
                     low.alias(f"LCI{s}"), high.alias(f"UCI{s}")]
        return w.select(*keys, *cols)

    @staticmethod
    def _long(df, keys, est, cause=None) -> DataFrame:
        c = F.lit(cause) if cause else F.col("cause_ext")
        return df.select(*keys, c.alias("cause_ext"), "sex", F.col(est).alias("est"), F.col("LCI").alias("lo"), F.col("UCI").alias("hi"))

    @cached_property
    def tab1(self) -> DataFrame:
        whole = F.lit("All people").alias("regime")
        keys = ["regime", "decade"]
        t = self._contrasts([self._long(self.smr, [whole, "decade"], "SMR", "All"),
                             self._long(self.smr_regime, keys, "SMRreg", "All"),
                             self._long(self.smr_i, [whole, "decade"], "SMRi"),
                             self._long(self.smr_regimei, keys, "SMRregi")], keys, self.cfg.ratio_limits)
        return self._relabel_regime(t)

    @cached_property
    def tab2(self) -> DataFrame:
        keys = ["age_group", "decade"]
        return self._contrasts([self._long(self.smr_j, keys, "SMRj", "All"), self._long(self.smr_ij, keys, "SMRij")], keys,
                               self.cfg.ratio_limits)

    @cached_property
    def tabs2(self) -> DataFrame:
        """Excess deaths and years lost by age group and decade. The totals
        over ages are strict sums of the age rows, so one grouping with two
        grouping sets gives both; those of Table 1 are not sums of the
        regimes' (each has its own population) and stay frames of their own."""
        keys = ["age_group", "decade"]
        cell = ["decade", "cause_ext", "sex"]

        def long(df, cause, deaths):
            c = F.lit(cause).alias("cause_ext") if cause else F.col("cause_ext")
            return df.select(*keys, c, "sex", F.col(deaths).alias("deaths"), F.col("yearsll").alias("yll"))
        ages = long(self.ylldec_agesex, "All", "SMRj").unionByName(long(self.ylldec_agesex_ext, None, "SMRij"))
        sums = ages.groupingSets([[*cell, "age_group"], cell], *cell, "age_group").agg(
            F.grouping("age_group").alias("total"), strict_sum("deaths").alias("deaths"), strict_sum("yll").alias("yll"))
        age = F.when(F.col("total") == 1, F.lit("All ages")).otherwise(F.col("age_group")).alias("age_group")
        w = self._side_by_side([sums.select(*cell, age, "deaths", "yll")], keys, ("deaths", "yll"))
        return w.select(*keys, *[(F.col(f"{v}{s}_Male") - F.col(f"{v}{s}_Female")).alias(f"{v}_excess{s}")
                                 for s in ("", "_ext", "_next") for v in ("deaths", "yll")])

    def report(self, table: str = "tab1") -> DataFrame:
        """Report text ``est (lo, hi)`` for the ratio columns."""
        t = getattr(self, table)
        out = (t.withColumn("smr_ratio", est_ci_text(F.col("smr_ratio"), F.col("LCI"), F.col("UCI")))
                .withColumn("smr_next", est_ci_text(F.col("smr_next"), F.col("LCI_next"), F.col("UCI_next")))
                .withColumn("smr_ext", est_ci_text(F.col("smr_ext"), F.col("LCI_ext"), F.col("UCI_ext"))))
        return out.drop("LCI", "UCI", "LCI_next", "UCI_next", "LCI_ext", "UCI_ext")

    def ordered(self, table: str) -> DataFrame:
        """A result table in report order (T6): regime / age group by their
        level order, then decade."""
        from vitalrates.functions.bins import label_ordinal
        t = {"report": lambda: self.report("tab1"), "report_age": lambda: self.report("tab2")}.get(
            table, lambda: getattr(self, table))()
        if "regime" in t.columns:
            levels = [b for _, b in REGIME_LABELS]
            return t.orderBy(label_ordinal(F.col("regime"), levels).asc_nulls_last(), "decade")
        levels = ["All ages", *self.cfg.wide.labels]
        return t.orderBy(label_ordinal(F.col("age_group"), levels).asc_nulls_last(), "decade")

    def write_report(self, root: str, fmt: str = "parquet") -> None:
        """Result sink (S11): Tables 1, 2, S2 and the formatted Tables 1 and
        2, one dataset each under ``root``, rows in report order."""
        from vitalrates.sources.sinks import write_results
        write_results({name: self.ordered(name) for name in ("tab1", "tab2", "tabs2", "report", "report_age")}, root, fmt)

    def unmatched(self, min_n: int = 10) -> DataFrame:
        """Municipality codes without a rurality row."""
        if self.raw is not None:
            return N.unmatched(self.counted("place"), self.regions, min_n)
        return H.unmatched_report(self.deaths_tot.where(F.col("cause").isNotNull()), self.regions, min_n)
