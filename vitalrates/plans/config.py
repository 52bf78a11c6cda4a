"""Study parameters. Defaults are the reference analysis's values."""

from __future__ import annotations

from dataclasses import dataclass, field

from vitalrates.functions.bins import Bins
from vitalrates.operators.harmonise import AGE_BREAKS, AGE_BREAKS5, AGE_GROUPS, AGE_GROUPS5


@dataclass(frozen=True)
class StudyConfig:
    years: tuple = (1980, 2023)          # deaths and national population
    mpio_years: tuple = (1985, 2023)     # municipal population (region, department)
    regime_years: tuple = (1998, 2023)   # regime grids
    insured_years: tuple = (2012, 2023)  # insured population
    std_year: int = 2000                 # standard population year
    mask_year: int = 1991                # unreliable year for the youngest groups
    anchor_year: int = 1990              # zero anchor for cause-level series
    n_masked_groups: int = 3
    min_count: int = 10
    scale: float = 1e5
    yll_scale: float = 1e6
    decade_width: int = 10
    interp_x: str = "row"
    anchor: str = "overwrite"
    ratio_limits: str = "reference"      # or "log": limits of rate ratios in Tables 1 and 2
    sexes: tuple = ("Male", "Female")
    regimes: tuple = ("contr", "subs")
    regions: tuple = ("Urban", "Rural")
    ext_causes: tuple = ("External causes", "Accidents", "Assault", "Intentional self-harm")
    wide: Bins = field(default_factory=lambda: Bins(AGE_BREAKS, AGE_GROUPS))
    abridged: Bins = field(default_factory=lambda: Bins(AGE_BREAKS5, AGE_GROUPS5))

    @property
    def masked_groups(self) -> tuple:
        return tuple(self.wide.labels[: self.n_masked_groups])

    def year_list(self, span: tuple) -> list[int]:
        return list(range(span[0], span[1] + 1))


# Parameters for the benchmark-derived study: ship years 1995-2001, the
# regime field present from 1997 on.
TPCH = StudyConfig(years=(1995, 2001), mpio_years=(1995, 2001), regime_years=(1997, 2001),
                   insured_years=(1997, 2001), std_year=2000, mask_year=1998, anchor_year=1997)
