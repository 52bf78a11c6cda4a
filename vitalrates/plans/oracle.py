"""DuckDB SQL mirror of the benchmark-derived study (the differential oracle).

Each derived table of :class:`vitalrates.plans.study.Study` built by
``Study.from_tpch`` has a CTE here written directly in SQL, over the
pre-registered views ``lineitem orders customer supplier part nation``.
``query_sql(final)`` prefixes the CTE list to a final SELECT.
"""

from __future__ import annotations

import re

# Study parameters for the benchmark-derived data (see plans.config.TPCH).
Y0, Y1 = 1995, 2001
MASK_YEAR, ANCHOR_YEAR = 1998, 1997
REGIME_Y0 = 1997
MIN_N = "10 /* least count */"
YOUNG = "('<1','1-4','5-14')"
AGES = ["<1", "1-4", "5-14", "15-24", "25-59", "60+"]
AGES5 = ["0", "1-4"] + [f"{a}-{a + 4}" for a in range(5, 85, 5)] + ["85+"]


def _to_int(x: str) -> str:
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return f"(CASE WHEN {d} = floor({d}) THEN TRY_CAST({d} AS INTEGER) END)"


def _pad(x: str, w: int) -> str:
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return f"(CASE WHEN {d} = floor({d}) THEN printf('%0{w}d', CAST({d} AS BIGINT)) END)"


def _cut_wide(x: str) -> str:
    return (f"(CASE WHEN {x} >= 0 AND {x} < 1 THEN '<1' WHEN {x} >= 1 AND {x} < 5 THEN '1-4' "
            f"WHEN {x} >= 5 AND {x} < 15 THEN '5-14' WHEN {x} >= 15 AND {x} < 25 THEN '15-24' "
            f"WHEN {x} >= 25 AND {x} < 60 THEN '25-59' WHEN {x} >= 60 AND {x} < 125 THEN '60+' END)")


def _cut5(x: str) -> str:
    parts = [f"WHEN {x} >= 0 AND {x} < 1 THEN '0'", f"WHEN {x} >= 1 AND {x} < 5 THEN '1-4'"]
    for a in range(5, 85, 5):
        parts.append(f"WHEN {x} >= {a} AND {x} < {a + 5} THEN '{a}-{a + 4}'")
    parts.append(f"WHEN {x} >= 85 AND {x} < 125 THEN '85+'")
    return "(CASE " + " ".join(parts) + " END)"


def _ss(x: str) -> str:
    """Missing-propagating sum."""
    return f"(CASE WHEN count(*) = count({x}) THEN sum({x}) END)"


def _ns(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _vals(name: str, values) -> str:
    body = ", ".join("(" + (f"'{v}'" if isinstance(v, str) else str(v)) + ")" for v in values)
    return f"(SELECT * FROM (VALUES {body}) AS t({name}))"


def _grid(years, extra: dict) -> str:
    """Cartesian grid: years × wide ages × sexes × extra domains (literal
    lists or a SELECT giving one column)."""
    parts = [_vals("year", list(range(years[0], years[1] + 1))), _vals("age_group", AGES),
             _vals("sex", ["Male", "Female"])]
    for name, dom in extra.items():
        parts.append(_vals(name, dom) if isinstance(dom, (list, tuple)) else f"({dom})")
    return "SELECT * FROM " + " CROSS JOIN ".join(f"{p} AS g{i}" for i, p in enumerate(parts))


def _complete(src: str, grid: str, keys, value: str, fill: str) -> str:
    ks = ", ".join(f"coalesce(d.{k}, g.{k}) AS {k}" for k in keys)
    return (f"SELECT {ks}, coalesce(d.{value}, {fill}) AS {value} "
            f"FROM {src} d FULL JOIN ({grid}) g ON {_ns('d', 'g', keys)}")


def _interp(src: str, value: str, part) -> str:
    """Linear interpolation over row positions within each series."""
    p = ", ".join(part)
    w = f"PARTITION BY {p} ORDER BY year"
    pre = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    post = f"OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    inner = (f"SELECT *, CAST(row_number() OVER ({w}) AS DOUBLE) AS pos FROM {src}")
    mid = (f"SELECT *, last_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) {pre} AS p0, "
           f"last_value({value} IGNORE NULLS) {pre} AS v0, "
           f"first_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) {post} AS p1, "
           f"first_value({value} IGNORE NULLS) {post} AS v1 FROM ({inner})")
    return (f"SELECT * EXCLUDE ({value}, pos, p0, v0, p1, v1), CASE WHEN {value} IS NOT NULL THEN {value} "
            f"ELSE v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) END AS {value} FROM ({mid})")


def _mask(value: str) -> str:
    return (f"CASE WHEN year = {MASK_YEAR} AND age_group IN {YOUNG} THEN NULL "
            f"ELSE CAST({value} AS DOUBLE) END")


def _anchor(src: str, value: str, dom_name: str, dom) -> str:
    keys = ["year", "age_group", "sex", dom_name]
    g = (f"SELECT * FROM {_vals('year', [ANCHOR_YEAR])} a0 CROSS JOIN {_vals('age_group', AGES[:3])} a1 "
         f"CROSS JOIN {_vals('sex', ['Male', 'Female'])} a2 CROSS JOIN "
         + (_vals(dom_name, dom) if isinstance(dom, list) else f"({dom})") + " a3")
    ks = ", ".join(f"coalesce(d.{k}, g.{k}) AS {k}" for k in keys)
    return (f"SELECT {ks}, CASE WHEN coalesce(d.year, g.year) = {ANCHOR_YEAR} AND "
            f"coalesce(d.age_group, g.age_group) IN {YOUNG} THEN 0.0 ELSE d.{value} END AS {value} "
            f"FROM {src} d FULL JOIN ({g}) g ON {_ns('d', 'g', keys)}")


def _rates(pop: str, counts: str, keys, n: str, d_cols: str, d: str, r: str, rstd: str) -> str:
    ks = ", ".join(f"coalesce(p.{k}, c.{k}) AS {k}" for k in keys)
    j = (f"SELECT {ks}, p.{n}, {d_cols}, c.{d} / NULLIF(p.{n}, 0) AS {r} "
         f"FROM {pop} p FULL JOIN {counts} c ON {_ns('p', 'c', keys)}")
    return (f"SELECT j.*, s.pop_ref, s.prop_ref, j.{r} * s.prop_ref AS {rstd} "
            f"FROM ({j}) j LEFT JOIN popref s ON j.age_group IS NOT DISTINCT FROM s.age_group")


def _limits(src: str, est: str, dstd: str) -> str:
    return (f"SELECT *, 1.0 / NULLIF(sqrt({dstd}), 0) AS se, {est} * exp(-1.96 * (1.0 / NULLIF(sqrt({dstd}), 0))) AS LCI, "
            f"{est} * exp(1.96 * (1.0 / NULLIF(sqrt({dstd}), 0))) AS UCI FROM {src}")


def _std(src: str, by, r: str, rstd: str, dout: str, rout: str) -> str:
    b = ", ".join(by)
    g = (f"SELECT {b}, {_ss(f'{r} * pop_ref')} AS {dout}, {_ss(rstd)} * 100000.0 AS {rout} "
         f"FROM {src} GROUP BY {b}")
    return _limits(f"({g})", rout, dout)


def _period(src: str, by, d: str, n: str, r: str, dstd: str, smr: str) -> str:
    b = ", ".join(by)
    g = (f"SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, {b}, age_group, pop_ref, prop_ref, "
         f"{_ss(d)} AS {d}, CAST({_ss(n)} AS BIGINT) AS {n} FROM {src} "
         f"GROUP BY ALL")
    m = (f"SELECT *, {d} / NULLIF({n}, 0) AS {r}, ({d} / NULLIF({n}, 0)) * pop_ref AS {dstd}, "
         f"({d} / NULLIF({n}, 0)) * prop_ref * 100000.0 AS {smr} FROM ({g})")
    return _limits(f"({m})", smr, dstd)


def _period_total(src: str, by, smr: str, dstd: str, smr_tot: str, dstd_tot: str) -> str:
    b = ", ".join(["decade", *by])
    g = f"SELECT {b}, {_ss(smr)} AS {smr_tot}, {_ss(dstd)} AS {dstd_tot} FROM {src} GROUP BY {b}"
    return _limits(f"({g})", smr_tot, dstd_tot)


#: a0 below the threshold (constant, slope), above; a1 the same
FACTORS = {"total": (0.049, 2.742, 0.34, 1.5865, -2.167, 1.3565), "Male": (0.045, 2.684, 0.33, 1.651, -2.816, 1.352),
           "Female": (0.053, 2.8, 0.35, 1.522, -1.518, 1.361)}


def _lifetable_rows(src: str, by, series: str | None = None) -> str:
    b = ", ".join(by)
    w = f"PARTITION BY {b}"
    wo = f"PARTITION BY {b} ORDER BY age_li"
    m = "CAST(D AS DOUBLE) / NULLIF(CAST(N AS DOUBLE), 0)"
    k = ([f"CASE {series} " + " ".join(f"WHEN '{s}' THEN {FACTORS[s][i]}" for s in ("Male", "Female")) + f" ELSE {FACTORS['total'][i]} END"
          for i in range(6)] if series else list(FACTORS["total"]))
    l1 = f"SELECT *, row_number() OVER ({wo}) AS rn FROM {src} WHERE age_li IS NOT NULL"
    l2 = f"SELECT *, CASE WHEN rn = 1 THEN coalesce({m}, 0.0) ELSE {m} END AS m FROM ({l1})"
    l3 = f"SELECT *, min(CASE WHEN m IS NULL THEN rn END) OVER ({w}) AS stp FROM ({l2})"
    l4 = f"SELECT * FROM ({l3}) WHERE stp IS NULL OR rn < stp"
    l5 = (f"SELECT *, max(rn) OVER ({w}) AS nn, min(CASE WHEN rn = 1 THEN m END) OVER ({w}) AS m0, "
          f"min(CASE WHEN rn = 1 THEN age_li END) OVER ({w}) AS first_age FROM ({l4})")
    l6 = ("SELECT *, CASE WHEN rn = 1 THEN 1.0 WHEN rn = 2 THEN 4.0 ELSE 5.0 END AS nx, "
          f"CASE WHEN rn = 1 THEN (CASE WHEN m0 < 0.107 THEN {k[0]} + {k[1]} * m0 ELSE {k[2]} END) "
          f"WHEN rn = 2 THEN (CASE WHEN m0 < 0.107 THEN {k[3]} + {k[4]} * m0 ELSE {k[5]} END) "
          f"ELSE 2.6 END AS ax FROM ({l5})")
    l7 = f"SELECT *, CASE WHEN rn = nn THEN 1.0 ELSE nx * m / (1.0 + (nx - ax) * m) END AS q FROM ({l6})"
    l8 = (f"SELECT *, coalesce(product(1.0 - q) OVER ({wo} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) "
          f"AS l FROM ({l7})")
    l9 = f"SELECT *, l - coalesce(lead(l) OVER ({wo}), 0.0) AS dd FROM ({l8})"
    return f"SELECT *, CASE WHEN rn = nn THEN l / NULLIF(m, 0) ELSE nx * l - dd * (nx - ax) END AS LL FROM ({l9})"


def _lifetable(src: str, by) -> str:
    b = ", ".join(by)
    return (f"SELECT {b}, {_ss('LL')} AS LE0 FROM ({_lifetable_rows(src, by)}) GROUP BY {b} "
            f"HAVING min(CASE WHEN rn = 1 THEN age_li END) = 0")


def whole_lifetable(strata: str, by, series: str | None = None) -> str:
    """Every column of the life tables over a strata CTE; person-years above
    an age by a join of each row with the ages from it on."""
    rows = f"SELECT * FROM ({_lifetable_rows(strata, by, series)}) WHERE first_age = 0"
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in by)
    t = (f"SELECT {', '.join('a.' + x for x in by)}, a.rn, {_ss('b.LL')} AS TT FROM ({rows}) a JOIN ({rows}) b "
         f"ON {on} AND b.rn >= a.rn GROUP BY {', '.join('a.' + x for x in by)}, a.rn")
    both = " AND ".join(f"r.{x} IS NOT DISTINCT FROM t.{x}" for x in by)
    return (f"SELECT {', '.join('r.' + x for x in by)}, r.age_group5, r.age_li, r.nx, r.m, r.ax, r.q, r.l AS lx, r.dd AS dx, r.LL AS person_years, "
            f"t.TT AS person_years_above, t.TT / NULLIF(r.l, 0) AS ex FROM ({rows}) r JOIN ({t}) t ON {both} AND r.rn = t.rn")


def _lt_strata(pop_src: str, cube_src: str, by) -> str:
    b = ", ".join(by)
    keys = [*by, "age_group5"]
    N = f"SELECT {b}, age_group5, CAST({_ss('pop')} AS BIGINT) AS N FROM {pop_src} GROUP BY {b}, age_group5"
    D = f"SELECT {b}, age_group5, CAST(sum(n) AS BIGINT) AS D FROM {cube_src} GROUP BY {b}, age_group5"
    return (f"SELECT x.*, D.D, a.age_li FROM ({N}) x LEFT JOIN ({D}) D ON {_ns('x', 'D', keys)} "
            f"LEFT JOIN age_starts a ON x.age_group5 IS NOT DISTINCT FROM a.age_group5")


def _yll(src: str, d: str, by, pop: str, pop_keys, how: str = "LEFT") -> str:
    b = ", ".join(["year", *by])
    y = (f"SELECT x.*, a.AIRP, le.LE0 FROM {src} x LEFT JOIN airp a ON x.age_group IS NOT DISTINCT FROM a.age_group "
         f"LEFT JOIN lifeexp le ON x.year IS NOT DISTINCT FROM le.year")
    y2 = (f"SELECT *, CASE WHEN (LE0 > AIRP) IS NULL THEN NULL WHEN LE0 > AIRP THEN {d} * (LE0 - AIRP) "
          f"ELSE 0.0 END AS yearsll FROM ({y})")
    g = f"SELECT {b}, {_ss('yearsll')} AS YLL FROM ({y2}) GROUP BY {b}"
    keyside = "p" if how == "RIGHT" else "g"
    ks = ", ".join(f"{keyside}.{k} AS {k}" for k in ["year", *by])
    if how == "RIGHT":
        sel = f"SELECT {ks}, g.YLL, p.n FROM ({g}) g RIGHT JOIN {pop} p ON {_ns('g', 'p', pop_keys)}"
    else:
        extra = [k for k in ["year", *by]]
        sel = (f"SELECT {', '.join('g.' + k for k in extra)}, g.YLL, p.n FROM ({g}) g LEFT JOIN {pop} p "
               f"ON {_ns('g', 'p', pop_keys)}")
    return f"SELECT *, YLL * 100000.0 / NULLIF(n, 0) AS yll_std FROM ({sel})"


def _yll_dec(src: str, d: str) -> str:
    y = (f"SELECT x.*, a.AIRP, le.LE0 FROM {src} x LEFT JOIN airp a ON x.age_group IS NOT DISTINCT FROM a.age_group "
         f"LEFT JOIN lifeexp_decade le ON x.decade IS NOT DISTINCT FROM le.decade")
    return (f"SELECT *, CASE WHEN (LE0 > AIRP) IS NULL THEN NULL WHEN LE0 > AIRP THEN {d} * (LE0 - AIRP) / 1000000.0 "
            f"ELSE 0.0 END AS yearsll FROM ({y})")


def _diff(src: str, ids, value: str, out: str, keep: bool = True, scale: str | None = None) -> str:
    i = ", ".join(ids)
    dif = "(Male - Female)" + (f" * {scale}" if scale else "")
    w = (f"SELECT {i}, max(CASE WHEN sex = 'Male' THEN {value} END) AS Male, "
         f"max(CASE WHEN sex = 'Female' THEN {value} END) AS Female FROM {src} GROUP BY {i}")
    cols = "*" if keep else f"{i}"
    return f"SELECT {cols}, {dif} AS {out} FROM ({w})"


def _ratio(src: str, ids, est: str, out: str, lo: str, hi: str) -> str:
    i = ", ".join(ids)
    parts = []
    for v in (est, "LCI", "UCI"):
        for s in ("Male", "Female"):
            parts.append(f"max(CASE WHEN sex = '{s}' THEN {v} END) AS {v}_{s}")
    w = f"SELECT {i}, {', '.join(parts)} FROM {src} GROUP BY {i}"
    return (f"SELECT {i}, {est}_Male / NULLIF({est}_Female, 0) AS {out}, UCI_Male / NULLIF(UCI_Female, 0) AS {lo}, "
            f"LCI_Male / NULLIF(LCI_Female, 0) AS {hi} FROM ({w})")


def _relabel(src: str) -> str:
    return (f"SELECT * EXCLUDE (regime), CASE regime WHEN 'All people' THEN 'All people' WHEN 'contr' THEN "
            f"'Contributory' WHEN 'subs' THEN 'Subsidised' END AS regime FROM ({src})")


ICD = """CASE
 WHEN ver = '9' AND num9 BETWEEN 1 AND 139 THEN 'Infectious and parasitic diseases'
 WHEN ver = '9' AND (num9 BETWEEN 140 AND 175 OR num9 BETWEEN 179 AND 239) THEN 'Neoplasms'
 WHEN ver = '9' AND num9 BETWEEN 279 AND 289 THEN 'Diseases of the blood'
 WHEN ver = '9' AND num9 BETWEEN 240 AND 278 THEN 'Endocrine, nutritional, and metabolic diseases'
 WHEN ver = '9' AND num9 BETWEEN 290 AND 319 THEN 'Mental and behavioural disorders'
 WHEN ver = '9' AND num9 BETWEEN 320 AND 389 THEN 'Diseases of the nervous system'
 WHEN ver = '9' AND num9 BETWEEN 390 AND 459 THEN 'Diseases of the circulatory system'
 WHEN ver = '9' AND num9 BETWEEN 460 AND 519 THEN 'Diseases of the respiratory system'
 WHEN ver = '9' AND num9 BETWEEN 520 AND 579 THEN 'Diseases of the digestive system'
 WHEN ver = '9' AND num9 BETWEEN 680 AND 709 THEN 'Diseases of the skin and subcutaneous tissue'
 WHEN ver = '9' AND num9 BETWEEN 710 AND 739 THEN 'Diseases of the musculoskeletal system'
 WHEN ver = '9' AND num9 BETWEEN 580 AND 629 THEN 'Diseases of the genitourinary system'
 WHEN ver = '9' AND num9 BETWEEN 630 AND 676 THEN 'Maternal diseases'
 WHEN ver = '9' AND num9 BETWEEN 760 AND 779 THEN 'Conditions of the perinatal period'
 WHEN ver = '9' AND num9 BETWEEN 740 AND 759 THEN 'Congenital malformations'
 WHEN ver = '9' AND num9 BETWEEN 780 AND 799 THEN 'Causes of death not elsewhere classified'
 WHEN ver = '9' AND num9 BETWEEN 800 AND 999 THEN 'External causes'
 WHEN ver = '10' AND let IN ('A', 'B') THEN 'Infectious and parasitic diseases'
 WHEN ver = '10' AND ((let = 'C' AND num10 <= 97) OR (let = 'D' AND num10 <= 48)) THEN 'Neoplasms'
 WHEN ver = '10' AND let = 'D' AND num10 BETWEEN 50 AND 89 THEN 'Diseases of the blood'
 WHEN ver = '10' AND let = 'E' AND num10 <= 88 THEN 'Endocrine, nutritional, and metabolic diseases'
 WHEN ver = '10' AND let = 'F' THEN 'Mental and behavioural disorders'
 WHEN ver = '10' AND (let = 'G' OR (let = 'H' AND num10 <= 93)) THEN 'Diseases of the nervous system'
 WHEN ver = '10' AND let = 'I' THEN 'Diseases of the circulatory system'
 WHEN ver = '10' AND let = 'J' AND num10 <= 98 THEN 'Diseases of the respiratory system'
 WHEN ver = '10' AND let = 'K' AND num10 <= 92 THEN 'Diseases of the digestive system'
 WHEN ver = '10' AND let = 'L' THEN 'Diseases of the skin and subcutaneous tissue'
 WHEN ver = '10' AND let = 'M' THEN 'Diseases of the musculoskeletal system'
 WHEN ver = '10' AND let = 'N' AND num10 <= 98 THEN 'Diseases of the genitourinary system'
 WHEN ver = '10' AND let = 'O' THEN 'Maternal diseases'
 WHEN ver = '10' AND let = 'P' AND num10 <= 96 THEN 'Conditions of the perinatal period'
 WHEN ver = '10' AND let = 'Q' THEN 'Congenital malformations'
 WHEN ver = '10' AND let = 'R' THEN 'Causes of death not elsewhere classified'
 WHEN ver = '10' AND ((let = 'V' AND num10 >= 1) OR let IN ('W', 'X') OR (let = 'Y' AND num10 <= 89)) THEN 'External causes'
END"""

EXT = """CASE
 WHEN ver = '10' AND ((let = 'V' AND num10 >= 1) OR let = 'W' OR (let = 'X' AND num10 <= 59)) THEN 'Accidents'
 WHEN ver = '10' AND let = 'X' AND num10 BETWEEN 60 AND 84 THEN 'Intentional self-harm'
 WHEN ver = '10' AND ((let = 'X' AND num10 >= 85) OR (let = 'Y' AND num10 <= 9)) THEN 'Assault'
END"""

WIDE_CODE = """CASE
 WHEN era = 0 THEN CASE WHEN code BETWEEN 1 AND 5 THEN '<1' WHEN code BETWEEN 6 AND 7 THEN '1-4'
   WHEN code BETWEEN 8 AND 9 THEN '5-14' WHEN code BETWEEN 10 AND 11 THEN '15-24'
   WHEN code BETWEEN 12 AND 18 THEN '25-59' WHEN code BETWEEN 19 AND 24 THEN '60+' END
 WHEN era = 1 THEN CASE WHEN code BETWEEN 1 AND 6 THEN '<1' WHEN code BETWEEN 7 AND 8 THEN '1-4'
   WHEN code BETWEEN 9 AND 10 THEN '5-14' WHEN code BETWEEN 11 AND 12 THEN '15-24'
   WHEN code BETWEEN 13 AND 19 THEN '25-59' WHEN code BETWEEN 20 AND 25 THEN '60+' END
 ELSE CASE WHEN code BETWEEN 1 AND 6 THEN '<1' WHEN code BETWEEN 7 AND 8 THEN '1-4'
   WHEN code BETWEEN 9 AND 10 THEN '5-14' WHEN code BETWEEN 11 AND 12 THEN '15-24'
   WHEN code BETWEEN 13 AND 19 THEN '25-59' WHEN code BETWEEN 20 AND 28 THEN '60+' END
END"""

IDX5_CODE = """CASE
 WHEN era = 0 THEN CASE WHEN code BETWEEN 1 AND 5 THEN 1 WHEN code BETWEEN 6 AND 7 THEN 2
   WHEN code BETWEEN 8 AND 24 THEN code - 5 END
 ELSE CASE WHEN code BETWEEN 1 AND 6 THEN 1 WHEN code BETWEEN 7 AND 8 THEN 2
   WHEN code BETWEEN 9 AND 25 THEN code - 6 WHEN era = 2 AND code BETWEEN 26 AND 28 THEN 19 END
END"""

AGES5_LIST = "[" + ", ".join(f"'{a}'" for a in AGES5) + "]"

_REC = """CASE WHEN mf2 = '18767' THEN '18785' WHEN mf2 = '18765' THEN '18756'
 WHEN mf2 IN ('11102','11265','11279','11769','11848','11850') THEN '11001'
 WHEN mf2 IN ('99572','99760') THEN '99773' WHEN mf2 = '99496' THEN '99524'
 WHEN mf2 = '27086' THEN '27493' WHEN mf2 = '05625' THEN '05665' ELSE mf2 END"""

FB = "coalesce(cod_dptore IN ('01','75'), false)"

def _raw(spread: bool = False) -> str:
    """Death records as raw text; ``spread``: see ``tpch.raw_deaths``."""
    year = "(year(l.l_shipdate) + (l.l_linenumber % 3 - 1) * 15)" if spread else "year(l.l_shipdate)"
    ages = 29 if spread else 26
    dept = ("CASE WHEN s.s_nationkey = 24 THEN '83' WHEN s.s_nationkey % 4 = 1 THEN CAST(s.s_nationkey AS VARCHAR) || '.0' "
            "ELSE CAST(s.s_nationkey AS VARCHAR) END" if spread else "CAST(s.s_nationkey AS VARCHAR)")
    return f"""
SELECT CASE WHEN c.c_nationkey = 0 THEN '' ELSE CAST(c.c_nationkey AS VARCHAR) END AS COD_DPTO,
  CAST(c.c_custkey % 1000 AS VARCHAR) AS COD_MUNIC,
  {dept} AS CODPTORE,
  CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE CAST(l.l_suppkey % 1000 AS VARCHAR) END AS CODMUNRE,
  CAST({year} AS VARCHAR) AS ANO,
  CAST(month(l.l_shipdate) AS VARCHAR) AS MES,
  CASE WHEN l.l_linenumber = 7 THEN '3' WHEN l.l_linestatus = 'O' THEN '1' ELSE '2' END AS SEXO,
  CASE WHEN {year} <= 1996 THEN NULL
       WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN '1'
       WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN '2' ELSE '9' END AS SEG_SOCIAL,
  CAST((CAST(floor(l.l_quantity) AS INTEGER) - 1) % {ages} + 1 AS VARCHAR) AS GRU_ED1,
  CASE WHEN l.l_partkey % 53 = 0 THEN NULL
       WHEN {year} <= 1996 THEN lpad(CAST((l.l_partkey * 7 + l.l_suppkey) % 1000 AS VARCHAR), 3, '0')
            || CAST(l.l_linenumber % 10 AS VARCHAR)
       ELSE chr(CAST(65 + l.l_partkey % 26 AS INTEGER)) || lpad(CAST(l.l_suppkey % 100 AS VARCHAR), 2, '0')
            || CAST(l.l_linenumber % 10 AS VARCHAR) END AS C_BAS1
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""


CTES: list[tuple[str, str]] = [
    ("raw", _raw()),
    ("s1", f"""
SELECT {_to_int('MES')} AS month, {_to_int('ANO')} AS year,
  CASE SEXO WHEN '1' THEN 'Male' WHEN '2' THEN 'Female' WHEN '3' THEN 'Indeterminate' END AS sex,
  CASE SEG_SOCIAL WHEN '1' THEN 'contr' WHEN '2' THEN 'subs' END AS regime,
  {_to_int('GRU_ED1')} AS code,
  {_pad('COD_DPTO', 2)} AS cod_dpto, {_pad('CODPTORE', 2)} AS cod_dptore,
  {_pad('COD_MUNIC', 3)} AS cod_mpio1, {_pad('CODMUNRE', 3)} AS cod_mpiore1, C_BAS1
FROM raw"""),
    ("s2", f"""
SELECT *, CASE WHEN year BETWEEN 1980 AND 1997 THEN 0 WHEN year BETWEEN 1998 AND 2007 THEN 1 ELSE 2 END AS era,
  CASE WHEN year <= 1996 THEN '9' ELSE '10' END AS ver,
  CASE WHEN regexp_matches(substr(C_BAS1, 1, 3), '^[0-9]{{3}}$') THEN CAST(substr(C_BAS1, 1, 3) AS INTEGER) END AS num9,
  CASE WHEN regexp_matches(substr(C_BAS1, 1, 3), '^[A-Z][0-9]{{2}}$') THEN substr(C_BAS1, 1, 1) END AS let,
  CASE WHEN regexp_matches(substr(C_BAS1, 1, 3), '^[A-Z][0-9]{{2}}$') THEN CAST(substr(C_BAS1, 2, 2) AS INTEGER) END AS num10
FROM s1"""),
    ("silver", f"""
SELECT year, month, sex, regime, {WIDE_CODE} AS age_group, {AGES5_LIST}[{IDX5_CODE}] AS age_group5,
  cod_dpto, cod_dptore, cod_mpio1, cod_mpiore1,
  CASE WHEN cod_dpto IS NOT NULL AND cod_mpio1 IS NOT NULL AND cod_mpio1 <> '999' THEN cod_dpto || cod_mpio1 END AS cod_mpio,
  CASE WHEN cod_dptore IS NOT NULL AND cod_mpiore1 IS NOT NULL AND cod_mpiore1 <> '999' THEN cod_dptore || cod_mpiore1 END AS cod_mpiore,
  C_BAS1, {ICD} AS cause, {EXT} AS ext_cause
FROM s2"""),
    ("a1", f"""
SELECT *, CASE WHEN cause IS NULL THEN NULL WHEN cause = 'External causes' THEN 'External causes'
  ELSE 'Non-external causes' END AS cause_ext,
  CASE WHEN cod_mpiore IS NULL OR {FB} THEN cod_mpio ELSE cod_mpiore END AS mf
FROM silver"""),
    ("a2", f"""
SELECT *, CASE WHEN mf IS NOT NULL THEN substr(mf, 1, 2) WHEN cod_dptore IS NOT NULL AND NOT {FB} THEN cod_dptore
  WHEN cod_dpto IS NOT NULL THEN cod_dpto END AS df FROM a1"""),
    ("a3", """
SELECT *, CASE WHEN year <= 1981 AND df = '83' THEN '18' || substr(mf, 3, 4) ELSE mf END AS mf2,
  CASE WHEN year <= 1981 AND df = '83' THEN '18' ELSE df END AS cod_dptof FROM a2"""),
    ("silver_places", f"SELECT * EXCLUDE (mf, df, mf2), {_REC} AS cod_mpiof FROM a3"),
    ("deaths_tot", "SELECT * FROM silver_places WHERE sex IN ('Male', 'Female') AND age_group5 IS NOT NULL"),
    ("regions", """
SELECT printf('%05d', Municipaly) AS cod_mpio, Departam_1 AS dpto, 'MPIO_' || CAST(Municipaly AS VARCHAR) AS mpio,
  CASE WHEN Categoria_ IN ('Rural', 'Rural Disperso') THEN 'Rural' ELSE 'Urban' END AS region
FROM (SELECT CAST(x.nk * 1000 + x.k AS INTEGER) AS Municipaly, n.n_name AS Departam_1,
        CASE n.n_regionkey WHEN 0 THEN 'Ciudades y aglomeraciones' WHEN 1 THEN 'Intermedio' WHEN 2 THEN 'Rural'
          WHEN 3 THEN 'Rural Disperso' END AS Categoria_
      FROM (SELECT c_nationkey AS nk, c_custkey % 1000 AS k FROM customer
            UNION SELECT s_nationkey, s_suppkey % 1000 FROM supplier) x
      JOIN nation n ON x.nk = n.n_nationkey)
UNION ALL SELECT '27493', 'Chocó', 'Nuevo Belén de Bajirá', 'Rural'"""),
    ("cube", """
SELECT d.year, d.sex, d.age_group, d.age_group5, d.cause, d.cause_ext, d.ext_cause, r.region, d.cod_dptof, d.regime,
  count(*) AS n
FROM deaths_tot d LEFT JOIN regions r ON d.cod_mpiof = r.cod_mpio
GROUP BY ALL"""),
    ("cube_cause", "SELECT * FROM cube WHERE cause IS NOT NULL"),
    ("pitems", """
SELECT printf('%02d%03d', c.c_nationkey, c.c_custkey % 1000) AS COD_MPIO, CAST(year(l.l_shipdate) AS INTEGER) AS ANO,
  CASE WHEN l.l_linestatus = 'O' THEN 'Male' ELSE 'Female' END AS SEXO,
  (CAST(floor(l.l_quantity) AS INTEGER) - 1) * 2 AS EDAD,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'CONTRIBUTIVO'
       WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'SUBSIDIADO' ELSE 'ESPECIAL' END AS regime,
  CASE WHEN l.l_linestatus = 'O' THEN 'MASCULINO' ELSE 'FEMENINO' END AS sex,
  CAST(p.p_size AS BIGINT) AS N
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey"""),
    ("popnac", f"""
SELECT * FROM (SELECT ANO AS year, SEXO AS sex, {_cut_wide('EDAD')} AS age_group, {_cut5('EDAD')} AS age_group5,
  CAST(sum(N) AS BIGINT) AS pop FROM pitems GROUP BY ALL) WHERE year BETWEEN {Y0} AND {Y1}"""),
    ("popmpio", f"""
SELECT * FROM (SELECT COD_MPIO AS cod_mpio, ANO AS year, SEXO AS sex, {_cut_wide('EDAD')} AS age_group,
  CAST(sum(N) AS BIGINT) AS pop FROM pitems GROUP BY ALL) WHERE year <= {Y1}"""),
    ("bdua_raw", f"""
SELECT CAST(ANO AS VARCHAR) AS year, regime, sex, EDAD AS age, CAST(sum(N) AS BIGINT) AS afil
FROM pitems WHERE ANO >= {REGIME_Y0} GROUP BY ALL"""),
    ("popbdua", f"""
SELECT * FROM (SELECT {_to_int('year')} AS year,
  CASE regime WHEN 'CONTRIBUTIVO' THEN 'contr' WHEN 'SUBSIDIADO' THEN 'subs' END AS regime,
  CASE sex WHEN 'FEMENINO' THEN 'Female' WHEN 'MASCULINO' THEN 'Male' END AS sex,
  {_cut_wide('age')} AS age_group, CAST(sum(afil) AS BIGINT) AS afil FROM bdua_raw GROUP BY ALL)
WHERE year <= {Y1}"""),
    ("popref", """
SELECT age_group, pop_ref, pop_ref / sum(pop_ref) OVER () AS prop_ref
FROM (SELECT age_group, CAST(sum(pop) AS BIGINT) AS pop_ref FROM popnac WHERE year = 2000 GROUP BY age_group)"""),
    ("airp", "SELECT * FROM (VALUES ('<1', 0.0), ('1-4', 2.5), ('5-14', 9.5), ('15-24', 19.5), ('25-59', 42.0), "
             "('60+', 60.0)) AS t(age_group, AIRP)"),
    ("age_starts", "SELECT * FROM (VALUES " + ", ".join(
        f"('{lab}', {lo})" for lab, lo in zip(AGES5, [0, 1] + list(range(5, 90, 5)))) + ") AS t(age_group5, age_li)"),
    ("nat", "SELECT year, sex, age_group, CAST(sum(pop) AS BIGINT) AS nj FROM popnac GROUP BY ALL"),
    ("pop_nat_ys", "SELECT year, sex, CAST(sum(pop) AS BIGINT) AS n FROM popnac GROUP BY ALL"),
    # ---- life tables
    ("lifeexp_sex", _lifetable(f"({_lt_strata('popnac', 'cube', ['year', 'sex'])})", ["year", "sex"])),
    ("lifeexp", _lifetable(f"({_lt_strata('popnac', 'cube', ['year'])})", ["year"])),
    ("lifeexp_decade", _lifetable(
        "(" + _lt_strata("(SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, age_group5, pop FROM "
                         "(SELECT year, age_group5, CAST(sum(pop) AS BIGINT) AS pop FROM popnac GROUP BY ALL))",
                         "(SELECT *, CAST(floor(year / 10) * 10 AS INTEGER) AS decade FROM cube)", ["decade"]) + ")",
        ["decade"])),
    # ---- counts: year × sex × cause_ext × age
    ("ij_interp", _interp(
        f"(SELECT year, sex, cause_ext, age_group, {_mask('dij')} AS dij FROM "
        "(SELECT year, sex, cause_ext, age_group, CAST(sum(n) AS BIGINT) AS dij FROM cube_cause GROUP BY ALL))",
        "dij", ["sex", "cause_ext", "age_group"])),
    ("d_ij", _complete(f"(SELECT * FROM ij_interp WHERE dij >= {MIN_N})",
                       _grid((Y0, Y1), {"cause_ext": "SELECT DISTINCT cause_ext FROM cube_cause"}),
                       ["year", "age_group", "sex", "cause_ext"], "dij", "0.0")),
    ("r_ij", _rates("nat", "d_ij", ["year", "sex", "age_group"], "nj", "c.cause_ext, c.dij", "dij", "rij", "rij_std")),
    ("d_j", f"SELECT * FROM (SELECT year, sex, age_group, {_ss('dij')} AS dj FROM d_ij GROUP BY ALL) WHERE dj >= {MIN_N}"),
    ("r_j", _rates("nat", "d_j", ["year", "sex", "age_group"], "nj", "c.dj", "dj", "rj", "rj_std")),
    # ---- region
    ("regionj_interp", _interp(
        f"(SELECT year, sex, region, age_group, {_mask('durj')} AS durj FROM "
        "(SELECT year, sex, region, age_group, CAST(sum(n) AS BIGINT) AS durj FROM cube_cause "
        "WHERE region IS NOT NULL GROUP BY ALL))", "durj", ["sex", "region", "age_group"])),
    ("d_regionj", _complete(f"(SELECT * FROM regionj_interp WHERE durj >= {MIN_N})",
                            _grid((Y0, Y1), {"region": ["Urban", "Rural"]}),
                            ["year", "age_group", "sex", "region"], "durj", "0.0")),
    ("pop_region", "SELECT p.*, r.region FROM popmpio p LEFT JOIN regions r ON p.cod_mpio IS NOT DISTINCT FROM r.cod_mpio"),
    ("r_regionj", _rates("(SELECT year, sex, region, age_group, CAST(sum(pop) AS BIGINT) AS nurj FROM pop_region GROUP BY ALL)",
                         f"(SELECT * FROM d_regionj WHERE year >= {Y0})", ["year", "sex", "region", "age_group"], "nurj",
                         "c.durj", "durj", "rurj", "rurj_std")),
    # ---- department
    ("dptoj_interp", _interp(
        f"(SELECT year, sex, cod_dpto, age_group, {_mask('ddptoj')} AS ddptoj FROM "
        "(SELECT year, sex, cod_dptof AS cod_dpto, age_group, CAST(sum(n) AS BIGINT) AS ddptoj FROM cube_cause "
        "WHERE cod_dptof IS NOT NULL GROUP BY ALL))", "ddptoj", ["sex", "cod_dpto", "age_group"])),
    ("d_dptoj", f"SELECT * FROM dptoj_interp WHERE ddptoj >= {MIN_N}"),
    ("r_dptoj", _rates("(SELECT year, sex, substr(cod_mpio, 1, 2) AS cod_dpto, age_group, CAST(sum(pop) AS BIGINT) AS ndptoj "
                       "FROM popmpio GROUP BY ALL)", f"(SELECT * FROM d_dptoj WHERE year >= {Y0})",
                       ["year", "sex", "cod_dpto", "age_group"], "ndptoj", "c.ddptoj", "ddptoj", "rdptoj", "rdptoj_std")),
    # ---- regime
    ("d_regimeij", _complete(
        f"(SELECT * FROM (SELECT year, sex, regime, cause_ext, age_group, CAST(sum(n) AS BIGINT) AS dregij FROM cube_cause "
        f"WHERE regime IS NOT NULL GROUP BY ALL) WHERE dregij >= {MIN_N})",
        _grid((REGIME_Y0, Y1), {"regime": ["contr", "subs"], "cause_ext": "SELECT DISTINCT cause_ext FROM cube_cause"}),
        ["year", "age_group", "sex", "regime", "cause_ext"], "dregij", "CAST(0 AS BIGINT)")),
    ("r_regimeij", _rates("(SELECT year, sex, age_group, regime, CAST(sum(afil) AS BIGINT) AS nregj FROM popbdua GROUP BY ALL)",
                          f"(SELECT * FROM d_regimeij WHERE year >= {REGIME_Y0})", ["year", "sex", "age_group", "regime"],
                          "nregj", "c.cause_ext, c.dregij", "dregij", "rregij", "rregij_std")),
    ("d_regimej", _complete(
        f"(SELECT * FROM (SELECT year, sex, regime, age_group, CAST(sum(n) AS BIGINT) AS dregj FROM cube_cause "
        f"WHERE regime IS NOT NULL GROUP BY ALL) WHERE dregj >= {MIN_N})",
        _grid((REGIME_Y0, Y1), {"regime": ["contr", "subs"]}),
        ["year", "age_group", "sex", "regime"], "dregj", "CAST(0 AS BIGINT)")),
    ("r_regimej", _rates("(SELECT year, sex, regime, age_group, CAST(sum(afil) AS BIGINT) AS nregj FROM popbdua GROUP BY ALL)",
                         f"(SELECT * FROM d_regimej WHERE year >= {REGIME_Y0})", ["year", "sex", "regime", "age_group"],
                         "nregj", "c.dregj", "dregj", "rregj", "rregj_std")),
    # ---- cause chapters (anchored interpolation)
    ("i2j_interp", _interp("(" + _anchor(
        f"(SELECT year, sex, cause, age_group, {_mask('dij')} AS dij FROM "
        "(SELECT year, sex, cause, age_group, CAST(sum(n) AS BIGINT) AS dij FROM cube_cause GROUP BY ALL))",
        "dij", "cause", "SELECT DISTINCT cause FROM cube_cause") + ")", "dij", ["sex", "cause", "age_group"])),
    ("d_i2j", "SELECT * FROM (" + _complete(f"(SELECT * FROM i2j_interp WHERE dij >= {MIN_N})",
                                           _grid((Y0, Y1), {"cause": "SELECT DISTINCT cause FROM cube_cause"}),
                                           ["year", "age_group", "sex", "cause"], "dij", "0.0")
     + ") WHERE NOT (sex = 'Male' AND cause = 'Maternal diseases')"),
    ("r_i2j", _rates("nat", "d_i2j", ["year", "sex", "age_group"], "nj", "c.cause, c.dij", "dij", "rij", "rij_std")),
    # ---- external-cause groups
    ("i3j_counts", """
SELECT year, sex, ext_cause, age_group, CAST(sum(n) AS BIGINT) AS dij FROM cube_cause WHERE ext_cause IS NOT NULL GROUP BY ALL
UNION ALL
SELECT year, sex, cause AS ext_cause, age_group, CAST(sum(n) AS BIGINT) AS dij FROM cube_cause
WHERE cause = 'External causes' GROUP BY ALL"""),
    ("i3j_interp", _interp("(" + _anchor(
        f"(SELECT year, sex, ext_cause, age_group, {_mask('dij')} AS dij FROM i3j_counts)", "dij", "ext_cause",
        ["External causes", "Accidents", "Assault", "Intentional self-harm"]) + ")", "dij",
        ["sex", "ext_cause", "age_group"])),
    ("d_i3j", _complete(f"(SELECT * FROM i3j_interp WHERE dij >= {MIN_N})",
                        _grid((Y0, Y1), {"ext_cause": ["External causes", "Accidents", "Assault", "Intentional self-harm"]}),
                        ["year", "age_group", "sex", "ext_cause"], "dij", "0.0")),
    ("r_i3j", _rates("nat", "d_i3j", ["year", "sex", "age_group"], "nj", "c.ext_cause, c.dij", "dij", "rij", "rij_std")),
    ("d_regimei2j", "SELECT * FROM (" + _complete(
        f"(SELECT * FROM (SELECT year, sex, regime, cause, age_group, CAST(sum(n) AS BIGINT) AS dregij FROM cube_cause "
        f"WHERE regime IS NOT NULL GROUP BY ALL) WHERE dregij >= {MIN_N})",
        _grid((REGIME_Y0, Y1), {"regime": ["contr", "subs"], "cause": "SELECT DISTINCT cause FROM cube_cause"}),
        ["year", "age_group", "sex", "regime", "cause"], "dregij", "CAST(0 AS BIGINT)")
     + ") WHERE NOT (sex = 'Male' AND cause = 'Maternal diseases')"),
    ("r_regimei2j", _rates("(SELECT year, sex, age_group, regime, CAST(sum(afil) AS BIGINT) AS nregj FROM popbdua GROUP BY ALL)",
                           f"(SELECT * FROM d_regimei2j WHERE year >= {REGIME_Y0})", ["year", "sex", "age_group", "regime"],
                           "nregj", "c.cause, c.dregij", "dregij", "rregij", "rregij_std")),
    # ---- yearly standardised rates
    ("mrnac_sex", _std("r_j", ["year", "sex"], "rj", "rj_std", "d_std", "r_std")),
    ("mrnac_sex_ext", _std("r_ij", ["year", "sex", "cause_ext"], "rij", "rij_std", "di_std", "ri_std")),
    ("mrur_sex", _std("r_regionj", ["year", "sex", "region"], "rurj", "rurj_std", "dur_std", "rur_std")),
    ("mrregime_sex", _std("r_regimej", ["year", "sex", "regime"], "rregj", "rregj_std", "dreg_std", "rreg_std")),
    # ---- yearly YLL
    ("yllnac_sex", _yll("d_j", "dj", ["sex"], "pop_nat_ys", ["year", "sex"])),
    ("yllnac_sex_excess", _diff("yllnac_sex", ["year"], "yll_std", "yll_excess")),
    ("yllnac_sex_ext", _yll("d_ij", "dij", ["sex", "cause_ext"], "pop_nat_ys", ["year", "sex"])),
    ("yllnac_sex_ext_excess", _diff("yllnac_sex_ext", ["year", "cause_ext"], "yll_std", "yll_excess")),
    ("yllur_sex", _yll("d_regionj", "durj", ["sex", "region"],
                       "(SELECT year, sex, region, CAST(sum(pop) AS BIGINT) AS n FROM pop_region GROUP BY ALL)",
                       ["year", "sex", "region"], "RIGHT")),
    ("yllregime_sex", _yll("d_regimej", "dregj", ["sex", "regime"],
                           "(SELECT year, sex, regime, CAST(sum(afil) AS BIGINT) AS n FROM popbdua GROUP BY ALL)",
                           ["year", "sex", "regime"], "RIGHT")),
    # ---- decades
    ("smr_ij", _period("r_ij", ["sex", "cause_ext"], "dij", "nj", "rij", "dij_std", "SMRij")),
    ("smr_i", _period_total("smr_ij", ["sex", "cause_ext"], "SMRij", "dij_std", "SMRi", "di_std")),
    ("smr_j", _period("r_j", ["sex"], "dj", "nj", "rj", "dj_std", "SMRj")),
    ("smr", _period_total("smr_j", ["sex"], "SMRj", "dj_std", "SMR", "d_std")),
    ("smr_regimeij", _period("r_regimeij", ["sex", "regime", "cause_ext"], "dregij", "nregj", "rregij", "dregij_std",
                             "SMRregij")),
    ("smr_regimei", _period_total("smr_regimeij", ["sex", "regime", "cause_ext"], "SMRregij", "dregij_std", "SMRregi",
                                  "dregi_std")),
    ("smr_regimej", _period("r_regimej", ["sex", "regime"], "dregj", "nregj", "rregj", "dregj_std", "SMRregj")),
    ("smr_regime", _period_total("smr_regimej", ["sex", "regime"], "SMRregj", "dregj_std", "SMRreg", "dreg_std")),
    ("ylldec_agesex", _yll_dec("smr_j", "dj")),
    ("ylldec_sex", f"SELECT decade, sex, {_ss('yearsll')} AS YLL, {_ss('SMRj')} AS SMR FROM ylldec_agesex GROUP BY ALL"),
    ("ylldec_agesex_ext", _yll_dec("smr_ij", "dij")),
    ("ylldec_sex_ext", f"SELECT decade, sex, cause_ext, {_ss('yearsll')} AS YLL, {_ss('SMRij')} AS SMRi "
                       "FROM ylldec_agesex_ext GROUP BY ALL"),
    ("deaths_sexage_excess", _diff("ylldec_agesex", ["decade", "age_group"], "SMRj", "deaths_excess")),
    ("ylldec_sexage_excess", _diff("ylldec_agesex", ["decade", "age_group"], "yearsll", "yll_excess")),
    ("deaths_sex_excess", _diff("ylldec_sex", ["decade"], "SMR", "deaths_excess")),
    ("ylldec_sex_excess", _diff("ylldec_sex", ["decade"], "YLL", "yll_excess")),
    ("deaths_sexage_ext_excess", _diff("ylldec_agesex_ext", ["decade", "age_group", "cause_ext"], "SMRij",
                                       "deaths_excess")),
    ("ylldec_sexage_ext_excess", _diff("ylldec_agesex_ext", ["decade", "age_group", "cause_ext"], "yearsll",
                                       "yll_excess")),
    ("deaths_sex_ext_excess", _diff("ylldec_sex_ext", ["decade", "cause_ext"], "SMRi", "deaths_excess")),
    ("ylldec_sex_ext_excess", _diff("ylldec_sex_ext", ["decade", "cause_ext"], "YLL", "yll_excess")),
    # ---- department decades over a completed grid
    ("sd0", "SELECT coalesce(r.year, g.year) AS year, coalesce(r.age_group, g.age_group) AS age_group, "
            "coalesce(r.sex, g.sex) AS sex, coalesce(r.cod_dpto, g.cod_dpto) AS cod_dpto, r.ddptoj, r.ndptoj, "
            "r.pop_ref, r.prop_ref FROM r_dptoj r FULL JOIN ("
            + _grid((Y0, Y1), {"cod_dpto": "SELECT DISTINCT cod_dptof AS cod_dpto FROM cube_cause"}) + ") g ON "
            + _ns("r", "g", ["year", "age_group", "sex", "cod_dpto"])),
    ("sd1", "SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, sex, age_group, cod_dpto, pop_ref, prop_ref, "
            f"sum(ddptoj) AS ddptoj, CAST({_ss('ndptoj')} AS BIGINT) AS ndptoj FROM sd0 GROUP BY ALL"),
    ("sd2", "SELECT *, ddptoj / NULLIF(ndptoj, 0) AS rr, (ddptoj / NULLIF(ndptoj, 0)) * pop_ref AS dstd, "
            "(ddptoj / NULLIF(ndptoj, 0)) * prop_ref * 100000.0 AS smr FROM sd1"),
    ("smr_dpto", _limits("(SELECT decade, sex, cod_dpto, sum(smr) AS SMR, CASE WHEN count(smr) > 0 THEN sum(dstd) END "
                         "AS d_std FROM sd2 GROUP BY decade, sex, cod_dpto)", "SMR", "d_std")),
]

# ---- result tables
_tab1_dsmr = ("SELECT decade, dsmr, 'All people' AS regime FROM (" + _diff("smr", ["decade"], "SMR", "dsmr") + ") "
              "UNION ALL SELECT decade, dsmr, regime FROM (" + _diff("smr_regime", ["decade", "regime"], "SMRreg", "dsmr") + ")")
_tab1_smr = ("SELECT decade, smr_ratio, LCI, UCI, 'All people' AS regime FROM (" + _ratio("smr", ["decade"], "SMR", "smr_ratio", "LCI", "UCI") + ") "
             "UNION ALL SELECT decade, smr_ratio, LCI, UCI, regime FROM ("
             + _ratio("(SELECT * EXCLUDE (SMRreg), SMRreg AS SMR FROM smr_regime)", ["decade", "regime"], "SMR",
                      "smr_ratio", "LCI", "UCI") + ")")
_tab1_dext = ("SELECT decade, cause_ext, dsmri, 'All people' AS regime FROM ("
              + _diff("smr_i", ["decade", "cause_ext"], "SMRi", "dsmri") + ") UNION ALL "
              "SELECT decade, cause_ext, dsmri, regime FROM ("
              + _diff("smr_regimei", ["decade", "regime", "cause_ext"], "SMRregi", "dsmri") + ")")
_tab1_sext = ("SELECT decade, cause_ext, smri_ratio, LCIi, UCIi, 'All people' AS regime FROM ("
              + _ratio("(SELECT * EXCLUDE (SMRi), SMRi AS SMR FROM smr_i)", ["decade", "cause_ext"], "SMR", "smri_ratio",
                       "LCIi", "UCIi") + ") UNION ALL SELECT decade, cause_ext, smri_ratio, LCIi, UCIi, regime FROM ("
              + _ratio("(SELECT * EXCLUDE (SMRregi), SMRregi AS SMR FROM smr_regimei)", ["decade", "regime", "cause_ext"],
                       "SMR", "smri_ratio", "LCIi", "UCIi") + ")")
CTES += [
    ("t1_dsmr", _relabel(_tab1_dsmr)),
    ("t1_smr", _relabel(_tab1_smr)),
    ("t1_dext", _relabel(_tab1_dext)),
    ("t1_sext", _relabel(_tab1_sext)),
    ("t2_dsmr", _diff("smr_j", ["age_group", "decade"], "SMRj", "dsmr", keep=False)),
    ("t2_smr", _ratio("smr_j", ["age_group", "decade"], "SMRj", "smr_ratio", "LCI", "UCI")),
    ("t2_dext", _diff("smr_ij", ["age_group", "decade", "cause_ext"], "SMRij", "dsmri", keep=False)),
    ("t2_sext", _ratio("smr_ij", ["age_group", "decade", "cause_ext"], "SMRij", "smri_ratio", "LCIi", "UCIi")),
]


def _assemble(keys, parts) -> str:
    """Chained null-safe full outer joins on ``keys``; ``parts`` are
    (source, [columns]) pairs."""
    sql = None
    for i, (src, cols) in enumerate(parts):
        sel = f"SELECT {', '.join(keys)}, {', '.join(cols)} FROM {src}"
        if sql is None:
            sql = sel
            continue
        ks = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
        sql = (f"SELECT {ks}, a.* EXCLUDE ({', '.join(keys)}), b.* EXCLUDE ({', '.join(keys)}) "
               f"FROM ({sql}) a FULL JOIN ({sel}) b ON {_ns('a', 'b', keys)}")
    return sql


def _tab(prefix: str, keys) -> str:
    return _assemble(keys, [
        (f"{prefix}_dsmr", ["dsmr"]),
        (f"{prefix}_smr", ["smr_ratio", "LCI", "UCI"]),
        (f"(SELECT * FROM {prefix}_dext WHERE cause_ext = 'Non-external causes')", ["dsmri AS dsmr_next"]),
        (f"(SELECT * FROM {prefix}_sext WHERE cause_ext = 'Non-external causes')",
         ["smri_ratio AS smr_next", "LCIi AS LCI_next", "UCIi AS UCI_next"]),
        (f"(SELECT * FROM {prefix}_dext WHERE cause_ext = 'External causes')", ["dsmri AS dsmr_ext"]),
        (f"(SELECT * FROM {prefix}_sext WHERE cause_ext = 'External causes')",
         ["smri_ratio AS smr_ext", "LCIi AS LCI_ext", "UCIi AS UCI_ext"]),
    ])


def _excess(dname, yname, keys, all_ages):
    sql = (f"SELECT d.* EXCLUDE (Male, Female), y.yll_excess FROM {dname} d LEFT JOIN "
           f"(SELECT * EXCLUDE (Male, Female) FROM {yname}) y ON {_ns('d', 'y', keys)}")
    return f"SELECT *, 'All ages' AS age_group FROM ({sql})" if all_ages else sql


CTES += [
    ("tab1", _tab("t1", ["regime", "decade"])),
    ("tab2", _tab("t2", ["age_group", "decade"])),
    ("tabs2_ex", "SELECT age_group, decade, deaths_excess, yll_excess FROM ("
                 + _excess("deaths_sex_excess", "ylldec_sex_excess", ["decade"], True) + ") UNION ALL "
                 "SELECT age_group, decade, deaths_excess, yll_excess FROM ("
                 + _excess("deaths_sexage_excess", "ylldec_sexage_excess", ["decade", "age_group"], False) + ")"),
    ("tabs2_ee", "SELECT age_group, decade, cause_ext, deaths_excess, yll_excess FROM ("
                 + _excess("deaths_sex_ext_excess", "ylldec_sex_ext_excess", ["decade", "cause_ext"], True)
                 + ") UNION ALL SELECT age_group, decade, cause_ext, deaths_excess, yll_excess FROM ("
                 + _excess("deaths_sexage_ext_excess", "ylldec_sexage_ext_excess", ["decade", "age_group", "cause_ext"],
                           False) + ")"),
    ("tabs2", _assemble(["age_group", "decade"], [
        ("tabs2_ex", ["deaths_excess", "yll_excess"]),
        ("(SELECT * FROM tabs2_ee WHERE cause_ext = 'External causes')",
         ["deaths_excess AS deaths_excess_ext", "yll_excess AS yll_excess_ext"]),
        ("(SELECT * FROM tabs2_ee WHERE cause_ext = 'Non-external causes')",
         ["deaths_excess AS deaths_excess_next", "yll_excess AS yll_excess_next"]),
    ])),
]


_LIMITS = re.compile(r"(\w+)_Male / NULLIF\(\1_Female, 0\) AS (\w+), UCI_Male / NULLIF\(UCI_Female, 0\) AS (\w+), "
                     r"LCI_Male / NULLIF\(LCI_Female, 0\) AS (\w+)")


def _log_limits(m: re.Match) -> str:
    """The ratio's limits on the log scale in place of the swapped ones."""
    est, out, lo, hi = m.groups()
    def se(s):
        q = f"UCI_{s} / NULLIF({est}_{s}, 0)"
        return f"(CASE WHEN {q} > 0 THEN ln({q}) END / 1.96)"
    both = f"sqrt({se('Male')} * {se('Male')} + {se('Female')} * {se('Female')})"
    r = f"{est}_Male / NULLIF({est}_Female, 0)"
    return f"{r} AS {out}, {r} * exp(-1.96 * {both}) AS {lo}, {r} * exp(1.96 * {both}) AS {hi}"


def query_sql(final: str, spread: bool = False, min_count: int | None = None, ratio: str | None = None) -> str:
    """Every CTE followed by ``final``; DuckDB evaluates only the CTEs the
    final SELECT reaches. ``spread``, ``min_count`` and ``ratio`` give the
    study of the spread records, of another suppression threshold and of
    limits on the log scale."""
    ctes = [(name, _raw(True) if spread and name == "raw" else body) for name, body in CTES]
    if min_count is not None:
        ctes = [(name, body.replace(MIN_N, str(min_count))) for name, body in ctes]
    if ratio == "log":
        ctes = [(name, _LIMITS.sub(_log_limits, body)) for name, body in ctes]
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final
