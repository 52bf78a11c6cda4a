"""Text codes: tolerant numbers, padding that never truncates, report text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(col: Column, dtype: str = "int") -> Column:
    """Tolerant numeric cast: bad text gives NULL (P13). Goes through DOUBLE
    so exports that write ``1.0`` survive; non-integral values give NULL for
    integral targets."""
    return _of_double(F.trim(col).try_cast("double"), dtype)


def _of_double(d: Column, dtype: str) -> Column:
    if dtype in ("int", "bigint", "long"):
        return F.when(d == F.floor(d), d.try_cast(dtype))
    return d.try_cast(dtype)


def with_numbers(df: DataFrame, columns: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with :func:`to_number` of some columns (name → text, type), in
    two projections: a text is parsed in the first and read several times in
    the second, so Spark keeps them apart and parses once. Written out in one
    expression, a record's codes make a method of more than 8 000 bytes, which
    the JVM interprets and never compiles."""
    df = df.withColumns({f"__double_{k}": F.trim(c).try_cast("double") for k, (c, _) in columns.items()})
    return (df.withColumns({k: _of_double(F.col(f"__double_{k}"), t) for k, (_, t) in columns.items()})
            .drop(*[f"__double_{k}" for k in columns]))


def zero_pad(col: Column, width: int) -> Column:
    """Blank/missing → NULL, else the non-negative integer code left-padded
    with zeros to ``width``; longer values are kept whole (P9: a plain
    ``lpad`` would cut them). Codes go through a number, so an export's
    ``5.0`` is ``05``. No regex and no formatter per row."""
    return pad_number(to_number(col, "bigint"), width)


def pad_number(n: Column, width: int) -> Column:
    """:func:`zero_pad` of a code that is a number already."""
    txt = n.cast("string")
    return F.when(n >= 0, F.lpad(txt, F.greatest(F.length(txt), F.lit(width)), F.lit("0")))


def number_from_header(header: str) -> int | None:
    """Single age from a header such as ``Hombres_85 y más``: letters and
    ``_`` dropped, the rest read as a number (P12). Headers are a table's
    metadata, so this runs once per column, never per row."""
    rest = "".join(c for c in header if not (c.isalpha() or c == "_")).strip()
    try:
        age = float(rest)
    except ValueError:
        return None
    return int(age) if age.is_integer() else None


def fixed2(col: Column) -> Column:
    """Two-decimal text of the exact binary value, ties to even, as C's
    ``%.2f`` prints it (P20, Q17): 1.005 is a little less and gives ``1.00``,
    0.125 is a tie and gives ``0.12``. NULL stays NULL; not-a-number and
    infinities print as ``NaN``, ``Inf``, ``-Inf``; magnitudes from 2**63 on
    are left to the platform's formatter.

    The fraction f is exact. Its product with 100 is p + e: f is split into
    two halves of 26 bits, whose products with 100 are exact, so e is what
    rounding p has lost. p - floor(p) - 1/2 is exact as well, and adding e to
    it gives the right sign."""
    def text(x: Column) -> Column:
        whole = F.floor(F.abs(x))
        return let(F.abs(x) - whole, lambda f: let(f * 134217729.0 - (f * 134217729.0 - f), lambda high: let(f * 100.0, lambda p: let(
            (p - F.floor(p) - 0.5) + ((high * 100.0 - p) + (f - high) * 100.0),
            lambda side: let(F.floor(p) + F.when((side > 0) | ((side == 0) & (F.floor(p) % 2 == 1)), 1).otherwise(0), lambda cents: F.concat(
                F.when(x < 0, "-").otherwise(""), (whole + F.floor(cents / 100)).cast("bigint").cast("string"), F.lit("."),
                F.lpad((cents % 100).cast("int").cast("string"), 2, "0")))))))

    return let(col.cast("double"), lambda x: F.when(F.isnan(x), "NaN")
               .when(F.abs(x) == float("inf"), F.when(x > 0, "Inf").otherwise("-Inf"))
               .when(F.abs(x) >= 2.0 ** 63, F.format_string("%.2f", x)).when(x.isNotNull(), text(x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: without it a value used
    five times in five steps is written out 5**5 times in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def est_ci_text(est: Column, lo: Column, hi: Column) -> Column:
    """``"est (lo, hi)"`` report text; a missing part prints as ``NA`` as the
    reference's ``paste0`` does."""
    def part(c):
        return F.coalesce(fixed2(c), F.lit("NA"))
    return F.concat(part(est), F.lit(" ("), part(lo), F.lit(", "), part(hi), F.lit(")"))
