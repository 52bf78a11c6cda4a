"""Secrets: fixed patterns, and a battery of randomness tests.

Fixed patterns find assignments, access keys and long hexadecimal runs. Any
other run of 20 or more token characters is a candidate; where fixed patterns
cover a run in part, each part of that length left between them is one. Its encoding is the
smallest alphabet that holds its characters; three tests then weigh it against
"ordinary text", for which the character distribution is at least a given
distance from uniform, the kind of character (upper, lower, digit, sign)
changes at most half as often as at random, and neighbouring characters are
correlated: a lower tail of the (noncentral) chi-squared statistic, an upper
tail of the number of runs, and a tail of the serial correlation. Fisher's
method combines the three into a p-value that is small for random strings.
Alphabets, counters, repeated units and other ordered strings are more even,
more correlated or more alternating than random ones: the same statistics (the
serial one also as equal characters at up to ``LAGS`` distances) are held
against randomness from that side, and a string that fails one (at one in a
thousand) is no candidate to accept, whatever the others say.
Candidates are accepted by the Benjamini-Hochberg rule within bands of length,
over all candidates of the corpus, so that short strings, whose p-values can
never be as small, are judged among their like. P-values are counted in bins
and rounded up to their bin's edge, which only makes the rule stricter.

Defined cases: null text is empty; an empty text has no span; a very long text
is scanned whole, alone in its batch; extra columns are carried in one struct
and cannot clash; a sign that
joins a part to a fixed pattern's span is in the part's span but not tested,
if 20 characters are left without it; repeated rows are scanned one by one; a corpus without candidates accepts none.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import ROW, fields, map_texts, stored, whole_row

#: the fixed patterns (fixed values), in the order of their kinds
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SIGNS, LEAST = "+/=_-", 20
KINDS = ["assign", "access", "hex", "random"]
#: alphabet, distance from uniform (sum of squared relative deviations) that ordinary text has at least
ALPHABETS = [("hex", "0123456789abcdef", 0.5), ("HEX", "0123456789ABCDEF", 0.5),
             ("base32", string.ascii_uppercase + "234567", 0.8), ("alnum", string.digits + string.ascii_lowercase, 0.9),
             ("base64", string.ascii_letters + string.digits + "+/", 1.4),
             ("base64url", string.ascii_letters + string.digits + "-_", 1.4),
             ("any", string.ascii_letters + string.digits + "+/-_=", 1.5)]
_SETS = [(set(a), {c: i for i, c in enumerate(a)}, w) for _, a, w in ALPHABETS]
BANDS = [20, 28, 40, 64, 128]
#: a random string fails each test for being too regular this seldom
REGULAR = 1e-3
#: longest distance at which characters are compared
LAGS = 64
#: p-values are counted in bins of a tenth of a power of ten, down to 10 to the -40
BINS = 400
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()),
                                 T.StructField("end", T.IntegerType()), T.StructField("band", T.IntegerType()),
                                 T.StructField("bin", T.IntegerType())]))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_lower(x: float, df: int, ncp: float) -> float:
    """P(noncentral chi-squared <= x), by Sankaran's normal approximation."""
    h = 1 - 2 * (df + ncp) * (df + 3 * ncp) / (3 * (df + 2 * ncp) ** 2)
    p = (df + 2 * ncp) / (df + ncp) ** 2
    m = (h - 1) * (1 - 3 * h)
    return _normal(((x / (df + ncp)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at least k of n)."""
    if k <= 0:
        return 1.0
    if n > 2000:
        return _normal(-(k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    a, b = math.log(p), math.log1p(-p)
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b)
                        for i in range(k, n + 1)))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def periodicity(x: np.ndarray, k: int) -> float:
    """P-value of the distance with most equal characters, over all distances."""
    lags = range(1, min(len(x) // 2, LAGS) + 1)
    same = [(int((x[j:] == x[:-j]).sum()), len(x) - j) for j in lags]
    c, m = max(same, key=lambda s: (s[0] - s[1] / k) / math.sqrt(s[1]))
    return min(1.0, len(lags) * binomial_tail(c, m, 1 / k))


def regularity(x: np.ndarray, k: int, chi: float, changes: int, change: float, r: float) -> float:
    """Smallest p-value of the tests of randomness against order: characters
    too even, neighbours too correlated, kinds alternating too often, a period."""
    n = len(x)
    z = (r + 1 / n) * math.sqrt(n)
    return min(chi_lower(chi, k - 1, 0), math.erfc(abs(z) / math.sqrt(2)),
               binomial_tail(changes, n - 1, change) if change else 1.0, periodicity(x, k))


def randomness(token: str, correlation: float = 0.5) -> float:
    """Combined p-value of a token under "ordinary text"; 1 for one that is too
    regular to be random."""
    body = token.rstrip("=") or token
    have = set(body)
    alphabet, index, far = next((a, i, w) for a, i, w in _SETS if have <= a)
    n, k = len(body), len(alphabet)
    x = np.fromiter((index[c] for c in body), np.int64, n)
    counts = np.bincount(x, minlength=k)
    chi = float(k * (counts.astype(float) ** 2).sum() / n - n)
    shares = np.bincount([_kind(c) for c in alphabet]) / k
    change = 1 - float((shares ** 2).sum())
    kinds = [_kind(c) for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / max(1e-9, (d * d).sum()))
    if regularity(x, k, chi, changes, change, r) < REGULAR:
        return 1.0
    p_even = chi_lower(chi, k - 1, n * far)
    p_runs = binomial_tail(changes, n - 1, change / 2)
    p_serial = _normal((abs(r) - correlation) * math.sqrt(n))
    t = -sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial))
    return min(1.0, math.exp(-t) * (1 + t + t * t / 2))     # chi-squared tail with six degrees of freedom at 2t


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def p_bin(p: float) -> int:
    """Number of the bin below whose upper edge p lies; 0 holds p near one."""
    return min(BINS, max(0, math.floor(-10 * math.log10(max(p, 1e-300)))))


def uncovered(runs: list[tuple], base: list[tuple]):
    """The runs without what the spans in ``base`` cover (both in order), as
    start, end, and whether a span was cut off before and after."""
    k = reach = 0
    for a, b in runs:
        at = max(a, reach)
        while k < len(base) and base[k][0] < b:
            if base[k][0] > at:
                yield at, base[k][0], at > a, True
            reach = max(reach, base[k][2])
            at = max(at, reach)
            k += 1
        if at < b:
            yield at, b, at > a, False


def spans(text: str) -> tuple[list[tuple], list[tuple]]:
    """Spans of the fixed patterns and candidates, as rows of SPAN."""
    base, runs = [], []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end(), None, None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for m in RUN.finditer(text):
        at, run = m.start(), m[0]
        base += [(at + x.start(), 1, at + x.end(), None, None) for x in ACCESS.finditer(run)]
        base += [(at + x.start(), 2, at + x.end(), None, None) for x in HEX.finditer(run)]
        runs.append((at, m.end()))
    base.sort()
    more = []
    for a, b, before, after in uncovered(runs, base):
        if b - a < LEAST:
            continue
        token = text[a + (before and text[a] in SIGNS):b - (after and text[b - 1] in SIGNS)]
        if len(token) < LEAST:
            token = text[a:b]
        more.append((a, 3, b, band(len(token)), p_bin(randomness(token))))
    return base, more


def _scan():
    def work(texts):
        found = [spans(t or "") for t in texts]
        as_rows = lambda rows: [dict(zip(("start", "rank", "end", "band", "bin"), r)) for r in rows]
        return [as_rows(b) for b, _ in found], [as_rows(m) for _, m in found]
    return work


def scanned(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns in ``carry``, by default all), spans of fixed
    patterns (``base``) and candidates (``maybe``); stored once."""
    own = docs if carry is None else docs.select(*[F.col(f"`{c}`") for c in carry])
    row = whole_row(own) if own.columns else F.lit(0).alias(ROW)
    return stored(map_texts(docs, F.col(f"`{text}`"), [row],
                            T.StructType([T.StructField("base", SPAN), T.StructField("maybe", SPAN)]), _scan), "secrets")


def accepted_bins(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Per band the lowest accepted bin by Benjamini-Hochberg."""
    out = {}
    for b in {k[0] for k in counts}:
        total = sum(n for (x, _), n in counts.items() if x == b)
        below = 0
        for i in sorted((i for x, i in counts if x == b), reverse=True):
            below += counts[b, i]
            if 10 ** (-i / 10) <= rate * below / total:
                out[b] = i
    return out


def thresholds(scan: DataFrame, rate: float) -> dict[int, int]:
    """Lowest accepted bin per band over all candidates; one number per band
    and bin reaches the driver."""
    per = scan.select(F.explode("maybe").alias("m")).groupBy("m.band", "m.bin").count()
    return accepted_bins({(r[0], r[1]): r[2] for r in per.collect()}, rate)


def secret_spans(scan: DataFrame, rate: float = 0.01) -> DataFrame:
    """Adds ``found``: all accepted spans in order."""
    least = thresholds(scan, rate)
    if least:
        bound = F.create_map(*[x for b, i in sorted(least.items()) for x in (F.lit(b), F.lit(i))])
        more = F.filter("maybe", lambda m: F.coalesce(m["bin"] >= bound[m["band"]], F.lit(False)))
    else:
        more = F.filter("maybe", lambda m: F.lit(False))
    return scan.withColumn("found", F.array_sort(F.concat("base", more)))


def _joined(c: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"),
                                                             s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """Query view: counts of the fixed patterns, their digest, all spans."""
    found = secret_spans(scanned(docs, carry=["doc_id"]))
    n = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return found.select(F.col(f"{ROW}.doc_id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"),
                        n(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("found").alias("spans"))


def masked(text: str, least: dict[int, int], mark: str) -> str:
    """The text with every accepted span replaced; overlapping spans are one."""
    base, maybe = spans(text)
    cuts = sorted(base + [m for m in maybe if m[4] >= least.get(m[3], BINS + 1)])
    if not cuts:
        return text
    parts, at = [], 0
    for start, _, end, _, _ in cuts:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", rate: float = 0.01) -> DataFrame:
    """The documents with every found span replaced by ``mark``; ``n_chars``
    follows the new text. Candidates are stored without the texts for the
    thresholds; texts are scanned again on their way out."""
    least = thresholds(scanned(docs, text, carry=[]), rate)

    def factory():
        return lambda texts: ([None if t is None else masked(t, least, mark) for t in texts],)

    new = map_texts(docs, F.col(f"`{text}`"), [whole_row(docs)], fields("_new string"), factory)
    cols = []
    for c in docs.columns:
        old = F.col(f"{ROW}.`{c}`")
        cols.append(F.col("_new").alias(c) if c == text else
                    F.char_length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else old.alias(c))
    return new.select(*cols)
