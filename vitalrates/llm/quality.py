"""Quality rules with risk-controlled cutoffs.

Every document gets counts over its whole text and, from them, a score per
rule (higher is worse). Labelled documents serve as holdout: for a stratum
(language) and a rule, cutoffs are tested from the most lenient to the
strictest. A cutoff is certified while the exact (Clopper-Pearson) upper
confidence bound of its false rejection rate among good documents stays within
the rule's share of the allowed risk; testing stops at the first failure
(fixed-sequence testing needs no further correction along a rule), and the
confidence is divided by the number of tests run (Bonferroni). Only rules that
catch a labelled bad document are tested, in a stratum only as many of them as
its good documents can certify, and these share the risk: which are tested
depends on the bad documents and the number of good ones alone. The certified cutoff with the best balance of bad documents caught against good
ones lost is used; where none is certified the rule rejects nothing.

Defined cases: null or empty text has no words and fails the base rule; a
document without label only receives verdicts; several labels of one document
count as good only if all are good; null quality is no label; documents
without a stratum are a stratum of their own; a stratum whose own good
documents certify nothing, and no labels at all, leave the base rule alone. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import ROW, fields, map_batches, map_texts, stored, unpack, whole_row

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
METRICS = fields("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                 "n_lines long, n_bangs long, n_upper long, n_letters long")
#: rule → (score, cutoffs from lenient to strict); a document is rejected when its score is above the cutoff
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [4.0, 2.0, 1.0, 0.5, 0.25, 0.1]),
    "bangs_per_word": ("n_bangs / greatest(n_words, 1)", [2.0, 1.0, 0.5, 0.25, 0.1]),
    "upper_share": ("n_upper / greatest(n_letters, 1)", [0.95, 0.9, 0.8, 0.6, 0.4, 0.3]),
    "duplicate_line_share": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeated_word_share": ("n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40.0, 30.0, 20.0, 15.0, 12.0]),
}


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document inside 3-word windows that occur at least twice
    in it. ``ids`` numbers the words (below 2**21), ``doc`` gives their rows."""
    out = np.zeros(n_docs, np.int64)
    if len(ids) < 3:
        return out
    key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    pos = np.flatnonzero(doc[:-2] == doc[2:])
    order = pos[np.lexsort((key[pos], doc[pos]))]
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = order[twice]
    mark = np.zeros(len(ids), bool)
    for k in range(3):
        mark[start + k] = True
    return np.bincount(doc[mark], minlength=n_docs)


def text_metrics():
    """Counts of a list of whole texts, one array per field of METRICS."""
    limit = 1 << 21

    def work(texts):
        texts = [t or "" for t in texts]
        words = [t.encode().split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        chars = [len(t) - sum(t.count(c) for c in SPACES) for t in texts]
        symbols = [sum(t.count(c) for c in SYMBOLS) for t in texts]
        dup, lines = [], []
        for t in texts:
            own = [x for x in t.split("\n") if x.strip(SPACES)]
            lines.append(len(own))
            dup.append(len(own) - len(set(own)))
        repeat = np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):   # documents together as long as their words are sure to have ids below the limit
            j, total = i + 1, n[i]
            while j < len(texts) and total + n[j] < limit:
                total += n[j]
                j += 1
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for d in words[i:j] for w in d), np.int64, total)
            if len(number) > limit:   # one document with more distinct words than ids can hold
                repeat[i] = _repeated_slow(words[i])
            else:
                repeat[i:j] = repeated_words(ids, np.repeat(np.arange(j - i), n[i:j]), j - i)
            i = j
        upper, letters = [], []
        for t in texts:
            low = t.lower()
            upper.append(_differing(t, low))
            letters.append(_letters(t))
        return n, chars, symbols, dup, repeat, lines, [t.count("!") for t in texts], upper, letters

    return work


def _repeated_slow(words: Sequence[bytes]) -> int:
    seen: dict[tuple, int] = {}
    for w in zip(words, words[1:], words[2:]):
        seen[w] = seen.get(w, 0) + 1
    mark = np.zeros(len(words), bool)
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if seen[w] > 1:
            mark[i:i + 3] = True
    return int(mark.sum())


def _differing(a: str, b: str) -> int:
    """Characters that lower-casing changes (all, should a length change)."""
    if a == b:
        return 0
    if len(a) != len(b):
        return sum(c.isupper() for c in a)
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    return int((x != y).sum())


def _letters(t: str) -> int:
    """ASCII letters and every character beyond ASCII that is no space."""
    x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    low = x | 32
    return int((((low >= 97) & (low <= 122)) | (x > 160)).sum())


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows as struct ``_row`` beside METRICS."""
    return map_texts(docs, F.col(f"`{text}`"), [whole_row(docs)], METRICS, text_metrics)


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound: the largest rate at which k or fewer of n
    still have probability delta."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (lo, hi) or mid >= 1.0:
            break
        lo, hi = (mid, hi) if tail(mid) > delta else (lo, mid)
    return hi


def active(c: dict) -> list[str]:
    """Rules that catch a bad document at all, by their mean catch over the
    cutoffs. Only bad documents have a say, so the good ones stay a holdout."""
    caught = {rule: [c[rule, i, 0] for i in range(len(cuts))] for rule, (_, cuts) in RULES.items()}
    return sorted((r for r in RULES if any(caught[r])), key=lambda r: -sum(caught[r]) / len(caught[r]))


def affordable(good: int, wanted: int, risk: float, level: float) -> int:
    """How many of ``wanted`` rules can share the risk so that ``good``
    documents certify a cutoff that loses none of them."""
    if good < 1:
        return 0
    least = -math.expm1(math.log(level) / good)
    return max((r for r in range(1, wanted + 1) if least <= risk / r), default=0)


def test_level(strata: dict[tuple[int, int], int], risk: float, delta: float) -> float:
    """``delta`` over the least number of tests that covers all that are run
    at that level. ``strata`` counts strata by good documents and active rules."""
    def run(tests: int) -> int:
        return sum(m * affordable(good, wanted, risk, delta / tests) for (good, wanted), m in strata.items())

    lo, hi = 1, max(1, run(1))
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if run(mid) <= mid else (mid + 1, hi)
    return delta / lo


def stratum_cutoffs(c: dict, risk: float, level: float, cost: float = 20.0) -> dict:
    """rule → cutoff (None: the rule rejects nothing) of one stratum.

    ``c``: good, bad and, per (rule, position), good and bad documents above
    the cutoff."""
    out: dict = dict.fromkeys(RULES)
    rules = active(c)
    rules = rules[:affordable(c["good"], len(rules), risk, level)]
    for rule in rules:
        share, value = risk / len(rules), 0.0
        for i, cut in enumerate(RULES[rule][1]):
            lost, caught = c[(rule, i, 1)], c[(rule, i, 0)]
            if lost > share * c["good"] or binomial_upper(lost, c["good"], level) > share:
                break
            gain = caught / max(1, c["bad"]) - cost * lost / max(1, c["good"])
            if gain > value:
                out[rule], value = cut, gain
    return out


def choose_cutoffs(counts: dict[str, dict], risk: float, delta: float, cost: float = 20.0) -> dict:
    """stratum → rule → cutoff; ``counts[stratum]`` as for ``stratum_cutoffs``."""
    level = test_level(Counter((c["good"], len(active(c))) for c in counts.values()), risk, delta)
    return {s: stratum_cutoffs(c, risk, level, cost) for s, c in counts.items()}


def calibrate(measures: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang",
              risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum`` (may be null) and its cutoff per rule, from every labelled
    document; a stratum without certified cutoff has no row.

    Strata are counted and judged in Spark. Only how many strata have how many
    good documents and active rules reaches the driver, to set the level;
    beyond a number of good documents that certifies every rule at any level,
    strata count as one kind."""
    lab = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("quality").alias("_good")))
    judged = (measures.where(~base_failed())
              .select(F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), F.col(f"{ROW}.`{stratum}`").cast("string").alias("stratum"),
                      *[F.expr(e).alias(r) for r, (e, _) in RULES.items()]).join(lab, "doc_id"))
    good = F.col("_good") == 1
    sums = [F.count(F.when((good if g else ~good) & (F.col(r) > c), 1)).alias(f"{r}|{i}|{g}")
            for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts) for g in (0, 1)]
    per = stored(judged.groupBy("stratum").agg(F.count(F.when(good, 1)).alias("good"), F.count(F.when(~good, 1)).alias("bad"), *sums),
                 "quality-strata")
    last = [F.col(f"{r}|{len(cuts) - 1}|0") for r, (_, cuts) in RULES.items()]      # the strictest cutoff catches most
    plenty = math.ceil((50 - math.log(delta)) / -math.log1p(-risk / len(RULES)))     # for up to e**50 tests
    kinds = per.select(F.least("good", F.lit(plenty)).alias("good"),
                       sum((F.when(c > 0, 1).otherwise(0) for c in last), F.lit(0)).alias("wanted")).groupBy("good", "wanted").count()
    level = test_level({(r[0], r[1]): r[2] for r in kinds.collect()}, risk, delta)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                c = {"good": r["good"], "bad": r["bad"]} | {
                    (rule, i, g): r[f"{rule}|{i}|{g}"] for rule, (_, cuts) in RULES.items() for i in range(len(cuts)) for g in (0, 1)}
                cuts = stratum_cutoffs(c, risk, level)
                if any(x is not None for x in cuts.values()):
                    rows.append({"stratum": r["stratum"]} | cuts)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("stratum", pa.string()), *((r, pa.float64()) for r in RULES)]))

    return stored(map_batches(per, run, fields(", ".join(["stratum string", *(f"{r} double" for r in RULES)]))), "quality-cutoffs")


def with_verdict(measures: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds ``kept``: true for documents that pass the base rule and every
    cutoff certified for their own stratum."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    out = measures.join(cuts, F.col(f"{ROW}.`{stratum}`").cast("string").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, (score, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(score) > F.col(f"_{rule}"), F.lit(False))
    return out.select(*measures.columns, (~base_failed() & ~rejected).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
          carry: Sequence[str] | None = None, **params) -> DataFrame:
    """``_row`` (the columns in ``carry``, by default all), METRICS,
    ``base_failed`` and ``kept``. The measured table is stored once."""
    m = measured(docs, text)
    if carry is not None:
        m = m.withColumn(ROW, F.struct(*[F.col(f"{ROW}.`{c}`") for c in dict.fromkeys([*carry, doc_id, stratum])]))
    m = stored(m, "quality")
    cutoffs = calibrate(m, labels, doc_id, stratum, **params)
    return with_verdict(m.withColumn("base_failed", base_failed()), cutoffs, stratum)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query view: one row per document with its counts and verdict."""
    j = judge(docs, labels, carry=["doc_id", "lang"])
    return j.select(F.col(f"{ROW}.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "n_lines", "n_bangs", "n_upper", "n_letters")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
              **params) -> DataFrame:
    """The documents that pass, with the input's columns. Counts are stored
    without the texts for the calibration; the texts are measured again on
    their way out rather than stored a second time."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((doc_id, text, stratum))])
    m = measured(narrow, text).withColumn(ROW, F.struct(*[F.col(f"{ROW}.`{c}`") for c in (doc_id, stratum)]))
    cutoffs = calibrate(stored(m, "quality"), labels, doc_id, stratum, **params)
    return with_verdict(measured(docs, text), cutoffs, stratum).where("kept").select(*unpack(docs, docs.columns))
