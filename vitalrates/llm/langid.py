"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of its hashed byte pairs and
triples (ASCII letters in lower case), square-rooted, over the whole text. A
multinomial model first predicts the language family; within a family, one
linear support vector machine per pair of languages decides by votes, ties by
the sum of margins. Models are fitted by Spark's own learners on a sample of
about ``sample`` labelled rows, the same number per language, drawn by a hash
of the row; the bound keeps training the same size at any scale. Every row is
predicted.

Defined cases: null text and text without a letter are ``und`` with score 0;
rows without language or text, or without id, teach nothing; with no teaching
rows everything is ``und``; with one language everything that has a letter is
that language; equal texts get equal predictions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import fields, map_batches, slices, stored
from vitalrates.llm.words import buffers

#: closely related languages (fixed values); any other language is a family of its own
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
DIMENSIONS = 2048
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def features(texts: pa.Array, dims: int = DIMENSIONS) -> np.ndarray:
    """One row of unit length per text (zero for an empty one)."""
    data, at = buffers(texts)
    x = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros((n, dims), np.float32)
    for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(x) < size:
            continue
        code = x[:len(x) - size + 1].copy()
        for k in range(1, size):
            code = (code << np.uint32(8)) | x[k:len(x) - size + 1 + k]
        code *= np.uint32(factor)
        code >>= np.uint32(32 - int(dims).bit_length() + 1)
        own = of[:len(code)]
        same = own == of[size - 1:]
        out += np.bincount((own * dims + code)[same], minlength=n * dims).reshape(n, dims)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _blocks(batches, text: int, rows: int = 512):
    for b in batches:
        for s in slices(b, text):
            for i in range(0, s.num_rows, rows):
                yield s.slice(i, rows)


def _vectors(df: DataFrame, text: str, label: str) -> DataFrame:
    src = df.select(F.col(f"`{label}`").alias("lang"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        for s in _blocks(batches, 1):
            f = features(s.column(1))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([s.column(0), x], names=["lang", "x"])

    return map_batches(src, run, schema)


def teaching(docs: DataFrame, eligible: Column, key: Column, sample: int, label: str = "lang", text: str = "text") -> DataFrame:
    """About ``sample`` eligible rows, as evenly over the languages as they
    allow, chosen by a hash of ``key``."""
    rows = docs.where(eligible & F.col(f"`{label}`").isNotNull() & has_letter(F.col(f"`{text}`")))
    counts = {r[0]: r[1] for r in rows.groupBy(f"`{label}`").count().orderBy(F.desc("count")).limit(sample).collect()}
    share, left, per = {}, sample, len(counts)
    for lang, n in sorted(counts.items(), key=lambda c: c[1]):     # what a rare language leaves goes to the others
        take = min(n, left // max(1, per))
        share[lang], left, per = take / n, left - take, per - 1
    if not share:
        return rows.limit(0)
    cut = F.create_map(*[x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(int(s * (1 << 30))))])[F.col(f"`{label}`")]
    return rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < cut)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model:
    """Family weights, pair weights; everything numpy, small and bounded."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family(x) for x in self.langs})
        self.top = None          # (dims x families, families)
        self.pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = {}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if self.top is None:
            fam, sure = np.zeros(n, int), np.ones(n)
        else:
            z = x @ self.top[0] + self.top[1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            fam, sure = z.argmax(axis=1), z.max(axis=1)
        best = np.zeros(n, int)
        for f, name in enumerate(self.families):
            own = [i for i, x_ in enumerate(self.langs) if family(x_) == name]
            at = np.flatnonzero(fam == f)
            votes, margin = np.zeros((len(at), len(self.langs))), np.zeros((len(at), len(self.langs)))
            for a, b, w, c in self.pairs.get(name, []):
                m = x[at] @ w + c                  # above 0: b
                votes[:, b] += m > 0
                votes[:, a] += m <= 0
                margin[:, b] += m
                margin[:, a] -= m
            rank = votes + 0.25 * np.tanh(margin / max(1, len(own)))
            best[at] = np.array(own)[rank[:, own].argmax(axis=1)]
            if len(own) > 1:
                won = margin[np.arange(len(at)), best[at]] / (len(own) - 1)
                sure[at] *= 1 / (1 + np.exp(-2 * np.clip(won, -20, 20)))
        return [self.langs[i] for i in best], np.clip(sure, 0.0, 1.0)


def fit(taught: DataFrame, max_iter: int = 15, reg: float = 1e-4, text: str = "text", label: str = "lang") -> Model | None:
    """Fit the hierarchy on the (bounded) teaching rows; None without any."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector
    rows = stored(_vectors(taught, text, label), "langid")
    langs = [r[0] for r in rows.select("lang").distinct().collect()]
    if not langs:
        return None
    model = Model(langs)
    fam = F.create_map(*[v for x in model.langs for v in (F.lit(x), F.lit(float(model.families.index(family(x)))))])
    num = F.create_map(*[v for i, x in enumerate(model.langs) for v in (F.lit(x), F.lit(i))])
    data = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), fam[F.col("lang")].alias("family"),
                       num[F.col("lang")].alias("lang"))
    if len(model.families) > 1:
        lr = LogisticRegression(featuresCol="features", labelCol="family", family="multinomial", maxIter=max_iter,
                                regParam=reg, standardization=False).fit(data)
        model.top = (lr.coefficientMatrix.toArray().T.astype(np.float32), lr.interceptVector.toArray())
    for name in model.families:
        own = [i for i, x in enumerate(model.langs) if family(x) == name]
        for a, b in combinations(own, 2):
            two = data.where(F.col("lang").isin(a, b)).select("features", (F.col("lang") == b).cast("double").alias("label"))
            svc = LinearSVC(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg, standardization=False).fit(two)
            model.pairs.setdefault(name, []).append((a, b, svc.coefficients.toArray().astype(np.float32), svc.intercept))
    return model


def predicted(docs: DataFrame, model: Model | None, keep: list[Column], text: str = "text") -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` of every row."""
    src = docs.select(*keep, has_letter(F.col(f"`{text}`")).alias("_letter"), F.col(f"`{text}`").alias("_text"))
    k = len(src.columns) - 2
    schema = T.StructType(src.schema.fields[:k] + fields("lang_pred string, score double").fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)      # bounded by languages and dimensions

    def run(batches):
        m = shared.value
        for s in _blocks(batches, k + 1):
            letter = s.column(k).to_numpy(zero_copy_only=False)
            if m is None:
                lang, score = [UNKNOWN] * s.num_rows, np.zeros(s.num_rows)
            else:
                lang, score = m.predict(features(s.column(k + 1)))
                lang = [x if ok else UNKNOWN for x, ok in zip(lang, letter, strict=True)]
                score = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*s.columns[:k], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=schema.names)

    return map_batches(src, run, schema)


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Query view: learn from the rows not held out, predict every row."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = fit(teaching(docs, ~held & F.col("doc_id").isNotNull(), F.col("doc_id"), sample))
    return predicted(docs, model, [F.col("doc_id"), held.alias("held_out")])
