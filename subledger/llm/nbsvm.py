"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of its byte trigrams, of its words and of how
far its n-grams repeat, hashed into two halves of ``2^BITS`` buckets.  Log-count
ratios of the classes, from the counts of *all* labelled training documents
(summed in Spark), scale the indicators; rows are divided by their length (with
a floor for short texts), and a linear model with hinge loss is fitted by dual
coordinate descent.  A logistic curve maps margins to scores.

Labels enter only for documents with ``crc32(doc_id) mod 4 <> 2``: remainders 0
and 1 give counts and fit, remainder 3 the curve, remainder 2 is held out.

Bounds: the descent sees at most ``FIT_ROWS`` labelled documents per class and
the curve ``CURVE_ROWS`` in all (those of least hash), so fit and driver memory
do not grow with the corpus.  The model is two vectors of ``2^BITS`` doubles
(4 MB), which is what is broadcast.  Counts and scores cover every document.

Defined results: null and empty texts are scored by the intercept; without
labels every score is 0.5, with one class the smoothed share of label 1; of
several labels for one id the lowest counts; a null id has no label and is not
held out; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LOWER, SPACED, mix, pieces, sequence_hash, word_hashes, words
from .common import map_arrow, named, stage, table

BITS = 18
FIT_ROWS, CURVE_ROWS = 4000, 8000
THRESHOLD = 0.7
SMOOTH, COST, EPOCHS, FLOOR = 1.0, 1.0, 12, 0.5


def row_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, feature), each feature once a row, sorted by row."""
    half = np.uint64(1 << (BITS - 1))
    for i, j, data, offsets in pieces(texts):
        keys = []
        if len(data) >= 3:
            tri = (data[:-2].astype(np.uint64) << np.uint64(16)) | (data[1:-1].astype(np.uint64) << np.uint64(8)) | data[2:]
            row = np.repeat(np.arange(j - i), np.diff(offsets))
            inside = row[:-2] == row[2:]
            keys.append((row[:-2][inside] << BITS) + (mix(tri[inside]) % half).astype(np.int64))
        row, start, end = words(LOWER[data], offsets, SPACED)
        if len(start):
            h = word_hashes(LOWER[data], start, end)
            keys.append((row << BITS) + (half + h % half).astype(np.int64))
            keys.append(_repeat_features(row, h, j - i))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        yield i, j, key >> BITS, key & ((1 << BITS) - 1)


def _repeat_features(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Keys of indicators of repeated n-grams: how large a share of a text's words repeats the last
    word, and of its word trigrams an earlier one, in steps."""
    n = np.bincount(row, minlength=rows)
    out = []
    for kind, width in ((0, 1), (1, 3)):
        if kind == 0:
            again = row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]
        else:
            inside = row[width - 1 :] == row[: len(row) - width + 1]
            # (row, hash) in one sortable value; 40 bits of hash tell the trigrams of a text apart
            key = np.sort((row[: len(inside)][inside].astype(np.uint64) << np.uint64(40)) | (sequence_hash(h, width)[inside] >> np.uint64(24)))
            again = (key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)
        share = np.bincount(again, minlength=rows) / np.maximum(n, 1)
        step = np.searchsorted([1e-9, 0.02, 0.1, 0.3, 0.6], share, "right")
        at = np.flatnonzero((n >= 8) & (step > 0))
        tag = mix((step[at] + 8 * kind + 1).astype(np.uint64)) % np.uint64(1 << (BITS - 1))
        out.append((at << BITS) + (1 << (BITS - 1)) + tag.astype(np.int64))
    return np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents of label 0, of label 1) of a task; columns: label, text."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        label = np.asarray(batch.column(0))
        for i, _, row, feature in row_features(batch.column(1)):
            for c in (0, 1):
                counts[c] += np.bincount(feature[label[i + row] == c], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "n0", "n1"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features) per document; columns: label, text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, j, row, feature in row_features(part.column(1)):
                offsets = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.record_batch([part.column(0).slice(i, j - i), lists], names=["label", "features"])


class Model:
    def __init__(self, ratio: np.ndarray, weight: np.ndarray, intercept: float, slope: float, offset: float, floor: float = 0.0):
        self.ratio2, self.product, self.floor = ratio * ratio, ratio * weight, floor
        self.intercept, self.slope, self.offset = intercept, slope, offset

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, row, feature in row_features(texts):
            dot = np.bincount(row, self.product[feature], minlength=j - i)
            norm = np.sqrt(np.bincount(row, self.ratio2[feature], minlength=j - i) + self.floor)
            out[i:j] = dot / np.where(norm > 0, norm, 1.0)
        return out + self.intercept

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights (for scaled indicators over their length) and intercept of the hinge-loss model."""
    weight, intercept = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for r in rows:
        x = ratio[r]
        n = np.sqrt(x @ x + floor)
        values.append((x / n if n > 0 else x).astype(np.float32))
    square = np.array([float(v @ v) + 1 for v in values])  # the intercept is one more feature of value 1
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], values[i]
            gradient = y[i] * (weight[r] @ x + intercept) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weight[r] += step * x
                intercept += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, intercept


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps on Platt's smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 1e-3 * a * a

    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        d, q = p - target, p * (1 - p)
        g = np.array([d @ margin + 2e-3 * a, d.sum()])
        h = np.array([[q @ margin**2 + 2e-3, q @ margin], [q @ margin, q.sum() + 1e-9]])
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > now:
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        before, now = now, loss(a, b)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return float(a), float(b)


def remainder(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents of remainders 0, 1 and 3."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    marks = marks.withColumn("part", remainder(F.col("doc_id"))).filter("part <> 2").withColumn("order", F.xxhash64(F.lit(11), "doc_id"))
    # texts are shuffled alike at every size, and never sorted: the labels' side is hashed
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marks.hint("shuffle_hash"), "doc_id")
    known = stage(known, "nbsvm-labelled")
    fit = known.filter("part < 2").select("label", "text")
    counts = map_arrow(fit, _count, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # Arrow tables: rows as Python objects would take the driver ten times the memory
    c = counts.toArrow()  # at most 2^BITS rows
    n = np.zeros((2, 1 << BITS))
    at = c["feature"].to_numpy()
    n[0, at], n[1, at] = c["n0"].to_numpy(), c["n1"].to_numpy()
    # smoothing in proportion to the classes' totals: a feature never seen speaks for neither
    total = np.maximum(n.sum(axis=1, keepdims=True), 1)
    share = (n + 2 * SMOOTH * total / total.sum()) / total
    ratio = np.log(share[1] / share[0])

    def least(df: DataFrame, rows: int) -> DataFrame:
        ids = df.select("doc_id", "order").distinct().orderBy("order", "doc_id").limit(rows).select("doc_id")
        return df.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("label", "text")

    classes = [least(known.filter(f"part < 2 and label = {v}"), FIT_ROWS) for v in (0, 1)]
    got = map_arrow(classes[0].unionByName(classes[1]), _vectors, "label int, features array<int>").toArrow().combine_chunks()
    y = got["label"].to_numpy()
    if len(set(y)) < 2:
        share1 = (y.sum() + 1) / (len(y) + 2)
        return Model(ratio * 0, ratio * 0, 0.0, 0.0, float(np.log(share1 / (1 - share1))))
    # rows in an order of their own content, so that the fit does not depend on partitions
    rows = [part[i].values.to_numpy() for part in got["features"].chunks for i in range(len(part))]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), zlib.crc32(rows[i]), y[i]))
    rows, y = [rows[i] for i in order], y[order]
    per_class = {v: len(y) / (2 * max(1, (y == v).sum())) for v in (0, 1)}
    # a floor under the squared length keeps a few words of a short text from counting as much as a long one
    floor = FLOOR * float(np.median([ratio[r] @ ratio[r] for r in rows]))
    weight, intercept = dual_descent(rows, np.where(y == 1, 1.0, -1.0), ratio, COST * np.where(y == 1, per_class[1], per_class[0]), floor=floor)
    plain = Model(ratio, weight, intercept, 1.0, 0.0, floor)
    curve = score_texts(least(known.filter("part = 3"), CURVE_ROWS), plain, margin=True).toArrow().sort_by([("score", "ascending"), ("label", "ascending")])
    if len(set(curve["label"].to_pylist())) < 2:
        return plain
    plain.slope, plain.offset = logistic_curve(curve["score"].to_numpy(), curve["label"].to_numpy())
    return plain


def score_texts(rows: DataFrame, model: Model, margin: bool = False, keep_text: bool = False) -> DataFrame:
    """``rows`` with ``text`` replaced by ``score`` (or followed by it)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            s = m.margins(texts) if margin else m.scores(texts)
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(s)], names=[*(f.name for f in kept), "score"])

    return map_arrow(rows, run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, F.col("text").cast("string").alias("text"))
    return score_texts(rows, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of score ``threshold`` or more, with all their columns."""
    rest = F.struct(*named(docs, "text")).alias("row")
    rows = docs.select(rest, F.col("text").cast("string").alias("text"))
    good = score_texts(rows, train(docs, labels), keep_text=True).filter(F.col("score") >= threshold)
    return good.select("row.*", "text").select(named(docs))


def op4_nbsvm_quality(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
