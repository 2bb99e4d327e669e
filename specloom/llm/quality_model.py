"""A linear quality classifier: naive Bayes log-count ratios, hinge loss.

A text's features are indicators of hashed n-grams: words, word pairs, and
runs of one to three word shapes (capitals, letters, digits and punctuation, a
repeat of the word before).  An indicator counts by the log ratio of its rates
in the two classes, from counts over all labelled rows; a linear hinge-loss
model over those scaled indicators is fitted by dual coordinate descent on a
bounded sample of labelled rows and applied to every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .shingles import mixed

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Buckets whose counts travel as one row.
BLOCK = 256
#: Bounds of the sample that the model is fitted on: rows, and features of all rows together.
SAMPLE_ROWS = 12_000
SAMPLE_FEATURES = 16_000_000
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9")]
_PUNCT = re.compile(rb"([^Aa9])\1+")


def _shape(word: bytes) -> bytes:
    """``Word,`` to ``Aa,``; ``12%%%`` to ``9%+``."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return _PUNCT.sub(rb"\1+", word)


class _Words(dict):
    """Hash of the lower-cased word and of its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        x = self[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(_shape(word), 7))
        return x


def features(text: str | None, seen: _Words) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64)
    both = np.array(list(map(seen.__getitem__, words)), np.uint64)
    w, s = both[:, 0], both[:, 1].copy()
    s[1:][w[1:] == w[:-1]] ^= _SALT[4]
    grams = [w * _SALT[0]]
    for n, salt in ((1, _SALT[1]), (2, _SALT[2]), (3, _SALT[3])):
        if len(s) >= n:
            h = np.full(len(s) - n + 1, n, np.uint64)
            for i in range(n):
                h = mixed(h * salt + s[i : len(s) - n + 1 + i])
            grams.append(h)
    if len(w) > 1:
        grams.append(mixed(w[:-1] * _SALT[3] + w[1:]))
    return np.unique(mixed(np.concatenate(grams)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def log_ratios(labelled: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bucket, from all rows of ``labelled`` (text, label 0 or 1).

    Tasks count buckets in arrays of fixed size, which travel in blocks and are
    summed block by block as they arrive; what reaches the driver is one such
    array a class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = _Words(), np.zeros((2, BUCKETS), "<u4")
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                total[label, features(text, seen)] += 1
        blocks = total.reshape(2, -1, BLOCK).swapaxes(0, 1)
        used = np.flatnonzero(blocks.any((1, 2)))
        # low bytes first, then the high ones, which are mostly zero and compress away
        n = [blocks[i].reshape(-1, 1).view(np.uint8).T.tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n, pa.binary())], names=["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # BUCKETS / BLOCK keys at most
        for b in batches:
            for block, n in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
                planes = np.frombuffer(n, np.uint8).reshape(4, -1)
                sums[block] = sums.get(block, 0) + planes.T.copy().view("<u4").ravel().astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "n"])

    counts = labelled.select("text", "label").mapInArrow(count, "block long, n binary").repartition("block").mapInArrow(add, "block long, n binary")
    n = np.zeros((2, BUCKETS))
    rows = counts.toPandas()
    for block, v in zip(rows["block"], rows["n"], strict=True):
        n[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(v, "<i8").reshape(2, -1)
    p = n + alpha
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def dual_coordinate_descent(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 1, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over indicators scaled by ``r``.

    ``y`` is -1 or 1.  One dual variable a row, each optimised in turn in random
    order, so that the weights are always the sum of rows times them.  Rows are
    scaled to unit length; errors of the rarer class cost more, by how rare it is.
    """
    w, bias = np.zeros(len(r)), 0.0
    # a row's scaled indicators are looked up again in each step, so that the sample is held once
    ones = np.array([1 / np.sqrt((r[i] ** 2).sum() + 1) for i in x])
    upper = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    alpha, rng = np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            scaled = r[x[i]] * ones[i]
            g = y[i] * (w[x[i]] @ scaled + bias * ones[i]) - 1
            a = min(max(alpha[i] - g, 0.0), upper[i])  # rows have unit length
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[x[i]] += step * scaled
                bias += step * ones[i]
                most = max(most, abs(a - alpha[i]))
                alpha[i] = a
        if most < tolerance:
            break
    return w, bias


def _margin(x: np.ndarray, r: np.ndarray, w: np.ndarray, bias: float) -> float:
    """Decision value of a text: of its unit row."""
    v = r[x]
    norm = np.sqrt((v**2).sum() + 1)
    return float((w[x] @ v + bias) / norm)


def _sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset that turn margins into rates of label 1 (logistic, Newton steps)."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class QualityModel:
    """What ``fit`` learns: ratios, weights, bias and the logistic map of margins."""

    def __init__(self, r: np.ndarray, w: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.r, self.bias, self.a, self.b = w.astype(np.float32), r.astype(np.float32), bias, a, b

    def score(self, text: str | None, seen: _Words) -> float:
        m = _margin(features(text, seen), self.r, self.weight, self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 1, sample_features: int = SAMPLE_FEATURES) -> QualityModel:
    """Fit on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) marks 0 or 1.

    A document with both labels counts as 0; null ids and other labels are left
    out.  Counts cover every labelled row.  The hinge loss is fitted on at most
    ``sample_rows`` rows, those of the smallest hash of their text, half of
    them at most from each class, repeated rows once, and of each class as many
    of those as have ``sample_features / 2`` features, whole texts (the last
    one may go over it); with no rows, or one
    class only, every score is that class's share (0.5 without rows).

    Texts are shuffled once, to meet their labels for the counts.  The sample
    is chosen from hashes; its ids, of bounded number, go to the texts.
    """
    labels = labels.filter("label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one plan at every size: labels grow with the input, so they are never broadcast
    r = log_ratios(docs.join(labels.hint("merge"), "doc_id"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            x = [features(t, seen).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("at"), pa.array([len(v) // 4 for v in x], pa.int64()), pa.array(x, pa.binary())], names=["label", "at", "n", "x"])

    at = F.xxhash64(F.lit(seed), "text").alias("at")
    keyed = docs.select("doc_id", at).join(labels, "doc_id").distinct()
    picks = [keyed.filter(F.col("label") == c).orderBy("at", "doc_id").limit(sample_rows // 2) for c in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    # at most sample_rows rows of three numbers
    sample = docs.withColumn("at", F.xxhash64(F.lit(seed), "text")).join(F.broadcast(chosen), ["doc_id", "at"]).dropDuplicates(["doc_id", "at"])
    drawn = written(sample.select("label", "at", "text").mapInArrow(take, "label int, at long, n long, x binary"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # of at most sample_rows numbers
    last = drawn.select("label", "at", before.alias("before")).filter(F.col("before") < sample_features // 2).groupBy("label").agg(F.max("at").alias("last"))
    bounded = drawn.join(F.broadcast(last), "label").filter(F.col("at") <= F.col("last"))  # two rows
    rows = bounded.select("label", "at", "x").toPandas().sort_values(["at", "label"], kind="stable")
    y = np.where(rows["label"].to_numpy() == 1, 1, -1)
    x = [np.frombuffer(v, "<i4") for v in rows["x"]]
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else float(y[0] > 0)
        return QualityModel(r, np.zeros(BUCKETS), 0.0, 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    # margins for the logistic map are those of rows the weights did not see
    fold = np.arange(len(y)) % 3 == 0
    part = np.flatnonzero(~fold)
    w, bias = dual_coordinate_descent([x[i] for i in part], y[part], r)
    a, b = _sigmoid_fit(np.array([_margin(x[i], r, w, bias) for i in np.flatnonzero(fold)]), y[fold])
    w, bias = dual_coordinate_descent(x, y, r)
    return QualityModel(r, w, bias, a, b)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text).

    Null texts count as empty, and those have the score of no features; null
    doc_ids and repeated rows are scored each; other columns are ignored; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # arrays of BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = _Words(), shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(t, seen) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows never learned from: CRC-32 of the id as text is a multiple of 5 (null ids count as empty)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scores = score_documents(docs, fit(docs, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
