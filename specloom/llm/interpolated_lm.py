"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed; the weights depend on how
often the context was seen (a bucket a power of two) and are learned by
expectation-maximisation on counts of a part of the training texts, the deleted
part, against estimates from the rest.  Scores use the counts of both.

Texts are packed into blocks once.  A block sends the sorted hashes of its
distinct n-grams, cut by range, to where they are added up, and gets back the
counts in the same order; no token ever travels by itself, an n-gram is one
entry a block however frequent it is, and no table of counts is ever whole in
one place.  With the counts of its n-grams a block works out its own share of
the held-out counts, and later the scores of its texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, table, written
from .shingles import WordHashes, mixed

#: Fixed values of the contract: folds of crc32(doc_id) and the fold that is scored only.
FOLDS, HELD_FOLD = 7, 2
#: Training fold whose counts the weights are learned on.
DELETED_FOLD = 3
KEPT, DELETED, HELD = 0, 1, 2
#: Bytes of text of a block, and bytes of text a range of hashes is to hold the n-grams of.
BLOCK_BYTES = 10 << 20
RANGE_BYTES = 32 << 20
#: Rounds of expectation-maximisation at most, and the gain in log-likelihood a token that ends them.
ROUNDS, LEAST_GAIN = 20, 1e-5

_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_LEVELS = 64

_BLOCK = "fold int, n_bytes long, payload binary"
_GRAMS = "grams int, range int, block long, fold int, hashes binary, n binary"
_TOTALS = "grams int, range int, block long, kept binary, total binary, tokens long, kept_tokens long, types long"


def _squeeze(x: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart so that small ones compress to little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _expand(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of doc_id and text, a fold each, as compressed Arrow streams."""
    held: dict[int, list] = {f: [0] for f in (KEPT, DELETED, HELD)}

    def block(fold: int) -> pa.RecordBatch:
        n, *parts = held[fold]
        held[fold] = [0]
        sink = io.BytesIO()
        whole = pa.Table.from_batches(parts).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([n], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["fold", "n_bytes", "payload"])

    for b in batches:
        folds = b.column("fold").to_numpy()
        for fold in held:
            own = b.filter(pa.array(folds == fold)).select(["doc_id", "text"])
            sizes = np.cumsum(pc.binary_length(own.column("text")).to_numpy(zero_copy_only=False) + 8)
            at = 0
            while at < own.num_rows:
                base = sizes[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES - held[fold][0], "right")))
                held[fold].append(own.slice(at, upto - at))
                held[fold][0] += int(sizes[upto - 1] - base)
                at = upto
                if at < own.num_rows or held[fold][0] >= BLOCK_BYTES:
                    yield block(fold)
    for fold in held:
        if len(held[fold]) > 1:
            yield block(fold)


class _Text:
    """A block's tokens: of every order the hashes of its n-grams, their distinct ones and where each is."""

    def __init__(self, payload: bytes, order: int):
        t = pa.ipc.open_stream(payload).read_all()
        self.ids = t.column("doc_id")
        words = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in t.column("text").to_pylist()]
        pads = order - 1
        n = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(n + pads + 1)  # a text: pads, words, an end
        self.first = ends - n - 1  # of each text's tokens
        seq = np.full(int(ends[-1]) if len(ends) else 0, _START, np.uint64)
        self.is_token = np.ones(len(seq), bool)
        for k in range(1, pads + 1):
            self.is_token[self.first - k] = False
        inner = self.is_token.copy()
        inner[ends - 1] = False
        seen = WordHashes()
        seq[inner] = np.fromiter((seen[w] for ws in words for w in ws), np.uint64, int(n.sum()))
        seq[ends - 1] = _END
        del words
        self.n_tokens = n + 1
        # an n-gram ends at each token; where a context can end, before the first one too
        self.at, self.types, self.type_of = [], [], []
        gram = seq
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros_like(seq)
                longer[1:] = mixed(gram[:-1] * _FACTOR + seq[1:] + np.uint64(k))
                gram = longer
            where = self.is_token.copy()
            if k < order:
                where[self.first - 1] = True
            types, of = np.unique(gram[where], return_inverse=True)
            place = np.full(len(seq), -1, np.int32)
            place[where] = of
            self.types.append(types)
            self.type_of.append(place)

    def counted(self, k: int) -> np.ndarray:
        return np.bincount(self.type_of[k][self.type_of[k] >= 0], minlength=len(self.types[k]))


def _grams(order: int, bits: int):
    """Of each block the distinct n-grams of every order, cut by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        for b in batches:
            for block, fold, payload in zip(b.column("block").to_pylist(), b.column("fold").to_pylist(), b.column("payload"), strict=True):
                text = _Text(payload.as_py(), order)
                for k in range(order):
                    types, n = text.types[k], text.counted(k)
                    edges = [0, *np.searchsorted(types, cuts).tolist(), len(types)]
                    rows = [(r, i, j) for r, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(rows), pa.int32()), pa.array([r for r, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([fold] * len(rows), pa.int32()),
                            pa.array([_squeeze(np.diff(types[i:j], prepend=np.uint64(0))) for _, i, j in rows], pa.binary()), pa.array([_squeeze(n[i:j]) for _, i, j in rows], pa.binary()),
                        ],
                        names=["grams", "range", "block", "fold", "hashes", "n"],
                    )

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """Counts of one range, for each block in the order of its own hashes; a row without a block has the sums of single words."""
    grams, ranges, folds = rows.column("grams")[0].as_py(), rows.column("range")[0].as_py(), rows.column("fold").to_pylist()
    hashes = [np.cumsum(_expand(h.as_py()), dtype=np.uint64) for h in rows.column("hashes")]
    every = np.unique(np.concatenate(hashes))
    kept, total = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    places = [np.searchsorted(every, h) for h in hashes]
    for place, fold, n in zip(places, folds, rows.column("n"), strict=True):
        if fold != HELD:  # a block has a hash once
            total[place] += _expand(n.as_py()).astype(np.int64)
            if fold == KEPT:
                kept[place] += _expand(n.as_py()).astype(np.int64)
    blocks = rows.column("block").to_pylist()
    sums = [0, 0, 0]
    if grams == 0:
        real = every != _START
        sums = [int(total[real].sum()), int(kept[real].sum()), int((total[real] > 0).sum())]
    m = len(blocks)
    return pa.table(
        {
            "grams": pa.array([grams] * (m + 1), pa.int32()), "range": pa.array([ranges] * (m + 1), pa.int32()), "block": pa.array([*blocks, None], pa.int64()),
            "kept": pa.array([*(_squeeze(kept[p]) if f == DELETED else None for p, f in zip(places, folds, strict=True)), None], pa.binary()), "total": pa.array([*(_squeeze(total[p]) for p in places), None], pa.binary()),
            "tokens": pa.array([None] * m + sums[:1], pa.int64()), "kept_tokens": pa.array([None] * m + sums[1:2], pa.int64()), "types": pa.array([None] * m + sums[2:], pa.int64()),
        }
    )


def _counts(text: _Text, totals: pa.Table, column: str) -> list[np.ndarray]:
    """Counts of the block's n-grams by order, as they came back by range."""
    totals = totals.sort_by([("grams", "ascending"), ("range", "ascending")])
    of, parts = totals.column("grams").to_pylist(), totals.column(column)
    out = [np.concatenate([_expand(p.as_py()) for p, g in zip(parts, of, strict=True) if g == k]).astype(np.int64) for k in range(len(text.types))]
    if any(len(a) != len(b) for a, b in zip(out, text.types, strict=True)):
        raise RuntimeError("counts of a block are incomplete")
    return out


def _estimates(text: _Text, counts: list[np.ndarray], n_tokens: int, types: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the context, and the estimate of each order, of the tokens at ``at``.

    The bucket is the longest context that was seen and the power of two of its count.
    """
    bucket, f = np.zeros(len(at), np.int64), np.zeros((len(counts), len(at)))
    for k, c in enumerate(counts):
        seen = np.full(len(at), n_tokens) if k == 0 else counts[k - 1][text.type_of[k - 1][at - 1]]
        own = c[text.type_of[k][at]]
        np.divide(own, seen, out=f[k], where=seen > 0)
        has = seen > 0
        bucket[has] = (k + 1) * _LEVELS + np.log2(seen[has]).astype(np.int64)
    return bucket, f


def _held_out(order: int, kept_tokens: int):
    """Of a deleted block the rows bucket, f1, f2, ..., n, alike ones added up."""

    def run(text: pa.Table, totals: pa.Table) -> pa.Table:
        t = _Text(text.column("payload")[0].as_py(), order)
        longest = t.type_of[-1]
        at = np.flatnonzero(t.is_token)
        types, first, n = np.unique(longest[at], return_index=True, return_counts=True)
        bucket, f = _estimates(t, _counts(t, totals, "kept"), kept_tokens, types, at[first])
        rows = pa.table({"bucket": bucket.astype(np.int32)} | {f"f{k + 1}": x for k, x in enumerate(f)} | {"n": n.astype(np.int64)})
        done = rows.group_by([c for c in rows.column_names if c != "n"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        return done.select(rows.column_names)

    return run


def _nearest(weights: dict[int, list[float]], order: int) -> np.ndarray:
    """Weights by bucket; a bucket without held-out counts has those of the nearest one with the same context, else equal ones."""
    out = np.zeros(((order + 1) * _LEVELS, order + 1))
    for b in range(len(out)):
        j = b // _LEVELS
        same = [x for x in weights if x // _LEVELS == j]
        out[b] = weights[min(same, key=lambda x: (abs(x - b), x))] if same else [1 / (j + 1)] * (j + 1) + [0] * (order - j)
    return out


def learn_weights(held_out: DataFrame, order: int, n_types: int, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> dict[int, list[float]]:
    """Mixture weights by bucket (of the uniform estimate first), from rows bucket, f1, f2, ..., n.

    Each round is one aggregation over the table to a row a bucket, of which
    there are at most 64 an order.
    """
    f = [F.lit(1.0 / (n_types + 1)), *[F.col(f"f{k + 1}") for k in range(order)]]
    seen = [r["bucket"] for r in held_out.select("bucket").distinct().collect()]
    weights = {b: [1 / (b // _LEVELS + 1)] * (b // _LEVELS + 1) + [0.0] * (order - b // _LEVELS) for b in seen}
    before = None
    for _ in range(rounds if seen else 0):
        every = _nearest(weights, order)
        parts = [F.get(F.array(*[F.lit(float(x)) for x in every[:, k]]), F.col("bucket")) * f[k] for k in range(order + 1)]
        p = sum(parts[1:], parts[0])
        rows = held_out.select("bucket", "n", p.alias("p"), *[x.alias(f"part{k}") for k, x in enumerate(parts)])
        sums = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("log"), *[F.sum(F.col("n") * F.col(f"part{k}") / F.col("p")).alias(f"sum{k}") for k in range(order + 1)]).collect()
        for r in sums:
            j = r["bucket"] // _LEVELS
            # one count more, spread evenly, so that no weight in use is ever nothing
            weights[r["bucket"]] = [(r[f"sum{k}"] + 1 / (j + 1)) / (r["n"] + 1) if k <= j else 0.0 for k in range(order + 1)]
        gain = sum(r["log"] for r in sums) / sum(r["n"] for r in sums)
        if before is not None and gain - before < least_gain:
            break
        before = gain
    return weights


def _scores(order: int, tokens: int, n_types: int, weights: np.ndarray):
    def run(text: pa.Table, totals: pa.Table) -> pa.Table:
        t = _Text(text.column("payload")[0].as_py(), order)
        counts = _counts(t, totals, "total")
        at = np.flatnonzero(t.is_token)
        # an n-gram of the highest order has one estimate wherever it stands
        types, first, of = np.unique(t.type_of[-1][at], return_index=True, return_inverse=True)
        bucket, f = _estimates(t, counts, tokens, types, at[first])
        p = weights[bucket, 0] / (n_types + 1)
        for k in range(order):
            p += weights[bucket, k + 1] * f[k]
        c = counts[0][t.type_of[0][at]]
        starts = np.cumsum(t.n_tokens) - t.n_tokens
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  a text has at least its end
        return pa.table(
            {
                "doc_id": t.ids, "held_out": pa.array([text.column("fold")[0].as_py() == HELD] * len(t.ids)), "n_tokens": t.n_tokens, "n_known": add((c > 0).astype(np.int64)),
                "train_tokens": np.full(len(t.ids), tokens, np.int64), "base_score": add(np.log10((c + 1) / (tokens + n_types + 1))), "score": add(np.log10(p)[of]),
            }
        )

    return run


def score_documents(docs: DataFrame, order: int = 2, held_fold: int = HELD_FOLD, deleted_fold: int = DELETED_FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    Trained on whole texts whose crc32(doc_id as text) mod 7 is not
    ``held_fold``.  A text's tokens are its words, A-Z in lower case, and an
    end; ``score`` is the log10 probability of them all, ``base_score`` that of
    single words with one added.  Words and n-grams are told apart by 64-bit
    hashes.  A null text counts as empty: its end alone is scored; a null
    doc_id falls in the fold of an empty string; repeated rows are trained on
    and scored each; without training texts every token has probability 1;
    other columns play no part; an empty table gives no rows.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    kind = F.when(fold == held_fold, HELD).when(fold == deleted_fold, DELETED).otherwise(KEPT).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), kind.alias("fold"))
    kinds = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = written(rows.mapInArrow(_pack, _BLOCK).withColumn("block", F.monotonically_increasing_id()))
    n_bytes = texts.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n_bytes / RANGE_BYTES)))))
    grams = texts.mapInArrow(_grams(order, bits), _GRAMS)
    totals = written(grams.groupBy("grams", "range").applyInArrow(_add_up, _TOTALS))
    tokens, kept_tokens, types = (x or 0 for x in totals.filter("block IS NULL").agg(F.sum("tokens"), F.sum("kept_tokens"), F.sum("types")).first())
    back = totals.filter("block IS NOT NULL")
    estimates = ", ".join(f"f{k + 1} double" for k in range(order))
    deleted = texts.filter(F.col("fold") == DELETED).groupBy("block").cogroup(back.filter("kept IS NOT NULL").groupBy("block"))
    held_out = written(deleted.applyInArrow(_held_out(order, kept_tokens), f"bucket int, {estimates}, n long"))
    weights = _nearest(learn_weights(held_out, order, types), order)
    drop_table(held_out)
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scores(order, tokens, types, weights), kinds)


def op12_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
