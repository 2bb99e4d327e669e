"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. A signature of one-byte minima per document, ``bands * rows`` and ``more``.  Documents
   with equal shingle sets become one node, named by its smallest doc_id.
2. Bands name buckets.  Only buckets with two nodes go on.
3. Candidates of a bucket are taken in rounds, so that a bucket with thousands
   of near copies does not give all its pairs: first each node with the
   bucket's smallest node, then nodes outside the bucket's main component with
   a few nodes of it, and last, inside tasks, the nodes that are still outside
   with all nodes of the bucket in other components.  A pair inside one
   component could not change it.
4. A candidate's signatures are compared batch by batch; it is dropped when,
   after a batch, the posterior probability of a similarity at the threshold or
   above falls below the miss probability.  Survivors are verified on their
   full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_name, drop_table, key_runs, table, written
from .graph import connected_components
from .shingles import WordHashes, mixed, shingle_set


@dataclass(frozen=True)
class MinHash:
    """Parameters.  A pair at the threshold shares no bucket with probability
    ``(1 - threshold ** rows) ** bands``, 2e-5 for the defaults."""

    rows: int = 6
    bands: int = 54
    #: Bytes beside those of the bands, for the comparison only.
    more: int = 324
    percent: int = 75
    width: int = 5
    batch: int = 36
    miss: float = 1e-6
    block: int = 1024
    seed: int = 1

    @property
    def size(self) -> int:
        return self.rows * self.bands + self.more


def _coefficients(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    return r.integers(1, 1 << 32, p.size, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, p.size, np.uint32)


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    h = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(low, (h[i : i + 512, None] * a + b).min(axis=0), out=low)
    # a minimum's own leading bits are nearly all zero: one byte of a product
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits of the shingle set), sig; null sig for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (a, b) = WordHashes(), _coefficients(p)
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, seen, p.width)
                x = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((x >> 64) - (1 << 63))
                h2.append((x & ((1 << 64) - 1)) - (1 << 63))
                sig.append(_signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def least_matches(p: MinHash) -> list[int]:
    """For each batch, the fewest agreeing bytes with which a pair stays.

    Uniform prior over the similarity s; a byte agrees with probability
    s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    q = s + (1 - s) / 256
    out = []
    for n in range(p.batch, p.size + 1, p.batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(q) + (n - m) * np.log1p(-q)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        tail = like[:, s >= p.percent / 100].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= p.miss)))
    return out


def _sequential(pairs: DataFrame, p: MinHash) -> DataFrame:
    """Candidates (u, v, su, sv) that survive the comparison of all batches, with the share of agreeing bytes."""
    least = least_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, p.size) for k in ("su", "sv"))
            alive, m = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                part = slice(k * p.batch, (k + 1) * p.batch)
                m[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[m[alive] >= need]
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(alive)), batch.column("v").take(pa.array(alive)), pa.array(m[alive] / p.size)], names=["u", "v", "share"])

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, share double")


def _exact(pairs: DataFrame, p: MinHash) -> DataFrame:
    """u, v of pairs (u, v, tu, tv) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, left = WordHashes(), None, None
        for batch in batches:
            ok = []
            for u, tu, tv in zip(batch.column("u").to_pylist(), batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), strict=True):
                if (u, tu) != last:
                    last, left = (u, tu), shingle_set(tu, seen, p.width)
                right = shingle_set(tv, seen, p.width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= p.percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _pairs(left: DataFrame, right: DataFrame, p: MinHash) -> DataFrame:
    """Distinct pairs (u > v) of nodes of one bucket in different components, sizes permitting."""
    j = left.join(right.select("bucket", F.col("node").alias("other"), F.col("comp").alias("other_comp"), F.col("n").alias("m")), "bucket")
    j = j.filter((F.col("comp") != F.col("other_comp")) & (100 * F.least("n", "m") >= p.percent * F.greatest("n", "m")))
    return j.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def _survivors(pairs: DataFrame, active: DataFrame, p: MinHash) -> DataFrame:
    sigs = active.select("node", "sig")
    with_u = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
    return _sequential(with_u.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v"), p)


def _bucket_blocks(now: DataFrame, active: DataFrame, p: MinHash) -> tuple[DataFrame, list[str]]:
    """Rows of ``now`` dealt out for comparison by bucket and blocks a, b, and those keys.

    Side 0 has the nodes outside their bucket's main component, side 1 all of
    its nodes; so a bucket's work grows with its outsiders times its nodes.
    """
    out = F.col("comp") != F.col("main")
    blocks = lambda n: F.ceil(n / p.block).cast("int")
    sizes = now.groupBy("bucket").agg(blocks(F.count_if(out)).alias("outer"), blocks(F.count(F.lit(1))).alias("all"))
    rows = now.withColumn("out", out).join(sizes, "bucket").join(active.select("node", "sig").dropDuplicates(["node", "sig"]), "node")
    part = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cols = ["bucket", "a", "b", "side", "out", "node", "n", "comp", "sig"]
    left = rows.filter("out").withColumns({"a": part("outer"), "side": F.lit(0)}).withColumn("b", each("all"))
    right = rows.withColumns({"b": part("all"), "side": F.lit(1)}).withColumn("a", each("outer"))
    key = ["bucket", "a", "b"]
    dealt = left.select(cols).unionByName(right.select(cols)).repartition(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.sortWithinPartitions(*key), key


def _within_buckets(now: DataFrame, active: DataFrame, p: MinHash) -> DataFrame:
    """Survivors (u, v, share) among the pairs of a bucket in different components.

    Of two nodes in different components one is outside the bucket's main
    component.  Buckets are compared block against block, so that a large one
    is many tasks' work, and only survivors leave a task, each from the first
    band that its ends share.
    """
    least = least_matches(p)
    dealt, key = _bucket_blocks(now, active, p)

    def compare(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        node, n, comp, side, out = (t.column(k).to_numpy() for k in ("node", "n", "comp", "side", "out"))
        x = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, p.size)
        band = t.column("bucket")[0].as_py() & 63
        outer, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for left in np.array_split(outer, -(-len(outer) // 64)) if len(outer) else []:
            i, j = np.meshgrid(left, right, indexing="ij")
            fit = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= p.percent * np.maximum(n[i], n[j]))
            fit &= ~out[j] | (node[i] > node[j])  # two outsiders meet twice
            i, j = i[fit], j[fit]
            m = np.zeros(len(i), np.int64)
            for k, need in enumerate(least):
                part = slice(k * p.batch, (k + 1) * p.batch)
                m += (x[i, part] == x[j, part]).sum(axis=1)
                alive = m >= need
                i, j, m = i[alive], j[alive], m[alive]
            if len(i):
                same = (x[i, : p.rows * p.bands] == x[j, : p.rows * p.bands]).reshape(-1, p.bands, p.rows).all(axis=2)
                first = same.argmax(axis=1) == band
                i, j = i[first], j[first]
                yield np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), m[first] / p.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, key):
            for u, v, share in compare(t):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(share)], names=["u", "v", "share"])

    return dealt.mapInArrow(run, "u long, v long, share double").dropDuplicates(["u", "v"])


def _links(pairs: DataFrame, active: DataFrame, p: MinHash) -> DataFrame:
    texts = active.select("node", "text")
    with_u = pairs.select("u", "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    return _exact(with_u.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v"), p)


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs`` (doc_id, text; more columns are ignored).

    Documents with 100 * intersection >= percent * union of their sets of
    five-word shingles are linked; component_id is the smallest doc_id
    reachable, kept marks it.  A document without words links with nothing.
    Rows that share a doc_id are judged by their own texts.  A row with a null
    doc_id takes the component of an equal text, else it stays alone: component
    null, kept.  An empty table gives no rows.
    """
    if p.bands > 64:
        raise ValueError("at most 64 bands")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = written(signatures(docs, p))
    named = s.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    nodes = written(
        named.join(classes.withColumnRenamed("node", "doc_id"), ["h1", "h2", "doc_id"]).dropDuplicates(["h1", "h2"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "h1", "h2", "sig")
    )

    # two longs a band: a bucket's last six bits are its band, all else is joined for those that share one
    slices = F.array(*[F.xxhash64(F.substring("sig", i * p.rows + 1, p.rows)).bitwiseAND(~63).bitwiseOR(i) for i in range(p.bands)])
    rows = nodes.select("node", F.explode(slices).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    members = written(rows.join(shared, "bucket"))
    mine = nodes.join(members.select("node").distinct(), "node", "left_semi")
    d = docs.select(F.col("doc_id").alias("node"), "text", F.xxhash64("text").alias("row_hash"))
    active = written(mine.join(d, "node").dropDuplicates(["node", "row_hash", "h1", "h2"]).select("node", "sig", "text"))

    comps = written(mine.select("node", F.col("node").alias("comp"), "n"))
    tried = None
    for turn in ("smallest", "some", "all"):
        now = members.join(comps, "node")
        per = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
        per = per.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").drop("comps")
        now = written(now.join(per, "bucket"))
        if turn == "all":
            found = _within_buckets(now, active, p)
        else:
            few, left = now.groupBy("bucket"), now
            if turn == "some":
                few, left = now.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(4)).alias("part")), now.filter("comp <> main")
            few = few.agg(F.min(F.struct("node", "comp", "n")).alias("x")).select("bucket", "x.*")
            found = _survivors(_pairs(left, few, p), active, p)
        if tried is not None:
            found = found.join(tried, ["u", "v"], "left_anti")
        found = written(found)
        if turn != "all":  # the likeliest partner of each node settles most
            found_now = found.groupBy("u").agg(F.max_by("v", F.struct("share", "v")).alias("v"))
            found_now = written(found_now)
        else:
            found_now = found
        links = written(_links(found_now, active, p))
        done = found_now.select("u", "v")
        tried = done if tried is None else tried.unionByName(done)
        of = lambda k: comps.select(F.col("node").alias(k), F.col("comp").alias(f"c_{k}"))
        merged = connected_components(links.join(of("u"), "u").join(of("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
        comps = written(comps.join(merged.select(F.col("node").alias("comp"), "component"), "comp", "left").select("node", F.coalesce("component", "comp").alias("comp"), "n"))
        drop_table(now)

    named_comps = classes.join(comps.drop("n"), "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("component"))
    rest = s.select("doc_id", "n_shingles", "h1", "h2").join(named_comps, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    # a slim table, so that those with signatures and texts can go
    done = written(rest.select("doc_id", "n_shingles", component.alias("component_id")))
    for t in (s, nodes, members, active):
        drop_table(t)
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """One row of each group of near copies in ``docs``, in the same columns.

    It is the first by doc_id (null last), then by a hash of the text.  Rows of
    one doc_id are judged each by its text, rows with a null doc_id like all
    others; of rows with the same doc_id and text one counts.
    """
    a, b, key = column_name(docs, "row_hash"), column_name(docs, "row_hash_2"), column_name(docs, "row_key")
    hashed = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit("second"), "doc_id", "text")})
    distinct = hashed.select(F.col("doc_id").cast("long").alias("doc_id"), a, b).distinct()
    order = written(distinct.orderBy(F.col("doc_id").asc_nulls_last(), a, b).select(a, b, F.monotonically_increasing_id().alias(key)))
    rows = written(hashed.join(order, [a, b]).dropDuplicates([a, b]))
    kept = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), p).filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select([f"`{c}`" for c in docs.columns])


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
