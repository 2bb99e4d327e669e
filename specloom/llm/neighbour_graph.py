"""Near-duplicate vectors by NN-descent.

Equal vectors of a label become one node.  A graph of each node's nearest nodes
is seeded from hyperplane buckets and refined by neighbours-of-neighbours
joins: the neighbours of a node, both ways, are compared with each other, and
what is nearer enters their lists, until a round brings no new link.  A list
that holds nothing but links is saturated: it is doubled and the joins go on,
until every list holds all its links or is as wide as lists get.  Links are the
list entries at the threshold or above.

A node whose widest list is still saturated is dense.  Its links are counted
exactly: angles to the centre of its component tell which members are linked
for certain or can't be, and blocks of the others are compared.  Links between
dense nodes of different components, which their lists may hide, are searched
in fresh buckets until there are none.

An audit compares bounded samples of nodes, of all and of those in small
components that have a link or nearly one, with all nodes; if too few have all
their links, the lists get seeds from fresh buckets and the descent goes on.  It
fails if the audit doesn't pass after a few tries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_norm
from .common import drop_table, key_runs, table, written
from .graph import connected_components


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.93
    #: Entries of a list at first, and of one that was doubled as often as lists are.
    list_size: int = 8
    widest: int = 32
    tables: int = 16
    #: Nodes of a label that a bucket should have, and those compared at once.
    bucket_nodes: int = 48
    window: int = 192
    per_window: int = 3
    #: Candidates below the threshold that a node gets from one pivot; links are never held back.
    per_pivot: int = 8
    #: Followers of a node that meet its list at once; a hub's are many groups.
    followers: int = 64
    block: int = 512
    #: Rings of angles to a component's centre, as parts of the threshold's angle.
    rings: int = 24
    audit_nodes: int = 256
    #: Members of a small component; four times audit_nodes are drawn from those with entries near the threshold.
    audit_members: int = 64
    #: Share of the nodes with links that must have all of them, in both samples.
    audit_recall: float = 0.995
    #: Searches for seeds before the audit is given up as failed.  They add seeds, they can't stand in for the descent.
    tries: int = 4
    seed: int = 1

    @property
    def near(self) -> float:
        """Cosine of twice the threshold's angle: two links of one node are no further apart, so no other entry leads to a link."""
        return 2 * self.threshold**2 - 1


_NODE = "id long, grp long, weight long, vec array<float>"


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit rows in double precision of vectors of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vector(vectors: DataFrame) -> F.Column:
    """Embeddings of doubles stay doubles; others fit floats."""
    own = vectors.schema["embedding"].dataType.simpleString()
    return F.col("embedding").cast("array<double>" if own in ("array<double>", "array<bigint>", "array<int>") or "decimal" in own else "array<float>")


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal usable vectors: rows (vec_id, id) and nodes (id, grp, weight, vec).

    ``id`` is the smallest vec_id of the class; ``grp`` tells apart labels and
    lengths.  Vectors that are null, zero, or have null or non-finite
    components, and rows without a label or vec_id, are in no class.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", bad)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _vector(vectors).alias("vec"), "label").filter(good)
    v = v.select("vec_id", F.xxhash64("label", F.size("vec")).alias("grp"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"), "vec")
    classes = v.groupBy("grp", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    named = written(v.join(classes, ["grp", "h1", "h2"]).select("vec_id", "id", "grp", "weight", F.when(F.col("vec_id") == F.col("id"), F.col("vec")).alias("vec")))
    nodes = named.filter("vec IS NOT NULL").dropDuplicates(["id", "grp"])
    return named.select("vec_id", "id"), nodes.select("id", "grp", "weight", "vec")


def _placed(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``nodes`` with arrays of an entry a table: code (sides of ``bits`` hyperplanes) and place (a projection); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                part = b.filter(pa.array(size == n))
                x = _matrix(part.column("vec"))
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, int(n)]).standard_normal((int(n), tables * (bits + 1)))
                y = (x @ planes[n]).reshape(len(x), tables, bits + 1)
                code = ((y[:, :, :bits] > 0) * (1 << np.arange(bits))).sum(axis=2)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                cols = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (code.astype(np.int64), y[:, :, bits])]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "code", "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return written(nodes.mapInArrow(run, f"{kinds}, code array<long>, place array<double>"))


def _search(nodes: DataFrame, bits: int, p: Descent, seed: int, pick: Callable, out: str) -> DataFrame:
    """Compare nodes within windows of their sorted buckets; ``pick`` chooses what leaves a window.

    A bucket is ordered by one more projection and may span tasks, so a bucket
    with very many nodes is neither one task nor all pairs.  Places are worked
    out once; finding the ranges reads them again.
    """
    key = ["tab", "grp", "code", "place"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = _placed(nodes, bits, p.tables, seed).select(*nodes.columns, F.posexplode(F.arrays_zip("code", "place")).alias("tab", "at")).select(*nodes.columns, "tab", "at.code", "at.place")
    dealt = copies.repartitionByRange(n, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["tab", "grp", "code"]):
            for at in range(0, max(1, t.num_rows - p.window // 2), p.window // 2):
                part = t.slice(at, p.window)
                if part.num_rows > 1:
                    x = _matrix(part.column("vec").combine_chunks())
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    got = pick(part, s)
                    if got is not None:
                        yield got

    return dealt.mapInArrow(run, out)


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


_EDGE = "u long, v long, sim double"


def _nearest(k: int):
    def pick(part: pa.Table, s: np.ndarray) -> pa.RecordBatch:
        ids, k_ = part.column("id").to_numpy(), min(k, len(s) - 1)
        best = np.argpartition(-s, k_ - 1, axis=1)[:, :k_]
        rows = np.repeat(np.arange(len(s)), k_)
        return _edges(ids[rows], ids[best.ravel()], s[rows, best.ravel()])

    return pick


def _across(threshold: float):
    """The nearest node of another component for each node, if that is a link."""

    def pick(part: pa.Table, s: np.ndarray) -> pa.RecordBatch | None:
        ids, comp = part.column("id").to_numpy(), part.column("comp").to_numpy()
        s = np.where(comp[:, None] == comp[None, :], -2, s)
        best = s.argmax(axis=1)
        rows = np.flatnonzero(s[np.arange(len(s)), best] >= threshold)
        return _edges(ids[rows], ids[best[rows]], s[rows, best[rows]]) if len(rows) else None

    return pick


def _kept(entries: DataFrame, p: Descent) -> DataFrame:
    """The nearest ``cap`` entries of each list of ``entries`` (u, v, sim, cap, fresh); a list without a cap has ``list_size``."""
    one = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("cap").alias("cap"), F.min("fresh").alias("fresh"))
    own = W.partitionBy("u")
    ranked = one.withColumns({"cap": F.coalesce(F.max("cap").over(own), F.lit(p.list_size)), "rank": F.row_number().over(own.orderBy(F.desc("sim"), "v"))})
    return ranked.filter("rank <= cap").drop("rank")


def _new(edges: DataFrame, p: Descent) -> DataFrame:
    return edges.select("u", "v", "sim", F.lit(None).cast("int").alias("cap"), (F.col("sim") >= p.near).alias("fresh"))


def _local_joins(lists: DataFrame, nodes: DataFrame, p: Descent) -> DataFrame:
    """Compare the neighbours of each node, of both directions, with each other; what belongs in a list and is not there comes out.

    Of the near entries, a pair is compared where at least one of the two is
    fresh on the list of the node between them.  All followers of a node meet
    its whole list, a group at a time.  Links always come out, of other
    candidates the best few.
    """
    about = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"), F.max("cap").alias("cap"), F.collect_list("v").alias("known"))
    about = about.select(F.col("u").alias("id"), F.when(F.col("n") >= F.col("cap"), F.col("worst")).otherwise(-1.0).alias("worst"), "known")
    entries = lists.filter(F.col("sim") >= p.near)
    groups = entries.groupBy(F.col("v").alias("pivot")).agg(F.ceil(F.count(F.lit(1)) / p.followers).cast("int").alias("groups"))
    mine = entries.select(F.col("u").alias("pivot"), F.col("v").alias("id"), "fresh").join(groups, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)))
    back = entries.select(F.col("v").alias("pivot"), F.col("u").alias("id"), "fresh").join(groups, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    cols = ["pivot", "part", "id", "fresh"]
    around = mine.select(cols).unionByName(back.select(cols)).groupBy("pivot", "part", "id").agg(F.max("fresh").alias("fresh"))
    active = around.filter("fresh").select("pivot", "part").distinct()
    around = around.join(active, ["pivot", "part"], "left_semi").unionByName(active.select("pivot", "part", F.col("pivot").alias("id"), F.lit(False).alias("fresh")))
    full = around.join(nodes.select("id", "vec").join(about, "id", "left").fillna(-1.0, ["worst"]), "id")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for t in key_runs(batches, ["pivot", "part"]):
            t = t.sort_by("id").combine_chunks()
            ids, fresh = t.column("id").to_numpy(), t.column("fresh").to_numpy()
            x = _matrix(t.column("vec").chunk(0))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            s[~(fresh[:, None] | fresh[None, :])] = -2
            known = t.column("known").chunk(0)
            size = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = known.flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            hit = ids[at] == flat
            s[np.repeat(np.arange(len(ids)), size)[hit], at[hit]] = -2
            want = s > t.column("worst").to_numpy()[:, None]
            if len(ids) > p.per_pivot:
                want &= (s >= p.threshold) | (s >= np.partition(s, -p.per_pivot, axis=1)[:, -p.per_pivot, None])
            i, j = np.nonzero(want)
            out.append((ids[i], ids[j], s[i, j]))
            rows += len(i)
            if rows > 20_000:
                yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
                out, rows = [], 0
        if rows:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return dealt.mapInArrow(run, _EDGE)


def _descend(lists: DataFrame, nodes: DataFrame, p: Descent) -> DataFrame:
    """Refine ``lists`` until a round brings no new link, doubling those that hold nothing but links."""

    def then(old: DataFrame, new: DataFrame) -> DataFrame:
        new = written(new)
        drop_table(old)
        return new

    before = -1
    while True:
        per = _lists(lists, p)
        now = per.agg(F.sum("links").alias("links"), F.count_if(_is_full(p) & (F.col("cap") < p.widest)).alias("wider")).first()
        if (now["links"] or 0) > before:
            before = now["links"] or 0
            old = lists.withColumn("fresh", F.lit(False))
            lists = then(lists, _kept(old.unionByName(_new(_local_joins(lists, nodes, p), p)), p))
        elif now["wider"]:
            before = -1
            full = per.filter(_is_full(p) & (F.col("cap") < p.widest)).select("u", F.lit(True).alias("wider"))
            j = lists.join(full, "u", "left").withColumn("wider", F.coalesce("wider", F.lit(False)))
            lists = then(lists, j.select("u", "v", "sim", F.when(F.col("wider"), F.least(2 * F.col("cap"), F.lit(p.widest))).otherwise(F.col("cap")).alias("cap"), F.col("wider").alias("fresh")))
        else:
            return lists


def _lists(lists: DataFrame, p: Descent) -> DataFrame:
    """u, cap, n, links, worst of each list."""
    return lists.groupBy("u").agg(F.max("cap").alias("cap"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("sim") >= p.threshold).alias("links"), F.min("sim").alias("worst"))


def _is_full(p: Descent) -> F.Column:
    """A list that holds nothing but links."""
    return (F.col("n") >= F.col("cap")) & (F.col("worst") >= p.threshold)


def _listed_counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, links: vectors on the other ends of ``links`` (u < v, distinct)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(nodes.select(F.col("id").alias("v"), "weight"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("links"))


def _dense_counts(nodes: DataFrame, comps: DataFrame, dense: DataFrame, p: Descent) -> DataFrame:
    """id, links of the ``dense`` nodes: vectors at the threshold or above among the members of their component.

    Members are put in rings by their angle to the component's centre.  Two
    rings whose angles add up to the threshold's angle at most are linked as a
    whole, two that are further apart than it not at all; of the others, blocks
    are compared with blocks, and only counts leave a task.
    """
    own = comps.join(dense, "id", "left_semi").select("comp").distinct()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec")
            ends = pa.array(np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32))
            rows = [_matrix(x.slice(i, 1)).ravel() for i in range(len(x))]  # lengths may differ between components
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows or [np.zeros(0)])))], names=b.schema.names)

    member = nodes.join(comps.join(own, "comp", "left_semi"), "id").select("id", "comp", "weight", "vec")
    member = written(member.mapInArrow(unit, "id long, comp long, weight long, vec array<double>"))
    axis = member.select("comp", F.posexplode("vec").alias("k", "x")).groupBy("comp", "k").agg(F.avg("x").alias("x"))
    centre = axis.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("centre"))
    theta = float(np.arccos(p.threshold))
    width = theta / p.rings
    cosine = F.try_divide(dot(F.col("vec"), F.col("centre")), l2_norm(F.col("centre")))
    ring = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(-1.0))))) / width).cast("int")
    placed = member.join(centre, "comp").select("id", "comp", "weight", "vec", ring.alias("ring"))
    placed = written(placed)
    rings = placed.groupBy("comp", "ring").agg(F.sum("weight").alias("weight"), F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"))
    other = rings.select("comp", F.col("ring").alias("ring2"), F.col("weight").alias("weight2"), F.col("blocks").alias("blocks2"))
    pairs = written(rings.join(other, "comp"))
    # an acos is off by less than a thousandth of a ring
    sure = (F.col("ring") + F.col("ring2") + 2.001) * width <= theta
    open_ = ~sure & ((F.abs(F.col("ring2") - F.col("ring")) - 1.001) * width <= theta)
    whole = pairs.filter(sure).groupBy("comp", "ring").agg(F.sum("weight2").alias("whole"), F.max(F.col("ring") == F.col("ring2")).alias("own"))
    certain = placed.drop("vec").join(whole, ["comp", "ring"]).select("id", (F.col("whole") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links"))

    halves = pairs.filter(open_ & (F.col("ring") <= F.col("ring2"))).select("comp", F.col("ring").alias("r1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b1"), F.col("ring2").alias("r2"), "blocks2")
    halves = halves.select("comp", "r1", "b1", "r2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("b2")).filter("r1 < r2 OR b1 <= b2")
    key = ["comp", "r1", "b1", "r2", "b2"]
    sized = placed.join(rings.select("comp", "ring", "blocks"), ["comp", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    left = sized.join(halves, (sized["comp"] == halves["comp"]) & (F.col("ring") == F.col("r1")) & (F.col("block") == F.col("b1"))).drop(sized["comp"]).withColumn("side", F.lit(0))
    right = sized.join(halves.filter("r1 <> r2 OR b1 <> b2"), (sized["comp"] == halves["comp"]) & (F.col("ring") == F.col("r2")) & (F.col("block") == F.col("b2"))).drop(sized["comp"]).withColumn("side", F.lit(1))
    cols = [*key, "side", "id", "weight", "vec"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.select(cols).unionByName(right.select(cols)).repartition(n, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, key):
            ids, w, side = (t.column(k).to_numpy() for k in ("id", "weight", "side"))
            x = _matrix(t.column("vec").combine_chunks())
            if (t.column("r1")[0].as_py(), t.column("b1")[0].as_py()) == (t.column("r2")[0].as_py(), t.column("b2")[0].as_py()):
                s = x @ x.T >= p.threshold
                np.fill_diagonal(s, False)
                out = [(ids, s @ w)]
            else:
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                s = x[a] @ x[b].T >= p.threshold
                out = [(ids[a], s @ w[b]), (ids[b], s.T @ w[a])]
            for i, k in out:
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k.astype(np.int64))], names=["id", "links"])

    every = certain.unionByName(dealt.mapInArrow(run, "id long, links long")).join(dense, "id", "left_semi")
    return every.groupBy("id").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, comps: DataFrame, counts: DataFrame, near: DataFrame, p: Descent) -> tuple[float | None, int]:
    """Share of the sampled nodes with links whose links were all found, and how many nodes with links were sampled.

    One sample is of all nodes, the other of the nodes of ``near`` (id) in small
    components; the share is that of the sample which has less.  It is null if
    no sampled node has a link: then nothing is known.
    """
    order = F.xxhash64(F.lit(p.seed), "id")
    small = comps.groupBy("comp").count().filter(F.col("count") <= p.audit_members)
    in_small = nodes.join(comps.join(small, "comp", "left_semi"), "id", "left_semi").join(near, "id", "left_semi")
    few = {r["id"] for r in nodes.select("id").orderBy(order).limit(p.audit_nodes).collect()}
    rows = {r["id"]: r for r in in_small.orderBy(order).limit(4 * p.audit_nodes).collect()}
    samples = [few, set(rows)]
    rows |= {r["id"]: r for r in nodes.filter(F.col("id").isin(list(few))).collect()}
    rows = list(rows.values())
    if not rows:
        return None, 0
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in rows}:
        own = [r for r in rows if r["grp"] == g]
        x = np.array([r["vec"] for r in own], np.float64)
        sample[g] = np.array([r["id"] for r in own]), x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp = b.column("grp").to_numpy()
            for g in np.unique(grp):
                if g in sample:
                    part = b.filter(pa.array(grp == g))
                    ids, y = sample[g]
                    s = y @ _matrix(part.column("vec")).T >= p.threshold + 1e-9  # a pair at the threshold itself may be rounded either way
                    s &= ids[:, None] != part.column("id").to_numpy()[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((s @ part.column("weight").to_numpy()).astype(np.int64))], names=["id", "truth"])

    truth = nodes.mapInArrow(run, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    judged = truth.filter("truth > 0").join(counts, "id", "left").select("id", (F.coalesce("links", F.lit(0)) >= F.col("truth")).alias("whole")).collect()
    shares = [[r["whole"] for r in judged if r["id"] in ids] for ids in samples]
    return min((sum(x) / len(x) for x in shares if x), default=None), len(judged)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp of every node; a node without links is its own component."""
    found = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return written(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))


def _joined_dense(plain: DataFrame, comps: DataFrame, dense: DataFrame, bits: int, p: Descent, seed: int) -> tuple[DataFrame, int]:
    """``comps`` after links between dense nodes of different components are found: fresh buckets, until they bring none."""
    while True:
        seed += 1
        few = plain.join(comps.join(dense, "id", "left_semi"), "id").select("id", "grp", "vec", "comp")
        more = written(_search(few, bits, p, seed, _across(p.threshold), _EDGE))
        if more.isEmpty():
            return comps, seed
        of = lambda k: comps.select(F.col("id").alias(k), F.col("comp").alias(f"c_{k}"))
        merged = connected_components(more.join(of("u"), "u").join(of("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
        comps = written(comps.join(merged.select(F.col("node").alias("comp"), "component"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))


def linked_vectors(vectors: DataFrame, p: Descent = Descent()) -> tuple[DataFrame, float | None, int]:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding, label), the audited recall, and on how many nodes with links it rests.

    Vectors of equal, known labels (and equal length) link at a cosine, in
    double precision, of ``threshold`` or above.  Rows that link with nothing,
    unusable ones included, have n_links 0 and are their own component; a null
    vec_id links with nothing.  Repeated rows count as vectors each.  More
    columns are ignored, an empty table gives no rows.  A search that does not
    pass its audit is a RuntimeError; the recall is null if no sampled node has a
    link.
    """
    classes, nodes = nodes_of(vectors)
    largest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    bits = max(1, min(24, int(np.ceil(np.log2(max(2, largest / p.bucket_nodes))))))
    plain = nodes.select("id", "grp", "vec")

    lists, seed, left = None, p.seed, p.tries
    while True:
        seeds = _new(_search(plain, bits, p, seed, _nearest(p.per_window), _EDGE), p)
        lists = written(_kept(seeds if lists is None else lists.unionByName(seeds), p))
        lists = _descend(lists, nodes, p)
        links = written(lists.filter(F.col("sim") >= p.threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        dense = written(_lists(lists, p).filter(_is_full(p)).select(F.col("u").alias("id")))
        comps = _components(nodes, links)
        counts = _listed_counts(links, nodes)
        if not dense.isEmpty():
            comps, seed = _joined_dense(plain, comps, dense, bits, p, seed)
            counts = counts.join(dense, "id", "left_anti").unionByName(_dense_counts(nodes, comps, dense, p))
        counts = written(counts)
        near = lists.filter(F.col("sim") >= p.near).select(F.col("u").alias("id")).distinct()
        recall, judged = _audit(nodes, comps, counts, near, p)
        if recall is None or recall >= p.audit_recall:
            break
        left -= 1
        if not left:
            raise RuntimeError(f"the audit found all links of {recall:.4f} of {judged} nodes only, below {p.audit_recall}, after {p.tries} searches for seeds")
        seed += 1

    per_class = nodes.select("id", "weight").join(comps, "id").join(counts, "id", "left").select("id", "comp", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    rows = classes.dropDuplicates(["vec_id", "id"]).join(per_class, "id").select(F.col("vec_id").alias("of"), "comp", "links")
    rows = rows.groupBy("of").agg(F.min("comp").alias("comp"), F.max("links").alias("links"))  # a vec_id with several vectors
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = v.join(rows, v["vec_id"] == rows["of"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall, judged


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, recall, judged = linked_vectors(table(spark, sf_dir, "embeddings"))
    return rows.withColumns({"audited_recall": F.lit(recall).cast("double"), "audited_nodes": F.lit(judged).cast("long")})
