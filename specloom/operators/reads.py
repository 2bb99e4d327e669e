"""Reads: vector search, subtrees, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.staging import written

NODE_COLUMNS = ["id", "kind", "slug", "dimension_code", "status", "version", "body"]


def best_chunks(chunk: DataFrame, query: Sequence[float]) -> DataFrame:
    """node_id, score: 1 less the smallest cosine distance of a node's chunks.

    Chunks without a usable embedding, and nodes without any, are left out.
    """
    distance = V.cosine_distance(F.col("embedding"), V.literal(query))
    scored = chunk.filter("embedding IS NOT NULL").select("node_id", distance.alias("distance")).filter("distance IS NOT NULL")
    return scored.groupBy("node_id").agg((1 - F.min("distance")).alias("score"))


def search(node: DataFrame, chunk: DataFrame, query: Sequence[float], dimension: str | None = None, status: str = "approved", k: int = 12) -> DataFrame:
    """The ``k`` nodes nearest to ``query``, best first, ties by id.

    The best chunk of a node is found before the join, so bodies are neither
    grouped nor shuffled by content.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    wanted = node.filter(F.col("body").isNotNull() & (F.col("status") == status))
    if dimension is not None:
        wanted = wanted.filter(F.col("dimension_code") == dimension)
    hits = wanted.join(best_chunks(chunk, query), wanted["id"] == F.col("node_id")).select(*NODE_COLUMNS, "score")
    return hits.orderBy(F.col("score").desc_nulls_last(), "id").limit(k)


_TREE = ["id", "parent_id", "kind", "slug", "dimension_code", "body", "version", "status"]


#: Levels of nodes with children below a head that are walked by joins: capabilities have business functions, and those may have some.
SPEC_DEPTH = 3


def subtree(node: DataFrame, head: str, max_depth: int = 100) -> DataFrame:
    """``head`` and all nodes below it, with their depth; a recursive query of at most ``max_depth`` levels."""
    cols = [c for c in _TREE if c in node.columns]
    return node.sparkSession.sql(
        f"""
        WITH RECURSIVE below ({", ".join(cols)}, depth) MAX RECURSION LEVEL {int(max_depth)} AS (
          SELECT {", ".join(cols)}, 0 FROM {{node}} WHERE id = :head
          UNION ALL
          SELECT {", ".join(f"n.{c}" for c in cols)}, b.depth + 1
          FROM {{node}} n JOIN below b ON n.parent_id = b.id
        )
        SELECT * FROM below
        """,
        args={"head": head},
        node=node,
    )


def subtree_levels(node: DataFrame, head: str, depth: int) -> DataFrame:
    """The same for a tree of a known depth: one join a level, and no limit on rows.

    The plan is fixed and Spark can pick each join by its side's size.
    """
    cols = [c for c in _TREE if c in node.columns]
    level = node.filter(F.col("id") == head).select(*cols, F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        above = level.select(F.col("id").alias("_above")) if d > 1 else None
        # the first level below the head is a filter, which reaches the scan
        child = node.filter(F.col("parent_id") == head) if above is None else node.join(above, node["parent_id"] == above["_above"]).drop("_above")
        level = child.select(*cols, F.lit(d).alias("depth"))
        if d == 1:  # nothing is below an unknown head
            level = level.join(node.filter(F.col("id") == head).select(F.col("id").alias("_head")), F.col("parent_id") == F.col("_head"), "left_semi")
        out = out.unionByName(level)
    return out


def spec(node: DataFrame, head: str, dimension: str | None = None, status: str | None = None) -> DataFrame:
    """Nodes with a body under ``head`` (itself included) of one status; an unknown head gives none.

    Nodes that have children are few: they are written once, as ids, and only
    they are walked, by one join a level or, where they go deeper than
    ``SPEC_DEPTH``, by the recursive query.  The others are read once, after the
    filters, and meet those found by their parent.  A tree may have any depth up
    to that of ``subtree``; a cycle below the head is an error.
    """
    edges = node.select("id", "parent_id")
    parents = edges.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
    inner = written(edges.join(parents, "id", "left_semi"))
    walked = subtree_levels(inner, head, SPEC_DEPTH)
    if not walked.filter(F.col("depth") == SPEC_DEPTH).isEmpty():
        walked = subtree(inner, head)
    above = walked.select(F.col("id").alias("_above"))
    wanted = F.col("body").isNotNull() & (F.col("status") == (status if status is not None else "approved"))
    if dimension is not None:
        wanted &= F.col("dimension_code") == dimension
    found = node.filter(wanted).join(above, F.col("parent_id") == F.col("_above"), "left")
    rows = found.filter((F.col("id") == head) | F.col("_above").isNotNull())
    cols = ["id", "kind", "slug", "dimension_code", "body", "version", "status"]
    return rows.select(cols).orderBy(F.col("dimension_code").asc_nulls_last(), F.col("slug").asc_nulls_last(), F.col("version").desc_nulls_first())


def links(spec_link: DataFrame, node: DataFrame, src: str | None = None, rel: str | None = None) -> DataFrame:
    """rel and target of outgoing links: the target node's slug, else its URN or unresolved reference.

    Without ``src``, of all nodes, with src_id.
    """
    rows = spec_link
    if src is not None:
        rows = rows.filter(F.col("src_id") == src)
    if rel is not None:
        rows = rows.filter(F.col("rel") == rel)
    slugs = node.select(F.col("id").alias("_id"), F.col("slug").alias("_slug"))
    found = rows.join(slugs, rows["dst_id"] == F.col("_id"), "left")
    target = F.coalesce("_slug", *[c for c in ("dst_urn", "dst_ref") if c in rows.columns])
    out = found.select("src_id", "rel", target.alias("target"))
    return (out.drop("src_id") if src is not None else out).orderBy("rel", F.col("target").asc_nulls_last())


def reach(spec_link: DataFrame, start: DataFrame | None = None, hops: int = 2, rel: str | None = None) -> DataFrame:
    """src_id, dst_id, hops: every other node that a node of ``start`` (id) reaches over at most ``hops`` links, and the fewest links it takes.

    Without ``start``, from every node.  Links out of the knowledge base, and
    unresolved ones, lead nowhere.  Each hop joins the nodes found by the last
    one with the links and leaves out what was found before, so a cycle ends;
    the search is over when a hop finds nothing.
    """
    rows = spec_link.filter("dst_id IS NOT NULL AND src_id IS NOT NULL")
    if rel is not None:
        rows = rows.filter(F.col("rel") == rel)
    edge = written(rows.select("src_id", "dst_id").distinct())
    own = edge.select("src_id").distinct() if start is None else start.select(F.col("id").alias("src_id")).distinct()
    front = own.select("src_id", F.col("src_id").alias("dst_id"))
    found = None
    for k in range(1, hops + 1):
        step = edge.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("_next"))
        new = front.join(step, "dst_id").select("src_id", F.col("_next").alias("dst_id")).filter("src_id <> dst_id").distinct()
        front = written(new if found is None else new.join(found, ["src_id", "dst_id"], "left_anti"))
        if front.isEmpty():
            break
        ranked = front.withColumn("hops", F.lit(k))
        found = ranked if found is None else found.unionByName(ranked)
    return edge.limit(0).withColumn("hops", F.lit(0)) if found is None else found
