"""Integrity rules as queries of violations: a sound state gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n; nulls count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``column`` that ``target.key`` lacks; null is allowed."""
    used = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return used.join(target.select(F.col(key).alias("value")), "value", "left_anti")


def capability_with_parent(node: DataFrame) -> DataFrame:
    return node.filter("kind = 'capability' AND parent_id IS NOT NULL").select("id")


def self_links(spec_link: DataFrame) -> DataFrame:
    return spec_link.filter("dst_id = src_id").select("src_id", "rel")


def mixed_containers(node: DataFrame) -> DataFrame:
    """Strict mode: containers with a body, version or commit, and leaves without body or dimension."""
    container = F.col("kind").isin("capability", "business_function")
    filled = F.col("body").isNotNull() | F.col("version").isNotNull() | F.col("source_commit").isNotNull()
    return node.filter((container & filled) | (~container & (F.col("body").isNull() | F.col("dimension_code").isNull()))).select("id", "kind")


def ambiguous_targets(spec_link: DataFrame) -> DataFrame:
    """Strict mode: links with both an internal and an external target, or neither."""
    return spec_link.filter(F.col("dst_id").isNull() == F.col("dst_urn").isNull()).select("src_id", "rel")


def violations(state: dict[str, DataFrame]) -> DataFrame:
    """rule and number of violations of every rule that is broken."""
    node, chunk, link = state["node"], state["chunk"], state["spec_link"]
    rules = {
        "node_id": duplicates(node, ["id"]),
        "chunk_id": duplicates(chunk, ["chunk_id"]),
        "link_id": duplicates(link, ["id"]),
        "dimension_code": duplicates(state["spec_dimension"], ["code"]),
        "link_type_code": duplicates(state["link_type"], ["code"]),
        "capability_is_root": capability_with_parent(node),
        "capability_slug": duplicates(node.filter("kind = 'capability'"), ["slug"]),
        "business_function_slug": duplicates(node.filter("kind = 'business_function'"), ["parent_id", "slug"]),
        "chunk_ord": duplicates(chunk, ["node_id", "ord"]),
        "ledger_key": duplicates(state["ingestion"], ["capability_slug", "source_commit"]),
        "edge_key": duplicates(link, ["src_id", "dst_id", "dst_urn", "dst_ref", "rel"]),
        "no_self_loop": self_links(link),
        "node_parent": missing(node, "parent_id", node, "id"),
        "node_supersedes": missing(node, "supersedes_id", node, "id"),
        "node_dimension": missing(node, "dimension_code", state["spec_dimension"], "code"),
        "chunk_node": missing(chunk, "node_id", node, "id"),
        "link_src": missing(link, "src_id", node, "id"),
        "link_dst": missing(link, "dst_id", node, "id"),
        "link_rel": missing(link, "rel", state["link_type"], "code"),
    }
    counts = [q.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, q in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.filter("n > 0")


def dedup_edges(spec_link: DataFrame) -> DataFrame:
    """One link of each key (the smallest id), nulls equal."""
    keys = ["src_id", "dst_id", "dst_urn", "dst_ref", "rel"]
    rest = [c for c in spec_link.columns if c not in keys]
    return spec_link.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("id")).alias("_row")).select(*keys, "_row.*").select(spec_link.columns)
