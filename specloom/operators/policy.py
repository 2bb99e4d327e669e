"""Row policies: scopes of nodes, and which of them a role may see.

A scope is a predicate on nodes; a node is in it if the predicate holds for it
or for anything above it in the tree, so a scope that names a capability covers
all of the capability's content.  A caller sees the nodes that are in no scope
but those granted.  Reads narrow the nodes, and the chunks and links that hang
on them, before they rank, group or limit anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .merge import MOST_BROADCAST


@dataclass(frozen=True)
class Scope:
    """``predicate``: SQL over the node table's columns; where it is null the node counts as in the scope."""

    name: str
    predicate: str


@dataclass(frozen=True)
class RowPolicy:
    """``grants``: names of scopes by role; a role without an entry is granted none of them."""

    scopes: tuple[Scope, ...] = ()
    grants: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self):
        names = [s.name for s in self.scopes]
        if len(set(names)) < len(names):
            raise ValueError("two scopes have the same name")
        unknown = set().union(*self.grants.values()) - set(names)
        if unknown:
            raise ValueError(f"unknown scopes: {sorted(unknown)}")

    def denied(self, role: str) -> list[str]:
        """Names of the scopes that a role may not see, in order."""
        return sorted(s.name for s in self.scopes if s.name not in self.grants.get(role, ()))

    def apply(self, state: dict[str, DataFrame], role: str) -> dict[str, DataFrame]:
        """``state`` with those rows of node, chunk and spec_link that a role may see."""
        denied = [s.predicate for s in self.scopes if s.name in self.denied(role)]
        if not denied:
            return state
        node = visible_nodes(state["node"], denied)
        seen = {"node": node}
        if "chunk" in state:
            seen["chunk"] = visible_chunks(state["chunk"], node)
        if "spec_link" in state:
            seen["spec_link"] = visible_links(state["spec_link"], node)
        return state | seen


def hidden_parents(node: DataFrame, predicates: list[str]) -> DataFrame:
    """id of the nodes with something below them that are in one of the scopes.

    Only nodes that are a parent can pass a scope on, a small part of a tree;
    the scope goes down among those, a join a level, until a level has no node
    that isn't hidden already.  So any depth is covered and a cycle ends.
    """
    inside = F.coalesce(F.expr(" OR ".join(f"coalesce(({p}), true)" for p in predicates)), F.lit(True))
    parents = node.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    inner = written(node.withColumn("_inside", inside).select("id", "parent_id", "_inside").join(parents, "id", "left_semi"))
    hidden = front = written(inner.filter("_inside").select("id").distinct())
    while not front.isEmpty():
        below = inner.join(front.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        front = written(below.join(hidden, "id", "left_anti"))
        hidden = hidden.unionByName(front)
    return hidden


def visible_nodes(node: DataFrame, predicates: list[str]) -> DataFrame:
    """``node`` without what is in one of the scopes."""
    outside = F.expr(" AND ".join(f"NOT coalesce(({p}), true)" for p in predicates))
    hidden = written(hidden_parents(node, predicates).select(F.col("id").alias("parent_id")))
    if hidden.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        hidden = F.broadcast(hidden)
    return node.filter(outside).join(hidden, "parent_id", "left_anti").select(node.columns)


def visible_chunks(chunk: DataFrame, node: DataFrame) -> DataFrame:
    """Chunks of the visible nodes."""
    return chunk.join(node.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(chunk.columns)


def visible_links(spec_link: DataFrame, node: DataFrame) -> DataFrame:
    """Links of visible nodes to visible nodes, or out of the knowledge base; a link to a hidden node doesn't show that it exists."""
    ids = node.select(F.col("id").alias("src_id"))
    out = spec_link.join(ids, "src_id", "left_semi")
    inner = out.filter("dst_id IS NOT NULL").join(ids.withColumnRenamed("src_id", "dst_id"), "dst_id", "left_semi")
    return inner.select(spec_link.columns).unionByName(out.filter("dst_id IS NULL").select(spec_link.columns))
