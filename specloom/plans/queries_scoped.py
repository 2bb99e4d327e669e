"""Registered reads under a row policy, deletes that take chunks along, and links over several hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import KnowledgeBase
from ..functions.vectors import GaussianEmbedder
from ..operators import governance as G
from ..operators import reads as R
from ..operators.merge import blocking, conform
from ..operators.policy import RowPolicy, Scope
from ..schemas import CHUNK, LINK, NODE, seed_dimensions
from ..sources.staging import shared_dir
from . import corpus as V
from .corpus import QUERY, with_views

#: A reader may see source 1, but not source 0, what is in French, and risks.
POLICY = RowPolicy(
    (Scope("french", "kind = 'business_function' AND slug LIKE '%-fr'"), Scope("risks", "kind = 'risk'"), Scope("source-0", "kind = 'capability' AND slug = 'src0'"), Scope("source-1", "kind = 'capability' AND slug = 'src1'")),
    {"read": frozenset({"source-1"}), "admin": frozenset({"french", "risks", "source-0", "source-1"})},
)


def _seen(spark, d):
    return POLICY.apply({"node": V.node(spark, d), "chunk": V.chunk(spark, d), "spec_link": V.spec_link(spark, d)}, "read")


def search_scoped(spark, d):
    """The nearest nodes that a reader may see: what is hidden takes no place among them."""
    s = _seen(spark, d)
    return R.search(s["node"], s["chunk"], QUERY).withColumns({"score": F.round("score", 6), "denied_scopes": F.lit(",".join(POLICY.denied("read")))})


def spec_scoped(spark, d):
    return R.spec(_seen(spark, d)["node"], "cap-src1")


def spec_scoped_hidden(spark, d):
    """Under a hidden capability there is nothing."""
    return R.spec(_seen(spark, d)["node"], "cap-src0")


def links_scoped(spark, d):
    s = _seen(spark, d)
    return R.links(s["spec_link"], s["node"])


def stats_scoped(spark, d):
    return G.stats(_seen(spark, d)["node"], seed_dimensions(spark))


def delete_cascade(spark, d):
    """Nodes and their chunks before and after the drafts are deleted, from two versions of one store."""
    kb = KnowledgeBase(spark, shared_dir(spark), GaussianEmbedder(64))
    kb.store.save({"node": conform(V.node(spark, d), NODE), "chunk": conform(V.chunk(spark, d), CHUNK)})
    kb.delete_nodes(kb.settings.api_key_admin, kb.store.load()["node"].filter("status = 'draft'").select("id"))

    def counted(k, version):
        s = kb.store.load(version)
        chunks = s["chunk"].groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        whole = s["node"].select("id").join(chunks, "id", "full")  # a chunk without its node would show
        return whole.select(F.lit(k).alias("version"), "id", F.coalesce("n", F.lit(0)).alias("n_chunks"))

    versions = kb.store.versions()
    return counted(1, versions[0]).unionByName(counted(2, versions[-1]))


def delete_blocked(spark, d):
    """Drafts that can't be deleted, as a link or a node that stays refers to them."""
    state = {"node": conform(V.node(spark, d), NODE), "spec_link": conform(V.spec_link(spark, d), LINK)}
    return blocking(state, state["node"].filter("status = 'draft'").select("id"))


def links_reach(spark, d):
    """What each node reaches over at most two links, and over how many."""
    return R.reach(V.spec_link(spark, d), hops=2)


def links_reach_of_node(spark, d):
    """All that one node reaches, however far; its links run in a cycle."""
    return R.reach(V.spec_link(spark, d), spark.createDataFrame([("doc-3",)], "id string"), hops=50)


_HIDDEN = "coalesce({0}.kind = 'risk' OR ({0}.kind = 'capability' AND {0}.slug = 'src0') OR ({0}.kind = 'business_function' AND {0}.slug LIKE '%-fr'), false)"
_VISIBLE = f"visible AS (SELECT n.* FROM node n LEFT JOIN node p ON p.id = n.parent_id LEFT JOIN node g ON g.id = p.parent_id WHERE NOT {_HIDDEN.format('n')} AND NOT {_HIDDEN.format('p')} AND NOT {_HIDDEN.format('g')})"
_SPEC = "SELECT n.id, n.kind, n.slug, n.dimension_code, n.body, n.version, n.status FROM visible n JOIN node p ON p.id = n.parent_id WHERE p.parent_id = '{}' AND n.body IS NOT NULL AND n.status = 'approved'"
_BEST = f"best AS (SELECT node_id, 1 - min(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY}::DOUBLE[])) AS score FROM chunk WHERE embedding IS NOT NULL GROUP BY node_id)"
_NODE = ("dims", "node")


def _reach(start: str, hops: int) -> str:
    return f""", reach AS (
  SELECT DISTINCT src_id AS src, dst_id AS dst, 1 AS hops FROM spec_link WHERE dst_id IS NOT NULL AND {start}
  UNION SELECT src, l.dst_id, hops + 1 FROM reach JOIN spec_link l ON l.src_id = dst WHERE l.dst_id IS NOT NULL AND hops < {hops}
) SELECT src AS src_id, dst AS dst_id, min(hops)::INTEGER AS hops FROM reach WHERE dst <> src GROUP BY src, dst"""


REGISTERED = [
    (
        "search_scoped",
        search_scoped,
        with_views(
            f""", {_VISIBLE}, {_BEST} SELECT id, kind, slug, dimension_code, status, version, body, round(score, 6) AS score, 'french,risks,source-0' AS denied_scopes
FROM (SELECT n.*, b.score FROM visible n JOIN best b ON b.node_id = n.id WHERE body IS NOT NULL AND status = 'approved' ORDER BY b.score DESC, n.id LIMIT 12)""",
            *_NODE,
            "chunk",
        ),
    ),
    ("spec_scoped", spec_scoped, with_views(f", {_VISIBLE} {_SPEC.format('cap-src1')}", *_NODE)),
    ("spec_scoped_hidden", spec_scoped_hidden, with_views(f", {_VISIBLE} {_SPEC.format('cap-src0')}", *_NODE)),
    (
        "links_scoped",
        links_scoped,
        with_views(
            f", {_VISIBLE} SELECT l.src_id, l.rel, coalesce(v.slug, l.dst_urn, l.dst_ref) AS target FROM spec_link l LEFT JOIN visible v ON v.id = l.dst_id WHERE l.src_id IN (SELECT id FROM visible) AND (l.dst_id IS NULL OR v.id IS NOT NULL)",
            *_NODE,
            "rels",
            "spec_link",
        ),
    ),
    ("stats_scoped", stats_scoped, with_views(f", {_VISIBLE} SELECT (SELECT count(*) FROM visible) AS nodes, (SELECT count(*) FROM dims) AS dimensions", *_NODE)),
    (
        "delete_cascade",
        delete_cascade,
        with_views(
            """, n AS (SELECT node_id, count(*) AS n FROM chunk GROUP BY node_id), gone AS (SELECT id FROM node WHERE status = 'draft')
SELECT 1 AS version, coalesce(id, node_id) AS id, coalesce(n, 0) AS n_chunks FROM node FULL JOIN n ON node_id = id
UNION ALL SELECT 2, coalesce(id, node_id), coalesce(n, 0) FROM node FULL JOIN n ON node_id = id WHERE coalesce(id, node_id) NOT IN (SELECT id FROM gone)""",
            *_NODE,
            "chunk",
        ),
    ),
    (
        "delete_blocked",
        delete_blocked,
        with_views(
            """, gone AS (SELECT id FROM node WHERE status = 'draft')
SELECT DISTINCT src_id AS id, 'link_src' AS rule FROM spec_link WHERE src_id IN (SELECT id FROM gone)
UNION ALL SELECT DISTINCT dst_id, 'link_dst' FROM spec_link WHERE dst_id IN (SELECT id FROM gone)""",
            *_NODE,
            "rels",
            "spec_link",
        ),
    ),
    ("links_reach", links_reach, with_views(_reach("true", 2), "rels", "spec_link")),
    ("links_reach_of_node", links_reach_of_node, with_views(_reach("src_id = 'doc-3'", 50), "rels", "spec_link")),
]
