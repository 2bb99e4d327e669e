"""Registered reads: search, subtrees, links, governance and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as C
from ..operators import governance as G
from ..operators import reads as R
from ..schemas import seed_dimensions, seed_link_types
from . import corpus as V
from .corpus import QUERY, with_views

_NODE = ("dims", "node")
_BEST = f"""best AS (
  SELECT node_id, 1 - min(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY}::DOUBLE[])) AS score
  FROM chunk WHERE embedding IS NOT NULL GROUP BY node_id
)"""


def _search(k: int = 12, **how):
    def run(spark, d):
        hits = R.search(V.node(spark, d), V.chunk(spark, d), QUERY, k=k, **how)
        return hits.withColumn("score", F.round("score", 6))

    return run


def _search_sql(where: str, k: int = 12) -> str:
    return with_views(
        f""", {_BEST}
SELECT id, kind, slug, dimension_code, status, version, body, round(score, 6) AS score FROM (
  SELECT n.*, b.score FROM node n JOIN best b ON b.node_id = n.id
  WHERE body IS NOT NULL AND {where} ORDER BY b.score DESC, n.id LIMIT {k}
)""",
        *_NODE,
        "chunk",
    )


def _spec(head: str, **how):
    return lambda spark, d: R.spec(V.node(spark, d), head, **how)


def _spec_sql(head: str, where: str = "status = 'approved'") -> str:
    return with_views(
        f""", below AS (
  SELECT * FROM node WHERE id = '{head}' UNION ALL SELECT n.* FROM node n JOIN below b ON n.parent_id = b.id
) SELECT id, kind, slug, dimension_code, body, version, status FROM below WHERE body IS NOT NULL AND {where}""",
        *_NODE,
    )


def best_chunk_score(spark, d):
    return R.best_chunks(V.chunk(spark, d), QUERY).select("node_id", F.round("score", 6).alias("score"))


def tree_region_levels(spark, d):
    below = R.subtree_levels(V.geo_node(spark, d), "r-1", 3)
    return below.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parent_id").alias("n_parents"))


def tree_recursive(spark, d):
    """The same tree by the recursive query, which needs no depth."""
    return R.subtree(V.node(spark, d), "cap-src1").select("id", "parent_id", "depth")


def _links(**how):
    return lambda spark, d: R.links(V.spec_link(spark, d), V.node(spark, d), **how)


def _links_sql(where: str = "true", cols: str = "src_id, rel, target") -> str:
    return with_views(
        f"SELECT {cols} FROM (SELECT l.src_id, l.rel, coalesce(n.slug, l.dst_urn, l.dst_ref) AS target FROM spec_link l LEFT JOIN node n ON n.id = l.dst_id WHERE {where})", *_NODE, "rels", "spec_link"
    )


def links_external(spark, d):
    link = V.spec_link(spark, d).filter("dst_urn IS NOT NULL")
    return R.links(link, V.node(spark, d))


def stats(spark, d):
    return G.stats(V.node(spark, d), seed_dimensions(spark))


def coverage_partial(spark, d):
    return G.coverage(_search()(spark, d), 12)


def coverage_exact(spark, d):
    return G.exact_coverage(_search(13)(spark, d), 12)


ROLES = ["read", "write", "admin", "guest", None]


def role_rank(spark, d):
    """Documents dealt out to roles, with each role's rank."""
    docs = V.table(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % len(ROLES) + 1).cast("int")).alias("role"))
    return docs.groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("role_rank", G.role_rank(F.col("role")))


def whitelist_merge(spark, d):
    """Seeded codes and, of the languages and sources of the documents, those that are new."""
    docs = V.table(spark, d, "documents")
    new = docs.select(F.col("lang").alias("code")).unionByName(docs.select(F.col("source").alias("code"))).filter("code IS NOT NULL")
    rows = new.select("code", F.upper("code").alias("label"), F.lit(None).cast("string").alias("description"))
    return G.add_missing(seed_dimensions(spark), rows, ["code"]).select("code", "label")


def health(spark, d):
    """Whether the node view can be read to its end and has nodes."""
    return V.node(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"), F.col("n").alias("nodes"))


def fk_violations(spark, d):
    """Values that a referenced table lacks, by rule; some references are broken first, those of two rules are left sound."""
    events = V.table(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 50 == 0, -F.col("user_id")).otherwise(F.col("user_id")))
    links = V.spec_link(spark, d).withColumn("dst_id", F.when(F.col("rel") == "depends_on", F.concat(F.lit("gone-"), "dst_id")).otherwise(F.col("dst_id")))
    labels = V.table(spark, d, "labels").withColumn("doc_id", F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    orders = V.table(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1_000_000_000_000).otherwise(F.col("o_custkey")))
    node = V.node(spark, d)
    rules = {
        "event_user": (events, "user_id", V.table(spark, d, "customer"), "c_custkey"),
        "node_dimension": (node.withColumn("dimension_code", F.when(F.col("status") == "draft", F.concat("dimension_code", F.lit("?"))).otherwise(F.col("dimension_code"))), "dimension_code", seed_dimensions(spark), "code"),
        "link_rel": (links, "rel", seed_link_types(spark), "code"),
        "link_src": (links, "src_id", node, "id"),
        "link_dst": (links, "dst_id", node, "id"),
        "label_doc": (labels, "doc_id", V.table(spark, d, "documents"), "doc_id"),
        "order_customer": (orders, "o_custkey", V.table(spark, d, "customer"), "c_custkey"),
    }
    found = [C.missing(*r).select(F.lit(name).alias("rule"), F.col("value").cast("string").alias("value")) for name, r in rules.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def root_violations(spark, d):
    """Business functions taken as capabilities have a parent each."""
    kind = F.when(F.col("kind") == "business_function", "capability").otherwise(F.col("kind"))
    return C.capability_with_parent(V.node(spark, d).withColumn("kind", kind))


def strict_containers(spark, d):
    """Leaves without their dimension break the strict rule where the document is a draft."""
    code = F.when(F.col("status") == "draft", None).otherwise(F.col("dimension_code"))
    return C.mixed_containers(V.node(spark, d).withColumn("dimension_code", code).withColumn("source_commit", F.lit(None).cast("string")))


def edge_dedup(spark, d):
    link = V.spec_link(spark, d)
    return C.dedup_edges(link.unionByName(link.withColumn("id", F.concat(F.lit("z"), "id")))).select("id", "src_id", "dst_id", "dst_urn", "dst_ref", "rel")


REGISTERED = [
    ("search_topk", _search(), _search_sql("status = 'approved'")),
    ("search_dimension", _search(dimension="constraints"), _search_sql("status = 'approved' AND dimension_code = 'constraints'")),
    ("search_status", _search(status="draft"), _search_sql("status = 'draft'")),
    ("search_k_zero", _search(0), _search_sql("status = 'approved'", 0)),
    ("best_chunk_score", best_chunk_score, with_views(f", {_BEST} SELECT node_id, round(score, 6) AS score FROM best", "chunk")),
    ("spec_subtree", _spec("cap-src1"), _spec_sql("cap-src1")),
    ("spec_dimension", _spec("cap-src1", dimension="processes"), _spec_sql("cap-src1", "status = 'approved' AND dimension_code = 'processes'")),
    ("spec_status", _spec("cap-src1", status="draft"), _spec_sql("cap-src1", "status = 'draft'")),
    ("spec_leaf_head", _spec("doc-7"), _spec_sql("doc-7")),
    ("spec_unknown_head", _spec("nothing"), _spec_sql("nothing")),
    (
        "tree_region_levels",
        tree_region_levels,
        with_views(
            """, below AS (SELECT *, 0 AS depth FROM geo WHERE id = 'r-1' UNION ALL SELECT g.*, depth + 1 FROM geo g JOIN below b ON g.parent_id = b.id)
SELECT depth, count(*) AS n, count(DISTINCT parent_id) AS n_parents FROM below GROUP BY depth""",
            "geo",
        ),
    ),
    (
        "tree_recursive",
        tree_recursive,
        with_views(""", below AS (SELECT id, parent_id, 0 AS depth FROM node WHERE id = 'cap-src1' UNION ALL SELECT n.id, n.parent_id, depth + 1 FROM node n JOIN below b ON n.parent_id = b.id) SELECT * FROM below""", *_NODE),
    ),
    ("links_all", _links(), _links_sql()),
    ("links_by_rel", _links(rel="depends_on"), _links_sql("rel = 'depends_on'")),
    ("links_of_node", _links(src="doc-3"), _links_sql("src_id = 'doc-3'", "rel, target")),
    ("links_external", links_external, _links_sql("dst_urn IS NOT NULL")),
    ("stats", stats, with_views("SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM dims) AS dimensions", *_NODE)),
    ("dimension_list", lambda spark, d: G.code_usage(seed_dimensions(spark), V.node(spark, d), "dimension_code"), with_views("SELECT code, label, count(n.id) AS n_used FROM dims LEFT JOIN node n ON n.dimension_code = code GROUP BY code, label", *_NODE)),
    ("link_type_list", lambda spark, d: G.code_usage(seed_link_types(spark), V.spec_link(spark, d), "rel"), with_views("SELECT code, label, count(l.id) AS n_used FROM rels LEFT JOIN spec_link l ON l.rel = code GROUP BY code, label", "rels", "spec_link")),
    ("coverage_partial", coverage_partial, with_views(f", {_BEST} SELECT least(12, count(*)) AS n_rows, count(*) >= 12 AS partial FROM node JOIN best ON node_id = id WHERE status = 'approved' AND body IS NOT NULL", *_NODE, "chunk")),
    ("coverage_exact", coverage_exact, with_views(f", {_BEST} SELECT least(12, count(*)) AS n_rows, count(*) > 12 AS partial FROM node JOIN best ON node_id = id WHERE status = 'approved' AND body IS NOT NULL", *_NODE, "chunk")),
    (
        "role_rank",
        role_rank,
        "SELECT role, count(*) AS n, role_rank FROM documents JOIN (VALUES (0, 'read', 1), (1, 'write', 2), (2, 'admin', 3), (3, 'guest', NULL), (4, NULL, NULL)) t(i, role, role_rank) ON i = doc_id % 5 GROUP BY role, role_rank",
    ),
    (
        "whitelist_merge",
        whitelist_merge,
        with_views("SELECT code, label FROM dims UNION ALL SELECT DISTINCT code, upper(code) FROM (SELECT lang AS code FROM documents UNION ALL SELECT source FROM documents) WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM dims)", "dims"),
    ),
    ("health", health, with_views("SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS nodes FROM node", *_NODE)),
    (
        "fk_violations",
        fk_violations,
        with_views(
            """, e AS (SELECT CASE WHEN event_id % 50 = 0 THEN -user_id ELSE user_id END AS v FROM events),
n AS (SELECT CASE WHEN status = 'draft' THEN dimension_code || '?' ELSE dimension_code END AS v FROM node),
l AS (SELECT src_id, rel, CASE WHEN rel = 'depends_on' THEN 'gone-' || dst_id ELSE dst_id END AS v FROM spec_link),
b AS (SELECT CASE WHEN toxic = 1 THEN -1 - doc_id ELSE doc_id END AS v FROM labels),
o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000000000000 ELSE o_custkey END AS v FROM orders)
SELECT DISTINCT 'event_user' AS rule, v::VARCHAR AS value FROM e WHERE v NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT 'node_dimension', v FROM n WHERE v NOT IN (SELECT code FROM dims)
UNION ALL SELECT DISTINCT 'link_rel', rel FROM l WHERE rel NOT IN (SELECT code FROM rels)
UNION ALL SELECT DISTINCT 'link_src', src_id FROM l WHERE src_id NOT IN (SELECT id FROM node)
UNION ALL SELECT DISTINCT 'link_dst', v FROM l WHERE v NOT IN (SELECT id FROM node)
UNION ALL SELECT DISTINCT 'label_doc', v::VARCHAR FROM b WHERE v NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT 'order_customer', v::VARCHAR FROM o WHERE v NOT IN (SELECT c_custkey FROM customer)""",
            *_NODE,
            "rels",
            "spec_link",
        ),
    ),
    ("unique_violations", lambda spark, d: C.duplicates(V.table(spark, d, "documents"), ["text"]), "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"),
    ("self_loops", lambda spark, d: C.self_links(V.spec_link(spark, d)), with_views("SELECT src_id, rel FROM spec_link WHERE dst_id = src_id", "rels", "spec_link")),
    ("edge_dedup", edge_dedup, with_views("SELECT id, src_id, dst_id, dst_urn, dst_ref, rel FROM (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, dst_urn, dst_ref, rel ORDER BY id) AS rn FROM spec_link) WHERE rn = 1", "rels", "spec_link")),
    ("root_violations", root_violations, with_views("SELECT id FROM node WHERE kind = 'business_function'", *_NODE)),
    ("strict_containers", strict_containers, with_views("SELECT id, kind FROM node WHERE status = 'draft'", *_NODE)),
    ("strict_edges", lambda spark, d: C.ambiguous_targets(V.spec_link(spark, d)), with_views("SELECT src_id, rel FROM spec_link WHERE (dst_id IS NULL) = (dst_urn IS NULL)", "rels", "spec_link")),
]
