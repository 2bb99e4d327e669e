"""Registered merges: version chains, containers, idempotency, whole ingests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as VEC
from ..operators import governance as G
from ..operators import merge as M
from ..operators import tree as T
from ..schemas import empty_state
from ..sources import archive as A
from ..sources.staging import written
from . import corpus as V
from .corpus import with_views
from .queries_text import archives, chunks_sql

_EMBEDDER = VEC.GaussianEmbedder()


def _history(spark, d):
    """Event types of a user as the bodies of one leaf."""
    e = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "event_id", F.col("event_type").alias("body"))
    none = spark.createDataFrame([], "key string, body string, version int")
    return M.leaf_history(e, none, ["ts", "event_id"], ["key"])


_HISTORY = """prev AS (
  SELECT user_id::VARCHAR AS key, ts, event_id, event_type AS body, lag(event_type) OVER w AS before, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), history AS (
  SELECT *, CASE WHEN rn = 1 THEN 'created' WHEN body = before THEN 'skipped' ELSE 'versioned' END AS outcome,
         sum(CASE WHEN rn = 1 OR body <> before THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id)::INTEGER AS version FROM prev
)"""


def version_chain(spark, d):
    return _history(spark, d).select("key", "event_id", "version", "outcome")


def version_current(spark, d):
    """Latest version of each key and its body."""
    changed = _history(spark, d).filter("outcome <> 'skipped'")
    return changed.groupBy("key").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def version_summary(spark, d):
    return _history(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def supersede_links(spark, d):
    """Each version and the one that it supersedes."""
    changed = _history(spark, d).filter("outcome <> 'skipped'").select("key", "version", "event_id")
    older = changed.select(F.col("key").alias("k"), (F.col("version") + 1).alias("v"), F.col("event_id").alias("supersedes_id"))
    return changed.join(older, (F.col("key") == F.col("k")) & (F.col("version") == F.col("v")), "left").select("key", "version", "event_id", "supersedes_id")


def merge_containers(spark, d):
    """Containers of a second batch: those that the English documents already made stay."""
    docs = V.table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    rows = docs.select(F.col("source").alias("parent"), F.col("lang").alias("slug"), F.lit("new").alias("origin"))
    have = docs.filter("lang = 'en'").select(F.col("source").alias("parent"), F.col("lang").alias("slug"), F.lit("stored").alias("origin")).distinct()
    return G.add_missing(have, rows, ["parent", "slug"])


def idempotent_batches(spark, d):
    """Archives of (source, language) that are new: not merged before, the first of its key in the batch."""
    docs = V.table(spark, d, "documents")
    found = docs.select(F.col("doc_id").cast("string").alias("archive"), F.col("source").alias("capability_slug"), F.col("lang").alias("source_commit"))
    ledger = docs.filter("lang = 'en'").select(F.col("source").alias("capability_slug"), F.col("lang").alias("source_commit"))
    return M.new_archives(found, ledger)


def dims_seen(spark, d):
    return V.node(spark, d).filter("dimension_code IS NOT NULL").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_set("dimension_code")), ",").alias("dimensions"))


def _capitals(c):
    """Capitals letter by letter, as the SQL has them: that of the sharp s is one letter."""
    return F.upper(F.replace(c, F.lit("\u00df"), F.lit("\u1e9e")))


def _changed(spark, d):
    """The files of a second commit: those of English documents are in capitals."""
    f = V.files(spark, d)
    return f.withColumn("body", F.when(F.col("lang") == "en", _capitals(F.col("body"))).otherwise(F.col("body")))


def _merged(spark, d):
    """State and summary of two commits merged one after the other."""
    state = empty_state(spark)
    for commit, files in (("c1", V.files(spark, d)), ("c2", _changed(spark, d))):
        found = V.manifests(spark, d, commit)
        state, summary = M.merge(state, T.build_nodes(files, found), found, T.unreached(files), _EMBEDDER)
    return state, summary


def merge_summary(spark, d):
    _, s = _merged(spark, d)
    return s.select("archive", "source_commit", "nodes_created", "nodes_versioned", "nodes_skipped", F.array_join("dimensions_seen", ",").alias("dimensions"), F.size("sources_unreached").alias("n_unreached"), "idempotent_hit")


def merge_repeat(spark, d):
    """A merge of a batch that the ledger has already: the stored summaries, nothing new."""
    found, files = V.manifests(spark, d), V.files(spark, d)
    state, _ = M.merge(empty_state(spark), T.build_nodes(files, found), found, T.unreached(files), _EMBEDDER)
    _, again = M.merge(state, T.build_nodes(files, found), found, T.unreached(files), _EMBEDDER)
    return again.select("archive", "nodes_created", "nodes_skipped", "idempotent_hit")


def merge_nodes(spark, d):
    state, _ = _merged(spark, d)
    return state["node"].select("id", "kind", "parent_id", "slug", "dimension_code", "version", "supersedes_id", "source_commit", "status", "content_hash")


def merge_vanished(spark, d):
    """The nodes after a second commit without the French files: a version says that a leaf's file is gone."""
    state, files = empty_state(spark), V.files(spark, d)
    for commit, own in (("c1", files), ("c2", files.filter(~F.col("lang").eqNullSafe("fr")))):
        found = V.manifests(spark, d, commit)
        state, _ = M.merge(state, T.build_nodes(own, found), found, T.unreached(own), _EMBEDDER, tombstone=True)
    return state["node"].select("id", "kind", "parent_id", "slug", "dimension_code", "version", "supersedes_id", "source_commit", "status", "content_hash")


def merge_chunks(spark, d):
    state, _ = _merged(spark, d)
    return state["chunk"].groupBy("node_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("ord").alias("last_ord"))


_HASH = "sha256(concat_ws(chr(31), {}))"
_SECOND = "SELECT * REPLACE (CASE WHEN lang = 'en' THEN upper(body) ELSE body END AS body, 'c2' AS source_commit) FROM keyed"
_MERGED = f""", keyed AS (
  SELECT archive, path, kind, slug, dim, body, lang, 'c1' AS source_commit, {_HASH.format("'', 'capability', 'cap-' || archive, '', ''")} AS cap_id, fn FROM classified WHERE dim IS NOT NULL AND name <> 'kb-manifest.yaml'
), commits AS (
  SELECT * FROM keyed UNION ALL {_SECOND}
), placed AS (
  SELECT *, CASE WHEN fn IS NULL THEN cap_id ELSE {_HASH.format("cap_id, 'business_function', fn, '', ''")} END AS parent_id FROM commits
), prev AS (
  SELECT *, lag(body) OVER w AS before, row_number() OVER w AS rn FROM placed WINDOW w AS (PARTITION BY parent_id, slug, dim ORDER BY source_commit, path)
), history AS (
  SELECT *, CASE WHEN rn = 1 THEN 'created' WHEN body = before THEN 'skipped' ELSE 'versioned' END AS outcome,
         sum(CASE WHEN rn = 1 OR body <> before THEN 1 ELSE 0 END) OVER (PARTITION BY parent_id, slug, dim ORDER BY source_commit, path)::INTEGER AS version FROM prev
), leaves AS (
  SELECT *, {_HASH.format("parent_id, 'leaf', slug, dim, version::VARCHAR")} AS id FROM history WHERE outcome <> 'skipped'
)"""
_PATH = ("paths", "files", "classified")

_SUMMARY_SQL = with_views(
    _MERGED
    + """, lost AS (SELECT archive, count(*) AS n FROM classified WHERE dim IS NULL AND name <> 'kb-manifest.yaml' GROUP BY archive)
SELECT h.archive, 'c2' AS source_commit, (count(*) FILTER (WHERE outcome = 'created'))::INTEGER AS nodes_created, (count(*) FILTER (WHERE outcome = 'versioned'))::INTEGER AS nodes_versioned,
       (count(*) FILTER (WHERE outcome = 'skipped'))::INTEGER AS nodes_skipped, array_to_string(list_sort(list(DISTINCT dim)), ',') AS dimensions, coalesce(any_value(l.n), 0)::INTEGER AS n_unreached, false AS idempotent_hit
FROM history h LEFT JOIN lost l ON l.archive = h.archive WHERE h.source_commit = 'c2' GROUP BY h.archive""",
    *_PATH,
)
_REPEAT_SQL = with_views(
    _MERGED
    + """ SELECT archive, (count(*) FILTER (WHERE outcome = 'created'))::INTEGER AS nodes_created, (count(*) FILTER (WHERE outcome = 'skipped'))::INTEGER AS nodes_skipped, true AS idempotent_hit
FROM history WHERE source_commit = 'c1' GROUP BY archive""",
    *_PATH,
)
_NODES_SQL = with_views(
    _MERGED
    + f""" SELECT DISTINCT cap_id AS id, 'capability' AS kind, NULL::VARCHAR AS parent_id, 'cap-' || archive AS slug, NULL::VARCHAR AS dimension_code, NULL::INTEGER AS version,
       NULL::VARCHAR AS supersedes_id, NULL::VARCHAR AS source_commit, NULL::VARCHAR AS status, NULL::VARCHAR AS content_hash FROM (SELECT {_HASH.format("'', 'capability', 'cap-' || archive, '', ''")} AS cap_id, archive FROM files)
UNION ALL SELECT DISTINCT parent_id, 'business_function', cap_id, fn, NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE fn IS NOT NULL
UNION ALL SELECT id, kind, parent_id, slug, dim, version, lag(id) OVER w, source_commit, CASE WHEN lead(id) OVER w IS NULL THEN 'approved' ELSE 'superseded' END, sha256(body)
FROM leaves WINDOW w AS (PARTITION BY parent_id, slug, dim ORDER BY version)""",
    *_PATH,
)
_VANISHED_SQL = with_views(
    _MERGED.replace(_SECOND, "SELECT * REPLACE ('c2' AS source_commit) FROM keyed WHERE lang IS DISTINCT FROM 'fr'")
    + f""", gone AS (
  SELECT parent_id, slug, dim, max(version) + 1 AS version, arg_max(kind, version) AS kind FROM leaves l
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.source_commit = 'c2' AND p.parent_id = l.parent_id AND p.slug = l.slug AND p.dim = l.dim) GROUP BY parent_id, slug, dim
), versions AS (
  SELECT id, kind, parent_id, slug, dim, version, source_commit, sha256(body) AS content_hash FROM leaves
  UNION ALL SELECT {_HASH.format("parent_id, 'leaf', slug, dim, version::VARCHAR")}, kind, parent_id, slug, dim, version, 'c2', NULL FROM gone
) SELECT DISTINCT cap_id AS id, 'capability' AS kind, NULL::VARCHAR AS parent_id, 'cap-' || archive AS slug, NULL::VARCHAR AS dimension_code, NULL::INTEGER AS version,
       NULL::VARCHAR AS supersedes_id, NULL::VARCHAR AS source_commit, NULL::VARCHAR AS status, NULL::VARCHAR AS content_hash FROM (SELECT {_HASH.format("'', 'capability', 'cap-' || archive, '', ''")} AS cap_id, archive FROM files)
UNION ALL SELECT DISTINCT parent_id, 'business_function', cap_id, fn, NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE fn IS NOT NULL
UNION ALL SELECT id, kind, parent_id, slug, dim, version, lag(id) OVER w, source_commit, CASE WHEN lead(id) OVER w IS NOT NULL THEN 'superseded' WHEN content_hash IS NULL THEN 'vanished' ELSE 'approved' END, content_hash
FROM versions WINDOW w AS (PARTITION BY parent_id, slug, dim ORDER BY version)""",
    *_PATH,
)
_CHUNKS_SQL = with_views(
    _MERGED
    + r""", sized AS (SELECT id, len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS n FROM leaves)
SELECT id AS node_id, (CASE WHEN n <= 200 THEN 1 ELSE 1 + (n - 200 + 159) // 160 END)::BIGINT AS n_chunks, (CASE WHEN n <= 200 THEN 0 ELSE (n - 200 + 159) // 160 END)::INTEGER AS last_ord FROM sized WHERE n > 0""",
    *_PATH,
)


def ingest_archives(spark, d):
    """A whole ingest: a ZIP a document, unzipped, classified, merged."""
    files = written(A.unzip(archives(spark, d)))
    found = A.require_valid(written(A.manifests(files)))
    _, s = M.merge(empty_state(spark), T.build_nodes(files, found), found, T.unreached(files), _EMBEDDER)
    return s.select("archive", "capability_slug", "source_commit", "nodes_created", "nodes_versioned", F.array_join("dimensions_seen", ",").alias("dimensions"), "idempotent_hit")


def reembed_count(spark, d):
    return M.reembed(V.node(spark, d), _EMBEDDER).agg(F.count(F.lit(1)).alias("n_chunks"))


def stale_chunks(spark, d):
    """Chunks to embed anew after the bodies of drafts changed their case."""
    node = V.node(spark, d).select("id", "body", "status")
    was = node.withColumn("body", F.when(F.col("status") == "draft", F.lower("body")).otherwise(F.col("body")))
    return M.stale_chunks(node, M.reembed(was, _EMBEDDER), _EMBEDDER)


REGISTERED = [
    ("version_chain", version_chain, f"WITH {_HISTORY} SELECT key, event_id, version, outcome FROM history"),
    ("version_current", version_current, f"WITH {_HISTORY} SELECT key, max(version) AS version, arg_max(body, version) AS body FROM history WHERE outcome <> 'skipped' GROUP BY key"),
    ("version_summary", version_summary, f"WITH {_HISTORY} SELECT outcome, count(*) AS n FROM history GROUP BY outcome"),
    ("supersede_links", supersede_links, f"WITH {_HISTORY} SELECT key, version, event_id, lag(event_id) OVER (PARTITION BY key ORDER BY version) AS supersedes_id FROM history WHERE outcome <> 'skipped'"),
    ("merge_containers", merge_containers, "SELECT DISTINCT source AS parent, lang AS slug, CASE WHEN lang = 'en' THEN 'stored' ELSE 'new' END AS origin FROM documents"),
    (
        "idempotent_batches",
        idempotent_batches,
        "SELECT min(doc_id::VARCHAR) AS archive, source AS capability_slug, lang AS source_commit FROM documents WHERE lang <> 'en' GROUP BY source, lang",
    ),
    ("dims_seen", dims_seen, with_views("SELECT parent_id, array_to_string(list_sort(list(DISTINCT dimension_code)), ',') AS dimensions FROM node WHERE dimension_code IS NOT NULL GROUP BY parent_id", "dims", "node")),
    ("merge_summary", merge_summary, _SUMMARY_SQL),
    ("merge_repeat", merge_repeat, _REPEAT_SQL),
    ("merge_nodes", merge_nodes, _NODES_SQL),
    ("merge_vanished", merge_vanished, _VANISHED_SQL),
    ("merge_chunks", merge_chunks, _CHUNKS_SQL),
    (
        "ingest_archives",
        ingest_archives,
        "SELECT doc_id || '.zip' AS archive, 'cap-' || source AS capability_slug, 'c' || doc_id AS source_commit, 1 AS nodes_created, 0 AS nodes_versioned, 'constraints' AS dimensions, false AS idempotent_hit FROM documents",
    ),
    ("reembed_count", reembed_count, f"SELECT count(*) AS n_chunks FROM ({chunks_sql(200, 40)})"),
    (
        "stale_chunks",
        stale_chunks,
        f"""SELECT 'doc-' || c.doc_id AS node_id, c.ord, c.chunk_text FROM ({chunks_sql(200, 40)}) c JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = c.doc_id
WHERE q = 0 AND lower(c.chunk_text) <> c.chunk_text""",
    ),
]
