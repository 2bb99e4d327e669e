"""Registered searches through indexes, and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import reads as R
from ..operators.cells import CellIndex
from ..operators.lexical import LOWER, TERM, UPPER, LexicalIndex, fused
from ..operators.merge import conform
from ..schemas import NODE
from ..sources.staging import shared_dir
from ..sources.store import SnapshotStore
from . import corpus as V
from .corpus import QUERY, with_views
from .queries_read import _BEST, _NODE

#: The text query of the hybrid search, and how far down it looks in both rankings.
QUERY_TEXT = "the of that is was and que la de"
DEPTH = 100
CELLS = 32


def search_bm25(spark, d):
    """The ten best documents of each benchmark item."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return LexicalIndex(spark, shared_dir(spark)).build(docs).search(queries, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def search_hybrid(spark, d):
    """Approved nodes by words and by vectors; ranks are fused."""
    node = V.node(spark, d).filter("body IS NOT NULL AND status = 'approved'")
    index = LexicalIndex(spark, shared_dir(spark)).build(V.node(spark, d).select("id", F.col("body").alias("text")))
    words = index.search(spark.createDataFrame([(1, QUERY_TEXT)], "query_id int, text string"), DEPTH, node.select("id"))
    near = R.search(node, V.chunk(spark, d), QUERY, k=DEPTH).select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))
    return fused(words, near).withColumn("score", F.round("score", 9))


def search_ivf(spark, d):
    """The nearest nodes through an index whose cells are all probed."""
    index = CellIndex(spark, shared_dir(spark)).build(V.chunk(spark, d), CELLS)
    return R.search(V.node(spark, d), index.probe(QUERY, CELLS), QUERY).withColumn("score", F.round("score", 6))


def snapshot_diff(spark, d):
    """What a change of the drafts made of the node table; risks are deleted and written again as they were."""
    store = SnapshotStore(spark, shared_dir(spark))
    old = store.save({"node": conform(V.node(spark, d), NODE)})
    node = store.load()["node"]
    gone = store.find("node", "id", node.filter("status = 'draft' OR kind = 'risk'").select("id"))
    again = gone.drop("_file", "_index").withColumns({"version": F.when(F.col("status") == "draft", F.col("version") + 1).otherwise(F.col("version")), "status": F.lit("approved")})
    store.save({}, {"node": again}, {"node": gone})
    return store.changes("node", old).select("change", "id", "version", "status", F.length("body").alias("n_chars"))


_TF = rf"""totals AS (SELECT count(*) AS n, sum(len(terms)) AS words FROM t),
tf AS (SELECT id, len(terms) AS words, term, count(*) AS tf FROM (SELECT id, terms, unnest(terms) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM q),
scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.words / (totals.words / n))))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), totals GROUP BY query_id, id
)"""
_TERMS = rf"coalesce(regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{TERM}'), [])"

REGISTERED = [
    (
        "search_bm25",
        search_bm25,
        f"""WITH t AS (SELECT doc_id AS id, {_TERMS.format("text")} AS terms FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark), {_TF}
SELECT query_id, id AS doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10""",
    ),
    (
        "search_hybrid",
        search_hybrid,
        with_views(
            f""", t AS (SELECT id, {_TERMS.format("body")} AS terms FROM node), q AS (SELECT 1 AS query_id, '{QUERY_TEXT}' AS text), {_TF}, {_BEST},
fit AS (SELECT id FROM node WHERE body IS NOT NULL AND status = 'approved'),
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE id IN (SELECT id FROM fit) ORDER BY rank LIMIT {DEPTH}),
b AS (SELECT node_id AS id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM best WHERE node_id IN (SELECT id FROM fit) ORDER BY rank LIMIT {DEPTH})
SELECT id, round(score, 9) AS score FROM (
  SELECT coalesce(a.id, b.id) AS id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY score DESC, id LIMIT 12
)""",
            *_NODE,
            "chunk",
        ),
    ),
    (
        "search_ivf",
        search_ivf,
        with_views(
            f""", {_BEST} SELECT id, kind, slug, dimension_code, status, version, body, round(score, 6) AS score FROM (
  SELECT n.*, b.score FROM node n JOIN best b ON b.node_id = n.id WHERE body IS NOT NULL AND status = 'approved' ORDER BY b.score DESC, n.id LIMIT 12
)""",
            *_NODE,
            "chunk",
        ),
    ),
    (
        "snapshot_diff",
        snapshot_diff,
        with_views(
            """SELECT 'removed' AS change, id, version, status, length(body) AS n_chars FROM node WHERE status = 'draft'
UNION ALL SELECT 'added', id, version + 1, 'approved', length(body) FROM node WHERE status = 'draft'""",
            *_NODE,
        ),
    ),
]
