"""The knowledge base's tables as views over the driver's tables, in Spark and as SQL.

``SQL`` has the same views as common table expressions for the oracle queries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DIMENSIONS, LINK_TYPES

CODES = [c for c, _ in DIMENSIONS]
RELS = [c for c, _ in LINK_TYPES]
#: The query vector of the search queries.
QUERY = [round(math.sin(i + 1), 6) for i in range(64)]
#: Path shapes; {d} is the document, {k} one of seven functions.
PATHS = [
    "documents/01-context-and-requirements/context-{d}.adoc",
    "{d}/documents/01-context-and-requirements/business-rules.md",
    "documents/01-context-and-requirements/{d}-requirements/business-fct-{k}/solution-requirements.md",
    "v{d}/requirements/business-fct-{k}/data-requirements.md",
    "v{d}/requirements/business-fct-{k}/business-rules.md",
    "documents/02-quality-attributes/load.{k}.{d}.md",
    "documents/03-constraints/noext{d}",
    "documents/04-architecture-diagrams/{d}/.adoc",
    "documents/05-infrastructure-costs/costs {d}.md",
    "documents/06-architectural-decisions/adr-{d}-queue.adoc",
    "documents/07-risks-and-technical-debts/RISK-{d}.md",
    "processes/flow-{d}.md",
    "cap/processes/flow-{d}.md",
    "stray/readme-{d}.txt",
    "documents/06-architectural-decisions/ADR-x-risk-{d}.md",
    "cap/{d}/kb-manifest.yaml",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], i: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability a source, a function a source and language, a leaf a document."""
    null = lambda t: F.lit(None).cast(t)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    empty = [null("string").alias("dimension_code"), null("string").alias("body"), null("int").alias("version"), null("string").alias("status")]
    fn = F.concat(F.lit("fn-"), "source", F.lit("-"), "lang")
    caps = docs.select("source").distinct().select(F.concat(F.lit("cap-"), "source").alias("id"), F.lit("capability").alias("kind"), null("string").alias("parent_id"), F.col("source").alias("slug"), *empty)
    fns = docs.select("source", "lang").distinct().select(fn.alias("id"), F.lit("business_function").alias("kind"), F.concat(F.lit("cap-"), "source").alias("parent_id"), F.concat("source", F.lit("-"), "lang").alias("slug"), *empty)
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    kind = F.when(F.col("doc_id") % 10 == 0, "decision_record").when(F.col("doc_id") % 10 == 1, "risk").otherwise("document")
    leaves = docs.join(quality, "doc_id", "left").select(
        name.alias("id"), kind.alias("kind"), fn.alias("parent_id"), name.alias("slug"), _pick(CODES, F.col("doc_id")).alias("dimension_code"),
        F.col("text").alias("body"), F.lit(1).alias("version"), F.when(F.col("quality") == 0, "draft").otherwise("approved").alias("status"),
    )
    return caps.unionByName(fns).unionByName(leaves)


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several vectors a node."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.concat(F.lit("doc-"), (F.col("vec_id") % 200).cast("string")).alias("node_id"), F.floor(F.col("vec_id") / 200).cast("int").alias("ord"), "embedding")


def spec_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents, to page URLs and to unresolved references."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))  # one row
    doc = lambda c: F.concat(F.lit("doc-"), c.cast("string"))
    none = F.lit(None).cast("string")
    d = F.col("doc_id")
    inner = docs.join(n).select(F.concat(F.lit("d"), d.cast("string")).alias("id"), doc(d).alias("src_id"), doc((7 * d + 4) % F.col("n")).alias("dst_id"), none.alias("dst_urn"), none.alias("dst_ref"), _pick(RELS, d).alias("rel"), F.lit(False).alias("pending"))
    p = F.col("page_id")
    outer = table(spark, sf_dir, "pages").join(n).select(F.concat(F.lit("p"), p.cast("string")).alias("id"), doc(p % F.col("n")).alias("src_id"), none.alias("dst_id"), F.col("url").alias("dst_urn"), none.alias("dst_ref"), F.lit("traces_to").alias("rel"), F.lit(False).alias("pending"))
    i = F.col("item_id")
    open_ = table(spark, sf_dir, "benchmark").join(n).select(F.concat(F.lit("i"), i.cast("string")).alias("id"), doc(i % F.col("n")).alias("src_id"), none.alias("dst_id"), none.alias("dst_urn"), F.concat(F.lit("item-"), i.cast("string")).alias("dst_ref"), F.lit("refines").alias("rel"), F.lit(True).alias("pending"))
    return inner.unionByName(outer).unionByName(open_)


def geo_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer as a tree of the node table's columns."""
    null = lambda t, a: F.lit(None).cast(t).alias(a)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rest = [null("string", "dimension_code"), null("string", "body"), null("int", "version"), null("string", "status")]
    r = table(spark, sf_dir, "region").select(key("r-", "r_regionkey").alias("id"), F.lit("capability").alias("kind"), null("string", "parent_id"), F.col("r_name").alias("slug"), *rest)
    n = table(spark, sf_dir, "nation").select(key("n-", "n_nationkey").alias("id"), F.lit("business_function").alias("kind"), key("r-", "n_regionkey").alias("parent_id"), F.col("n_name").alias("slug"), *rest)
    c = table(spark, sf_dir, "customer").select(key("c-", "c_custkey").alias("id"), F.lit("document").alias("kind"), key("n-", "c_nationkey").alias("parent_id"), F.col("c_name").alias("slug"), *rest)
    return r.unionByName(n).unionByName(c)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of its source's archive, and some attribute lines around its text."""
    d = F.col("doc_id").cast("string")
    path = F.replace(F.replace(_pick(PATHS, F.col("doc_id")), F.lit("{d}"), d), F.lit("{k}"), (F.col("doc_id") % 7).cast("string"))
    nl = F.lit("\n")
    body = F.concat(F.lit(":lang: "), "lang", nl, F.lit(":source:  "), "source", F.lit(" "), nl, F.coalesce("text", F.lit("")), nl, F.lit(":n-chars: "), F.col("n_chars").cast("string"), nl, F.lit(":lang: last "), "lang", nl, F.lit(":no name: x"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("archive"), F.col("doc_id").alias("ord"), path.alias("path"), body.alias("body"), "doc_id", "lang")


def manifests(spark: SparkSession, sf_dir: str, commit: str = "c1") -> DataFrame:
    """A manifest an archive of ``files``."""
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("archive")).distinct()
    return s.select("archive", F.concat(F.lit("cap-"), "archive").alias("capability_slug"), F.lit("test").alias("category"), F.lit("synthetic").alias("domain"), F.lit(commit).alias("source_commit"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


SQL = {
    "dims": f"dims(i, code, label) AS (VALUES {_values([(i, *d) for i, d in enumerate(DIMENSIONS)])})",
    "rels": f"rels(i, code, label) AS (VALUES {_values([(i, *r) for i, r in enumerate(LINK_TYPES)])})",
    "paths": f"paths(i, shape) AS (VALUES {_values(list(enumerate(PATHS)))})",
    "node": """node AS (
  SELECT DISTINCT 'cap-' || coalesce(source, 'none') AS id, 'capability' AS kind, NULL::VARCHAR AS parent_id, coalesce(source, 'none') AS slug,
         NULL::VARCHAR AS dimension_code, NULL::VARCHAR AS body, NULL::INTEGER AS version, NULL::VARCHAR AS status FROM documents
  UNION ALL
  SELECT DISTINCT 'fn-' || coalesce(source, 'none') || '-' || coalesce(lang, 'none'), 'business_function', 'cap-' || coalesce(source, 'none'),
         coalesce(source, 'none') || '-' || coalesce(lang, 'none'), NULL, NULL, NULL, NULL FROM documents
  UNION ALL
  SELECT 'doc-' || d.doc_id, CASE d.doc_id % 10 WHEN 0 THEN 'decision_record' WHEN 1 THEN 'risk' ELSE 'document' END,
         'fn-' || coalesce(source, 'none') || '-' || coalesce(lang, 'none'), 'doc-' || d.doc_id, code, text, 1, CASE WHEN quality = 0 THEN 'draft' ELSE 'approved' END
  FROM documents d JOIN dims ON i = d.doc_id % 11 LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)""",
    "chunk": "chunk AS (SELECT 'doc-' || (vec_id % 200) AS node_id, vec_id // 200 AS ord, embedding FROM embeddings)",
    "spec_link": """spec_link AS (
  SELECT 'd' || doc_id AS id, 'doc-' || doc_id AS src_id, 'doc-' || ((7 * doc_id + 4) % (SELECT count(*) FROM documents)) AS dst_id,
         NULL::VARCHAR AS dst_urn, NULL::VARCHAR AS dst_ref, code AS rel FROM documents JOIN rels ON i = doc_id % 21
  UNION ALL SELECT 'p' || page_id, 'doc-' || (page_id % (SELECT count(*) FROM documents)), NULL, url, NULL, 'traces_to' FROM pages
  UNION ALL SELECT 'i' || item_id, 'doc-' || (item_id % (SELECT count(*) FROM documents)), NULL, NULL, 'item-' || item_id, 'refines' FROM benchmark
)""",
    "geo": """geo AS (
  SELECT 'r-' || r_regionkey AS id, NULL AS parent_id, 'capability' AS kind, r_name AS slug FROM region
  UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey, 'business_function', n_name FROM nation
  UNION ALL SELECT 'c-' || c_custkey, 'n-' || c_nationkey, 'document', c_name FROM customer
)""",
    "files": """files AS (
  SELECT source AS archive, doc_id, lang, replace(replace(shape, '{d}', doc_id::VARCHAR), '{k}', (doc_id % 7)::VARCHAR) AS path,
         ':lang: ' || lang || chr(10) || ':source:  ' || source || ' ' || chr(10) || coalesce(text, '') || chr(10) || ':n-chars: ' || n_chars || chr(10) || ':lang: last ' || lang || chr(10) || ':no name: x' AS body
  FROM documents JOIN paths ON i = doc_id % 16
)""",
    "classified": r"""classified AS (
  SELECT *, regexp_replace(name, '\.[^.]*$', '') AS slug, nullif(regexp_extract(path, 'requirements/(business-fct-[^/]+)/', 1), '') AS fn,
         CASE WHEN regexp_matches(name, '(?i)adr-[0-9]+') THEN 'decision_record' WHEN regexp_matches(name, '(?i)risk-[0-9]+') THEN 'risk' ELSE 'document' END AS kind,
         CASE WHEN contains(path, 'requirements/') AND name = 'solution-requirements.md' THEN 'solution-requirements'
              WHEN contains(path, 'requirements/') AND name = 'data-requirements.md' THEN 'data-requirements'
              WHEN contains(path, 'requirements/') AND name = 'business-rules.md' THEN 'business-rules'
              WHEN contains(path, 'documents/01-context-and-requirements') THEN 'context-and-requirements'
              WHEN contains(path, 'documents/02-quality-attributes') THEN 'quality-attributes'
              WHEN contains(path, 'documents/03-constraints') THEN 'constraints'
              WHEN contains(path, 'documents/04-architecture-diagrams') THEN 'architecture-diagrams'
              WHEN contains(path, 'documents/05-infrastructure-costs') THEN 'infrastructure-costs'
              WHEN contains(path, 'documents/06-architectural-decisions') THEN 'architectural-decisions'
              WHEN contains(path, 'documents/07-risks-and-technical-debts') THEN 'risks-and-technical-debts'
              WHEN contains(path, '/processes/') THEN 'processes' END AS dim
  FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files)
)""",
}


def with_views(query: str, *views: str) -> str:
    """``query`` after the common table expressions it names."""
    return f"WITH RECURSIVE {', '.join(SQL[v] for v in views)}\n{query}"
