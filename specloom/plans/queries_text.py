"""Registered text, path, vector and source functions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as VEC
from ..operators import tree as T
from ..sources import archive as A
from ..sources.staging import written
from . import corpus as V
from .corpus import with_views

_PATH = ("paths", "files", "classified")
_WORDS = "words AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)"


def _path(f):
    return lambda spark, d: V.files(spark, d).select("doc_id", "path", f(F.col("path")).alias("value"))


def _path_sql(column: str) -> str:
    return with_views(f"SELECT doc_id, path, {column} AS value FROM classified", *_PATH)


def adoc_attrs(spark, d):
    e = V.files(spark, d).select("doc_id", F.explode(X.attribute_entries(F.col("body"))).alias("e"))
    return e.select("doc_id", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


_ADOC_SQL = with_views(
    r""", found AS (
  SELECT doc_id, unnest(regexp_extract_all(body, '(?m)^:([\p{L}\p{N}_-]+):[ \t]*(.*)$', 1)) AS key,
         unnest(regexp_extract_all(body, '(?m)^:([\p{L}\p{N}_-]+):[ \t]*(.*)$', 2)) AS value,
         generate_subscripts(regexp_extract_all(body, '(?m)^:([\p{L}\p{N}_-]+):[ \t]*(.*)$', 1), 1) AS i
  FROM files
)
SELECT doc_id, key, trim(arg_max(value, i)) AS value FROM found GROUP BY doc_id, key""",
    "paths",
    "files",
)


def build_nodes(spark, d):
    n = T.build_nodes(V.files(spark, d), V.manifests(spark, d))
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return n.select("archive", "local_id", "kind", "slug", "parent_local_id", "dimension_code", F.sha2("body", 256).alias("body_sha256"), "source_path", attrs.alias("attrs"))


_BUILD_SQL = with_views(
    """, reached AS (SELECT * FROM classified WHERE dim IS NOT NULL AND name <> 'kb-manifest.yaml')
SELECT DISTINCT source AS archive, 'cap' AS local_id, 'capability' AS kind, 'cap-' || source AS slug, NULL::VARCHAR AS parent_local_id, NULL::VARCHAR AS dimension_code,
       NULL::VARCHAR AS body_sha256, NULL::VARCHAR AS source_path, 'category=test;domain=synthetic' AS attrs FROM documents
UNION ALL SELECT DISTINCT archive, 'bf:' || fn, 'business_function', fn, 'cap', NULL, NULL, NULL, '' FROM reached WHERE fn IS NOT NULL
UNION ALL SELECT archive, 'doc:' || path, kind, slug, coalesce('bf:' || fn, 'cap'), dim, sha256(body), path,
       CASE WHEN ends_with(path, '.adoc') THEN 'lang=last ' || lang || ';n-chars=' || (SELECT n_chars FROM documents d WHERE d.doc_id = reached.doc_id) || ';source=' || archive ELSE '' END FROM reached""",
    *_PATH,
)


def unreached_paths(spark, d):
    lost = T.unreached(V.files(spark, d))
    return lost.groupBy("archive").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"))


def kind_counts(spark, d):
    return T.build_nodes(V.files(spark, d), V.manifests(spark, d)).groupBy("archive", "kind").agg(F.count(F.lit(1)).alias("n"))


def _chunks(size: int, overlap: int):
    def run(spark, d):
        docs = V.table(spark, d, "documents")
        return docs.select("doc_id", F.posexplode(X.chunks(F.coalesce("text", F.lit("")), size, overlap)).alias("ord", "chunk_text"))

    return run


def chunks_sql(size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""WITH {_WORDS}, starts AS (
  SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {step})) AS s FROM words WHERE len(w) > 0
)
SELECT doc_id, (s // {step})::INTEGER AS ord, array_to_string(w[s + 1 : s + {size}], ' ') AS chunk_text FROM starts WHERE s = 0 OR s - {step} + {size} < len(w)"""


def chunk_counts(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", F.size(X.chunks(F.coalesce("text", F.lit("")))).alias("n_chunks"))


def hash_embed(spark, d):
    docs = V.table(spark, d, "documents")
    v = docs.select("doc_id", F.posexplode(VEC.normalize(VEC.hash_components(F.coalesce("text", F.lit("")), 8))).alias("i", "x"))
    return v.select("doc_id", "i", F.round("x", 6).alias("x"))


_HASH_SQL = """WITH c AS (
  SELECT doc_id, i, ('0x' || substr(sha256(i || ':' || coalesce(text, '')), 1, 8))::BIGINT / 2147483648.0 - 1 AS x FROM documents, range(8) r(i)
)
SELECT doc_id, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM c"""


def l2_norm(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.round(VEC.l2_norm(F.col("embedding")), 6).alias("norm"))


def vector_dim(spark, d):
    """The vectors that pass the size check, which fails the query for any other."""
    return V.table(spark, d, "embeddings").select("vec_id", F.size(VEC.checked(F.col("embedding"), 64)).alias("dim"))


def vector_literal(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", VEC.vector_literal(F.col("embedding")).alias("literal"))


def stub_embed_norm(spark, d):
    """Length of the Gaussian stand-in's vector of every chunk."""
    e = VEC.GaussianEmbedder(64)
    c = _chunks(200, 40)(spark, d).withColumn("v", VEC.embed_column(F.col("chunk_text"), e))
    return c.select("doc_id", "ord", F.size("v").alias("dim"), F.round(VEC.l2_norm(F.col("v")), 4).alias("norm"))


def utf8_repair(spark, d):
    """Texts with malformed bytes after them, decoded with replacement."""
    docs = V.table(spark, d, "documents")
    raw = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("FF")), F.lit("x").cast("binary"), F.unhex(F.lit("C3")))
    return docs.select("doc_id", F.sha2(X.decode_utf8(raw), 256).alias("body_sha256"))


#: Bytes of archives that a task hands on at once.
_ZIP_BYTES = 4 << 20
_ZIP_SCHEMA = pa.schema([("archive", pa.string()), ("content", pa.binary())])


def _zip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, held = [], 0
        for doc, source, text in zip(*b.columns, strict=True):
            doc, source, text = doc.as_py(), source.as_py(), text.as_py()
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("cap/", "")
                z.writestr("cap/kb-manifest.yaml", f"capability_slug: cap-{source}\ncategory: 'test'\ndomain: synthetic  # made up\nsource_commit: c{doc}\n")
                z.writestr(f"cap/documents/03-constraints/{doc}.md", text or "")
            out.append({"archive": f"{doc}.zip", "content": buf.getvalue()})
            held += len(out[-1]["content"])
            if held > _ZIP_BYTES:
                yield pa.RecordBatch.from_pylist(out, _ZIP_SCHEMA)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _ZIP_SCHEMA)


def archives(spark, d):
    """A ZIP archive per document, made in tasks."""
    docs = V.table(spark, d, "documents").select("doc_id", "source", "text")
    return docs.mapInArrow(_zip_rows, "archive string, content binary")


def zip_scan(spark, d):
    f = A.unzip(archives(spark, d))
    return f.select("archive", "ord", "path", F.length("body").cast("long").alias("body_chars"), F.when(F.col("ord") == 1, F.sha2("body", 256)).alias("body_sha256"))


_ZIP_SQL = """SELECT doc_id || '.zip' AS archive, 0 AS ord, 'cap/kb-manifest.yaml' AS path,
       (length('capability_slug: cap-' || source) + length('category: ''test''') + length('domain: synthetic  # made up') + length('source_commit: c' || doc_id) + 4)::BIGINT AS body_chars, NULL AS body_sha256 FROM documents
UNION ALL SELECT doc_id || '.zip', 1, 'cap/documents/03-constraints/' || doc_id || '.md', length(coalesce(text, ''))::BIGINT, sha256(coalesce(text, '')) FROM documents"""


def manifest_parse(spark, d):
    # written, as the check reads it first
    return A.require_valid(written(A.manifests(A.unzip(archives(spark, d), A.MANIFEST_FILE))))


REGISTERED = [
    ("path_basename", _path(X.basename), _path_sql("name")),
    ("path_slug", _path(X.slug), _path_sql("slug")),
    ("path_dimension", _path(X.dimension), _path_sql("dim")),
    ("path_function", _path(X.business_function), _path_sql("fn")),
    ("path_kind", _path(X.kind), _path_sql("kind")),
    ("adoc_attrs", adoc_attrs, _ADOC_SQL),
    ("build_nodes", build_nodes, _BUILD_SQL),
    ("unreached_paths", unreached_paths, with_views("SELECT archive, string_agg(path, '|' ORDER BY path) AS paths FROM classified WHERE dim IS NULL AND name <> 'kb-manifest.yaml' GROUP BY archive", *_PATH)),
    ("kind_counts", kind_counts, f"SELECT archive, kind, count(*) AS n FROM ({_BUILD_SQL}) GROUP BY archive, kind"),
    ("chunk_documents", _chunks(200, 40), chunks_sql(200, 40)),
    ("chunk_counts", chunk_counts, f"SELECT d.doc_id, count(c.doc_id)::INTEGER AS n_chunks FROM documents d LEFT JOIN ({chunks_sql(200, 40)}) c ON c.doc_id = d.doc_id GROUP BY d.doc_id"),
    ("rechunk_small", _chunks(50, 10), chunks_sql(50, 10)),
    ("hash_embed", hash_embed, _HASH_SQL),
    ("l2_norm", l2_norm, "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings"),
    ("vector_dim", vector_dim, "SELECT vec_id, len(embedding)::INTEGER AS dim FROM embeddings"),
    ("vector_literal", vector_literal, "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings"),
    ("stub_embed_norm", stub_embed_norm, None),
    ("utf8_repair", utf8_repair, "SELECT doc_id, sha256(coalesce(text, '') || chr(65533) || 'x' || chr(65533)) AS body_sha256 FROM documents"),
    ("zip_scan", zip_scan, _ZIP_SQL),
    ("manifest_parse", manifest_parse, "SELECT doc_id || '.zip' AS archive, 'cap-' || source AS capability_slug, 'test' AS category, 'synthetic' AS domain, 'c' || doc_id AS source_commit FROM documents"),
]
