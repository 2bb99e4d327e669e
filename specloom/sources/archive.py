"""ZIP archives of specification files, and their manifests."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput
from ..functions import text as X

#: Name of the file that describes an archive.
MANIFEST_FILE = X.MANIFEST_FILE
FIELDS = ("capability_slug", "category", "domain", "source_commit")


#: Bytes of files that a task hands on at once, but for a larger file.
BATCH_BYTES = 4 << 20
_ROW = pa.schema([("archive", pa.string()), ("ord", pa.int32()), ("path", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


def _files(archive: str, content: bytes, only: str | None) -> list[dict]:
    rows: dict[str, dict] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    # a repeated name keeps its first place and its last content; each file is read, as a broken one spoils the archive
                    place, body = rows[info.filename]["ord"] if info.filename in rows else len(rows), z.read(info)
                    kept = only is None or info.filename.rsplit("/", 1)[-1] == only
                    rows[info.filename] = {"archive": archive, "ord": place, "path": info.filename, "bytes": body if kept else None}
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
        return [{"archive": archive, "ord": 0, "error": f"{type(e).__name__}: {e}"}]
    return list(rows.values())


def unzip(archives: DataFrame, only: str | None = None) -> DataFrame:
    """archive, ord, path, body and error of the files in ``archives`` (archive, content).

    Bodies are UTF-8 with malformed parts replaced; with ``only``, those of
    files of another name are null.  An archive that can't be read gives one
    row with an ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for archive, content in zip(*b.columns, strict=True):
                for row in _files(archive.as_py(), content.as_py(), only):
                    out.append(row)
                    held += 200 + len(row.get("bytes") or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, _ROW)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _ROW)

    rows = archives.select("archive", "content").mapInArrow(run, "archive string, ord int, path string, bytes binary, error string")
    return rows.select("archive", "ord", "path", X.decode_utf8(F.col("bytes")).alias("body"), "error")


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Files of all ZIP archives under ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return unzip(found.select(F.col("path").alias("archive"), "content"))


try:
    import yaml
except ImportError:  # plain ``name: value`` lines can be read without it
    yaml = None


def _mapping(texts: pd.Series) -> pd.DataFrame:
    """The string values of a YAML mapping; nulls for other values, other documents and malformed ones."""
    rows = []
    for t in texts:
        try:
            doc = yaml.safe_load(t) if t is not None else None
        except yaml.YAMLError:
            doc = None
        doc = doc if isinstance(doc, dict) else {}
        rows.append([v if isinstance(v := doc.get(f), str) else None for f in FIELDS])
    return pd.DataFrame(rows, columns=list(FIELDS), dtype=object)


def _field(body: Column, name: str) -> Column:
    """Text value of a flat ``name: value`` line; null if absent or not a string."""
    raw = F.nullif(F.regexp_extract(body, rf"(?m)^{name}:[ \t]+(\S.*)$", 1), F.lit(""))
    quoted = F.coalesce(F.nullif(F.regexp_extract(raw, r'\A"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"\A'([^']*)'", 1), F.lit("")))
    plain = F.regexp_replace(raw, r"[ \t]+#.*\z|[ \t\r]+\z", "")
    other = plain.rlike(r"(?i)\A([-+]?[0-9][0-9_]*|[-+]?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?|true|false|yes|no|on|off|null|~|[\[{&*!|>%@`].*)\z")
    return F.coalesce(quoted, F.when(~raw.rlike(r"\A[\"']") & ~other, plain))


def parse_manifests(texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (archive, manifest and more) with the four fields, all required strings, in place of the manifest; ``error`` where one is missing."""
    if yaml is None:
        fields = texts.select("*", *[_field(F.col("manifest"), f).alias(f) for f in FIELDS])
    else:
        fields = texts.withColumn("_fields", F.pandas_udf(_mapping, ", ".join(f"{f} string" for f in FIELDS))("manifest")).select("*", "_fields.*").drop("_fields")
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    return fields.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("manifest lacks "), F.array_join(missing, ", "))))


def manifests(files: DataFrame) -> DataFrame:
    """Manifest row of each archive in ``files``, with an ``error`` where it can't be used.

    An archive's manifest is its first file of that name, at any depth.
    """
    named = X.basename(F.col("path")) == X.MANIFEST_FILE
    # one pass: only manifests are carried, other bodies are dropped before the shuffle
    texts = files.groupBy("archive").agg(F.max("error").alias("broken"), F.min_by(F.when(named, F.col("body")), F.when(named, F.col("ord"))).alias("manifest"), F.count_if(named).alias("n"))
    none = F.when(F.col("n") == 0, F.lit(f"{X.MANIFEST_FILE} not found"))
    return parse_manifests(texts).select("archive", *FIELDS, F.coalesce("broken", none, "error").alias("error"))


def require_valid(found: DataFrame) -> DataFrame:
    """``found`` of ``manifests`` without the error column; raises for the first bad archive."""
    bad = found.filter("error IS NOT NULL").orderBy("archive").first()
    if bad is not None:
        raise BadInput(f"{bad['archive']}: {bad['error']}")
    return found.drop("error")
