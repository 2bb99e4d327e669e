"""Exact removal of lines that several documents share.

Line hashes are dealt out by range and sorted by (hash, document, position);
each sorted partition is streamed once, and every line after the first document
of its hash is marked.  A hash may run over several partitions (a hot line can
hold a third of all rows): the rows of a partition's first document that might
continue an earlier partition's run are kept apart and settled by a minimum per
hash over those few rows.  The result is a bitmap per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS_CHARS, column_name, lower_ascii, table, written

_MARKS = "doc_null boolean, doc_id long, row_hash long, n_lines int, pos int, open boolean, h1 long, h2 long"


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with the hash that tells apart rows sharing a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """A row per line whose key has at least ``min_chars`` code points."""
    lines = _rows(docs).withColumn("lines", F.split("text", "\n", -1)).select("doc_id", "row_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = lines.select("doc_id", "row_hash", "n_lines", "pos", lower_ascii(F.btrim("line", F.lit(WS_CHARS))).alias("key"))
    return key.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), F.col("doc_id").isNull().alias("doc_null"), "doc_id", "pos", "row_hash", "n_lines"
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the lines of one sorted partition.

    Rows of a later document of a hash are marked for certain.  Rows of the
    first document of the partition's first hash are ``open``: an earlier
    partition may hold a smaller document.  The last hash is also reported once
    (``pos`` -1), so that a later partition can find its first document.
    """
    run: tuple | None = None  # h1, h2, doc_null, doc_id of the first document of the current hash
    head: tuple | None = None  # the partition's first hash

    def out(cols: list[np.ndarray | pa.Array], opened: np.ndarray) -> pa.RecordBatch:
        h1, h2, null, doc, pos, row, n = cols
        return pa.RecordBatch.from_arrays(
            [pa.array(null), pa.array(doc, mask=null), pa.array(row), pa.array(n), pa.array(pos), pa.array(opened), pa.array(h1), pa.array(h2)],
            names=["doc_null", "doc_id", "row_hash", "n_lines", "pos", "open", "h1", "h2"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, null, doc, pos, row, n = (b.column(k) for k in ("h1", "h2", "doc_null", "doc_id", "pos", "row_hash", "n_lines"))
        h1, h2, pos, row, n = (np.asarray(x) for x in (h1, h2, pos, row, n))
        null = null.to_numpy(zero_copy_only=False)
        doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.empty(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = run is None or (h1[0], h2[0]) != run[:2]
        start = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first_doc = np.where(start >= 0, doc[start], 0 if run is None else run[3])
        first_null = np.where(start >= 0, null[start], False if run is None else run[2])
        if head is None:
            head = (h1[0], h2[0])
        later = (doc != first_doc) | (null != first_null)
        opened = ~later & (h1 == head[0]) & (h2 == head[1])
        pick = later | opened
        if pick.any():
            yield out([x[pick] for x in (h1, h2, null, doc, pos, row, n)], opened[pick])
        run = (h1[-1], h2[-1], bool(first_null[-1]), int(first_doc[-1]))
    if run is not None:
        one = [np.array([x]) for x in (run[0], run[1], run[2], run[3])]
        yield out([*one, np.array([-1], np.int32), np.array([0]), np.array([0], np.int32)], np.array([True]))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits, dropped = [], []
        for n, at in zip(b.column("n_lines").to_pylist(), b.column("at"), strict=True):
            keep = np.ones(n, bool)
            keep[at.values.to_numpy(zero_copy_only=False)] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_hash"), b.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(bits, pa.binary())], names=["doc_id", "row_hash", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Bitmap of the lines to keep, for each document that loses a line.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns
    doc_id, row_hash (xxhash64 of the text), n_lines, n_dropped and keep_bitmap
    (zlib over packed bits, first line in the highest bit).  A line's key is the
    line without white space at its ends and with A-Z lower-cased; a key of at
    least ``min_chars`` code points held by two documents stays only in the
    smallest doc_id.  Null texts count as empty; a null doc_id is one document
    after all others; rows that share a doc_id count as one document, and each
    row gets the bitmap of its own text.  An empty table gives no rows.
    """
    # sized by the shuffle setting of the session; doc_id and pos break up a hot hash
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_null", "doc_id", "pos"]
    # written first: finding the ranges reads the narrow rows, not the texts, once more
    runs = written(line_hashes(docs, min_chars)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    marks = written(runs.mapInArrow(_stream, _MARKS))
    # a handful of rows for each partition: its first document of its first hash, its last hash
    edge = marks.filter("open")
    first = edge.groupBy("h1", "h2").agg(F.min(F.struct("doc_null", "doc_id")).alias("first"))
    late = (
        edge.filter("pos >= 0")
        .join(first, ["h1", "h2"])
        .filter((F.col("doc_null") != F.col("first.doc_null")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    )
    cols = ["doc_id", "row_hash", "n_lines", "pos"]
    drops = marks.filter("not open").select(cols).unionByName(late.select(cols))
    grouped = drops.groupBy("doc_id", "row_hash", "n_lines").agg(F.collect_list("pos").alias("at"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, row_hash long, n_lines int, n_dropped int, keep_bitmap binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First column the text, last the bitmap; the text loses its lines, the bitmap goes."""
    for b in batches:
        names = b.schema.names
        texts = b.column(0).to_pylist()
        for i, z in enumerate(b.column(len(names) - 1).to_pylist()):
            if z is not None:
                lines = texts[i].split("\n")
                keep = np.unpackbits(np.frombuffer(zlib.decompress(z), np.uint8), count=len(lines))
                texts[i] = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[1:-1]], names=names[:-1])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with only the lines to keep in ``text``; rows without a bitmap keep their text.

    Other columns of ``docs`` are passed on, whatever their names; with
    ``n_dropped``, a column of that name has the number of lines that went.  A
    null text stays null, an empty one empty; a null doc_id has the bitmaps of
    the null doc_id; repeated rows are cut alike; an empty table gives no rows.
    """
    key, bits, count, doc, row = (column_name(docs, x) for x in ("row_hash", "keep_bitmap", n_dropped or "n_dropped", "bitmap_doc", "bitmap_row"))
    d = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    b = bitmaps.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(row), F.col("n_dropped").cast("long").alias(count), F.col("keep_bitmap").alias(bits))
    joined = d.join(b, d["doc_id"].cast("long").eqNullSafe(b[doc]) & (d[key] == b[row]), "left").fillna(0, [count])
    rest = [c for c in docs.columns if c != "text"] + [count] * bool(n_dropped)
    slim = joined.select("text", *(f"`{c}`" for c in rest), bits)
    done = slim.mapInArrow(_kept, T.StructType(slim.schema.fields[:-1]))
    return done.select([f"`{c}`" for c in docs.columns] + [count] * bool(n_dropped))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with shared lines removed, in the same columns; nulls, repeats and ties as in ``keep_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    kept = apply_bitmaps(docs.withColumn("n_lines", n_lines), keep_bitmaps(docs), n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(f.first_doc < l.doc_id, false) AS gone
  FROM keyed l LEFT JOIN firsts f ON f.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
