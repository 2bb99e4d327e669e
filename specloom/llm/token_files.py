"""Flat token files and a separator scan that counts their documents' tokens.

A file is a run of little-endian 16-bit token ids; the end-of-document id
follows each document and nothing says where documents start.  The last segment
of a file written here lists the doc_ids in order, as digits above the
vocabulary, so that counts can be given back to documents.

The scan cuts files into blocks, searches each block for the separator with one
vectorised comparison, and stitches segments that cross blocks by a prefix scan
over the blocks of a file: the last separator and the number of separators
before each block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .flat_files import read_files, write_records

END = 50256
#: Documents of a file; it is full at so many bytes of tokens or documents, whichever comes first.
DOCS_PER_FILE = 1 << 16
FILE_BYTES = 16 << 20
BLOCK_TOKENS = 1 << 18
#: doc_ids are written as five digits of this base, each above the vocabulary.
DIGIT_BASE, FIRST_DIGIT, N_DIGITS = 15000, 50400, 5


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_tokens(ids: list[int | None]) -> bytes:
    """The digits of the ids; a null id is the number after the largest."""
    out = []
    for i in ids:
        x = (1 << 64) if i is None else i + (1 << 63)
        for _ in range(N_DIGITS):
            x, d = divmod(x, DIGIT_BASE)
            out.append(FIRST_DIGIT + d)
    return np.array(out, "<u2").tobytes()


def token_ids(raw: bytes) -> list[int | None]:
    d = (np.frombuffer(raw, "<u2").astype(np.int64) - FIRST_DIGIT).reshape(-1, N_DIGITS).tolist()
    x = [sum(v * DIGIT_BASE**k for k, v in enumerate(row)) for row in d]
    return [None if v == 1 << 64 else v - (1 << 63) for v in x]


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, docs_per_file: int = DOCS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Tokenize ``docs`` (doc_id, text) into flat files under ``path``, in the order of its partitions.

    A file is two records, its documents with a separator between any two, and
    their ids; it is over ``file_bytes`` only by its last document.  A null or
    empty text is a document of no tokens; a null doc_id is kept; repeated rows
    are documents each; other columns are ignored; an empty table makes no
    records.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, between = load_encoding(vocabulary).encode_ordinary, np.array([END], "<u2").tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def file() -> Iterator[pa.RecordBatch]:
            nonlocal ids, held, size
            for record in (between.join(held), id_tokens(ids)):
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["tokens"])
            ids, held, size = [], [], 0

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                held.append(np.array(encode(text), "<u2").tobytes() if text else b"")
                ids.append(i)
                size += len(held[-1]) + len(between)
                if len(ids) == docs_per_file or size >= file_bytes:
                    yield from file()
        if ids:
            yield from file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "tokens binary")
    write_records(rows, "tokens", np.array([END], "<u2").tobytes(), path, 2)


_BLOCK = "shard long, block long, n_seps long, last_sep long, seps array<long>, high binary"


def _scan(block_tokens: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seps, last, high = [], [], []
            for no, raw in zip(batch.column("block").to_pylist(), batch.column("raw"), strict=True):
                t = np.frombuffer(raw.as_buffer(), "<u2")
                at = np.flatnonzero(t == end) + no * block_tokens
                seps.append(at)
                last.append(int(at[-1]) if len(at) else None)
                high.append(t[t >= FIRST_DIGIT].tobytes())
            n = pa.array([len(x) for x in seps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), n, pa.array(last, pa.int64()), pa.array(seps, pa.list_(pa.int64())), pa.array(high, pa.binary())], names=["shard", "block", "n_seps", "last_sep", "seps", "high"])

    return run


def scan_separators(spark: SparkSession, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Segments (shard, ordinal, n_tokens) of the files under ``path``, and the blocks they came from.

    A file is read by one task, so files should be of a bounded size, as those
    written here are.  Files are scanned once: the blocks are written, without
    their tokens.  Two separators in a row enclose a document of no tokens;
    tokens after a file's last separator are not a document; no files give no
    rows.
    """
    size = 2 * block_tokens
    files = read_files(spark, path).filter("length > 0")
    blocks = files.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size).cast("long"))).alias("block"))
    raw = blocks.select("shard", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("raw"))
    scanned = written(raw.mapInArrow(_scan(block_tokens, end), _BLOCK))
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = scanned.withColumns({"before": F.coalesce(F.max("last_sep").over(earlier), F.lit(-1)), "ordinal": F.coalesce(F.sum("n_seps").over(earlier), F.lit(0))})
    lengths = F.zip_with("seps", F.concat(F.array("before"), F.slice("seps", 1, F.greatest(F.lit(0), F.size("seps") - 1))), lambda s, b: s - b - 1)
    found = stitched.filter("n_seps > 0").select("shard", "ordinal", F.posexplode(lengths).alias("i", "n_tokens"))
    return found.select("shard", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens"), scanned


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, parts in zip(batch.column("shard").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            ids = token_ids(b"".join(p["high"] for p in parts))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())], names=["shard", "ordinal", "doc_id"])


def count_tokens(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens per row of ``docs``: written as flat files, then counted by the separator scan.

    An empty table gives no rows; a null doc_id comes back null; repeated rows
    are counted each.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_token_files(docs, path, vocabulary)
    segments, blocks = scan_separators(spark, path)
    listed = blocks.filter(F.length("high") > 0).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("block", "high"))).alias("parts"))
    ids = listed.mapInArrow(_ids, "shard long, ordinal long, doc_id long")
    return segments.join(ids, ["shard", "ordinal"]).select("doc_id", "n_tokens")


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
