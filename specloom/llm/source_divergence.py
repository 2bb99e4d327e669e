"""How far the word use of each language's sources differs, source against source and term by term.

Terms are found on bytes: texts lie one after the other in a UTF-8 buffer, a
lookup table lower-cases A-Z and clears whatever separates terms, and the
places where the cleared bytes begin and end are the terms' boundaries.  Slices
are grouped by their xxHash and every slice is compared byte by byte with the
first of its group, so that a collision can't join two terms.

Shares are whole numbers in units of 1e-9, so sums are exact in any order.
For the pairs, the kept terms of a language are dealt out into blocks; a block
is a CSR matrix of sources and terms, in which a source's distance from all
others takes one pass over the stored entries (``reduceat`` a row), as all
terms that a source lacks have the same share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Fixed values of the audit.
MIN_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP_TERMS = 50
#: Bytes of text that a task tokenizes at once, and entries of a block.
PIECE_BYTES = 16 << 20
BLOCK_ENTRIES = 50_000

#: What each byte becomes: 0 for a separator, else the byte in lower case.
LOOKUP = np.arange(256, dtype=np.uint8)
LOOKUP[: 0x41] = LOOKUP[0x5B:0x61] = LOOKUP[0x7B:0x80] = 0
LOOKUP[0x41:0x5B] += 32

_COUNTS = "lang string, source string, term string, n long, n_docs long"


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with its bytes looked up, and of each term in it start, end and number of the text.

    ``offsets`` are those of the texts; a term ends with its text.
    """
    low = LOOKUP[data]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    inside = low != 0
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(low)]))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[: len(low)])) + 1
    return low.tobytes(), starts, ends, np.searchsorted(offsets, starts, "right") - 1


def group_slices(buffer: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """Number of each slice's term, and the terms, exact whatever the digests."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    hashes = np.fromiter(map(digest, map(buffer.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    number, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(starts))[::-1]
    terms = [buffer[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    data, sizes, like = np.frombuffer(buffer, np.uint8), ends - starts, first[number]
    odd = sizes != sizes[like]
    check = np.flatnonzero(~odd & (like != np.arange(len(starts))))
    for at in np.array_split(check, len(check) // (1 << 19) + 1):  # in steps, as each byte has an index
        if len(at):
            n = sizes[at]
            begins = np.cumsum(n) - n
            inner = np.arange(n.sum())
            same = data[np.repeat(starts[at] - begins, n) + inner] == data[np.repeat(starts[like[at]] - begins, n) + inner]
            odd[at] = ~np.logical_and.reduceat(same, begins)
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        number[i] = more.setdefault(buffer[starts[i] : ends[i]], len(terms) + len(more))
    return number, terms + list(more)


def _piece(texts: list[pa.StringArray], langs: list[str], sources: list[str]) -> pa.RecordBatch:
    """Counts of one piece: a row per (lang, source, term), and one without a term per (lang, source)."""
    whole = pa.concat_arrays(texts).cast(pa.large_string())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    buffer, starts, ends, text = term_slices(data, offsets - offsets[0])
    number, terms = group_slices(buffer, starts, ends)
    groups: dict[tuple[str, str], int] = {}
    of = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
    width = max(1, len(terms))
    code, keys = pd.factorize(of[text] * width + number)
    n = np.bincount(code, minlength=len(keys))
    n_docs = np.bincount(code[~pd.Series(text * width + number).duplicated().to_numpy()], minlength=len(keys))
    names = list(groups)
    at = np.concatenate([keys // width, np.arange(len(groups))]).tolist()
    words = [terms[i].decode("utf-8", "surrogatepass") for i in (keys % width).tolist()] + [None] * len(groups)
    zero = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i][0] for i in at], pa.string()), pa.array([names[i][1] for i in at], pa.string()), pa.array(words, pa.string()), pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([n_docs, zero]))],
        names=["lang", "source", "term", "n", "n_docs"],
    )


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, langs, sources, held = [], [], [], 0
    for b in batches:
        column = b.column("text")
        lengths = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            # as many texts as fit, one at least
            base = lengths[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(lengths, base + PIECE_BYTES - held, "right")))
            texts.append(column.slice(at, upto - at))
            langs += b.column("lang").slice(at, upto - at).to_pylist()
            sources += b.column("source").slice(at, upto - at).to_pylist()
            held += int(lengths[upto - 1] - base)
            at = upto
            if held >= PIECE_BYTES or at < b.num_rows:
                yield _piece(texts, langs, sources)
                texts, langs, sources, held = [], [], [], 0
    if texts:
        yield _piece(texts, langs, sources)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs: occurrences and documents; a row with a null term for each (lang, source)."""
    none = F.lit("")
    rows = docs.select(F.coalesce("text", none).alias("text"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"))
    return rows.mapInArrow(_tokenize, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(1e9 * (n + 5) / (total + 5 * v)), exact; null where no term is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(SCALE).cast("decimal(10,0)") * whole(n + PRIOR), whole(total + PRIOR * v)
    return F.when(v > 0, 1 + F.call_function("div", above, below)).cast("long")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value of one block: for each pair of sources the sum over the block's terms.

    The rows have the stored shares of sources (source, term, p) and, with a
    null term, each source of the language with the share of a term it lacks.
    """
    rows = pa.Table.from_batches(list(batches))
    lang = rows.column("lang")[0].as_py()
    known = pc.is_valid(rows.column("term"))
    lacking, stored = rows.filter(pc.invert(known)).sort_by("source"), rows.filter(known)
    names = lacking.column("source").combine_chunks()
    p0 = lacking.column("p").fill_null(0).to_numpy()
    s = len(names)
    row = pc.index_in(stored.column("source"), names).to_numpy()
    coded = stored.column("term").combine_chunks().dictionary_encode()
    col, width = coded.indices.to_numpy(), len(coded.dictionary)
    order = np.lexsort([col, row])
    data, col = stored.column("p").to_numpy()[order], col[order]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=s))])
    full = np.flatnonzero(np.diff(indptr))  # reduceat gives an empty row what isn't its
    lacked = np.repeat(p0, np.diff(indptr))
    for i in range(s):
        p = np.full(width, p0[i], np.int64)
        own = slice(indptr[i], indptr[i + 1])
        p[col[own]] = data[own]
        # all terms as if the other source lacked them: a sum over sorted shares, for every source at once
        up = np.sort(data[own])
        sums = np.concatenate([[0], np.cumsum(up)])
        k = np.searchsorted(up, p0)
        value = p0 * k - sums[k] + (sums[-1] - sums[k]) - p0 * (len(up) - k) + (width - len(up)) * np.abs(p0 - p0[i])
        # then what the other's stored terms change
        if len(full):
            mine = p[col]
            value[full] += np.add.reduceat(np.abs(data - mine) - np.abs(lacked - mine), indptr[full])
        others = pa.array(np.delete(np.arange(s), i))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (s - 1), pa.string()), pa.array([names[i].as_py()] * (s - 1), pa.string()), names.take(others).cast(pa.string()), pa.array(np.delete(value, i))], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance of each other source of the language, all of
    them.  Part ``term``: the ``top_terms`` terms that the source uses most
    beyond the language's own share.  Terms count if at least ``min_docs`` rows
    of the language hold them.

    A null text, lang or source counts as an empty string; a row is a document,
    so repeated rows count as often as they occur; ties are ranked by the
    item's bytes; a source without terms has its pairs; a language with one
    source has no rows, as has an empty table; other columns play no part.
    """
    counts = written(term_counts(docs))
    same = W.partitionBy("lang", "term")
    kept = counts.filter("term IS NOT NULL").withColumns({"lang_docs": F.sum("n_docs").over(same), "lang_n": F.sum("n").over(same), "is_first": F.min("source").over(same) == F.col("source")})
    kept = written(kept.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "is_first"))
    of_lang = kept.groupBy("lang").agg(F.count_if("is_first").alias("v"), F.sum("n").alias("lang_total"), F.ceil(F.count(F.lit(1)) / block_entries).alias("n_blocks"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    groups = written(groups.fillna(0, ["v", "lang_total", "total"]).fillna(1, ["n_blocks"]))
    drop = kept.join(groups, ["lang", "source"])
    shared = drop.select("lang", "source", "term", F.pmod(F.xxhash64("term"), "n_blocks").alias("block"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))

    lacking = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), share(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    blocks = shared.drop("q").unionByName(lacking)
    pairs = blocks.groupBy("lang", "block").applyInArrow(_distances, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = shared.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(cols).unionByName(terms.select(cols))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(ts) AS term FROM docs
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), lang_sums AS (
  SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS total FROM kept GROUP BY lang
), group_sums AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM group_sums g JOIN kept k ON k.lang = g.lang JOIN lang_sums l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term
         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL
  SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
