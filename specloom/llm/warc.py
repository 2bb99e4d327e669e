"""WARC archives of captures, and a globally ordered capture index.

Archives are files of one gzip member a record, written by Spark's own writer;
the separator it puts after a record is an empty gzip member, which any reader
skips.  Reading an archive gives its captures as a run sorted by URL key and
timestamp.  While there are more than ``FAN_IN`` runs, passes merge groups of
about as many into one longer run each.  The last runs are cut at common range
boundaries into small sorted blocks; each range is then merged, so that all
ranges together are one ordered index.  Every merge is a loser tree over
streamed blocks that holds about one block of each of its runs, whatever their
length.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .flat_files import read_files, write_records

#: Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 1000
#: An archive has at most so many records, and over so many compressed bytes only by its last one.
RECORDS_PER_FILE, FILE_BYTES = 8192, 32 << 20
BLOCK_ENTRIES = 64
#: Runs that a merge takes at once, or about as many.
FAN_IN = 64
CAPTURES_PER_RANGE = 500_000
#: Ranges at most; beyond that they grow, as each is streamed.  The driver gets SAMPLED keys for them at any size.
MOST_RANGES, SAMPLED = 4096, 200_000
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, lower case, without scheme, www, port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){u.path.lower() or '/'}{'?' + u.query.lower() if u.query else ''}"


def assign_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest, refers_to.

    Of equal payloads of ``min_bytes`` or more the largest page_id is stored and
    the others refer to it.  Payloads are equal if their SHA-1 and length are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # payloads meet what they refer to by their page, so that one payload of very many pages is no hot key for them
    slim = written(p.select("page_id", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= min_bytes))
    held = slim.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = slim.join(held, ["payload_digest", "payload_bytes"]).filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"), F.col("first").alias("refers_to")).distinct()
    j = p.join(again, p["page_id"].eqNullSafe(again["page"]) & (p["payload_digest"] == again["digest"]) & (p["payload_bytes"] == again["bytes"]), "left")
    return j.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    when = (EPOCH + datetime.timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {when}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """A WARC record per row of ``pages``; null html is an empty payload, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            rows = zip(*(b.column(k) for k in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True)
            for row in rows:
                held.append(_gzip(_record(*(x.as_py() for x in row))))
                size += len(held[-1])
                if len(held) == records_per_file or size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])

    write_records(assign_types(pages).mapInArrow(run, "members binary"), "members", _gzip(b""), path, 1)


def _members(data: bytes, step: int = 16384) -> Iterator[tuple[int, int, bytes]]:
    """offset, length, content of the gzip members of a file that aren't empty."""
    view, start = memoryview(data), 0
    while start < len(data):
        z, at, parts = zlib.decompressobj(31), start, []
        while not z.eof:
            if at >= len(data):
                raise ValueError(f"gzip member at {start} is cut off")
            parts.append(z.decompress(view[at : at + step]))
            at += step
        end = min(at, len(data)) - len(z.unused_data)
        if content := b"".join(parts):
            yield start, end - start, content
        start = end


def _parse(record: bytes) -> tuple:
    """page_id, url, date, type, payload bytes, SHA-1 in hex, refers_to."""
    head, _, block = record.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: None if urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
    said = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    refers = None
    if h["WARC-Type"] == "revisit":
        refers = number(h["WARC-Refers-To"])
    elif (len(payload), hashlib.sha1(payload).hexdigest()) != (n, said):
        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
    return number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Date"], h["WARC-Type"], n, said, refers


_ENTRY = pa.struct(
    [("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)
_ENTRY_DDL = "url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, shard long, offset long, length long"


def _key(e: dict) -> tuple:
    """Order of the index: URL key, time, then page (null first) and place."""
    return e["url_key"], e["ts"], e["page_id"] is not None, e["page_id"] or 0, e["shard"], e["offset"]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under ``path``; those of an archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                entries = []
                for offset, length, record in _members(data.as_py()):
                    page, url, date, kind, n, digest, refers = _parse(record)
                    entries.append({"url_key": url_key(url), "ts": date, "page_id": page, "url": url, "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to": refers, "shard": shard, "offset": offset, "length": length})
                entries.sort(key=_key)
                yield pa.RecordBatch.from_struct_array(pa.array(entries, _ENTRY))

    return read_files(spark, path).filter("length > 0").select("shard", "content").mapInArrow(run, _ENTRY_DDL).withColumn("run", F.col("shard"))


class LoserTree:
    """Smallest head of k sorted runs: inner nodes keep the loser of their match.

    A run without a head plays as infinity.  After the winner's head changes,
    only the matches on its path are played again.
    """

    def __init__(self, heads: list[tuple | None]):
        self.heads, self.k = heads, len(heads)
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def replace(self, head: tuple | None) -> None:
        """Give the winner's run its next head."""
        run = self.winner
        self.heads[run] = head
        node = (run + self.k) // 2
        while node >= 1 and self.k > 1:
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.winner = run


def _cut(boundaries: list[tuple], size: int, groups: int = 0):
    """Sorted runs to blocks of at most ``size`` entries, none across a boundary; a range's first block of a run is marked.

    With ``groups`` a run belongs to one of so many instead of ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        at: tuple | None = None  # range and run of the block
        # a run that two tasks read is two runs
        number, run_id = TaskContext.get().partitionId() << 32, None
        rows: list[tuple] = []
        opening, n = True, 0
        # a block is needed when the entry before it has been merged: that entry's key is its place
        before: tuple = ("", "", None)

        def close(last: bool) -> None:
            nonlocal block, opening, n, before
            if block:
                rows.append((at[0], at[1], opening, last, *before, n, block))
                before = block[-1]["url_key"], block[-1]["ts"], block[-1]["page_id"]
                opening, block, n = last, [], n + 1

        def flush() -> pa.RecordBatch:
            nonlocal rows
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(9)]
            rows = []
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(_ENTRY)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["range_id", "run", "opening", "last", "k", "t", "p", "block", "entries"])

        for b in batches:
            for e in _lazily(b, 512):
                # equal pages aren't told apart by a boundary
                if e["run"] != run_id:
                    number, run_id = number + 1, e.pop("run")
                else:
                    del e["run"]
                here = (run_id % groups if groups else bisect_left(boundaries, _key(e)[:4]), number)
                if here != at:
                    close(True)
                    at = here
                elif len(block) == size:
                    close(False)
                block.append(e)
            yield flush()
        close(True)
        yield flush()

    return run


def _lazily(b: pa.RecordBatch, step: int) -> Iterator[dict]:
    """Rows of a batch as dicts, ``step`` of them at a time; the rest stays Arrow."""
    for i in range(0, b.num_rows, step):
        yield from b.slice(i, step).to_pylist()


def _merge(batches: Iterator[pa.RecordBatch], watch: Callable[[int], None] = lambda n: None) -> Iterator[pa.RecordBatch]:
    """Merge each range's blocks.  First blocks of all runs come first, the others in the order in which they are needed.

    ``watch`` is told how many entries are held whenever there are more.
    """
    stream = (row for b in batches for row in _lazily(b, 1))
    row = next(stream, None)
    while row is not None:
        range_id, queues, more, runs, held = row["range_id"], defaultdict(deque), {}, [], 0

        def load(row: dict) -> None:
            nonlocal held
            queues[row["run"]].extend(row["entries"])  # noqa: B023
            more[row["run"]] = not row["last"]  # noqa: B023
            held += len(row["entries"])
            watch(held)

        while row is not None and row["range_id"] == range_id and row["opening"]:
            runs.append(row["run"])
            load(row)
            row = next(stream, None)
        tree = LoserTree([_key(queues[r][0]) for r in runs])
        out: list[dict] = []
        ranks: list[int] = []
        n = 0
        while tree.heads[tree.winner] is not None:
            r = runs[tree.winner]
            q = queues[r]
            out.append(q.popleft())
            held -= 1
            ranks.append(n)
            n += 1
            while not q and more[r]:  # its next block is the stream's next one, but for others that follow an equal key
                load(row)
                row = next(stream, None)
            tree.replace(_key(q[0]) if q else None)
            if len(out) >= 4096:
                yield _merged(range_id, ranks, out)
                out, ranks = [], []
        if out:
            yield _merged(range_id, ranks, out)


def _merged(range_id: int, ranks: list[int], out: list[dict]) -> pa.RecordBatch:
    b = pa.RecordBatch.from_struct_array(pa.array(out, _ENTRY))
    return pa.RecordBatch.from_arrays([pa.array([range_id] * len(out), pa.int64()), pa.array(ranks, pa.int64()), *b.columns], names=["range_id", "rank", *b.schema.names])


_BLOCKS = f"range_id long, run long, opening boolean, last boolean, k string, t string, p long, block long, entries array<struct<{_ENTRY_DDL.replace(' ', ':').replace(',:', ',')}>>"


def _merge_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The entries of each range_id in order, with their rank there."""
    dealt = blocks.repartition(n, "range_id").sortWithinPartitions("range_id", F.desc("opening"), "k", "t", "p", "run", "block")
    return written(dealt.mapInArrow(_merge, f"range_id long, rank long, {_ENTRY_DDL}"))


def longer_runs(runs: DataFrame, fan_in: int = FAN_IN, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``runs`` (entries, and ``run``) merged in passes until there are no more than about ``fan_in`` runs."""
    while (n := runs.select("run").distinct().count()) > fan_in:
        groups = -(-2 * n // fan_in)  # half of what a merge may take, as they are dealt out by hash
        blocks = runs.mapInArrow(_cut([], block_entries, groups), _BLOCKS)
        runs = _merge_blocks(blocks, groups).withColumn("run", F.xxhash64("range_id")).drop("range_id", "rank")
    return runs


def merge_runs(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE, block_entries: int = BLOCK_ENTRIES, fan_in: int = FAN_IN) -> DataFrame:
    """One index in global order: the columns of ``read_runs``, range_id, rank and position (from 0).

    ``runs`` must be written; entries of one run that a task reads in a row
    must be sorted, as those of ``read_runs`` and of a table written from it
    are.  Boundaries come from a sample of the keys of bounded number; they
    include time and page, so one URL may span ranges.  Blocks of a run that
    start with equal keys keep their order by number.
    """
    spark = runs.sparkSession
    runs = longer_runs(runs, fan_in, block_entries)
    total = runs.count()
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-total // captures_per_range)))
    keys = runs.select("url_key", "ts", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("page"))
    sample = sorted(map(tuple, keys.sample(min(1.0, min(50 * n_ranges, SAMPLED) / max(1, total)), seed=1).collect()))
    boundaries = sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)}) if sample else []
    merged = _merge_blocks(runs.mapInArrow(_cut(boundaries, block_entries), _BLOCKS), n_ranges)
    starts = merged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    # one row a range
    starts = starts.select("range_id", (F.sum("n").over(W.orderBy("range_id")) - F.col("n")).alias("start"))
    return merged.join(F.broadcast(starts), "range_id").withColumn("position", F.col("start") + F.col("rank")).drop("start")


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their runs.

    Null html is an empty payload, a null url has an empty key and sorts first,
    null page_ids sort before others of the same key and time.  Repeated rows
    are repeated records; if the largest page_id of equal payloads is repeated,
    each of its rows is a response.  An empty table gives no rows.  A record's
    date is 2024-01-01 plus page_id seconds, as pages carry none.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archives(pages, path)
    return merge_runs(written(read_runs(spark, path)))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), parts AS (
  SELECT *, regexp_extract(url, '^[a-z]+://(www\.)?([^/:?#]*)', 2) AS host,
         regexp_extract(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/?]*(/[^?]*)?(\?.+)?', 1) AS pth,
         regexp_extract(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/?]*(/[^?]*)?(\?.+)?', 2) AS query
  FROM p
), keyed AS (
  SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN pth = '' THEN '/' ELSE lower(pth) END || lower(query) AS url_key,
         max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first
  FROM parts
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM keyed
"""
