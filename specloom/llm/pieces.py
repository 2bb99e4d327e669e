"""Encoding with a merge-type SentencePiece model, with seeded merge-dropout.

Text is encoded piece by piece as the model's own encoder does: a space in
front, spaces as U+2581, the best-scored merge first (leftmost of equals), byte
pieces for characters without a piece.  Under dropout a candidate merge - two
neighbouring symbols, named by where the left one starts, the right one starts
and the right one ends in their chunk - is skipped if its keyed hash falls
below the rate.  The key is the seed, the doc_id, the number of the document's
copy and the place of the chunk in the text, so each occurrence of a word has
coins of its own, and the same call gives the same pieces.  Every segmentation
decodes to the same text; U+2581 itself is written in bytes, so that it can't
be taken for a space.

No piece has a space after its first run of spaces, so a text is cut into
chunks before spaces and around line ends, and all chunks of many documents go
through the agenda together: each round takes the best candidate of every
chunk.  What the agenda does depends only on which of the candidates it comes
to are skipped.  Its runs are remembered by chunk and skipped candidates, and
an occurrence follows the run of its own coins: they choose among the runs, so
that the outcome is that of an agenda for each occurrence.  Long chunks have an
agenda (a heap) each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_name, table
from .shingles import mixed

SPACE = "▁"
CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Below 128, as places in a chunk are kept in 7 bits.
LONG_CHUNK = 64
#: Bytes of text, or of ids, that a task works on at once; one row at least.
BYTES_AT_ONCE = 1_000_000
#: Runs of the agenda that are remembered; beyond that, all are forgotten and found again.
MOST_RUNS = 250_000
_M = (1 << 64) - 1
_NONE = np.int64(1) << 40
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Symbols from here on are characters without a piece.
_CHAR = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables of a model: characters to symbols, pairs of symbols to their merge, pieces to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = [0] * 256
        self.bytes_of: list[bytes] = []
        ids: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                ids[p] = i
                self.bytes_of.append(p.replace(SPACE, " ").encode())
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("the model has pieces that cross spaces or line ends")
        # pieces in the order in which they are merged
        self.rank_of = np.zeros(n, np.int64)
        for rank, i in enumerate(sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))):
            self.rank_of[i] = rank
        self.char = np.arange(_CHAR, _CHAR + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")], self.char[ord(SPACE)] = ids[SPACE], _CHAR + ord(SPACE)
        for b in range(128):  # one-byte characters without a piece
            if self.char[b] >= _CHAR:
                self.char[b] = self.byte_id[b]
        self.merge = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self._table()

    def _table(self) -> None:
        """The merges as an open-addressing table of numpy arrays."""
        self.mask = (1 << max(4, (4 * len(self.merge)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        key = np.array([(a << 32) | b for a, b in self.merge], np.int64)
        value = np.array(list(self.merge.values()), np.int64)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = key[free], value[free]  # of several, the last one stays
            lost = self.keys[at] != key
            key, value, at = key[lost], value[lost], (at[lost] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _C[0]) >> np.uint64(40)).astype(np.int64) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, -1 where they don't merge."""
        key = (left << 32) | right
        at = self._slot(key)
        out, open_ = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(open_):
            k = self.keys[at[open_]]
            hit = k == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


def _candidate(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of a candidate merge by its places in the chunk."""
    return mixed(mixed(mixed(start.astype(np.uint64) * _C[0]) + mid.astype(np.uint64) * _C[1]) + end.astype(np.uint64) * _C[2])


def _skipped(key: np.ndarray, candidate: np.ndarray, rate: float) -> np.ndarray:
    """The coin of each occurrence's key for a candidate's hash."""
    return (mixed(mixed(key + candidate)) >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def _agenda(sym: np.ndarray, key: np.uint64, rate: float, p: Pieces) -> np.ndarray:
    """Symbols of one chunk by a heap of candidates; merged ones are -1 but for their first place."""
    sym, n = sym.tolist(), len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def candidate(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (m := p.merge.get((sym[i], sym[j]))) is not None:
            heapq.heappush(heap, (int(p.rank_of[m]), i, j, after[j], m))

    for i in range(n):
        candidate(i)
    one = lambda x: np.array([x])
    skip = lambda i, j, end: _skipped(one(key), _candidate(one(i), one(j), one(end)), rate)[0]
    while heap:
        _, i, j, end, m = heapq.heappop(heap)
        if sym[i] < 0 or sym[j] < 0 or after[i] != j or after[j] != end:
            continue
        if rate > 0 and skip(i, j, end):
            continue
        sym[i], sym[j], after[i] = m, -1, end
        if end < n:
            before[end] = i
        candidate(i)
        if before[i] >= 0:
            candidate(before[i])
    return np.array(sym, np.int64)


def _rounds(sym: np.ndarray, lens: np.ndarray, skipped: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many chunks at once, in place of their characters, and the merges done: chunk and candidate, by chunk.

    ``skipped`` has the candidates skipped, sorted: the chunk's number shifted by 21 bits, and three places of 7 bits.
    """
    merges: list[np.ndarray] = []
    out = np.full(len(sym), -1, np.int64)
    word = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(sym))
    first = np.cumsum(lens) - lens
    limit = first + lens

    def code(a: np.ndarray) -> np.ndarray:
        """The candidates of the symbols a with their right neighbours."""
        k = np.minimum(a + 2, len(sym) - 1)
        end = np.where((a + 2 < len(sym)) & (word[k] == word[a]), place[k], limit[word[a]])
        base = first[word[a]]
        return (word[a] << 21) | ((place[a] - base) << 14) | ((place[a + 1] - base) << 7) | (end - base)

    def rank(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge and priority of the symbols i with their right neighbours."""
        j = np.minimum(i + 1, len(sym) - 1)
        w = word[i]
        m = np.where((i + 1 < len(sym)) & (word[j] == w), p.merged(sym[i], sym[j]), -1)
        ok = m >= 0
        if len(skipped) and ok.any():
            c = code(i[ok])
            drop = skipped[np.minimum(np.searchsorted(skipped, c), len(skipped) - 1)] == c
            ok[np.flatnonzero(ok)[drop]] = False
        return m, np.where(ok, p.rank_of[np.maximum(m, 0)], _NONE)

    if not len(sym):
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece, prio = rank(np.arange(len(sym)))
    while len(sym):
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(prio, new)
        size = np.diff(np.append(new, len(sym)))
        open_ = np.repeat(least < _NONE, size)
        out[place[~open_]] = sym[~open_]
        if not open_.any():
            break
        # the leftmost of the best candidates of each open chunk
        best = np.flatnonzero(open_ & (prio == np.repeat(least, size)))
        best = best[np.concatenate(([True], word[best][1:] != word[best][:-1]))]
        merges.append(code(best))
        sym[best] = piece[best]
        keep = open_
        keep[best + 1] = False
        at = np.cumsum(keep)[best] - 1
        sym, word, place, piece, prio = sym[keep], word[keep], place[keep], piece[keep], prio[keep]
        again = np.concatenate((at, at[at > 0] - 1))
        piece[again], prio[again] = rank(again)
    done = np.concatenate(merges or [np.zeros(0, np.int64)])
    done = done[np.argsort(done >> 21, kind="stable")]
    return out, done >> 21, done & ((1 << 21) - 1)


def _spelled(done: np.ndarray, lens: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of chunks in a row, and how many each has; a character without a piece takes the place of its bytes."""
    n_ids = (done >= 0).astype(np.int64)
    lacking = np.flatnonzero(done >= _CHAR)
    spelled = [[p.byte_id[b] for b in chr(x).encode()] for x in (done[lacking] - _CHAR).tolist()]
    n_ids[lacking] = [len(x) for x in spelled]
    flat = np.repeat(done, n_ids)
    if spelled:
        at = (np.cumsum(n_ids) - n_ids)[lacking]
        n = n_ids[lacking]
        flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate(spelled)
    return flat.astype(np.int32), np.add.reduceat(n_ids, np.cumsum(lens) - lens)


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.all, self.n = np.zeros(1024, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            self.all = np.concatenate((self.all[: self.n], np.zeros(max(self.n, len(x)), self.all.dtype)))
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)


class Runs(dict):
    """Runs of the agenda: number of each short chunk's run without a skip, and all runs by number.

    A run has the candidates that it comes to after the last one skipped, in
    turn, its piece ids, and for each candidate the run that skips it (-1: not
    known yet).
    """

    def __init__(self, p: Pieces):
        super().__init__()
        self.p, self.waiting = p, []
        self.chunks: list[str] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chunks.clear()
        self.waiting.clear()
        self.n_runs = 0
        self.chunk, self.above, self.skip, self.depth = _Column(np.int32), _Column(np.int32), _Column(np.int32), _Column(np.int32)
        self.first, self.size, self.ids_at, self.n_ids = _Column(np.int64), _Column(np.int32), _Column(np.int64), _Column(np.int32)
        self.code, self.candidate, self.owner, self.below, self.ids = _Column(np.int32), _Column(np.uint64), _Column(np.int32), _Column(np.int32), _Column(np.int32)

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = self.n_runs + len(self.waiting)
        self.waiting.append(len(self.chunks))
        self.chunks.append(chunk)
        return n

    def settle(self) -> None:
        """Find the runs of the new chunks."""
        w, none = np.array(self.waiting, np.int32), np.full(len(self.waiting), -1, np.int32)
        self.waiting = []
        self._find(w, none, none, np.zeros(len(w), np.int32))

    def _find(self, chunk: np.ndarray, above: np.ndarray, skip: np.ndarray, depth: np.ndarray) -> None:
        """New runs: of a chunk, below another run, with one more candidate skipped after ``depth`` merges."""
        if not len(chunk):
            return
        texts = [self.chunks[c] for c in chunk.tolist()]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        number, run, skipped, last = np.arange(len(chunk)), above, [], skip
        while len(number := number[(has := run >= 0)]):
            run, last = run[has], last[has]
            skipped.append((number << 21) | last)
            run, last = self.above.all[run], self.skip.all[run]
        done, of, code = _rounds(self.p.char[cp], lens, np.sort(np.concatenate(skipped or [np.zeros(0, np.int64)])), self.p)
        n = np.bincount(of, minlength=len(chunk))
        code = code[np.arange(len(of)) - (np.cumsum(n) - n)[of] >= depth[of]]
        n = n - depth
        flat, n_ids = _spelled(done, lens, self.p)
        self.first.add(self.code.n + np.cumsum(n) - n)
        self.ids_at.add(self.ids.n + np.cumsum(n_ids) - n_ids)
        self.owner.add(np.repeat(self.n_runs + np.arange(len(chunk)), n))
        self.candidate.add(_candidate(code >> 14, (code >> 7) & 127, code & 127))
        for column, x in ((self.chunk, chunk), (self.above, above), (self.skip, skip), (self.depth, depth), (self.size, n), (self.n_ids, n_ids), (self.code, code), (self.below, np.full(len(code), -1)), (self.ids, flat)):
            column.add(x)
        self.n_runs += len(chunk)

    def follow(self, run: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """The run that each occurrence comes to by the coins of its key, from its chunk's run without a skip."""
        run = run.copy()
        open_ = np.arange(len(run)) if rate > 0 else np.zeros(0, np.int64)
        while len(open_):
            n = self.size.all[run[open_]]
            of = np.repeat(np.arange(len(open_)), n)
            step = np.arange(len(of)) + np.repeat(self.first.all[run[open_]] - (np.cumsum(n, dtype=np.int64) - n), n)
            hit = np.flatnonzero(_skipped(keys[open_][of], self.candidate.all[step], rate))
            hit = hit[np.diff(of[hit], prepend=-1) > 0]
            open_, step = open_[of[hit]], step[hit]
            lacking = np.unique(step[self.below.all[step] < 0])
            owner = self.owner.all[lacking]
            self.below.all[lacking] = self.n_runs + np.arange(len(lacking))
            self._find(self.chunk.all[owner], owner, self.code.all[lacking], self.depth.all[owner] + (lacking - self.first.all[owner]).astype(np.int32))
            run[open_] = self.below.all[step]
        return run


def segment(chunks: list[str], keys: np.ndarray, rate: float, p: Pieces, runs: Runs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all chunks in a row, and how many each has; ``keys`` has a 64-bit key for each.

    ``runs`` are those known from earlier calls, and get new ones.
    """
    if not chunks:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    runs = Runs(p) if runs is None else runs
    if runs.n_runs > MOST_RUNS:
        runs.forget()
    long = [k for k, c in enumerate(chunks) if len(c) > LONG_CHUNK]
    if long:
        short = np.array([len(c) <= LONG_CHUNK for c in chunks])
        number = np.zeros(len(chunks), np.int64)
        number[short] = [runs[c] for c in chunks if len(c) <= LONG_CHUNK]
    else:
        short, number = slice(None), np.fromiter(map(runs.__getitem__, chunks), np.int64, len(chunks))
    runs.settle()
    run = runs.follow(number[short], keys[short], rate)
    n, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    n[short], starts[short] = runs.n_ids.all[run], runs.ids_at.all[run]
    more, at = [runs.ids.all[: runs.ids.n]], runs.ids.n
    plain: dict[str, np.ndarray] = {}
    for k in long:
        got = plain.get(chunks[k])
        if got is None:
            sym = p.char[np.frombuffer(chunks[k].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)]
            got = _spelled(_agenda(sym, keys[k], rate, p), np.array([len(sym)]), p)[0]
            if rate <= 0:
                plain[chunks[k]] = got
        n[k], starts[k] = len(got), at
        more.append(got)
        at += len(got)
    flat = np.concatenate(more) if long else more[0]
    return flat[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)], n


def _document_key(doc: int | None, text: str, seed: int, copy: int) -> int:
    """A document's key; the text stands for a null doc_id."""
    name = f"t{xxhash.xxh3_64_intdigest(text.encode('utf-8', 'surrogatepass'))}" if doc is None else f"d{doc}"
    return xxhash.xxh3_64_intdigest(f"{seed}:{copy}:{name}".encode())


def encode_texts(rows: list[tuple[int | None, str | None]], p: Pieces, rate: float, seed: int, copies: int | Sequence[int] = 0, runs: Runs | None = None) -> list[np.ndarray | None]:
    """Piece ids of (doc_id, text) rows; ``copies`` has the number of each row's copy, or one for all."""
    chunks: list[str] = []
    keys: list[int] = []
    sizes: list[int] = []
    for (doc, text), copy in zip(rows, np.broadcast_to(copies, len(rows)).tolist(), strict=True):
        own = CHUNK.findall(" " + text) if text else []
        chunks += own
        sizes.append(len(own))
        keys.append(_document_key(doc, text, seed, copy) if own and rate > 0 else 0)
    n_chunks = np.array(sizes, np.int64)
    ends = np.cumsum(n_chunks)
    place = np.arange(len(chunks)) - np.repeat(ends - n_chunks, n_chunks)
    flat, lens = segment(chunks, mixed(np.repeat(np.array(keys, np.uint64), n_chunks) + place.astype(np.uint64) * _C[1]), rate, p, runs)
    total = np.concatenate(([0], np.cumsum(lens)))
    return [None if text is None else flat[total[e - n] : total[e]] for (_, text), n, e in zip(rows, sizes, ends.tolist(), strict=True)]


def _parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of its rows."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _encoder(names: list[str], rate: float, seed: int, copy: str | None, model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """For a task: slices of its batches, their piece ids by row, and the model's tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None], Pieces]]:
        p = Pieces(model)
        runs = Runs(p)
        doc, text = names.index("doc_id"), names.index("text")
        for batch in batches:
            for part in _parts(batch, pc.binary_length(batch.column(text))):
                number = part.column(names.index(copy)).to_pylist() if copy else 0
                rows = list(zip(part.column(doc).to_pylist(), part.column(text).to_pylist(), strict=True))
                yield part, encode_texts(rows, p, rate, seed, number, runs), p

    return run


def _id_lists(got: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in got]))).astype(np.int32)
    flat = np.concatenate([x for x in got if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in got]))


def decode_ids(ids: np.ndarray | None, p: Pieces) -> str | None:
    """Text of the piece ids of one text; the space put in front is taken off."""
    return None if ids is None else b"".join(map(p.bytes_of.__getitem__, ids.tolist()))[1:].decode()


def _free(df: DataFrame, *names: str) -> None:
    for n in names:
        if column_name(df, n) != n:
            raise ValueError(f"there is a column {n} already")


def encode(docs: DataFrame, ids: str = "ids", rate: float = 0.1, seed: int = 1, copy: str | None = None, model: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in a new array column.

    ``rate`` 0 gives the model's own segmentation.  A null text has null ids, an
    empty one none; rows with the same doc_id and text get the same ids, unless
    ``copy`` names a column that numbers them; the text stands for a null
    doc_id; other columns pass through, and one that is called as ``ids`` is a
    ValueError; an empty table gives no rows.
    """
    _free(docs, ids)
    names = docs.columns
    encoder = _encoder(names, rate, seed, copy, model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got, _ in encoder(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, _id_lists(got)], names=[*names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """``encoded`` with the text of the piece ids in place of them.

    Null ids give a null text, no ids an empty one; other columns pass through,
    and one that is called as ``text`` is a ValueError; an empty table gives no
    rows.
    """
    model = model or default_model()
    _free(encoded.drop(ids), text)
    names = encoded.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model)
        for batch in batches:
            for part in _parts(batch, pc.multiply(pc.list_value_length(batch.column(at)), 4)):
                out = [decode_ids(x.values.to_numpy(zero_copy_only=False) if x.is_valid else None, p) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *part.columns[at + 1 :], pa.array(out, pa.string())], names=[*names[:at], *names[at + 1 :], text])

    fields = [f for f in encoded.schema.fields if f.name != ids]
    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType())]))


def encode_and_check(docs: DataFrame, ids: str = "ids", rate: float = 0.1, seed: int = 1, copy: str | None = None, model: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with ids, n_tokens, decoded_sha256 and lossless: encoded, and decoded in the same step.

    A task has one process with the model's tables, and neither the ids nor the
    decoded text are sent through another one.  ``lossless`` compares the
    decoded text with the text.  A null text has null ids, no tokens and a null
    digest, and is lossless; an empty one has no ids.  Repeated rows, null
    doc_ids, clashing names and empty tables are as in ``encode``.
    """
    more = ["n_tokens", "decoded_sha256", "lossless"]
    _free(docs, ids, *more)
    names = docs.columns
    rest = [c for c in names if c != "text"]
    encoder = _encoder(names, rate, seed, copy, model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got, p in encoder(batches):
            sha, same = [], []
            for x, text in zip(got, part.column(names.index("text")).to_pylist(), strict=True):
                back = decode_ids(x, p)
                sha.append(None if back is None else hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            n = pa.array([0 if x is None else len(x) for x in got], pa.int64())
            columns = [c for c, name in zip(part.columns, names, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, _id_lists(got), n, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=[*rest, ids, *more])

    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *kinds]))


def round_trip(docs: DataFrame, rate: float = 0.1, seed: int = 1, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids), decoded_sha256 and lossless per row of ``docs``, by ``encode_and_check``."""
    done = encode_and_check(docs.select("doc_id", "text"), rate=rate, seed=seed, model=model)
    return done.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "decoded_sha256", "lossless")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
