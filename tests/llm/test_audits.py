"""Source divergence, language-model scores and the filter audit against brute force, and on hard rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from specloom.llm import filter_audit, interpolated_lm, source_divergence
from specloom.llm.common import table

from ..oracle import SF
from .test_operators import hard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf=SF):
    return [r.asDict() for r in table(spark, sf, "documents").collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 11
def divergence_by_hand(rows, min_docs=30, top=50):
    docs = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r["text"]))) for r in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        held = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for _, x, ts in own if x == s for t in ts if held[t] >= min_docs) for s in {x[1] for x in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        for s, c in counts.items():
            pairs = sorted((-sum(abs(share(c, t) - share(d, t)) for t in kept), r.encode()) for r, d in counts.items() if r != s)
            terms = sorted((share(whole, t) - share(c, t), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t))
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, rows in (("pair", pairs), ("term", terms[:top])) for k, (v, item) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("min_docs, block", [(30, 1_000_000), (3, 40), (10_000, 5)])
def test_divergence_equals_brute_force(spark, min_docs, block):
    docs = table(spark, SF, "documents").filter("doc_id < 120")  # a fixture of the test, whole texts
    got = source_divergence.divergences(docs, min_docs=min_docs, block_entries=block).collect()
    assert sorted(map(tuple, got)) == divergence_by_hand([r.asDict() for r in docs.collect()], min_docs)


def test_divergence_on_hard_rows(spark):
    docs = hard_documents(spark)
    got = source_divergence.divergences(docs, min_docs=2).collect()
    assert sorted(map(tuple, got)) == divergence_by_hand([r.asDict() for r in docs.collect()], 2)
    assert source_divergence.divergences(docs.limit(0)).count() == 0


def test_terms_are_told_apart_whatever_their_hashes():
    texts = ["Ab ab,AB cd", "", "éÉ x\x00y", "ab", "tail"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    buffer, starts, ends, text = source_divergence.term_slices(data, offsets)
    want = [(i, t) for i, x in enumerate(texts) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x))]
    for digest in (len, lambda b: 7, lambda b: b[0]):
        number, terms = source_divergence.group_slices(buffer, starts, ends, digest)
        assert [(i, terms[n].decode()) for i, n in zip(text.tolist(), number.tolist(), strict=True)] == want
        assert len(set(terms)) == len(terms)


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 9_000_000_000_123_456, 9_100_000_000_000_007, 123_457
    got = spark.range(1).select(source_divergence.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


# 12
def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def score_by_hand(rows, order, rounds):
    """The same model with dictionaries: counts, held-out events, expectation-maximisation, scores."""
    texts = [(r["doc_id"], fold(r["doc_id"]), ["<s>"] * (order - 1) + WORD.findall(lower(r["text"])) + ["</s>"]) for r in rows]
    grams = lambda ts, k: Counter(tuple(t[i - k + 1 : i + 1]) for t in ts for i in range(order - 1, len(t)))
    contexts = lambda ts, k: Counter(tuple(t[i - k + 1 : i]) for t in ts for i in range(order - 1, len(t)))
    kept, train = [t for _, f, t in texts if f not in (2, 3)], [t for _, f, t in texts if f != 2]
    models = {name: [(grams(ts, k), contexts(ts, k)) for k in range(1, order + 1)] for name, ts in (("kept", kept), ("train", train))}
    tokens, types = sum(models["train"][0][0].values()), len(models["train"][0][0])

    def event(model, t, i):
        bucket, f = (0, 0), []
        for k, (own, ctx) in enumerate(models[model], 1):
            n = ctx[tuple(t[i - k + 1 : i])]
            f.append(own[tuple(t[i - k + 1 : i + 1])] / n if n else 0.0)
            if n:
                bucket = (k, int(math.log2(n)))
        return bucket, [1 / (types + 1), *f]

    events = [event("kept", t, i) for _, f, t in texts if f == 3 for i in range(order - 1, len(t))]
    even = lambda j: [1 / (j + 1)] * (j + 1) + [0.0] * (order - j)
    weights = {b: even(b[0]) for b, _ in events}
    before = None
    for _ in range(rounds):
        sums, n, log = defaultdict(lambda: [0.0] * (order + 1)), Counter(), 0.0
        for b, f in events:
            parts = [x * y for x, y in zip(weights[b], f, strict=True)]
            log, n[b] = log + math.log(sum(parts)), n[b] + 1
            sums[b] = [s + x / sum(parts) for s, x in zip(sums[b], parts, strict=True)]
        weights = {b: [(s + 1 / (b[0] + 1)) / (n[b] + 1) if k <= b[0] else 0.0 for k, s in enumerate(v)] for b, v in sums.items()}
        if not events or before is not None and log / len(events) - before < interpolated_lm.LEAST_GAIN:
            break
        before = log / len(events)

    def weight(b):
        near = sorted((abs(x[1] - b[1]), x[1]) for x in weights if x[0] == b[0])
        return weights[(b[0], near[0][1])] if near else even(b[0])

    out = []
    for d, f, t in texts:
        own = [event("train", t, i) for i in range(order - 1, len(t))]
        c = [models["train"][0][0][(w,)] for w in t[order - 1 :]]
        base = sum(math.log10((x + 1) / (tokens + types + 1)) for x in c)
        out.append((d, f == 2, len(c), sum(x > 0 for x in c), tokens, base, sum(math.log10(sum(x * y for x, y in zip(weight(b), p, strict=True))) for b, p in own)))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    # small blocks and ranges, so that counts come from many of them
    monkeypatch.setattr(interpolated_lm, "RANGE_BYTES", 20_000)
    docs = table(spark, SF, "documents")
    close(interpolated_lm.score_documents(docs, order).collect(), score_by_hand(rows_of(spark), order, interpolated_lm.ROUNDS))


def test_blocks_by_size_and_fold():
    import pyarrow as pa

    texts = ["a" * (4 << 20)] * 5 + [""]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array([0, 0, 0, 2, 0, 1], pa.int32())], names=["doc_id", "text", "fold"])
    blocks = [(x.column("fold")[0].as_py(), pa.ipc.open_stream(x.column("payload")[0].as_py()).read_all()) for x in interpolated_lm._pack(iter([b]))]
    assert sorted((f, t.column("doc_id").to_pylist()) for f, t in blocks) == [(0, [0, 1]), (0, [2, 4]), (1, [5]), (2, [3])]
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (interpolated_lm._expand(interpolated_lm._squeeze(x)) == x).all()


def test_scores_of_hard_rows(spark):
    docs = hard_documents(spark)
    close(interpolated_lm.score_documents(docs).collect(), score_by_hand([r.asDict() for r in docs.collect()], 2, interpolated_lm.ROUNDS))
    assert interpolated_lm.score_documents(docs.limit(0)).count() == 0
    # nothing to train on: every token has probability 1
    only = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert only.count() and all(r.score == r.base_score == 0 and r.held_out for r in interpolated_lm.score_documents(only).collect())


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = interpolated_lm.score_documents(table(spark, SF.replace("0.001", "0.01"), "documents")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows.s / rows.n > rows.b / rows.n + 0.2


# 13
def audit_by_hand(rows, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first = {}
    for r in rows:
        t, d = r["text"] or "", r["doc_id"]
        if d is not None:
            first[t] = min(first.get(t, d), d)
    fails = []
    for r in rows:
        t, d = r["text"] or "", r["doc_id"]
        w = WORD.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((r["source"] or "", d, {x for x in bad if bad[x]}))
    out, sums = [], Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(d, f) for p, d, f in fails if p == part]
            everyone = left
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                sums[part, x] += len(gone)
                failing = sum(x in f for _, f in everyone)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in everyone), sum(d in good for d in gone), sum(d in toxic for d in gone)))
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("hard", [False, True])
def test_filter_audit_equals_brute_force(spark, hard):
    docs, labels = (hard_documents(spark) if hard else table(spark, SF, "documents")), table(spark, SF, "labels")
    if hard:
        labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (3, 1, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.order_effects(filter_audit.mask_cells(filter_audit.failure_masks(docs, labels))).collect()
    assert sorted(map(tuple, got)) == audit_by_hand([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert filter_audit.order_effects(filter_audit.mask_cells(filter_audit.failure_masks(docs.limit(0), labels))).count() == 0


def test_filter_audit_runs_no_python(spark):
    plan = filter_audit.op13_filter_audit(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
