"""Inverted index, vector cells and snapshot differences against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from specloom.operators import reads as R
from specloom.operators.cells import CellIndex
from specloom.operators.lexical import TERM, LexicalIndex, fused
from specloom.operators.merge import conform
from specloom.plans import corpus as V
from specloom.schemas import NODE
from specloom.sources.staging import shared_dir
from specloom.sources.store import SnapshotStore

DDL = "id string, text string, block string"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, text or "")]


def bm25(docs, query, k, among=None):
    bags = {i: Counter(words(t)) for i, t in docs}
    mean = max(1, sum(b.total() for b in bags.values())) / max(1, len(bags))
    out = []
    for i, bag in bags.items():
        s = 0.0
        for w in set(words(query)) & set(bag):
            df = sum(w in b for b in bags.values())
            s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean))
        if set(words(query)) & set(bag) and (among is None or i in among):
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def index(spark, docs, **how):
    return LexicalIndex(spark, shared_dir(spark)).build(spark.createDataFrame([(i, t, "more") for i, t in docs], DDL), **how)


def test_bm25_equals_scoring_every_document(spark):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "ñandú", "été", "x1"] + [f"w{i}" for i in range(60)]
    docs = [(f"d{i:03d}", " ".join(["all", *rng.choices(vocabulary, k=rng.randint(1, 40))])) for i in range(300)]
    docs += [("n0", None), ("n1", ""), ("n2", "... !!"), ("c1", docs[3][1]), ("c2", docs[3][1]), ("long", "beta " * 30_000)]
    ix = index(spark, docs, block_docs=4)
    asked = {1: "alpha W3 w3 all", 2: "ñandú", 3: "nothing here", 4: None, 5: docs[3][1]}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    among = {i for i, _ in docs if hash_even(i)}
    for allowed in (None, among):
        frame = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "id string")
        got = {}
        for r in ix.search(queries, 7, frame).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        for q, text in asked.items():
            want = bm25(docs, text, 7, allowed)
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
            assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want], atol=2e-6)


def hash_even(i):
    return sum(map(ord, i)) % 2 == 0


def test_blocks_without_hope_are_left_out(spark):
    docs = [(i, f"all common {'rare ' * 3 if i < 5 else 'filler ' * 3}") for i in range(400)]
    ix = LexicalIndex(spark, shared_dir(spark)).build(spark.createDataFrame(docs, "id long, text string"), block_docs=4)
    query = spark.createDataFrame([(1, "all rare")], "query_id int, text string")
    _, blocks = ix.plan(query, 3)
    assert blocks.count() <= 5 < ix.read("totals").first()["blocks"]
    assert [r["id"] for r in ix.search(query, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_empty_indexes_and_negative_k(spark):
    ix = index(spark, [])
    query = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    assert ix.search(query, 5).count() == 0
    full = index(spark, [("a", "a b")])
    assert full.search(query, 0).count() == 0 and full.search(query.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        full.search(query, -1)


def test_ranks_are_fused(spark):
    rows = lambda *ids: spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], "id string, rank int")
    got = [(r["id"], r["score"]) for r in fused(rows("a", "b", "c"), rows("c", "d"), 3).collect()]
    assert got == [("c", 1 / 63 + 1 / 61), ("a", 1 / 61), ("b", 1 / 62)]


def test_cells_keep_every_vector_and_prune_the_scan(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    vecs = [(f"n{i}", 0, (centres[0 if i % 3 == 0 else i % 20] + 0.3 * rng.standard_normal(16)).astype(float).tolist()) for i in range(1500)]
    odd = [("null", 0, None), ("zero", 0, [0.0] * 16), ("nan", 0, [math.nan] * 16), ("hole", 0, [None] + [1.0] * 15)]
    chunk = spark.createDataFrame(vecs + odd, "node_id string, ord int, embedding array<double>")
    ix = CellIndex(spark, shared_dir(spark)).build(chunk, cells=20)
    query = centres[4].tolist()
    assert ix.probe(query, 20).count() == 1500
    few = ix.probe(query, 2)
    top = lambda c: {r["node_id"] for r in R.best_chunks(c, query).orderBy("score", ascending=False).limit(10).collect()}
    assert len(top(few) & top(chunk.filter("node_id NOT IN ('null', 'zero', 'nan', 'hole')"))) >= 9
    assert 0 < few.count() < 1500
    assert {f.split("cell=")[1].split("/")[0] for f in few.inputFiles()} <= {str(c) for c in ix.nearest(query, 2)} or "PartitionFilters: [cell" in plan(few)


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_cells_of_nothing(spark):
    ix = CellIndex(spark, shared_dir(spark)).build(spark.createDataFrame([("a", 0, None)], "node_id string, ord int, embedding array<double>"))
    assert ix.nearest([1.0], 3) == [] and ix.probe([1.0], 3).count() == 0


def test_recall_of_a_tenth_of_the_cells(spark):
    chunk = V.chunk(spark, "/root/testdata/sf0.01")
    rows = chunk.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = CellIndex(spark, shared_dir(spark)).build(chunk, cells=30)
    name = {(r["node_id"], r["ord"]): i for i, r in enumerate(rows)}
    hit = 0
    for q in range(0, len(rows), max(1, len(rows) // 10)):
        own = {name[r["node_id"], r["ord"]] for r in ix.probe(x[q].tolist(), 3).select("node_id", "ord").collect()}
        hit += len(own & set(np.argsort(-(x @ x[q]))[:10].tolist())) / 10 / len(range(0, len(rows), max(1, len(rows) // 10)))
    print("recall at a tenth of the cells:", round(hit, 3))
    assert hit > 0.3  # vectors of this table are hardly clustered


def nodes(spark, rows):
    return conform(spark.createDataFrame([(i, b, s, {"k": b}) for i, b, s in rows], "id string, body string, status string, attrs map<string,string>"), NODE)


def test_changes_compare_rows_as_often_as_they_are_there(spark):
    store = SnapshotStore(spark, shared_dir(spark))
    first = store.save({"node": nodes(spark, [("a", "1", "draft"), ("b", "2", "approved"), ("b", "2", "approved"), ("c", None, None)])})
    store.save({}, {"node": nodes(spark, [("e", "5", "draft")])})
    gone = store.find("node", "id", spark.createDataFrame([("a",), ("b",)], "id string"))
    last = store.save({}, {"node": nodes(spark, [("a", "1", "draft"), ("b", "2", "approved"), ("b", "3", "approved")])}, {"node": gone})
    got = lambda *v: Counter((r["change"], r["id"], r["body"], (r["attrs"] or {}).get("k")) for r in store.changes("node", *v).collect())
    added = {("added", "e", "5", "5"): 1, ("added", "b", "3", "3"): 1}
    assert got(first) == added | {("removed", "b", "2", "2"): 1}
    assert got(last, first) == {("removed", "e", "5", "5"): 1, ("removed", "b", "3", "3"): 1, ("added", "b", "2", "2"): 1}
    assert not got(last) and got(1, 2) == {("added", "e", "5", "5"): 1}


def test_changes_skip_folders_that_both_versions_name(spark, monkeypatch):
    store = SnapshotStore(spark, shared_dir(spark))
    store.save({"node": nodes(spark, [("a", "1", "draft")])})
    two = store.save({}, {"node": nodes(spark, [("b", "2", "draft")])})
    store.save({}, {"node": nodes(spark, [("c", "3", "draft")])}, {"node": store.find("node", "id", spark.createDataFrame([("b",)], "id string"))})
    seen = []
    real_read, real_rows = store.read, store._rows
    monkeypatch.setattr(store, "read", lambda t, f, d=None: (seen.extend(f), real_read(t, f, d))[1])
    monkeypatch.setattr(store, "_rows", lambda t, f, d: (seen.extend(f), real_rows(t, f, d))[1])
    assert {(r["change"], r["id"]) for r in store.changes("node", two).collect()} == {("removed", "b"), ("added", "c")}
    have = store.folders()["node"]
    assert have[0] not in seen and have[1] in seen and have[2] in seen
