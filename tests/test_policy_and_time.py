"""Row policies, deletions, links over several hops, and joins in time against plain passes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from specloom.config import Settings
from specloom.engine import KnowledgeBase
from specloom.errors import Conflict, Forbidden
from specloom.functions.vectors import GaussianEmbedder
from specloom.operators import constraints as C
from specloom.operators import policy as P
from specloom.operators import reads as R
from specloom.operators import temporal as T

from .test_knowledge_base import BASE, MANIFEST, zipped

TREE = "id string, parent_id string, kind string, slug string"


def test_scopes_go_down_the_tree(spark):
    rows = [("a", None, "capability", "a"), ("b", None, "capability", None), ("c", None, "capability", "c"), ("a1", "a", "f", "x"), ("a2", "a1", "leaf", "x"), ("a3", "a2", "leaf", "x"), ("a4", "a3", "leaf", "x"), ("b1", "b", "f", "x"), ("c1", "c", "f", "x"), ("c2", "c1", "leaf", "secret"), ("c3", "c1", "leaf", "x"), ("y", "z", "f", "x"), ("z", "y", "f", "x"), ("lost", "nowhere", "leaf", "x")]
    node = spark.createDataFrame(rows, TREE)
    # b is hidden too: nobody knows that its slug isn't a
    assert sorted(r.id for r in P.visible_nodes(node, ["kind = 'capability' AND slug = 'a'", "slug = 'secret'"]).collect()) == ["c", "c1", "c3", "lost", "y", "z"]
    assert sorted(r.id for r in P.visible_nodes(node, ["coalesce(id = 'y', false)"]).collect()) == sorted(r[0] for r in rows if r[0] not in "yz")
    assert P.visible_nodes(node.limit(0), ["true"]).count() == 0


def test_policy_names(spark):
    scopes = (P.Scope("one", "id = 'a'"), P.Scope("two", "id = 'b'"))
    policy = P.RowPolicy(scopes, {"read": frozenset({"two"})})
    assert policy.denied("read") == ["one"] and policy.denied("other") == ["one", "two"]
    with pytest.raises(ValueError, match="unknown"):
        P.RowPolicy(scopes, {"read": frozenset({"three"})})
    with pytest.raises(ValueError, match="same name"):
        P.RowPolicy((*scopes, scopes[0]))


def kb_of(spark, tmp_path, policy=None):
    return KnowledgeBase(spark, f"file://{tmp_path}/kb", GaussianEmbedder(32), Settings(embedding_dim=32), policy)


def test_knowledge_base_under_a_policy(spark, tmp_path):
    kb = kb_of(spark, tmp_path, P.RowPolicy((P.Scope("rules", "kind = 'business_function'"),), {"admin": frozenset({"rules"})}))
    kb.ingest("write-key", zipped(tmp_path / "a.zip", BASE))
    rows, coverage = kb.search("read-key", "Pay in time", k=1)
    # the best match is hidden, and the next one has its place
    assert [r.slug for r in rows] == ["context"] and coverage.denied_scopes == ["rules"]
    rows, coverage = kb.search("admin-key", "Pay in time", k=1)
    assert [r.body for r in rows] == ["Pay in time"] and coverage.denied_scopes == []
    head = kb.store.load()["node"].filter("kind = 'capability'").first().id
    assert [r.slug for r in kb.spec("read-key", head)[0].collect()] == ["context"] and kb.spec("admin-key", head)[0].count() == 2
    assert kb.spec("read-key", head)[1].denied_scopes == ["rules"]


def files_of(store):
    """Data files and when they were written."""
    from pathlib import Path

    return {str(p): p.stat().st_mtime_ns for p in Path(store.root.removeprefix("file://")).glob("data/*/*/*")}


def test_deletes_take_chunks_along_and_write_no_folder_again(spark, tmp_path):
    kb = kb_of(spark, tmp_path)
    kb.ingest("write-key", zipped(tmp_path / "a.zip", BASE))
    before, version = files_of(kb.store), kb.store.versions()[-1]
    leaf = kb.store.load()["node"].filter("dimension_code = 'business-rules'").select("id")
    ids = leaf.unionByName(spark.createDataFrame([("unknown",), (None,)], "id string")).unionByName(leaf)
    with pytest.raises(Forbidden):
        kb.delete_nodes("write-key", ids)
    with pytest.raises(Conflict, match="parent"):
        kb.delete_nodes("admin-key", kb.store.load()["node"].filter("kind = 'business_function'").select("id"))
    assert kb.delete_nodes("admin-key", ids) == 1 and kb.delete_nodes("admin-key", ids) == 0
    state = kb.store.load()
    assert state["node"].count() == 3 and state["chunk"].count() == 1 and C.violations(state).count() == 0
    assert all(files_of(kb.store)[f] == t for f, t in before.items())
    assert kb.store.load(version)["node"].count() == 4 and kb.store.load(version)["chunk"].count() == 2
    # its function goes next, and then the leaf can come back
    assert kb.delete_nodes("admin-key", state["node"].filter("kind = 'business_function'").select("id")) == 1
    again = BASE | {"x/kb-manifest.yaml": MANIFEST.replace("abc", "def"), "x/documents/01-context-and-requirements/context.adoc": "new"}
    s = kb.ingest("write-key", zipped(tmp_path / "b.zip", again)).first()
    assert (s.nodes_created, s.nodes_versioned) == (1, 1)
    assert all(files_of(kb.store)[f] == t for f, t in before.items())
    state = kb.store.load()
    assert sorted((r.slug, r.status) for r in state["node"].filter("dimension_code IS NOT NULL").collect()) == [("business-rules", "approved"), ("context", "approved"), ("context", "superseded")]
    assert C.violations(state).count() == 0
    old = state["node"].filter("status = 'superseded'").select("id")
    with pytest.raises(Conflict, match="supersedes"):
        kb.delete_nodes("admin-key", old)
    for t in ("node", "chunk"):
        kb.store.compact(t)
    assert not kb.store.deletions() and kb.store.load()["node"].count() == state["node"].count() == 5


def test_reach_in_cycles(spark):
    link = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("a", "c", "y"), ("a", None, "x"), ("d", "d", "x"), ("c", "e", "x"), ("a", "b", "y")], "src_id string, dst_id string, rel string")
    reach = lambda **how: sorted(map(tuple, R.reach(link, **how).collect()))
    a = spark.createDataFrame([("a",), ("a",)], "id string")
    assert reach(start=a, hops=9) == [("a", "b", 1), ("a", "c", 1), ("a", "e", 2)]
    assert reach(start=a, hops=9, rel="x") == [("a", "b", 1), ("a", "c", 2), ("a", "e", 3)]
    assert reach(hops=1) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("c", "e", 1)]
    assert reach(start=spark.createDataFrame([("q",)], "id string")) == []


DAY = datetime(2024, 3, 30)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("partitions", ["2", "9"])
def test_asof_equals_a_sequential_pass(spark, strict, partitions):
    """One key with most of the rows, keys without versions, nulls, ties, repeated rows."""
    r = random.Random(7)
    keys = ["hot"] * 6 + ["k1", "k2", "none", None]
    when = lambda: r.choice([None] + [DAY + timedelta(hours=h) for h in range(40)])
    left = [(i, r.choice(keys), when()) for i in range(300)] + [(7, "hot", DAY)] * 2
    right = [(r.choice([k for k in keys if k != "none"]), when(), r.randrange(3), r.choice(["p", "q", None])) for _ in range(120)] + [("hot", DAY, 1, "p")] * 2
    want = []
    for i, k, t in left:
        fit = [x for x in right if k is not None and x[0] == k and t is not None and x[1] is not None and (x[1] < t or not strict and x[1] == t)]
        best = max(fit, key=lambda x: (x[1], x[2], x[3] is not None, x[3] or ""), default=(None, None, None, None))
        want.append((i, k, t, best[3], best[1]))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        a = spark.createDataFrame(left, "id int, key string, ts timestamp_ntz")
        b = spark.createDataFrame(right, "key string, since timestamp_ntz, n int, body string")
        got = T.asof_join(a, b, ["key"], "ts", "since", {"body": "body", "since": "since"}, ties=["n"], strict=strict).collect()
        assert T.asof_join(a, b.limit(0), ["key"], "ts", "since", {"body": "body"}).filter("body IS NOT NULL").count() == 0
        assert T.asof_join(a.limit(0), b, ["key"], "ts", "since", {"body": "body"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    with pytest.raises(ValueError, match="there already"):
        T.asof_join(a, b, ["key"], "ts", "since", {"body": "id"})


def test_a_hot_key_is_carried_through_many_ranges(spark):
    """A version at the start, none later: every range of the hot key gets it from ranges before."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        left = spark.range(5000).select(F.lit("hot").alias("key"), F.col("id").alias("at")).unionByName(spark.range(50).select(F.concat(F.lit("z"), "id").alias("key"), F.col("id").alias("at")))
        right = spark.createDataFrame([("hot", -5, "old"), ("hot", 10, "new")], "key string, since long, body string")
        got = T.asof_join(left, right, ["key"], "at", "since", {"body": "body"}).groupBy("key", "body").count().filter("key = 'hot'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r["body"], r["count"]) for r in got) == [("new", 4990), ("old", 10)]


@pytest.mark.parametrize("kind", ["int", "bigint", "date", "timestamp", "timestamp_ntz"])
def test_overlaps_equal_all_pairs(spark, kind):
    r = random.Random(len(kind))
    make = {"date": lambda x: DAY.date() + timedelta(days=x), "timestamp": lambda x: DAY + timedelta(minutes=x), "timestamp_ntz": lambda x: DAY + timedelta(minutes=x)}.get(kind, lambda x: x)
    lengths = [0, 1, 1, 2, 3, 4, 5, 8, 17, 100, 1000, -3]

    def spans(n):
        out = []
        for i in range(n):
            s = r.randrange(-200, 900)
            e = s + r.choice(lengths)
            out.append((i, r.choice(["hot", "hot", "a", None]), None if r.random() < 0.04 else s, None if r.random() < 0.04 else e))
        return out + out[:2]

    a, b = spans(120), spans(90)
    real = lambda x: (-(10**9) if x[2] is None else x[2], 10**9 if x[3] is None else x[3])
    hit = lambda x, y: max(real(x)[0], real(y)[0]) < min(real(x)[1], real(y)[1]) and real(x)[0] < real(x)[1] and real(y)[0] < real(y)[1]
    frame = lambda rows: spark.createDataFrame([(i, k, None if s is None else make(s), None if e is None else make(e)) for i, k, s, e in rows], f"id int, key string, s {kind}, e {kind}")
    for keys in (["key"], []):
        got = sorted((x.l.id, x.r.id) for x in T.overlap_join(frame(a), frame(b), keys, ("s", "e"), ("s", "e")).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if hit(x, y) and (not keys or x[1] is not None and x[1] == y[1]))
    empty = frame(a).limit(0)
    assert T.overlap_join(empty, frame(b), ["key"], ("s", "e"), ("s", "e")).count() == T.overlap_join(frame(a), empty, [], ("s", "e"), ("s", "e")).count() == 0


def test_overlaps_make_no_products(spark):
    a = spark.createDataFrame([(1, "k", 1, 5)], "id int, key string, s long, e long")
    plan = T.overlap_join(a, a, ["key"], ("s", "e"), ("s", "e"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="double"):
        T.overlap_join(a.withColumn("s", F.col("s").cast("double")), a, ["key"], ("s", "e"), ("s", "e"))
