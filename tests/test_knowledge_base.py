"""Archives, merge, reads and governance end to end, and against a sequential pass."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from specloom.config import Settings
from specloom.engine import KnowledgeBase
from specloom.errors import BadInput, Conflict, Forbidden, Unauthorized
from specloom.functions.vectors import GaussianEmbedder
from specloom.operators import constraints as C
from specloom.operators import merge as M
from specloom.operators import reads as R
from specloom.sources.archive import parse_manifests
from specloom.streaming.ingest import ingest_stream

MANIFEST = "capability_slug: billing\ncategory: core\ndomain: \"money\"\nsource_commit: abc\n"
BASE = {
    "x/kb-manifest.yaml": MANIFEST,
    "x/documents/01-context-and-requirements/context.adoc": ":status: draft\nContext of billing\n",
    "x/requirements/business-fct-pay/business-rules.md": "Pay in time",
    "x/stray.txt": "lost",
}


def zipped(path, files):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x/", "")
        for name, body in files.items() if isinstance(files, dict) else files:
            z.writestr(name, body)
    return str(path)


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, f"file://{tmp_path}/kb", GaussianEmbedder(32), Settings(embedding_dim=32))


def test_life_of_a_knowledge_base(kb, tmp_path):
    first = kb.ingest("write-key", zipped(tmp_path / "a.zip", BASE)).first()
    assert (first.nodes_created, first.nodes_versioned, first.nodes_skipped, first.idempotent_hit) == (2, 0, 0, False)
    assert first.sources_unreached == ["x/stray.txt"] and first.dimensions_seen == ["business-rules", "context-and-requirements"]
    assert kb.ingest("write-key", str(tmp_path / "a.zip")).first().idempotent_hit
    assert kb.stats("admin-key") == {"nodes": 4, "dimensions": 11}
    changed = BASE | {"x/kb-manifest.yaml": MANIFEST.replace("abc", "def"), "x/requirements/business-fct-pay/business-rules.md": "Pay later"}
    second = kb.ingest("write-key", zipped(tmp_path / "b.zip", changed)).first()
    assert (second.nodes_created, second.nodes_versioned, second.nodes_skipped) == (0, 1, 1)
    state = kb.store.load()
    rules = {r.status: r for r in state["node"].filter("dimension_code = 'business-rules'").collect()}
    assert rules["approved"].version == 2 and rules["approved"].supersedes_id == rules["superseded"].id
    assert C.violations(state).count() == 0
    attrs = state["node"].filter("slug = 'context'").first().attrs
    assert attrs == {"status": "draft"}

    rows, coverage = kb.search("read-key", "Pay later")
    assert rows[0].body == "Pay later" and rows[0].score > 0.99 and not coverage.partial
    assert kb.search("read-key", "x", k=0)[1].partial
    with pytest.raises(ValueError, match="negative"):
        kb.search("read-key", "x", k=-1)
    head = state["node"].filter("kind = 'capability'").first().id
    assert [r.slug for r in kb.spec("read-key", head)[0].collect()] == ["business-rules", "context"]
    assert kb.spec("read-key", head, dimension="business-rules")[0].count() == 1
    assert kb.spec("read-key", head, status="superseded")[0].count() == 1
    assert kb.spec("read-key", "nothing")[0].count() == 0
    assert kb.reembed("admin-key") == 3

    kb.add_dimension("admin-key", "glossary", "Glossary")
    with pytest.raises(Conflict):
        kb.add_dimension("admin-key", "glossary", "Again")
    kb.delete_dimension("admin-key", "glossary")
    kb.delete_dimension("admin-key", "unknown")
    with pytest.raises(Conflict):
        kb.delete_dimension("admin-key", "business-rules")
    kb.add_link_type("admin-key", "cites", "Cites")
    assert kb.store.load()["link_type"].count() == 22 and kb.dimensions("admin-key").count() == 11 and kb.health() == {"status": "ok"}
    with pytest.raises(Forbidden):
        kb.stats("read-key")
    with pytest.raises(Unauthorized):
        kb.search("no", "x")


@pytest.mark.parametrize(
    ("files", "message"),
    [({"a.md": "x"}, "not found"), (BASE | {"x/kb-manifest.yaml": MANIFEST.replace("abc", "12")}, "source_commit"), ({"kb-manifest.yaml": ""}, "lacks"), (None, "BadZipFile")],
)
def test_bad_archives(kb, tmp_path, files, message):
    path = tmp_path / "bad.zip"
    path.write_bytes(b"PK no") if files is None else zipped(path, files)
    with pytest.raises(BadInput, match=message):
        kb.ingest("write-key", str(path))
    assert kb.store.versions() == []


def test_faults_that_ingest_refuses(kb, tmp_path):
    """Damaged data inside a ZIP, a dimension off the whitelist, an id that is taken."""
    path = tmp_path / "bad.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("kb-manifest.yaml", MANIFEST * 50)
    raw = bytearray(path.read_bytes())
    raw[60:70] = b"\xff" * 10
    path.write_bytes(raw)
    with pytest.raises(BadInput):
        kb.ingest("write-key", str(path))
    kb.delete_dimension("admin-key", "business-rules")
    with pytest.raises(BadInput, match="whitelisted"):
        kb.ingest("write-key", zipped(tmp_path / "a.zip", BASE))
    assert kb.stats("admin-key") == {"nodes": 0, "dimensions": 10}
    kb.add_dimension("admin-key", "business-rules", "Business Rules")
    kb.ingest("write-key", str(tmp_path / "a.zip"))
    node = kb.store.load()["node"].withColumn("status", F.when(F.col("dimension_code").isNotNull(), "superseded"))
    kb.store.save({"node": node})
    with pytest.raises(Conflict, match="exists"):
        kb.ingest("write-key", zipped(tmp_path / "b.zip", BASE | {"x/kb-manifest.yaml": MANIFEST.replace("abc", "def")}))


def test_manifests_are_yaml(spark):
    texts = ["capability_slug: 'it''s'\ncategory: \"a\\\"b\"\ndomain: x # note\nsource_commit: c\nsource_commit: d\n", MANIFEST.replace("abc", "2024-01-01"), "[1, 2]", "a: [", None, "capability_slug: >\n  folded\n  text\ncategory: c\ndomain: d\nsource_commit: e\n"]
    got = parse_manifests(spark.createDataFrame(list(enumerate(texts)), "archive int, manifest string")).orderBy("archive").collect()
    assert (got[0].capability_slug, got[0].category, got[0].domain, got[0].source_commit, got[0].error) == ("it's", 'a"b', "x", "d", None)
    assert got[1].error == "manifest lacks source_commit" and all("capability_slug" in r.error for r in got[2:5]) and got[5].capability_slug == "folded text\n"


def test_unchanged_tables_are_not_written_again(kb, tmp_path):
    kb.ingest("write-key", zipped(tmp_path / "a.zip", BASE))
    before = kb.store.folders()
    kb.add_dimension("admin-key", "glossary", "Glossary")
    after = kb.store.folders()
    assert [t for t in after if after[t] != before[t]] == ["spec_dimension"]
    more = {"y/kb-manifest.yaml": MANIFEST.replace("billing", "other"), "y/documents/03-constraints/c.md": "text"}
    kb.ingest("write-key", zipped(tmp_path / "b.zip", more))
    assert kb.store.folders()["node"][:-1] == before["node"]  # nothing was superseded
    kb.ingest("write-key", zipped(tmp_path / "c.zip", more | {"y/kb-manifest.yaml": MANIFEST.replace("billing", "other").replace("abc", "x"), "y/documents/03-constraints/c.md": "new"}))
    # a superseded node is a deletion and a new row: no folder is written again
    assert len(kb.store.folders()["node"]) == len(before["node"]) + 2 and set(before["node"]) < set(kb.store.folders()["node"]) and len(kb.store.deletions()["node"]) == 1
    n = kb.stats("admin-key")["nodes"]
    kb.store.compact("node")
    assert len(kb.store.folders()["node"]) == 1 and not kb.store.deletions() and kb.stats("admin-key")["nodes"] == n and C.violations(kb.store.load()).count() == 0


def test_repeated_entries_and_chain_within_an_archive(kb, tmp_path):
    where = "requirements/business-fct-a"
    files = [("kb-manifest.yaml", MANIFEST), ("v1/" + where + "/business-rules.md", "old"), ("v1/" + where + "/business-rules.md", "A"), ("v2/" + where + "/business-rules.md", "B"), ("v3/" + where + "/business-rules.md", "B")]
    with pytest.warns(UserWarning, match="Duplicate"):
        zipped(tmp_path / "c.zip", files)
    s = kb.ingest("write-key", str(tmp_path / "c.zip")).first()
    assert (s.nodes_created, s.nodes_versioned, s.nodes_skipped) == (1, 1, 1)
    leaves = kb.store.load()["node"].filter("dimension_code IS NOT NULL").orderBy("version").collect()
    assert [(r.body, r.version, r.status) for r in leaves] == [("A", 1, "superseded"), ("B", 2, "approved")]


def test_stream_of_archives(kb, tmp_path):
    (tmp_path / "in").mkdir()
    zipped(tmp_path / "in/a.zip", BASE)
    (tmp_path / "in/bad.zip").write_bytes(b"PK no")
    for _ in range(2):
        ingest_stream(kb, f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
        assert kb.stats("admin-key")["nodes"] == 4
    assert [r.archive.rsplit("/", 1)[1] for r in kb.rejected().collect()] == ["bad.zip"]


@pytest.mark.parametrize("seed", range(3))
def test_history_equals_a_sequential_pass(spark, seed):
    r = random.Random(seed)
    stored = [(f"k{i}", r.choice("ABC"), r.choice([None, 1, 4])) for i in range(0, 30, 2)]
    staged = [(f"k{i % 30}", i, r.choice("ABC")) for i in range(120)]
    now = {k: (b, v or 0) for k, b, v in stored}
    want = {}
    for k, i, b in staged:
        body, version = now.get(k, (None, 0))
        if k in now and body == b:
            want[i] = ("skipped", version)
        else:
            want[i] = ("versioned" if k in now else "created", version + 1)
            now[k] = (b, version + 1)
    got = M.leaf_history(spark.createDataFrame(staged, "key string, i int, body string"), spark.createDataFrame(stored, "key string, body string, version int"), ["i"], ["key"])
    assert {x.i: (x.outcome, x.version) for x in got.collect()} == want


def test_search_ties_nulls_and_zero_vectors(spark):
    node = spark.createDataFrame([(i, "document", i, "c", "t", 1, "approved") for i in "abcd"], "id string, kind string, slug string, dimension_code string, body string, version int, status string")
    chunk = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("a", [0.0, 1.0])], "node_id string, embedding array<float>")
    assert [(r.id, r.score) for r in R.search(node, chunk, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 1.0)]


def test_links_and_edges(spark):
    node = spark.createDataFrame([("n", "slug-n")], "id string, slug string")
    link = spark.createDataFrame([("1", "s", "n", None, None, "x"), ("2", "s", None, "urn:a", None, "x"), ("3", "s", None, None, "ref", "y"), ("4", "s", None, "urn:b", None, "x"), ("5", "s", None, "urn:b", None, "x")], "id string, src_id string, dst_id string, dst_urn string, dst_ref string, rel string")
    assert [(r.rel, r.target) for r in R.links(link, node, "s").collect()] == [("x", "slug-n"), ("x", "urn:a"), ("x", "urn:b"), ("x", "urn:b"), ("y", "ref")]
    assert R.links(link, node, "s", "y").count() == 1 and C.dedup_edges(link).count() == 4


def test_cycle_ends_with_an_error(spark):
    node = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string").selectExpr("id", "parent_id", "'document' kind", "id slug", "'c' dimension_code", "'t' body", "1 version", "'approved' status")
    with pytest.raises(Exception, match="RECURSION"):
        R.spec(node, "a").collect()
    assert R.subtree_levels(node, "a", 3).count() == 4


def test_spec_has_no_limit_on_rows(spark):
    node = spark.sql("SELECT 'head' id, cast(null as string) parent_id UNION ALL SELECT concat('n', id), 'head' FROM range(60)").selectExpr("id", "parent_id", "'document' kind", "id slug", "'c' dimension_code", "'t' body", "1 version", "'approved' status")
    deep = spark.createDataFrame([("0", None), *((str(i + 1), str(i)) for i in range(6))], "id string, parent_id string").selectExpr("id", "parent_id", "'document' kind", "id slug", "'c' dimension_code", "'t' body", "1 version", "'approved' status")
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    try:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
        assert R.spec(node, "head").count() == 61
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)
    assert R.spec(deep, "0").count() == 7


def test_vanished_files_get_a_last_version(kb, tmp_path):
    """Only with tombstones, once, in their own capability; a file that comes back is a new version."""
    commit = lambda name, c, gone=(): zipped(tmp_path / f"{name}.zip", {k: v for k, v in BASE.items() if k not in gone} | {"x/kb-manifest.yaml": MANIFEST.replace("abc", c)})
    rules = "x/requirements/business-fct-pay/business-rules.md"
    kb.ingest("write-key", commit("a", "c1"))
    other = MANIFEST.replace("billing", "other")
    kb.ingest("write-key", zipped(tmp_path / "o.zip", {"y/kb-manifest.yaml": other, "y/documents/03-constraints/c.md": "stays"}))
    assert kb.ingest("write-key", commit("b", "c2", [rules])).first().nodes_vanished == 0
    assert kb.store.load()["node"].filter("status = 'vanished'").isEmpty()
    assert kb.ingest("write-key", commit("c", "c3", [rules]), tombstone=True).first().nodes_vanished == 1
    assert kb.ingest("write-key", commit("d", "c4", [rules]), tombstone=True).first().nodes_vanished == 0
    chain = lambda: [(r.version, r.status, r.body) for r in kb.store.load()["node"].filter("dimension_code = 'business-rules'").orderBy("version").collect()]
    assert chain() == [(1, "superseded", "Pay in time"), (2, "vanished", None)]
    back = kb.ingest("write-key", commit("e", "c5"), tombstone=True).first()
    assert (back.nodes_versioned, back.nodes_skipped, back.nodes_vanished) == (1, 1, 0)
    assert chain() == [(1, "superseded", "Pay in time"), (2, "superseded", None), (3, "approved", "Pay in time")]
    assert kb.store.load()["node"].filter("status = 'approved' AND body = 'stays'").count() == 1


def test_files_that_vanish_within_a_batch(kb, tmp_path):
    """The last archive of a capability says which files there are; what an earlier one of the batch brought is superseded."""
    rules = "x/requirements/business-fct-pay/business-rules.md"
    (tmp_path / "in").mkdir()
    zipped(tmp_path / "in" / "a.zip", BASE)
    zipped(tmp_path / "in" / "b.zip", {k: v for k, v in BASE.items() if k != rules} | {"x/kb-manifest.yaml": MANIFEST.replace("abc", "c2")})
    found = {r.archive[-5:]: r.nodes_vanished for r in kb.ingest("write-key", str(tmp_path / "in"), tombstone=True).collect()}
    assert found == {"a.zip": 0, "b.zip": 1}
    rows = kb.store.load()["node"].filter("dimension_code = 'business-rules'").orderBy("version").collect()
    assert [(r.version, r.status, r.source_commit, r.supersedes_id) for r in rows] == [(1, "superseded", "abc", None), (2, "vanished", "c2", rows[0].id)]
