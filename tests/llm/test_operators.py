"""Each operator against its SQL or a brute-force version, and on hard rows."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from specloom.llm import chat_format, line_dedup, minhash, mixing, neighbour_graph, pieces, quality_model, quality_rules, queries, token_files, warc
from specloom.llm.common import shared_dir, written

from ..oracle import SF, assert_same, connect
from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("row_hash", "ids", "size", "slice", "bucket", "node", "words", "_words", "_doc", "_row", "_host", "n_words", "word_chars", "plan_doc", "bitmap_doc", "rejected", "salt", "row", "host", "copies", "row_key", "row_at", "tokens", "shard", "at", "x", "label")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def hard_documents(spark, extra=True):
    """Nulls, empty and very long texts, ties, repeated rows, a column whose name operators use."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nA shared line of text", "en", "a", 1),
        (2, "a SHARED line of text \nown words here that stay in this document alone ok", "en", None, 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, LONG, "en", "a", 1),
        (6, LONG + " tail", "en", "a", 1),
        (7, "alpha BETA gamma delta epsilon zeta eta theta iota kappa\nA shared line of text", "en", "b", 1),
        (8, "▁ \x00 emoji \U0001f600 \t\r\n  x", "fr", "b", 1),
        (9, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nA shared line of text", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows + ([rows[0], (None, "no id at all", "en", "a", 1)] if extra else []), DOCS)
    return written(df.withColumns({c: F.lit(1) for c in CLASHING}) if extra else df)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect().execute(queries.ORACLE_SQL[name]).df())


# 1
def test_capture_index_on_hard_pages(spark):
    big = "x" * 1000
    rows = [(1, "http://www.A.org/p?Q#f", big), (5, "http://a.org/p", big), (5, "http://a.org/p", big), (3, None, None), (4, "http://b.org", "é" * 500), (2, "http://b.org", "é" * 500), (6, "no url\r\nx", ""), (None, "http://a.org:80/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    got = warc.capture_index(pages).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.url_key, r.ts) for r in got] == sorted((r.url_key, r.ts) for r in got)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "response", None), (1, "revisit", 5), (2, "revisit", 4), (3, "response", None), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None),
    ]
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_merge_of_many_runs_in_small_blocks(spark):
    rows = [(i, f"http://h{i * 7919 % 50}.org/{i % 13}", f"{i}") for i in range(3000)]
    path = shared_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(11), path, records_per_file=97)
    got = warc.merge_runs(written(warc.read_runs(spark, path)), captures_per_range=300, block_entries=7, fan_in=9).orderBy("position").collect()
    assert [(r.url_key, r.ts, r.page_id) for r in got] == sorted((r.url_key, r.ts, r.page_id) for r in got) and [r.position for r in got] == list(range(3000))


def test_a_merge_holds_a_block_of_each_of_few_runs(spark):
    """40,000 captures in 400 runs and 200 ranges: passes make longer runs, and no merge holds more than its runs' blocks."""
    r = random.Random(3)
    entries = [{"url_key": f"k{r.randrange(900):03}", "ts": "t", "page_id": i, "url": None, "record_type": "response", "payload_bytes": 0, "payload_digest": "", "refers_to": None, "shard": i // 100, "offset": i % 100, "length": 1} for i in range(40_000)]
    entries.sort(key=lambda e: (e["shard"], *warc._key(e)))
    runs = written(spark.createDataFrame(entries, warc._ENTRY_DDL).withColumn("run", F.col("shard")).repartitionByRange(8, "shard").sortWithinPartitions("shard", "url_key", "ts", "page_id"))
    longer = warc.longer_runs(runs, fan_in=16, block_entries=8)
    assert longer.select("run").distinct().count() <= 16 and longer.count() == 40_000
    got = warc.merge_runs(runs, captures_per_range=200, block_entries=8, fan_in=16).orderBy("position").collect()
    assert [e.page_id for e in got] == [e["page_id"] for e in sorted(entries, key=warc._key)] and max(e.range_id for e in got) > 150
    # one group of runs as a task sees it
    for source, groups, n in ((runs, 50, 400), (longer, 1, 16)):
        blocks = source.mapInArrow(warc._cut([], 8, groups), warc._BLOCKS).filter("range_id = 0")
        n_runs = blocks.select("run").distinct().count()
        held: list[int] = []
        out = list(warc._merge(iter(blocks.orderBy(F.desc("opening"), "k", "t", "p", "run", "block").toArrow().to_batches()), held.append))
        assert 1 < n_runs <= n and sum(b.num_rows for b in out) >= 100 and max(held) <= n_runs * 8


def test_archives_are_cut_by_bytes(spark):
    """Pages of a megabyte that don't compress, one payload of most pages, a repeated row."""
    r = random.Random(5)
    pages = [(i, f"http://a.org/{i}", "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))) for i in range(6)] + [(i, "http://b.org/", "e" * 2000) for i in range(10, 40)] + [(39, "http://b.org/", "e" * 2000), (None, "http://b.org/", "e" * 2000)]
    path = shared_dir(spark)
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, file_bytes=1_500_000)
    sizes = [x.length for x in warc.read_files(spark, path).collect()]
    assert len(sizes) >= 3 and max(sizes) < 2_600_000
    got = warc.merge_runs(written(warc.read_runs(spark, path))).collect()
    assert sorted((x.page_id or 0, x.payload_bytes, x.refers_to or 0) for x in got) == sorted((i or 0, len(h), 39 if len(h) == 2000 and i != 39 else 0) for i, _, h in pages)


def test_many_equal_captures_in_small_blocks(spark):
    """Blocks of a run that start with equal keys come in their order; a very long payload comes back whole."""
    rows = [(7, "http://a.org/", None)] * 400 + [(i, "http://a.org/", "x" * 3_000_000 if i == 8 else f"{i}") for i in range(5, 9)]
    path = shared_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, records_per_file=150)
    runs = written(warc.read_runs(spark, path))
    got = warc.merge_runs(runs, captures_per_range=50, block_entries=3).orderBy("position").collect()
    key = lambda r: (r.url_key, r.ts, r.page_id)
    assert [key(r) for r in got] == sorted(key(r) for r in got) and [r.position for r in got] == list(range(404))
    assert len({(r.shard, r.offset) for r in got}) == 404 and [r.payload_bytes for r in got if r.page_id == 8] == [3_000_000]


def test_loser_tree():
    r = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted((r.randrange(50),) for _ in range(r.randrange(20))) for _ in range(k)]
        at, out = [0] * k, []
        tree = warc.LoserTree([x[0] if x else None for x in runs])
        while tree.heads[tree.winner] is not None:
            w = tree.winner
            out.append(runs[w][at[w]])
            at[w] += 1
            tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for run in runs for x in run)


# 2
def test_linked_vectors(spark):
    r = np.random.default_rng(1)
    centres, rows = r.standard_normal((12, 16)), []
    for i in range(400):
        v = (centres[i % 12] + r.standard_normal(16) * r.choice([0.0, 0.15, 0.3])).astype(np.float32).tolist()
        rows.append((i, v, int(i % 3) if i % 17 else None))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0))
    out, recall, judged = neighbour_graph.linked_vectors(df)
    assert recall >= 0.995 and judged > 100
    assert {x.vec_id: (x.n_links, x.component_id) for x in out.collect()} == brute.linked_vectors(rows)
    assert neighbour_graph.linked_vectors(df.limit(0))[0].count() == 0


def test_one_large_group_of_near_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + r.standard_normal(8) * 0.05).astype(np.float32).tolist(), 1) for i in range(900)]
    out, *_ = neighbour_graph.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {x.vec_id: (x.n_links, x.component_id) for x in out.collect()} == brute.linked_vectors(rows)


def test_links_come_from_the_lists(spark, monkeypatch):
    """Doubles keep their digits, null and repeated ids are rows of their own, and without lists there are no links."""
    r = np.random.default_rng(7)
    rows = []
    for g in range(30):
        c = r.standard_normal(24)
        rows += [(len(rows) + k, (c + r.standard_normal(24) * 0.1).tolist(), g % 2) for k in range(g)]
    rows += [(None, rows[0][1], 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "grp", "comp", "weight", "of")})
    got = neighbour_graph.linked_vectors(df)[0].collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got if x.vec_id is not None) == sorted((i, *v) for i, v in brute.linked_vectors([x for x in rows if x[0] is not None]).items())
    assert [(x.n_links, x.component_id) for x in got if x.vec_id is None] == [(0, None)] * 2
    twice = df.filter("vec_id < 20").unionByName(df.filter("vec_id = 3"))
    assert neighbour_graph.linked_vectors(twice)[0].count() == 21
    monkeypatch.setattr(neighbour_graph, "_descend", lambda lists, nodes, p: lists.limit(0))
    with pytest.raises(RuntimeError, match="audit"):
        neighbour_graph.linked_vectors(df, neighbour_graph.Descent(tries=1))


def test_audit_sees_the_lost_links_of_small_groups(spark):
    r = np.random.default_rng(5)
    big = [(i, np.ones(16) + r.standard_normal(16) * 0.01) for i in range(300)]
    small = [(300 + i, np.repeat(r.standard_normal((1, 16)), 2, 0)[0]) for i in range(60)]
    small += [(i + 60, v + r.standard_normal(16) * 0.01) for i, v in small]
    nodes = written(spark.createDataFrame([(i, 1, 1, v.astype(np.float32).tolist()) for i, v in big + small], neighbour_graph._NODE))
    p = neighbour_graph.Descent()
    truth = brute.linked_vectors([(i, v.astype(np.float32).tolist(), 1) for i, v in big + small])
    frame = lambda t: (spark.createDataFrame([(i, c) for i, (_, c) in t.items()], "id long, comp long"), spark.createDataFrame([(i, n) for i, (n, _) in t.items()], "id long, links long"))
    lost = truth | {i: (0, i) for i, _ in small}
    assert sum(n for n, _ in lost.values()) / sum(n for n, _ in truth.values()) > 0.995
    near = nodes.select("id")
    recall, judged = neighbour_graph._audit(nodes, *frame(truth), near, p)
    assert recall == 1 and judged >= 120
    assert neighbour_graph._audit(nodes, *frame(lost), near, p)[0] < 0.5


def _tight_groups(size):
    """Groups of ``size`` vectors whose members are all links of each other, as rows of one label."""
    r = np.random.default_rng(11)
    centres = r.standard_normal((1200 // size, 32))
    return [(g * size + k, (c + r.standard_normal(32) * 0.05).astype(np.float32).tolist(), 1) for g, c in enumerate(centres) for k in range(size)]


@pytest.mark.parametrize("size", [20, 40])
def test_the_joins_find_the_links(spark, monkeypatch, size):
    """With the local joins off, seeds from all tries together don't pass the audit; with them every link is there."""
    rows = _tight_groups(size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out, *_ = neighbour_graph.linked_vectors(df)
    assert {x.vec_id: (x.n_links, x.component_id) for x in out.collect()} == brute.linked_vectors(rows)
    monkeypatch.setattr(neighbour_graph, "_local_joins", lambda lists, nodes, p: spark.createDataFrame([], neighbour_graph._EDGE))
    with pytest.raises(RuntimeError, match="audit"):
        neighbour_graph.linked_vectors(df)


def test_no_recall_without_links(spark):
    """Vectors at right angles: nothing is known of the recall."""
    out, recall, judged = neighbour_graph.linked_vectors(spark.createDataFrame([(i, np.eye(12)[i].tolist(), 1) for i in range(12)], "vec_id long, embedding array<double>, label int"))
    assert (recall, judged, out.filter("n_links > 0").count()) == (None, 0, 0)


def test_a_failed_audit_is_an_error(spark):
    rows = [(i, [1.0, i / 100], 1) for i in range(20)]
    with pytest.raises(RuntimeError, match="audit"):
        neighbour_graph.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), neighbour_graph.Descent(audit_recall=1.1, tries=1))


# 3
def test_segmentation_is_the_models_own_without_dropout(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.Pieces(pieces.default_model())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "a", "  two  spaces ", "x" * 300, "é中\U0001f600\n\n", "tab\there"]
    got = pieces.encode_texts(list(enumerate(texts)), p, 0.0, 1, 8)
    assert [g.tolist() for g in got] == [sp.encode(t) for t in texts]


def test_dropout_round_trip(spark):
    docs = hard_documents(spark).drop("ids")
    a = pieces.round_trip(docs).collect()
    assert all(r.lossless for r in a) and Counter(a) == Counter(pieces.round_trip(docs).collect())
    plain = {(r.doc_id, r.ids_hash) for r in pieces.round_trip(docs, rate=0.0).collect()}
    assert {(r.doc_id, r.ids_hash) for r in a} - plain
    assert {(r.doc_id, r.ids_hash) for r in a} != {(r.doc_id, r.ids_hash) for r in pieces.round_trip(docs, seed=2).collect()}
    assert pieces.round_trip(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="column"):
        pieces.encode(docs.withColumn("ids", F.lit(1)))


def test_dropped_merges_do_not_happen():
    p = pieces.Pieces(pieces.default_model())
    every = pieces.encode_texts([(1, "hello world")], p, 1.0, 1, 8)[0]
    assert len(every) == len(" hello world")
    chunk = " internationalisation" * 1
    key = np.array([7], np.uint64)
    short, _ = pieces.segment([chunk], key, 0.3, p)
    keep = pieces.LONG_CHUNK
    try:
        pieces.LONG_CHUNK = 0
        assert pieces.segment([chunk], key, 0.3, p)[0].tolist() == short.tolist()
    finally:
        pieces.LONG_CHUNK = keep


def test_each_occurrence_has_coins_of_its_own(spark):
    p = pieces.Pieces(pieces.default_model())
    word = " internationalisation"
    once = lambda rows, copies=0: [tuple(g.tolist()) for g in pieces.encode_texts(rows, p, 0.3, 1, copies)]
    # inside a document: the pieces of each word, told apart by their leading space
    starts = [i for i, b in enumerate(p.bytes_of) if b.startswith(b" ")]
    ids = np.array(once([(1, word[1:] + word * 199)])[0])
    words = np.split(ids, np.flatnonzero(np.isin(ids, starts))[1:])
    assert len(words) == 200 and len({tuple(w.tolist()) for w in words}) > 8
    # over documents, over copies, over null ids with texts of their own
    assert len(set(once([(d, word[1:]) for d in range(200)]))) > 8
    assert len(set(once([(1, word[1:])] * 200, list(range(200))))) > 8
    assert once([(1, word[1:])] * 2)[0] == once([(1, word[1:])])[0]
    a, b = once([(None, f"{word * 20} a"), (None, f"{word * 20} b")])
    assert a[:20] != b[:20]
    df = spark.createDataFrame([(1, word * 5, k) for k in range(3)], "doc_id long, text string, n int")
    assert len({tuple(r.ids) for r in pieces.encode(df, rate=0.3, copy="n").collect()}) == 3


def test_remembered_runs_are_those_of_an_agenda_for_each_occurrence(spark):
    p = pieces.Pieces(pieces.default_model())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()] + [(None, "é中\U0001f600 ▁ \x00"), (7, None), (8, "")]
    keep, runs = (pieces.LONG_CHUNK, pieces.MOST_RUNS), pieces.Runs(p)
    try:
        pieces.MOST_RUNS = 1000
        got = [g for at in range(0, len(rows), 10) for g in pieces.encode_texts(rows[at : at + 10], p, 0.2, 1, 0, runs)]
        pieces.LONG_CHUNK = 0
        want = pieces.encode_texts(rows, p, 0.2, 1, 0)
    finally:
        pieces.LONG_CHUNK, pieces.MOST_RUNS = keep
    assert [None if g is None else g.tolist() for g in got] == [None if g is None else g.tolist() for g in want]


def test_pieces_of_random_chunks_are_those_of_a_plain_agenda():
    p, r = pieces.Pieces(pieces.default_model()), random.Random(6)
    letters = ["e", "t", "a", "n", "i", "o", "s", "r", "h", "l", "d", "c", "er", "ing", "tion", "the", "é", "中", "▁", "0", "."]
    chunks = [" " * r.randrange(3) + "".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    assert {len(c) > pieces.LONG_CHUNK for c in chunks} == {True, False}
    keys = np.array([r.getrandbits(64) for _ in chunks], np.uint64)
    for rate in (0.0, 0.1, 0.3, 0.9):
        flat, n = pieces.segment(chunks, keys, rate, p)
        got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == [brute.agenda(c, int(k), rate, p) for c, k in zip(chunks, keys, strict=True)]


def test_encoding_with_its_check(spark):
    docs = hard_documents(spark).drop("ids")
    both = {r.both: r for r in pieces.decode(pieces.encode(docs.withColumn("both", F.xxhash64("doc_id", "text")), ids="p"), ids="p").collect()}
    for r in pieces.encode_and_check(docs.withColumn("both", F.xxhash64("doc_id", "text"))).collect():
        assert both[r.both].decoded == both[r.both].text and r.lossless and r.n_tokens == len(r.ids or [])
        assert (r.decoded_sha256 is None) == (r.ids is None) == (both[r.both].text is None) and r.size == 1
    assert pieces.encode_and_check(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="column"):
        pieces.encode_and_check(docs.withColumn("lossless", F.lit(1)))


# 4
def test_quality_scores(spark):
    rows = quality_model.op4_nbsvm(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    hits = sum(r.predicted == r.quality for r in rows) / len(rows)
    base = max(Counter(r.quality for r in rows).values()) / len(rows)
    assert hits >= max(0.85, base), (hits, base)
    everything = quality_model.op4_nbsvm(spark, SF).collect()
    assert len(everything) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in everything)


def test_ratios_and_dual_solution_are_those_of_plain_numpy(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 60, 12) + 20 * (i % 2)) for i in range(60)]
    marks = [i % 2 for i in range(60)]
    x = [quality_model.features(t, quality_model._Words()) for t in texts]
    counts = np.ones((2, quality_model.BUCKETS))
    for ids, c in zip(x, marks, strict=True):
        counts[c, ids] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratios = quality_model.log_ratios(spark.createDataFrame(list(zip(texts, marks, strict=True)), "text string, label int"))
    assert np.allclose(ratios, want)
    y = np.where(np.array(marks) == 1, 1, -1)
    w, bias = quality_model.dual_coordinate_descent(x, y, ratios, epochs=5000, tolerance=1e-9)
    used = np.unique(np.concatenate(x))
    rows = np.zeros((60, len(used) + 1))
    for i, ids in enumerate(x):
        rows[i, np.searchsorted(used, ids)], rows[i, -1] = ratios[ids], 1
        rows[i] /= np.linalg.norm(rows[i])
    q, a = (rows * y[:, None]) @ (rows * y[:, None]).T, np.zeros(60)
    for _ in range(20_000):  # projected gradient on the dual; both classes have half of the rows, so each costs 1
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, 1)
    assert np.allclose((a * y) @ rows, [*w[used], bias], atol=1e-4)
    model = quality_model.QualityModel(ratios, w, bias, 2.0, -0.5)
    m = rows @ [*w[used], bias]
    assert np.allclose([model.score(t, quality_model._Words()) for t in texts], 1 / (1 + np.exp(0.5 - 2 * m)), atol=1e-5)


def test_very_long_texts_and_a_small_sample(spark):
    good = [" ".join(f"Good{k} sentence, number {k * i}." for k in range(40)) for i in range(30)]
    bad = [" ".join(f"BAD### {k * i}!!!" for k in range(40)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, label int")
    for bound in (16_000_000, 1000):
        model = quality_model.fit(docs, marks, sample_features=bound)
        long = [" ".join(f"{head} {k}x{k * 7}" for k in range(150_000)) for head in ("Good sentence, number", "BAD### !!!")]
        scores = {r.doc_id: r.score for r in quality_model.score_documents(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model).collect()}
        assert scores[0] > scores[1]
    assert quality_model.score_documents(docs.limit(0), model).count() == 0


def test_quality_scores_of_hard_rows(spark):
    docs = hard_documents(spark)
    for labels in ([], [1, 1], [0, 1, None]):
        known = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(3)] * 2 + [(0, None)], "doc_id long, text string")
        marks = spark.createDataFrame([*enumerate(labels), (None, 1), (9, 1)], "doc_id long, label int")
        scores = quality_model.score_documents(docs, quality_model.fit(known, marks)).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)


# 5
def test_line_dedup_of_hard_rows(spark):
    docs = hard_documents(spark, extra=False)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text or "" for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute.dedup_lines(rows)
    many = line_dedup.dedup_lines(hard_documents(spark))
    assert many.columns == hard_documents(spark).columns and many.count() == 11 and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_line_in_every_document_over_many_partitions(spark):
    rows = [(i, f"the very common line\nown line number {i}\n" + "the very common line\n" * (i % 3)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute.dedup_lines(rows)


# 6
def test_near_duplicates_of_real_and_hard_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard_documents(spark, extra=False).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = minhash.near_duplicates(hard_documents(spark)).collect()
    assert len(odd) == 11 and [r.kept for r in odd if r.doc_id is None] == [True]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.deduplicated(hard_documents(spark)).columns == hard_documents(spark).columns


def test_pairs_around_the_threshold_and_a_large_group(spark):
    r = random.Random(3)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(4):
            w = list(base)
            for i in r.sample(range(120), r.randrange(0, 6)):
                w[i] = f"n{r.random()}"
            rows.append((len(rows), " ".join(w)))
    crowd = [f"c{i}" for i in range(200)]
    for i in range(300):
        w = list(crowd)
        w[r.randrange(200)] = f"m{i}"
        rows.append((len(rows), " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_duplicates(rows)


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    text = lambda k, *more: " ".join([*(f"g{k}w{i}" for i in range(200)), *more])
    rows = [
        (1, text(1)), (1, text(1)),  # repeated
        (2, text(2)), (2, text(3)), (3, text(3, "end")),  # one doc_id, two texts
        (4, text(4)), (None, text(4)), (None, text(4, "end")),  # null copies of a named one
        (None, text(5)), (None, text(5, "end")), (None, text(5)),
        (None, text(6)),
    ]
    got = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text.split("w")[0]) for r in got) == Counter([(1, "g1"), (2, "g2"), (2, "g3"), (4, "g4"), (None, "g5"), (None, "g6")])


def test_outsiders_of_a_large_bucket_meet_all_its_nodes_once(spark):
    """20,000 members of one component and 10 outsiders: outsiders times nodes, not nodes times nodes."""
    n, p = 20_000, minhash.MinHash()
    now = spark.range(n + 10).select(F.lit(64).cast("long").alias("bucket"), F.col("id").alias("node"), F.lit(100).cast("long").alias("n"), F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("comp"), F.lit(0).cast("long").alias("main"))
    sig = F.concat(F.lit(bytes(p.size - 9)), F.lpad(F.col("id").cast("string"), 9, "0").cast("binary"))
    active = spark.range(n + 10).select(F.col("id").alias("node"), sig.alias("sig"))
    dealt, key = minhash._bucket_blocks(now, active, p)
    blocks = dealt.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    assert blocks.agg(F.sum(F.col("l") * F.col("r"))).first()[0] == 10 * (n + 10)
    found = {(r.u, r.v) for r in minhash._within_buckets(now, active, p).filter(f"v >= {n - 5}").collect()}
    assert found == {(u, v) for u in range(n, n + 10) for v in range(n - 5, u)}


# 7
def test_mix(spark):
    docs = hard_documents(spark)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 11 and Counter(plan) == Counter(mixing.mix_plan(docs.repartition(5)).collect())
    assert sum(r.taken for r in plan) == sum(r.size for r in plan) and all(0 <= r.taken <= 3 * r.size for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.QUANTUM
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_plan(docs.filter("text IS NULL OR text = ''")).filter("taken > 0 OR first_position IS NOT NULL").count() == 0


def test_mix_equals_one_sorted_list(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    target, taken = brute.mix(rows)
    plan = mixing.mix_plan(docs).collect()
    assert {r.doc_id: r.taken for r in plan} == taken and all(abs(r.target - target[r.source]) < 1e-6 for r in plan)
    # the cut at the budget is what ends sources: without it every packet of every pass is taken
    assert brute.mix(rows, cut=False)[1] != taken
    queued = written(mixing.queued_documents(docs))
    packets = mixing.mix_packets(queued)
    assert packets.agg(F.sum("words")).first()[0] == 3 * sum(r.size for r in plan)
    for budget in (0, 1000, 10**12):
        assert mixing.mix_order(packets, budget).agg(F.sum("taken")).first()[0] == min(budget, 3 * sum(r.size for r in plan))
    order = mixing.mix_order(packets, 10**12).orderBy("position").collect()
    assert [r.position for r in order] == list(range(1, len(order) + 1)) and [r.finish for r in order] == sorted(r.finish for r in order)


def test_mix_of_as_many_sources_as_documents(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()} == brute.mix(rows)[1]


def test_targets_of_many_sources_by_ranges(spark):
    """The water level against adding sources one by one."""
    r = random.Random(4)
    sizes = [(f"s{i:03}" if i else None, r.choice([0, 1, 10, 10, 500, 90_000]), 1) for i in range(300)]
    got = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long, n_docs long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {x[0]: [5, 2, 1][i % 3] for i, x in enumerate(order)}
    caps, full = {s: 3 * n for s, n, _ in sizes}, set()
    while True:
        level = (sum(n for _, n, _ in sizes) - sum(caps[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and w * level >= caps[s]}
        if not more:
            break
        full |= more
    assert all(abs(got[s] - (caps[s] if s in full else weight[s] * level)) < 1e-6 for s in got) and len(got) == 300


# 8
def test_chat_round_trip_of_hard_turns(spark):
    texts = [r"\### Assistant: </turn> ok", None, "", "\\", "<+><+>", "a\n### user: b</turn>\n", "\\b\\h", "x" * 50_000]
    rows = [(1, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(texts)] + [(2, None, "a: ###", "t"), (2, 0, "assistant", "u"), (2, 0, "assistant", "u"), (None, 1, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    f = chat_format.format_conversations(turns).withColumns({"t": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in f.collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(role or "", t or "") for _, _, role, t in rows[:8]]
    assert got[1].loss == "".join(t or "" for _, _, role, t in rows[:8] if role == "assistant")
    assert [(x.role, x.text) for x in got[2].t] == [("a: ###", "t"), ("assistant", "u"), ("assistant", "u")] and None in got
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    """Many parts of pieces, strips cut inside wide letters, empty texts at the ends."""
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], ("\U0001f600<+>" * (i % 11) + f" \\ {i}") if i % 7 else "") for i in range(5000)]
    f = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = f.withColumns({"t": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).first()
    assert [tuple(t) for t in got.t] == [x[2:] for x in rows]
    assert got.loss == "".join(x[3] for x in rows if x[2] == "assistant")
    assert len(got.loss_spans) == sum(x[2] == "assistant" for x in rows)


# 9
def test_quality_rules_of_hard_rows(spark):
    docs = hard_documents(spark)
    con = duckdb.connect()
    plain = hard_documents(spark, extra=False)
    con.register("documents", plain.toPandas())
    assert_same(quality_rules.judge_documents(plain.select("doc_id", "source", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), con.execute(queries.ORACLE_SQL["op9_quality_rules"]).df())
    assert quality_rules.judge_documents(docs).count() == 11 and quality_rules.passing_documents(docs).columns == docs.columns
    assert quality_rules.judge_documents(docs.limit(0)).count() == 0


def test_hosts_are_shrunk(spark):
    rows = [(1, "good", False)] * 200 + [(1, "bad", True)] * 200 + [(1, "bad", False)] * 5 + [(1, "tiny", True)]
    got = {r.h: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "x int, h string, base_failed boolean"), "h").collect()}
    assert got["good"].host_ok and not got["bad"].host_ok and got["tiny"].shrunk_rate < 1


def test_many_rejected_hosts_are_joined_by_salts(spark, monkeypatch):
    rows = [(i, "few words" if i % 2 else " ".join(f"w{i}x{j}" for j in range(12)), "en", "hot" if i < 150 else "bad" if i % 2 else None, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    want = {r.doc_id: r.kept for r in quality_rules.judge_documents(docs).collect()}
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", -1)
    assert {r.doc_id: r.kept for r in quality_rules.judge_documents(docs).collect()} == want and len(want) == 200


# 10
def test_token_counts(spark):
    enc = token_files.load_encoding(token_files.default_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard_documents(spark).select("doc_id", "text"))
    want = Counter((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_files.count_tokens(docs).collect()) == want
    assert token_files.count_tokens(docs.limit(0)).count() == 0


def test_token_files_are_cut_by_bytes(spark):
    docs, path = spark.createDataFrame([(i, f"w{i} " * 500) for i in range(40)], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING}).coalesce(1), shared_dir(spark)
    token_files.write_token_files(docs, path, file_bytes=10_000)
    sizes = [r.length for r in token_files.read_files(spark, path).filter("length > 0").collect()]
    assert len(sizes) > 5 and max(sizes) < 20_000
    counted = token_files.count_tokens(docs).collect()
    assert {r.doc_id for r in counted} == set(range(40)) and sum(r.n_tokens for r in counted) * 2 + 40 * 12 > sum(sizes) - 40 * 12


def test_segments_over_many_blocks(spark):
    docs, path = hard_documents(spark).select("doc_id", "text"), shared_dir(spark)
    token_files.write_token_files(docs.coalesce(1), path, docs_per_file=4)
    whole = {(r.shard, r.ordinal, r.n_tokens) for r in token_files.scan_separators(spark, path)[0].collect()}
    assert {(r.shard, r.ordinal, r.n_tokens) for r in token_files.scan_separators(spark, path, block_tokens=3)[0].collect()} == whole
