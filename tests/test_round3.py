"""Findings of round 3: odd inputs, and steps that must not grow with the tables."""

import math
import random
import re
import struct
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from specloom.operators import temporal as T
from specloom.operators.cells import CellIndex
from specloom.operators.lexical import TERM, LexicalIndex, terms
from specloom.plans import queries_text, registry
from specloom.sources.staging import shared_dir


def test_vector_literals_round_like_printf(spark, tmp_path):
    minus_nan = struct.unpack("<f", struct.pack("<I", 0xFFC00000))[0]
    rows = [[math.nan, math.inf, -math.inf, None, -0.0], None, [], [None, None], [minus_nan, 1e-30, 3e38, 0.1], [i / 512 for i in range(-40, 40)]]
    pq.write_table(pa.table({"vec_id": range(len(rows)), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = registry.QUERIES["vector_literal"](spark, str(tmp_path)).collect()
    assert dict(map(tuple, got)) == dict(con.execute(registry.ORACLE_SQL["vector_literal"]).fetchall())


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_terms_are_what_the_pattern_matches(spark):
    text = "".join(map(chr, range(0x180))) + " ÀÉ A--b\u2028c\U0001f600d  " + "\x00e\x7f"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, text)]
    df = spark.createDataFrame([(text,), ("",), (None,), (" . ",)], "t string").select(terms(F.col("t")).alias("w"))
    assert "regexp" not in plan(df)
    assert [r["w"] for r in df.collect()] == [want, [], [], []]


def test_postings_are_a_row_a_term_and_block(spark):
    docs = spark.createDataFrame([(i, f"all even{i % 2}") for i in range(1000)], "id long, text string")
    ix = LexicalIndex(spark, shared_dir(spark)).build(docs, block_docs=100)
    postings = ix.read("postings")
    assert postings.count() == 30 == postings.select("term", "block").distinct().count()
    assert ix.read("blocks").agg(F.sum("n")).first()[0] == 2000


def test_manifests_are_made_once(spark):
    assert "MapIn" not in plan(registry.QUERIES["manifest_parse"](spark, "/root/testdata/sf0.001"))


def test_archives_are_handed_on_in_small_batches():
    texts = [random.Random(i).randbytes(1 << 20).hex() for i in range(12)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(12), "source": ["s"] * 12, "text": texts})
    made = list(queries_text._zip_rows(iter([batch])))
    assert sum(b.num_rows for b in made) == 12 and max(b.nbytes for b in made) < 8 << 20


def test_ranges_in_time_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_ROWS", 20)
    left = spark.createDataFrame([(i, 1, i) for i in range(600)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 7 * i, i) for i in range(60)], "k int, at int, n int")
    found = T.asof_join(left, right, ["k"], "t", "at", {"n": "n"})
    assert {r["id"]: r["n"] for r in found.collect()} == {i: min(i // 7, 59) for i in range(600)}
    assert len(found.inputFiles()) > 20


def test_a_hot_cell_is_many_files(spark):
    chunk = spark.createDataFrame([(f"n{i}", i, [1.0, 0.5]) for i in range(2000)] + [("m", 0, [0.0, 1.0])], "node_id string, ord int, embedding array<double>")
    ix = CellIndex(spark, shared_dir(spark)).build(chunk, cells=2, sample_rows=100, task_rows=100)
    stored = ix.probe([1.0, 0.5], 2)
    assert stored.count() == 2001
    assert stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 500


SPANS = "id int, key string, s int, e int"


def test_rows_of_small_keys_meet_whole(spark):
    """spans of many lengths were written once or twice a level."""
    a = spark.createDataFrame([(i, f"k{i % 9}", i, i + (1 << i % 20)) for i in range(200)], SPANS)
    found = T.overlap_join(a, a, ["key"], ("s", "e"), ("s", "e")).select("l.id", F.col("r.id").alias("other"))
    assert "Generate" not in plan(found) and "Union" not in plan(found)
    rows = a.collect()
    assert sorted(map(tuple, found.collect())) == sorted((x.id, y.id) for x in rows for y in rows if x.key == y.key and x.s < y.e and y.s < x.e)


def test_large_keys_meet_by_bins_beside_small_ones(spark, monkeypatch):
    monkeypatch.setattr(T, "KEY_ROWS", 40)
    r = random.Random(4)

    def spans(n, sizes):
        out = [(i, r.choice(["hot", "hot", "hot", *sizes, None]), r.choice([None, *range(-90, 400)]), r.choice([0, 1, 2, 5, 9, 70, 600, None])) for i in range(n)]
        return [(i, k, s, None if s is None or n is None else s + n) for i, k, s, n in out]

    a, b = spans(200, ["x", "y", "left"]), spans(150, ["x", "y", "z", "right"])
    real = lambda x: (-(10**9) if x[2] is None else x[2], 10**9 if x[3] is None else x[3])
    hit = lambda x, y: x[1] is not None and x[1] == y[1] and max(real(x)[0], real(y)[0]) < min(real(x)[1], real(y)[1])
    found = T.overlap_join(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), ["key"], ("s", "e"), ("s", "e"))
    assert "Union" in plan(found)
    assert sorted((x.l.id, x.r.id) for x in found.collect()) == sorted((x[0], y[0]) for x in a for y in b if hit(x, y))


def test_shipments_on_odd_orders_equal_their_sql(spark, tmp_path):
    """No dates, no customer, an order twice, an order shipped before its date."""
    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(days=n)
    orders = [(1, 7, 0), (2, 7, 5), (2, 7, 5), (3, 7, None), (4, None, 3), (5, 7, 90), (6, 7, 20), (None, 7, 1)]
    items = [(1, 1, 9), (1, 1, 9), (1, 2, None), (2, 1, 30), (3, 1, 12), (4, 1, 8), (5, 1, 2), (6, 1, 21), (6, None, 22), (9, 1, 4), (None, 1, 4)]
    stamp, names = pa.timestamp("us"), {"orders": ["o_orderkey", "o_custkey", "o_orderdate"], "lineitem": ["l_orderkey", "l_linenumber", "l_shipdate"]}
    con = duckdb.connect()
    for t, rows in (("orders", orders), ("lineitem", items)):
        columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([day(x[2]) for x in rows], stamp)]
        pq.write_table(pa.table(dict(zip(names[t], columns, strict=True))), tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for q in ("shipments_in_force", "order_overlaps"):
        got = registry.QUERIES[q](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(registry.ORACLE_SQL[q]).fetchall())), q
