import pytest
from specloom.plans import registry

from .oracle import SF, assert_same, connect


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), connect().execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["merge_nodes", "merge_summary", "merge_vanished", "ingest_archives", "stale_chunks", "whitelist_merge", "spec_subtree", "adoc_attrs"])
def test_query_equals_its_sql_on_more_rows(spark, name):
    sf = SF.replace("0.001", "0.01")
    assert_same(registry.QUERIES[name](spark, sf), connect(sf).execute(registry.ORACLE_SQL[name]).df())


def test_stub_embedding_has_unit_length(spark):
    rows = registry.QUERIES["stub_embed_norm"](spark, SF).collect()
    assert rows and all(r["dim"] == 64 and abs(r["norm"] - 1) < 1e-3 for r in rows)


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(registry.__file__).resolve().parents[2]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "specloom", tmp_path / "specloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
