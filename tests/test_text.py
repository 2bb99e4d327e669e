"""Column functions against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from specloom.functions import text as X
from specloom.functions import vectors as V

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def windows(text, size, overlap):
    w, out, s = text.split(), [], 0
    while s < len(w):
        out.append(" ".join(w[s : s + size]))
        if s + size >= len(w):
            break
        s += max(1, size - overlap)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(200, 40), (5, 2), (5, 5), (3, 7), (4, -1), (1, 0)])
def test_chunks(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 4, 5, 6, 199, 200, 201, 360, 361)] + [" ", "a" + SPACES + "b", SPACES]
    assert values(spark, texts, lambda t: X.chunks(t, size, overlap)) == [windows(t, size, overlap) for t in texts]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab:_-é\n\r " + SPACES, max_size=60), min_size=20, max_size=40))
def test_words_and_attributes_as_python_sees_them(spark, texts):
    assert values(spark, texts, X.words) == [t.split() for t in texts]
    want = [dict((k, v.strip()) for k, v in re.findall(r"(?m)^:([\w-]+):[ \t]*(.*)$", t)) for t in texts]
    assert values(spark, texts, X.attributes) == want


def test_attributes_of_hard_texts(spark):
    texts = [":a: 1\r\n:b:\t x \r\n", ":a: 1\n:a: 2\n", ":a: \u00a0v\u00a0\n", ":a: x\u2028:b: y\n", ":no name: x\n::\n:k:", "\ufeff:a: 1\n:b: 2", ""]
    assert values(spark, texts, X.attributes) == [{"a": "1", "b": "x"}, {"a": "2"}, {"a": "v"}, {"a": "x\u2028:b: y"}, {"k": ""}, {"b": "2"}, {}]


def test_paths(spark):
    cases = [
        ("a/documents/01-context-and-requirements/business-rules.md", "business-rules", "document", "business-rules", None),
        ("processes/x.md", None, "document", "x", None),
        ("p/processes/x.y.md", "processes", "document", "x.y", None),
        ("requirements/business-fct-7/data-requirements.md", "data-requirements", "document", "data-requirements", "business-fct-7"),
        ("documents/06-architectural-decisions/adr-12.adoc", "architectural-decisions", "decision_record", "adr-12", None),
        ("documents/07-risks-and-technical-debts/my-R\u0130SK-1", "risks-and-technical-debts", "risk", "my-R\u0130SK-1", None),
        ("documents/03-constraints/.adoc", "constraints", "document", "", None),
        ("documents/03-constraints/ADR-", "constraints", "document", "ADR-", None),
    ]
    paths = [c[0] for c in cases]
    for k, f in enumerate((X.dimension, X.kind, X.slug, X.business_function), 1):
        assert values(spark, paths, f) == [c[k] for c in cases]


def test_malformed_bytes(spark):
    samples = [b"a\xff", b"\xc3", b"\xe2\x82", b"\xef\xbb\xbfx", b"\xed\xa0\x80", "é".encode()]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, b binary")
    got = [r["v"] for r in df.select("i", X.decode_utf8(F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [s.decode("utf-8", "replace") for s in samples]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    q = V.literal([3.0, 4.0])
    got = df.select(V.l2_norm(F.col("v")).alias("n"), V.cosine_distance(F.col("v"), q).alias("d"), V.normalize(F.col("v")).alias("u")).collect()
    assert got[0]["n"] == 5 and abs(got[0]["d"]) < 1e-12 and got[0]["u"] == [0.6, 0.8]
    assert got[1]["d"] is None and got[1]["u"] == [0, 0] and got[2]["d"] is None
    with pytest.raises(Exception, match="components"):
        df.select(V.checked(F.col("v"), 3)).collect()
    e = V.GaussianEmbedder(8)
    assert e.embed(["x"]) == e.embed(["x"]) and abs(sum(x * x for x in e.embed(["x"])[0]) - 1) < 1e-6
