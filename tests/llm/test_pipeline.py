"""The five stages against brute-force versions of each."""

from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from specloom.llm import pieces

from ..oracle import SF
from . import brute
from .test_operators import hard_documents


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, SF)
        if k < 4:
            assert df.columns == docs.columns
            docs = corpus_pipeline.written(df)
            df = docs
        out.append(df.collect())
    return out


def test_rules_lines_and_near_copies(stages):
    start, quality, lines, near = stages[:4]
    assert {r.doc_id for r in quality} == brute.quality([(r.doc_id, r.source, r.text) for r in start])
    assert {r.doc_id: r.text for r in lines} == brute.dedup_lines([(r.doc_id, r.text) for r in quality])
    assert all(r.n_chars == len(r.text) for r in lines)
    comp = brute.near_duplicates([(r.doc_id, r.text) for r in lines])
    assert Counter(r.doc_id for r in near) == Counter(d for d, (_, c) in comp.items() if c == d)


def test_mix_and_encoding(spark, stages):
    near, mixed, last = stages[3:]
    taken = brute.mix([(r.doc_id, r.source, r.text) for r in near])[1]
    size = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in near}
    want = Counter({d: (2 * n + size[d]) // (2 * size[d]) for d, n in taken.items() if size[d]})
    assert Counter(r.doc_id for r in mixed) == +want
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert len(last) == len(mixed) and all(r.lossless and r.n_tokens == len(r.ids) for r in last)
    texts = {r.doc_id: r.text for r in mixed}
    assert all(sp.decode(list(r.ids)) == texts[r.doc_id] for r in last)


def test_copies_of_a_document_have_pieces_of_their_own(stages):
    copies = {}
    for r in stages[-1]:
        copies.setdefault(r.doc_id, []).append(tuple(r.ids))
    long = [c for c in copies.values() if len(c) > 1 and len(c[0]) > 200]
    assert long and all(len(set(c)) == len(c) for c in long)


def test_hard_rows_and_an_empty_table_go_through_all_stages(spark):
    docs = hard_documents(spark, extra=False)
    rows = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, "no id " * 20, None, None, 1)], docs.schema))
    for start in (rows, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if k < 4:
                assert now.columns == docs.columns
                now = corpus_pipeline.written(now)
        out = now.collect()
        assert all(r.lossless for r in out) and bool(out) == (start is rows)


def test_stages_keep_columns_of_any_name(spark):
    docs = hard_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
