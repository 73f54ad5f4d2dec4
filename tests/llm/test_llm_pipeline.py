import pytest
from llm_cases import empty, frame

import __spark_entry__ as entry
import corpus_pipeline
from undercroft.llm.common import staged
from undercroft.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} - {"pipeline"}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    from check import connect, rows_of_spark, rows_of_sql, same

    names, got = rows_of_spark(QUERIES[name](spark, FOLDER))
    theirs, want = rows_of_sql(connect(FOLDER), ORACLE_SQL[name])
    assert names == theirs and got and same(got, want)


@pytest.mark.parametrize("make", [frame, empty])
def test_stages_keep_their_columns(spark, make):
    docs = make(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "encode":
            assert out.columns == docs.columns
            if name != "mix":
                assert out.count() <= docs.count()
        docs = out
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({r.doc_id for r in got}) > 100 and all(len(r.ids) == r.n_tokens > 0 for r in got)
