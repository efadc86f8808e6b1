"""The pipeline's stages on an empty table, with very long texts, nulls, repeated rows and columns that clash."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    say = lambda i, n: " ".join(f"w{(i * 31 + j * j) % 997}x{j % 7}" for j in range(n))
    rows = [(i, say(i, 60 + i), "en", f"s{i % 3}", 300) for i in range(40)]
    rows += [(40, say(41, 200_000), None, None, None), (None, None, None, None, None), (41, "", "en", "s1", 0), (41, "", "en", "s1", 0), (None, say(3, 63), "de", "s0", 1), (7, say(7, 67), "en", "s1", 300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("clash") for c in ("text_key", "score", "component", "kept", "mix_kept", "mix_tokens", "predicted", "l", "first")}
    return frame.withColumns(clash).repartition(4)


@pytest.mark.parametrize(("number", "name"), list(enumerate(n for n, _ in corpus_pipeline.STAGES)))
def test_stages_at_their_edges(spark, docs, folder, number, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, folder)
    rows = out.collect()
    last = number == len(corpus_pipeline.STAGES) - 1
    assert last or out.columns == docs.columns
    given = {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= given
    if not last:
        assert all(r["score"] == r["mix_kept"] == "clash" for r in rows)
    else:
        assert len(rows) == docs.count() and {r.doc_id: r.n_tokens for r in rows}[41] == 0
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == out.columns and empty.count() == 0
