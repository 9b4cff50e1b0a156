"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from fixhound.llm import decontaminate

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.count() == len(now) and now <= ids
        ids = now
        if name == "benchmark_leaks":
            items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
            assert decontaminate.contaminated(docs, items).count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ids


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 0


def test_rows_keep_their_values(spark):
    """Ids that are null or shared, repeated rows, null texts, and columns named like those of the stages."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(150)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    leak = items.selectExpr("concat('word ', text, ' and more words behind it that are plain') AS text").first().text
    rows = [tuple(r) for r in docs.collect()]
    fine = [r for r in rows if 400 < len(r[1]) < 4000][:40]
    rows += [(None, *r[1:]) for r in fine[:3]] + [fine[3], fine[3]] + [(fine[4][0], *fine[5][1:]), (None, None, None, None, None), (1, "", "en", "s", 0)]
    rows += [(None, leak, "en", "s", 3), (fine[6][0], leak, "en", "s", 3)]
    extra = "n_words bigint, kept string, score double, lang_pred string, row string, digest string, label int, class bigint, _row int"
    values = (-5, "mine", 7.0, "xx", "r", "d", 4, 9, 8)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra
    docs = spark.createDataFrame([r + values for r in rows], schema)
    known = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= known, name
        texts = [r[1] for r in got]
        if name == "quality_rules":
            assert None not in texts and "" not in texts
            assert sum(r[0] is None for r in got) >= 3
        if name == "near_duplicates":
            assert len(set(texts)) == len(texts) and {r[1] for r in fine} & set(texts)
        if name == "benchmark_leaks":
            assert leak not in texts
            assert fine[6][1] not in before or fine[6][1] in texts
        before = set(texts)
        docs = spark.createDataFrame(got, schema)
