import corpus_pipeline as pipeline
from waymill.llm import exact, jaccard, quality, secrets

from .test_tokens import check_packing


def test_stages_follow_each_other(docs, spark, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    left, sizes = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == pipeline.COLUMNS, name
        sizes.append(left.count())
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = docs.join(quality.judged(docs).filter("kept").select("doc_id"), "doc_id").select(*pipeline.COLUMNS).cache()
    one = good.join(exact.groups(good).filter("kept").select("doc_id"), "doc_id").select(*pipeline.COLUMNS).cache()
    near = {r.component_id for r in jaccard.clustered(one).collect()}
    assert sizes == [good.count(), one.count(), len(near), len(near)]
    assert ids(left) == near
    want = {r.doc_id: r.text for r in secrets.redacted(one).collect()}
    for r in left.collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text)
    rows = pipeline.run(spark, str(tmp_path)).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} == near


def test_stages_of_odd_and_empty_tables(odd, none, spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long + "  "), (2, None), (2, "short"), (3, ""), (5, long + " more"), (5, long.upper()), (5, " ".join(f"other{i}" for i in range(60)))]
    frame = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    ruled = pipeline.rules(spark, frame, "")
    assert found(ruled) == sorted([r for r in rows if r[1] and len(r[1]) > 9], key=str)
    one = pipeline.copies(spark, ruled, "")
    assert found(one) == sorted([(None, long + "  "), *rows[6:]], key=str)
    assert found(pipeline.near_copies(spark, one, "")) == sorted([(None, long + "  "), rows[8]], key=str)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
        assert stage(spark, odd, "").count() == {"quality_rules": 0, "exact_dedup": 2, "ngram_jaccard": 4, "secret_scan": 6, "best_fit_packing": 6}[name], name


def test_rejected_rows_go_though_another_with_their_id_stays(spark):
    good = " ".join(f"word{i}" for i in range(80))
    frame = spark.createDataFrame([(7, good, "en", "s", 1), (7, "too short", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in pipeline.rules(spark, frame, "").collect()] == [good]
