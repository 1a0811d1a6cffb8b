import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), None if not name else stage(spark, docs, SF).schema)
        out[name] = docs.collect()
    return out


def test_each_stage_does_its_part(spark, stages):
    from test_decontam import brute as leaks
    from test_near_dup import brute as groups
    from test_secrets import brute as found

    before = {r.doc_id: r for r in stages["input"]}
    languages = {r.doc_id: r for r in stages["language_id"]}
    assert {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text or "")} == set(languages)
    agree = sum(before[d].lang == r.lang for d, r in languages.items())
    assert agree >= 0.97 * len(languages)

    classes = groups([(d, r.text) for d, r in languages.items()], 5)
    deduped = {r.doc_id: r for r in stages["near_dup"]}
    assert set(deduped) == {d for d, (_, component) in classes.items() if component == d}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    cut = {r.doc_id: r for r in stages["decontamination"]}
    hits = {d: h for d, _, h, _ in leaks([(d, r.text) for d, r in deduped.items()], items, 10)}
    assert set(cut) == set(deduped)
    assert all((cut[d].text == deduped[d].text) == (h == 0) for d, h in hits.items())
    assert sum(h for _, _, h, _ in leaks([(d, r.text) for d, r in cut.items()], items, 10)) == 0

    safe = {r.doc_id: r for r in stages["secret_scans"]}
    assert set(safe) == set(cut) and not any(found(r.text) for r in safe.values())
    assert all(safe[d].text == r.text for d, r in cut.items() if not found(r.text))
    assert all(r.n_chars == len(r.text) for r in safe.values())

    mixed = stages["mixing"]
    assert 0 < len(mixed) < len(safe) and all(safe[r.doc_id].text == r.text for r in mixed)


def test_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "the same words again and again here", None, "s", 35, 1), (3, "the same words again and again here", None, "s", 35, 1), (None, "password=abcdefgh of the people", "en", None, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns[:5] == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[:5] == list(corpus_pipeline.COLUMNS)


def test_texts_without_any_label_are_kept(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_languages(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert kept.where("lang IS NOT NULL").count() == 0 and kept.columns == docs.select(*corpus_pipeline.COLUMNS).columns


def test_very_long_text_and_further_columns(spark):
    from pyspark.sql import functions as F

    long = "word " * 200_000
    rows = [(1, long, "en", "a", len(long), "x", 1), (2, "Ein kurzer Satz mit vielen Worten.", None, "b", 3, "y", 2), (3, None, "en", None, None, None, None), (4, "12 34", None, "a", 5, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("kept out"))
        assert {r.doc_id for r in docs.collect()} == {1, 2}
