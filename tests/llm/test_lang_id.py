import random
import zlib

import pytest

from pyspark.sql import functions as F

from corvane.llm import lang_id

SYLLABLES = {"xa": ["ka", "to", "mi", "ruk"], "xb": ["zel", "gri", "sno", "wub"], "xc": ["éa", "ñui", "ßo", "yth"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(text(rng, lang, rng.randrange(20, 60)), lang) for lang in SYLLABLES for _ in range(25)] + [(None, "xa"), ("kato", None), ("", "xb")]
    return lang_id.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_accuracy_and_mixtures(spark, model):
    rng = random.Random(6)
    rows = [(i, text(rng, lang, n), lang, 1) for i, (lang, n) in enumerate((lang, n) for lang in SYLLABLES for n in (2, 5, 30, 400))]
    mixed = [(100, text(rng, "xa", 100) + " " + text(rng, "xc", 60), "xa", 1)]
    df = spark.createDataFrame(rows + mixed, "id int, body string, want string, score int")
    got = {r.id: r for r in lang_id.identify(df, model, text="body").collect()}
    assert all(got[i].lang_pred == want for i, _, want, _ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    sets = {s["lang"]: s["share"] for s in got[100].languages}
    assert set(sets) == {"xa", "xc"} and 0.45 < sets["xa"] < 0.75 and got[100].lang_pred == "xa"
    assert [len(got[i].languages) for i, *_ in rows if i % 4 >= 2] == [1] * 6


def test_texts_without_letters_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 456"), (4, "k"), (4, "k"), (5, "zelgri " * 30000)], "id int, text string")
    got = [(r.id, r.lang_pred, len(r.languages)) for r in lang_id.identify(df, model).orderBy("id").collect()]
    assert got[:3] == [(1, "und", 0), (2, "und", 0), (3, "und", 0)]
    assert got[3] == got[4] and got[3][1] in SYLLABLES
    assert got[5][1] == "xb"
    assert lang_id.identify(df.limit(0), model).count() == 0
    nothing = lang_id.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in lang_id.identify(df, nothing).collect()} == {"und"}


def test_the_query_holds_out_by_the_id_and_predicts_what_it_never_saw(spark):
    """Over the query itself, on texts of four languages."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in lang_id.query(spark, sf).collect()}
    assert set(got) == set(docs)
    right = []
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        has = any(c.isalpha() for c in docs[d].text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
        if r.held_out and has and docs[d].lang:
            right.append(r.lang_pred == docs[d].lang)
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    other.write.parquet(f"{tmp_path}/documents.parquet")
    take = lambda sf: sorted(map(tuple, lang_id.query(spark, sf).collect()))
    assert take("/root/testdata/sf0.001") == take(str(tmp_path))
