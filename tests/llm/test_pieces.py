import pytest

from corvane.llm import pieces

P = pytest.importorskip("public_tokenizers")
S = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
TEXTS = [
    "Hello  world ", " leading", "tail   ", "   ", " ", "", None, "tabs\tand\nlines\r\n\n", "▁mark ▁▁ in a▁b text▁", "<s> </s> <unk> <0x41> \x00 \x7f",
    "日本語のテキスト 한국어 עברית", "é ﬁ ½ 　  x ​", "🙂🙂 👩‍👩‍👧 \U0010ffff", "a" * 3000, "word " * 5000, "x" + " " * 2000 + "y", "Ünïcödé" * 500,
]


@pytest.fixture(scope="module")
def library():
    return S.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("head,chars", [(1 << 17, 32), (0, 32), (5, 32), (1 << 17, 3)])
def test_as_the_library(spark, library, monkeypatch, head, chars):
    monkeypatch.setattr(pieces, "HEAD", head)
    monkeypatch.setattr(pieces, "HEAD_CHARS", chars)
    monkeypatch.setattr(pieces, "HELD", 3)
    monkeypatch.setattr(pieces, "LONG", 1000)
    rows = [(i, t, i, "kept") for i, t in enumerate(TEXTS)] + [(1, " leading", 1, "kept")] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string, piece_ids int, __known string").repartition(3)
    got = pieces.decode(pieces.encode(docs, PATH, out="ids"), PATH, "ids").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.decoded == (library.decode(ids) if ids else "") and (r.piece_ids, r["__known"]) == (r.doc_id, "kept")


def test_whole_texts_where_pieces_cross_chunks(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "chunks_apart", lambda model: False)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert all(r.piece_ids == library.encode(r.text or "") for r in pieces.encode(docs, PATH).collect())


def test_empty_table_and_null_ids(spark, library, monkeypatch):
    assert pieces.encode(spark.createDataFrame([], "text string"), PATH).count() == 0
    rows = spark.createDataFrame([(None,), ([],), (library.encode("a b"),)], "piece_ids array<int>")
    assert [r.decoded for r in pieces.decode(rows, PATH).collect()] == [None, "", "a b"]
    monkeypatch.setattr(pieces, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        pieces.load(PATH)


def test_each_chunk_once(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a",), ("b  c",)] * 4, "text string").repartition(4)
    model = spark.sparkContext.broadcast(pieces.load(PATH))
    counts = pieces.chunk_counts(docs, "text", model)
    assert {tuple(r) for r in counts.collect()} == {("a", 8), ("b", 8), ("▁c", 4)}
    assert sorted(pieces.chunk_table(counts, model).column(0).to_pylist()) == ["a", "b", "▁c"]
    monkeypatch.setattr(pieces, "HEAD", 2)
    assert sorted(pieces.chunk_table(counts, model).column(0).to_pylist()) == ["a", "b"]


def test_the_rest_is_segmented_once_in_a_task(library):
    table = pieces.pa.table({"chunk": ["a"], "ids": pieces.pa.array([library.encode("a")], pieces.pa.list_(pieces.pa.int32()))})
    asked = []

    class Counting:
        def encode(self, texts, **options):
            asked.extend(texts if isinstance(texts, list) else [])
            return library.encode(texts, **options)

    known = pieces.ChunkIds(Counting(), table)
    for _ in range(3):
        texts = ["a rare a rare word", "", "a", "rare"]
        assert known.of(library.normalize(texts)).to_pylist() == library.encode(texts)
    assert sorted(asked) == ["rare", "word"]


def test_query_on_whole_texts(spark, library):
    import hashlib

    got = {r.doc_id: r for r in pieces.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))
