"""Sentence pieces by a table of distinct chunks.

A normalised text is a row of chunks: white space marks, then what follows up to
the next mark.  Where no piece holds a mark behind another character, no piece
crosses chunks, and a merge in one never depends on another: so a distinct chunk
is segmented once, and a text's ids are its chunks' ids joined by position.

Tasks count chunks, a shuffle sums them, and the HEAD most frequent of at most
HEAD_CHARS characters are the table: segmented once for all texts, then broadcast.
They hold nearly all positions, every hot chunk among them.  The rest, of which
each is rare or long, is segmented once in each task that meets it (in bounded
portions), as shuffling rare chunks to the table and back moves every text.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import BLOCK_BYTES, tidy

MARK = "▁"
#: A chunk is kept without its first mark, which the library puts in front of a text.
CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
#: Chunks of the broadcast table, and the characters of the longest: some 40 MB in a worker at most.
HEAD, HEAD_CHARS = 1 << 18, 32
#: Chunks that a task counts, segments or keeps at once; characters of a text beyond which it is cut into such portions.
HELD, LONG = 1 << 17, 1 << 22
#: Bytes of a tokenizer file; one beyond is refused, as it is broadcast.
MODEL_BYTES = 64 << 20


def processor(model: bytes):
    """The library's tokenizer, once in a worker."""
    import sentencepiece

    if processor.held is None or processor.held[0] != model:
        processor.held = (model, sentencepiece.SentencePieceProcessor(model_proto=model))
    return processor.held[1]


processor.held = None


def chunks_apart(model: bytes) -> bool:
    """Whether chunks can be segmented apart: no piece has a mark behind another character, normalising adds one mark in front and drops none."""
    sp = processor(model)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    return not any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())) and sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"


def load(path: str) -> bytes:
    """The bytes of a tokenizer file."""
    size = Path(path).stat().st_size
    if size > MODEL_BYTES:
        raise ValueError(f"{path} has {size} bytes; a tokenizer of at most {MODEL_BYTES} is broadcast")
    return Path(path).read_bytes()


def _slices(column, most: int = BLOCK_BYTES):
    """Bounded runs of whole texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")), a + 1)
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def _portions(texts: list[str]):
    """Yields the chunks of normalised texts, in order and bounded in number, with how many belong to each text."""
    chunks, counts = [], []

    def of(text):
        if len(text) > LONG:
            found = (m[1] for m in CHUNK.finditer(text))
            while part := list(islice(found, HELD)):
                yield part
        elif text:
            yield text.split(MARK)[1:] if MARK + MARK not in text else CHUNK.findall(text)

    for i, text in enumerate(texts):
        for part in of(text):
            chunks += part
            counts.append((i, len(part)))
            if len(chunks) >= HELD:
                yield chunks, counts
                chunks, counts = [], []
    if chunks:
        yield chunks, counts


def _counter(model, column: int):
    """(chunk, n) of the chunks of a task's texts, in portions."""

    def run(batches):
        sp, n = processor(model.value), Counter()
        portion = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["chunk", "n"])
        for batch in batches:
            for _, _, texts in _slices(batch.column(column)):
                for chunks, _ in _portions(sp.normalize(texts)):
                    n.update(chunks)
                    if len(n) > HELD:
                        yield portion()
                        n.clear()
        if n:
            yield portion()

    return run


def _segment(sp, chunks: list[str]) -> list[list[int]]:
    """Each chunk's ids; a lone mark would be an empty text."""
    lone = sp.encode("a ")[len(sp.encode("a")) :]
    return [ids if c else lone for ids, c in zip(sp.encode(chunks, num_threads=1), chunks)] if chunks else []


def _segmenter(model):
    def run(batches):
        sp = processor(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_segment(sp, batch.column(0).to_pylist()), pa.list_(pa.int32()))], names=["chunk", "ids"])

    return run


def chunk_counts(texts: DataFrame, column: str, model) -> DataFrame:
    """(chunk, n): every distinct chunk of a text column; a written table."""
    schema = T.StructType().add("chunk", T.StringType()).add("n", T.LongType())
    return store.publish(texts.select(column).mapInArrow(tidy(_counter(model, 0)), schema).groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")


def chunk_table(counts: DataFrame, model) -> pa.Table:
    """(chunk, ids) of the most frequent short chunks, each segmented once: the counts' magnitudes give a bound, so at most HEAD rows are gathered."""
    short = F.length("chunk") <= HEAD_CHARS
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r.level: r["count"] for r in counts.where(short).groupBy(level.alias("level")).count().collect()}  # at most 512 rows
    least, held = 1 << 30, 0
    for value in sorted(sizes, reverse=True):
        held += sizes[value]
        if held > HEAD:
            break
        least = value
    schema = T.StructType().add("chunk", T.StringType()).add("ids", T.ArrayType(T.IntegerType()))
    return counts.where(short & (level >= least)).select("chunk").mapInArrow(tidy(_segmenter(model)), schema).toArrow()


class _Ids:
    """Ids of numbered chunks, one after the other."""

    def __init__(self, lists: pa.ListArray):
        self.flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size


class ChunkIds:
    """Ids of texts by the broadcast table, and by a table of the task's own for other chunks."""

    def __init__(self, sp, table: pa.Table):
        self.sp, self.head, self.own = sp, _Ids(table.column(1).combine_chunks()), {}
        self.place = dict(zip(table.column(0).to_pylist(), range(len(table))))

    def of(self, texts: list[str]) -> pa.ListArray:
        """The ids of normalised texts, a bounded number of chunks at a time."""
        total, found = np.zeros(len(texts) + 1, dtype=np.int64), []
        for chunks, counts in _portions(texts):
            ids, size = self._portion(chunks)
            found.append(ids)
            at = 0
            for i, n in counts:
                total[i + 1] += int(size[at : at + n].sum())
                at += n
        return pa.ListArray.from_arrays(pa.array(np.cumsum(total), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0), pa.int32()))

    def _portion(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number by chunk."""
        get = self.place.get
        at = np.array([get(c, -1) for c in chunks])
        missed = np.flatnonzero(at < 0)
        size = self.head.size[at] if len(self.place) else np.zeros(len(at), dtype=np.int64)
        rest = [chunks[i] for i in missed.tolist()]
        if len(self.own) > HELD:
            self.own.clear()
        new = list({c for c in rest if c not in self.own})
        self.own.update(zip(new, (np.array(x, dtype=np.int32) for x in _segment(self.sp, new))))
        lists = [self.own[c] for c in rest]
        size[missed] = [len(x) for x in lists]
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        if lists:
            kept = np.zeros(len(out) + 1, dtype=np.int32)  # which ids are the rest's: a chunk's first adds one, what follows its last takes it back
            np.add.at(kept, (ends - size)[missed], 1)
            np.add.at(kept, ends[missed], -1)
            out[np.cumsum(kept[:-1]) > 0] = np.concatenate(lists)
        known = np.flatnonzero(at >= 0)
        n = size[known]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - size)[known], n) + within] = self.head.flat[np.repeat(self.head.start[at[known]], n) + within]
        return out, size


def _resolver(model, table, column: int, schema: pa.Schema):
    """Adds the ids of each text."""

    def run(batches):
        sp = processor(model.value)
        if _resolver.held is None or _resolver.held[0] is not table.value:  # once in a worker
            _resolver.held = (table.value, ChunkIds(sp, table.value))
        known = _resolver.held[1]
        for batch in batches:
            for a, b, texts in _slices(batch.column(column)):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, known.of(sp.normalize(texts))], schema=schema)

    return run


_resolver.held = None


def _whole(model, column: int, schema: pa.Schema):
    """Encodes whole texts, for tokenizers whose pieces cross chunks."""

    def run(batches):
        sp = processor(model.value)
        for batch in batches:
            for a, b, texts in _slices(batch.column(column)):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))], schema=schema)

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """The rows with ``out``: the ids of the whole text, as the library encodes it without begin or end ids.

    Null and empty texts have no ids.  Repeated rows stay as they are; other
    columns are kept, whatever their names.  A chunk is as long as its text has
    no white space.  A tokenizer whose pieces cross chunks encodes whole texts.
    """
    spark = docs.sparkSession
    store.ship(spark)
    proto = load(model_path)
    model = spark.sparkContext.broadcast(proto)
    own = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    at, ids = docs.columns.index(text), T.ArrayType(T.IntegerType())
    names = [*docs.columns, out]
    schema = T.StructType([*plain.schema.fields]).add("__ids", ids)
    if not chunks_apart(proto):
        return plain.mapInArrow(tidy(_whole(model, at, to_arrow_schema(schema))), schema).toDF(*names)
    counts = chunk_counts(plain, own[at], model)
    table = spark.sparkContext.broadcast(chunk_table(counts, model))
    store.discard(counts)
    return plain.mapInArrow(tidy(_resolver(model, table, at, to_arrow_schema(schema))), schema).toDF(*names)


def _decoder(model, column: int, schema: pa.Schema):
    """Adds the texts of lists of ids, some 1,000,000 ids of whole texts at a time."""

    def run(batches):
        sp = processor(model.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends, a = np.cumsum(sizes), 0
            while a < len(batch):
                b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, side="right")), a + 1)
                lists = batch.column(column).slice(a, b - a)
                flat, cuts = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *sizes[a:b].tolist()]).tolist()
                texts = [None if empty else sp.decode(flat[i:j]) if j > i else "" for i, j, empty in zip(cuts, cuts[1:], lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], schema=schema)
                a = b

    return run


def decode(rows: DataFrame, model_path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """The rows with ``out``: the library's text of their ids; null ids give null, none an empty text."""
    spark = rows.sparkSession
    store.ship(spark)
    model = spark.sparkContext.broadcast(load(model_path))
    own = rows.toDF(*(f"__c{i}" for i in range(len(rows.columns))))
    schema = T.StructType([*own.schema.fields]).add("__text", T.StringType())
    return own.mapInArrow(tidy(_decoder(model, rows.columns.index(ids), to_arrow_schema(schema))), schema).toDF(*rows.columns, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, path).drop("text")
    both = decode(encoded, path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("piece_ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


QUERIES = {"op12_sentence_pieces": query}
ORACLES: dict[str, str] = {}
