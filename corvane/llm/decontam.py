"""Benchmark decontamination: an FM-index per training shard, searched for the windows of benchmark items.

A shard is a run of whole texts of one input partition, a few MB.  Benchmark
items are taken in blocks of bounded size; each block is broadcast, so nothing
that grows is.  Several blocks are passes one after another, each adding to the
hits so far; none is dropped.  No shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm import store
from corvane.llm.fm_index import FMIndex, mask_spans, merge
from corvane.llm.kernel import ALNUM_WORDS, blocks, tidy

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Benchmark words and items in one broadcast block (some 100 MB at most).
BLOCK_WORDS = 2_000_000
BLOCK_ITEMS = 100_000
#: What the operator adds; spans are by code points, end exclusive.
_SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
ADDED = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("hit_items", T.ArrayType(T.StringType())).add("removal_spans", T.ArrayType(_SPAN))


class PhraseBlock:
    """Distinct windows of a block of items over a vocabulary of word hashes; symbol i + 1 is vocabulary[i]."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        column = pa.array(texts, pa.string())
        hashes: list[np.ndarray] = []
        for a, b, words in blocks(column, ALNUM_WORDS):
            hashes += [words.hash[words.first[i] : words.first[i + 1]] for i in range(b - a)]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
        self.ids = [None if i is None else str(i) for i in ids]
        found: dict[int, dict[bytes, set[int]]] = {}
        for item, h in enumerate(hashes):
            if len(h):
                symbols = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
                size = min(window, len(h))
                for i in range(len(h) - size + 1):
                    found.setdefault(size, {}).setdefault(symbols[i : i + size].tobytes(), set()).add(item)
        #: (phrases [m, length], items of each phrase)
        self.groups = [(np.frombuffer(b"".join(by), dtype=np.int64).reshape(len(by), size), [sorted(x) for x in by.values()]) for size, by in sorted(found.items())]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def phrase_blocks(benchmark: DataFrame, text: str, key: str, window: int = WINDOW) -> Iterator[PhraseBlock]:
    """The items in blocks of bounded size; at least one block, maybe an empty one."""
    ids, texts, words, any_block = [], [], 0, False
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        ids.append(row["k"])
        texts.append(row["t"])
        words += len(row["t"]) // 2 + 1
        if words >= BLOCK_WORDS or len(ids) >= BLOCK_ITEMS:
            yield PhraseBlock(ids, texts, window)
            ids, texts, words, any_block = [], [], 0, True
    if ids or not any_block:
        yield PhraseBlock(ids, texts, window)


def _search(words, n_docs: int, phrases: PhraseBlock) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Mask of hit words; items that hit, by text."""
    # One terminator after each text: word i of text d stands at i + d.
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(words.first))
    place = np.arange(len(words.hash)) + doc_of_word
    sequence = np.zeros(len(words.hash) + n_docs, dtype=np.int64)
    sequence[place] = phrases.symbols(words.hash)
    mask, items = np.zeros(len(sequence), dtype=bool), {}
    if not phrases.groups or not sequence.any():
        return mask[place], items
    index = FMIndex(sequence, len(phrases.vocabulary))
    text_start = words.first[:-1] + np.arange(n_docs)
    for windows, owners in phrases.groups:
        which, low, high = index.search(windows)
        span, position = index.locate(low, high)
        mask |= merge(position, np.full(len(position), windows.shape[1]), len(sequence))
        doc = np.searchsorted(text_start, position, side="right") - 1
        for d, w in np.unique(np.stack((doc, which[span])), axis=1).T if len(span) else ():
            items.setdefault(int(d), set()).update(owners[w])
    return mask[place], items


def _pass(block, text: str, fields: list[str], first: bool, schema: pa.Schema):
    """A mapInArrow function: adds to each row what one block of phrases hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: PhraseBlock = block.value
        for batch in batches:
            for a, b, words in blocks(batch.column(batch.schema.get_field_index(text)), ALNUM_WORDS):
                n = b - a
                part = batch.slice(a, n)
                mask, items = _search(words, n, phrases)
                count = np.concatenate(([0], np.cumsum(mask)))
                n_hit = count[words.first[1:]] - count[words.first[:-1]]
                names = [[] for _ in range(n)] if first else part.column("hit_items").to_pylist()
                spans = [[] for _ in range(n)] if first else part.column("removal_spans").to_pylist()
                for d in np.flatnonzero(n_hit):
                    w0, w1 = words.first[d], words.first[d + 1]
                    base, limit = words.offsets[d], words.offsets[d + 1]
                    starts_point = (words.low[base:limit] & 0xC0) != 0x80
                    points = np.concatenate(([0], np.cumsum(starts_point)))
                    first_word, end_word = mask_spans(mask[w0:w1])
                    new = [(int(points[words.start[w0 + s] - base]), int(points[words.end[w0 + e - 1] - base])) for s, e in zip(first_word, end_word)]
                    spans[d], n_hit[d] = _merge_more(spans[d], new, words, int(w0), int(w1), points, int(base))
                    names[d] = sorted({*names[d], *(phrases.ids[i] for i in items.get(int(d), ()) if phrases.ids[i] is not None)})
                if not first:
                    n_hit = np.where(n_hit > 0, n_hit, part.column("n_hit").to_numpy())
                made = {"n_words": pa.array(np.diff(words.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_items": pa.array(names, schema.field("hit_items").type), "removal_spans": pa.array(spans, schema.field("removal_spans").type)}
                yield pa.RecordBatch.from_arrays([made[f] if f in made else part.column(f).cast(schema.field(f).type) for f in fields], schema=schema)

    return run


def _merge_more(old: list, new: list, words, w0: int, w1: int, points: np.ndarray, base: int) -> tuple[list, int]:
    """Old and new spans merged where a word joins them; how many words they cover."""
    covered = np.zeros(w1 - w0, dtype=bool)
    start, end = points[words.start[w0:w1] - base], points[words.end[w0:w1] - base]
    for s, e in [*((x["start"], x["end"]) for x in old), *new]:
        covered[np.searchsorted(start, s) : np.searchsorted(end, e, side="right")] = True
    a, b = mask_spans(covered)
    return [{"start": int(start[i]), "end": int(end[j - 1])} for i, j in zip(a, b)], int(covered.sum())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", key: str = "item_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, hit_items (sorted as strings) and removal_spans (merged, by code points).

    keep: the columns of ``docs`` to return (all by default); columns named as
    the added ones are replaced.  Null and empty texts have no words and no
    hits; repeated rows are each searched; an item without words hits nothing,
    items with a null id hit but aren't named; an empty benchmark hits nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    store.ship(spark)
    added = [f.name for f in ADDED]
    docs = docs.drop(*added)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    source = docs.select(*dict.fromkeys([*kept, text]))
    out, first = None, True
    for phrases in phrase_blocks(benchmark, item_text, key, window):
        if out is not None:  # another pass over what the last one found
            source = store.publish(out, "decontam")
        block = spark.sparkContext.broadcast(phrases)
        fields = T.StructType([*(f for f in source.schema.fields if f.name not in added), *ADDED.fields])
        out = source.mapInArrow(tidy(_pass(block, text, [f.name for f in fields], first, to_arrow_schema(fields))), fields)
        first = False
    return out.select(*kept, *added)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``decontaminate`` with the removal spans cut from the text; rows without spans stay as they are."""

    def step(state, s):
        gap = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.struct(s["end"].alias("at"), F.concat(state["out"], gap).alias("out"))

    cut = F.aggregate("removal_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("removal_spans") > 0, cut).otherwise(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(n, {WINDOW}) AS k, array_to_string(w[i:i + least(n, {WINDOW}) - 1], ' ') AS p
        FROM b, unnest(range(1, greatest(n - {WINDOW - 1}, 1) + 1)) AS u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
          FROM d, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
found AS (SELECT r, i, k, item_id FROM grams JOIN win USING (k, p)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) AS u(j) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""

QUERIES = {"op7_decontamination": query}
ORACLES = {"op7_decontamination": _SQL}
