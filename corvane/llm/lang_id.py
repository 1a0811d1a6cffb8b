"""Language identification as a multilingual mixture.

Each language is a distribution over hashed byte trigrams (ASCII letters in
lower case), counted over all labelled training texts.  For a text, EM
estimates the proportions of the languages; the language set is the one of
highest penalised likelihood among the best single language and the leading
languages of the full mixture.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import byte_blocks, runs, tidy

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Languages that the broadcast model may have: 256 * 32768 doubles are 64 MB.
MAX_LANGUAGES = 256
#: EM steps of the full mixture and of each smaller set.
STEPS, SET_STEPS = 12, 8
SMOOTHING = 0.5


def penalty(grams: np.ndarray) -> np.ndarray:
    """What each further language must gain, in nats.

    A share and a place in the set cost log(grams) each, as by a Bayesian
    criterion. 0.01 a gram is a margin for model error, which grows with the
    text: a single-language text's grams fit its own language's smoothed counts
    a little worse than a free mixture does.
    """
    return 2 * np.log(np.maximum(grams, 2)) + 0.01 * grams


def trigrams(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct buckets of each text, sorted; ``low`` has spare bytes at its end."""
    n = int(offsets[-1])
    if n < 3:
        return (np.zeros(0, dtype=np.int64),) * 3
    b = low[:n].astype(np.uint32)
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:-2] == text[2:]
    key = np.sort(((text[:-2] << BUCKET_BITS) | bucket)[inside])
    start, count = runs(key)
    return key[start] >> BUCKET_BITS, key[start] & (BUCKETS - 1), count


def _counter(schema: pa.Schema):
    """Sums (lang, bucket, count) over a partition; bucket -1 counts texts."""

    def flush(held):
        for lang, counts in held.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some - 1, pa.int32()), pa.array(counts[some])], schema=schema)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, low, offsets in byte_blocks(batch.column(0), block_bytes=1 << 20):
                text, bucket, count = trigrams(low, offsets)
                names = sorted(set(langs[a:b]))
                code = {x: i for i, x in enumerate(names)}
                of = np.array([code[x] for x in langs[a:b]])
                sums = np.bincount(of[text] * BUCKETS + bucket, count, minlength=len(names) * BUCKETS).astype(np.int64).reshape(len(names), BUCKETS)
                for i, x in enumerate(names):
                    into = held.setdefault(x, np.zeros(BUCKETS + 1, dtype=np.int64))
                    into[0] += int((of == i).sum())
                    into[1:] += sums[i]
                if len(held) > MAX_LANGUAGES:
                    yield from flush(held)
                    held = {}
        yield from flush(held)

    return run


class Model:
    """languages; p [bucket, language]; log prior of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray):
        self.languages = languages
        smooth = counts.astype(float) + SMOOTHING
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)
        self.log_p = np.log(self.p)
        self.best_log_p = self.log_p.max(axis=1) if len(languages) else np.zeros(BUCKETS)
        self.prior = np.log((texts + 1.0) / (texts.sum() + len(languages))) if len(languages) else np.zeros(0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows whose text and language aren't null."""
    store.ship(labelled.sparkSession)
    schema = T.StructType().add("lang", T.StringType()).add("bucket", T.IntegerType()).add("n", T.LongType())
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = store.publish(rows.mapInArrow(tidy(_counter(to_arrow_schema(schema))), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r[0] for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model's size is bounded")
    counts, texts = np.zeros((len(languages), BUCKETS), dtype=np.int64), np.zeros(len(languages))
    found = sums.toArrow()  # at most MAX_LANGUAGES * BUCKETS rows
    if found.num_rows:
        code = {x: i for i, x in enumerate(languages)}
        which = np.array([code[x] for x in found["lang"].to_pylist()])
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        grams = bucket >= 0
        counts[which[grams], bucket[grams]] = n[grams]
        texts[which[~grams]] = n[~grams]
    return Model(languages, counts, texts)


def _em(p, count, start, text, share, steps):
    """EM over the rows of each text; share [text, language] is where it begins. Returns shares and log-likelihoods."""
    total = np.add.reduceat(count, start)
    for _ in range(steps):
        q = np.einsum("ul,ul->u", p, share[text])
        share = share * np.add.reduceat(p * (count / q)[:, None], start, axis=0) / total[:, None]
    return share, np.add.reduceat(count * np.log(np.einsum("ul,ul->u", p, share[text])), start)


def infer(model: Model, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares [text, language] of the selected set (0 outside it) and the confidence in the leading one."""
    n_lang = len(model.languages)
    shares, confidence = np.zeros((n_texts, n_lang)), np.zeros(n_texts)
    best = np.full(n_texts, int(np.argmax(model.prior)))
    posterior = np.tile(model.prior, (n_texts, 1))
    count = count.astype(float)
    grams = np.bincount(text, count, minlength=n_texts)
    start, _ = runs(text)
    has = text[start]
    if len(has):
        single = np.add.reduceat(model.log_p[bucket] * count[:, None], start, axis=0)
        posterior[has] += single
        best = posterior.argmax(axis=1)
        bound = np.add.reduceat(model.best_log_p[bucket] * count, start)
        alone = single[np.arange(len(has)), best[has]]
    odds = np.exp(posterior - posterior.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    every = np.arange(n_texts)
    shares[every, best] = 1.0
    confidence[:] = odds[every, best]
    if not len(has) or n_lang < 2:
        return shares, confidence
    # No mixture can exceed ``bound``: where that gains too little, the single language is the best set.
    open_texts = has[bound - alone >= penalty(grams[has])]

    def rows_of(chosen):
        pick = np.zeros(n_texts, dtype=bool)
        pick[chosen] = True
        rows = np.flatnonzero(pick[text])
        s, _ = runs(text[rows])
        return model.p[bucket[rows]], count[rows], s, np.searchsorted(chosen, text[rows])

    if not len(open_texts):
        return shares, confidence
    alone_of = np.zeros(n_texts)
    alone_of[has] = alone
    full, likelihood = _em(*rows_of(open_texts), np.full((len(open_texts), n_lang), 1 / n_lang), STEPS)
    left = likelihood - alone_of[open_texts] >= penalty(grams[open_texts])
    todo, full = open_texts[left], full[left]
    value = alone_of.copy()
    for size in range(2, n_lang + 1):
        if not len(todo):
            break
        lead = np.argsort(-full, axis=1, kind="stable")[:, :size]
        begin = np.zeros_like(full)
        np.put_along_axis(begin, lead, np.maximum(np.take_along_axis(full, lead, axis=1), 1e-6), axis=1)
        begin /= begin.sum(axis=1, keepdims=True)
        share, likelihood = _em(*rows_of(todo), begin, SET_STEPS)
        net = likelihood - (size - 1) * penalty(grams[todo])
        better = net > value[todo]
        at = todo[better]
        value[at], shares[at], confidence[at] = net[better], share[better], share[better].max(axis=1)
        # A larger set must still be able to win by what the full mixture explains.
        more = np.take_along_axis(full, lead[:, -1:], axis=1)[:, 0] > 0.005
        todo, full = todo[more], full[more]
    return shares, confidence


def _predictor(block, fields: list[str], schema: pa.Schema):
    def run(batches):
        model = Model.__new__(Model)
        model.__dict__.update(block.value)
        size = max(1 << 16, (1 << 22) // max(4, len(model.languages)))
        for batch in batches:
            letters = batch.column(batch.schema.get_field_index("__cv_letter")).to_pylist()
            for a, b, low, offsets in byte_blocks(batch.column(batch.schema.get_field_index("__cv_text")), block_bytes=size):
                if model.languages:
                    shares, confidence = infer(model, *trigrams(low, offsets), b - a)
                names, scores, sets = [], [], []
                for i in range(b - a):
                    if not letters[a + i] or not model.languages:
                        names.append("und"), scores.append(0.0), sets.append([])
                        continue
                    by = np.argsort(-shares[i], kind="stable")
                    names.append(model.languages[by[0]])
                    scores.append(float(min(max(confidence[i], 0.0), 1.0)))
                    sets.append([{"lang": model.languages[j], "share": float(shares[i, j])} for j in by if shares[i, j] > 0])
                made = {"lang_pred": names, "score": scores, "languages": sets}
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(made[f], schema.field(f).type) if f in made else part.column(f).cast(schema.field(f).type) for f in fields], schema=schema)

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score (0 to 1) and languages: array<struct<lang, share>>, the largest share first.

    score: how much of the text the leading language explains. For a set of one
    it is that language's posterior among single languages (its share is 1), for
    a larger set its share, as the set itself has won by the penalty's margin.

    keep: the columns to return (all by default); columns named as the added
    ones are replaced.  Null texts, texts without a letter, and all texts if the
    model has no language, are ``und`` with score 0.  A text too short for a
    trigram gets the language that is most common in training.
    """
    spark = docs.sparkSession
    store.ship(spark)
    added = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("languages", T.ArrayType(T.StructType().add("lang", T.StringType()).add("share", T.DoubleType())))
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added.names]
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*kept, body.alias("__cv_text"), body.rlike(r"\p{L}").alias("__cv_letter"))
    schema = T.StructType([*(source.schema[c] for c in kept), *added.fields])
    block = spark.sparkContext.broadcast(model.__dict__)
    return source.mapInArrow(tidy(_predictor(block, schema.names, to_arrow_schema(schema))), schema)


def remainder(key: str, by: int):
    """crc32 of the id as text; a null id counts as remainder 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    model = learn(docs.where(~held_out))
    found = identify(docs.drop("lang").withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


QUERIES = {"op3_language_id": query}
ORACLES: dict[str, str] = {}
