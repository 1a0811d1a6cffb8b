"""Spelling variants: words one edit apart, found by a positional q-gram index.

Two words of lengths c, or c and c + 1, are of class c.  One edit leaves the
first or the last half of the shorter word alone, so both words have it in
common; posting lists are cut by class and half, and each part is an index of its
own in one task.  An edit spoils at most q of a word's q-grams, so two
words share at least (grams of the longer one) - q of them, at positions that
differ by an insertion at most.  Grams inside the common half are shared anyway;
a probe heap-merges the lists of its others and keeps the words met often enough,
which are then compared.

A part of more than PART words is dealt out once more by gram: of two near words'
first q + 1 other grams, in any fixed order, one is common, so a word goes to a
list for each of these.
"""

from __future__ import annotations

from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.llm import store
from corvane.llm.kernel import tidy

#: Fewest code points of a word; shorter ones have too few grams for the bound.
LEAST = 6
#: Words of a part, beyond which it is dealt out by gram.
PART = 1024
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram_length(c: int) -> int:
    """q of a class: with halves of at least q + 1 code points, the bound on the other grams is at least 1."""
    return 2 if c < 8 else 3


def one_edit(a: str, b: str) -> bool:
    """Whether one replaced code point, or one inserted into ``a``, makes ``b``; a is no longer than b."""
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in_part(c: int, last: bool, short: list[str], long: list[str]):
    """Yields the near pairs (shorter or equal, longer) of words of length c and c + 1 that have the first (or last) half in common.

    Pairs that have the first half in common too are left to that half's part.
    """
    q, half = gram_length(c), c // 2
    same = c - half if last else half
    # starts of the grams that don't lie within the common half
    other = lambda n: range(0, n - same) if last else range(half - q + 1, n - q + 1)
    need = c - same - q
    equal: dict[tuple[str, int], list[int]] = {}
    longer: dict[tuple[str, int], list[int]] = {}
    for j, word in enumerate(long):
        for p in other(c + 1):
            longer.setdefault((word[p : p + q], p), []).append(j)
    for i, word in enumerate(short):
        grams = [(word[p : p + q], p) for p in other(c)]
        lists = [x for g in grams if (x := equal.get(g))]
        if len(lists) >= need:
            for j, met in groupby(merge(*lists)):
                if sum(1 for _ in met) >= need and not (last and short[j][:half] == word[:half]) and one_edit(word, short[j]):
                    yield word, short[j], False
        lists = [x for g, p in grams for at in (p, p + 1) if (x := longer.get((g, at)))]
        if len(lists) > need:
            for j, met in groupby(merge(*lists)):
                if sum(1 for _ in met) > need and not (last and long[j][:half] == word[:half]) and one_edit(word, long[j]):
                    yield word, long[j], True
        for g in grams:
            equal.setdefault(g, []).append(i)


_PAIRS = T.StructType().add("word", T.StringType()).add("near", T.StringType()).add("near_n", T.LongType())


def _find(batches):
    """Streams rows sorted by part; each pair is given in both directions."""
    current, words = None, []

    def pairs():
        if len(words) < 2:
            return
        c, last = words[0][0], words[0][1]
        short = [w for _, _, w, _ in words if len(w) == c]
        if not short:
            return
        n = {w: k for _, _, w, k in words}
        for a, b, _ in near_in_part(c, last, short, [w for _, _, w, _ in words if len(w) > c]):
            yield a, b, n[b]
            yield b, a, n[a]

    def frame(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64())], names=_PAIRS.names)

    found: list[tuple[str, str, int]] = []
    for batch in batches:
        for part, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if part != current:
                found.extend(pairs())
                current, words = part, []
                if len(found) >= 10_000:
                    yield frame(found)
                    found = []
            words.append(row)
    found.extend(pairs())
    if found:
        yield frame(found)


def _parts(words: DataFrame) -> DataFrame:
    """(part, class, last, word, n): each word under the halves of its own class and, as a longer word, of the class below."""
    length = F.length("word")
    half = F.floor(F.col("class") / 2).cast("int")
    classes = F.explode(F.filter(F.array(length, length - 1), lambda c: c >= LEAST)).alias("class")
    rows = words.select("word", "n", classes).select("word", "n", "class", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    kept = F.when(F.col("last"), F.expr("right(word, class - floor(class / 2))")).otherwise(F.substring("word", F.lit(1), half))
    return rows.select(F.concat_ws(" ", "class", "last", kept).alias("part"), "class", "last", "word", "n")


def _dealt_by_gram(rows: DataFrame) -> DataFrame:
    """The rows of large parts, under each list that one of the first q + 1 other grams names."""
    q = F.when(F.col("class") < 8, 2).otherwise(3)
    half = F.floor(F.col("class") / 2).cast("int")
    same = F.when(F.col("last"), F.col("class") - half).otherwise(half)
    first = F.when(F.col("last"), 0).otherwise(half - q + 1)
    final = F.when(F.col("last"), F.length("word") - same - 1).otherwise(F.length("word") - q)
    gram = lambda p: F.substring(F.col("word"), p + 1, q)
    grams = F.transform(F.sequence(first, final), lambda p: F.struct(F.xxhash64(gram(p)).alias("by"), gram(p).alias("g"), p.alias("p")))
    chosen = F.slice(F.array_sort(grams), F.lit(1), q + 1)
    shifts = F.when(F.length("word") > F.col("class"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.select("*", F.explode(chosen).alias("x")).select("*", F.explode(shifts).alias("shift"))
    return spread.select(F.concat_ws(" ", "part", "x.g", F.col("x.p") - F.col("shift")).alias("part"), "class", "last", "word", "n").distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words one edit apart, in both directions; ``words`` has distinct words of LEAST or more code points and their n."""
    store.ship(words.sparkSession)
    rows = _parts(words)
    large = store.publish(rows.groupBy("part").count().where(F.col("count") > PART).select("part"), "large-parts")
    if large.isEmpty():
        dealt = rows
    else:
        dealt = rows.join(large, "part", "left_anti").unionByName(_dealt_by_gram(rows.join(large, "part", "left_semi")))
    return dealt.repartition(F.xxhash64("part")).sortWithinPartitions("part").mapInArrow(tidy(_find), _PAIRS).distinct()


def word_counts(runs: DataFrame, word: str = "word", least: int = 5, length: int = LEAST) -> DataFrame:
    """(word, n): the words of at least ``length`` code points that occur ``least`` times or more."""
    return runs.where(F.length(word) >= length).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n).

    A word's form is its near word of largest n, ties to the smallest in
    code-point order, if that n is at least ``factor`` times the word's.  root
    follows forms to the last.  Words that are null or of fewer than LEAST code
    points are dropped; a word that repeats counts with the sum of its n.
    Whatever an n, forms never lead in a circle, as n grows with each
    (``factor`` is at least 2, n at least 1; rows with less are dropped).
    """
    if factor < 2:
        raise ValueError("a form occurs more often than the word: factor must be 2 or more")
    words = store.publish(words.where(F.length("word") >= LEAST).groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n >= 1"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    good = F.col("m") >= factor * F.col("n")
    joined = words.join(near.select("word", "n_near", F.col("best.w").alias("w"), (-F.col("best.m")).alias("m")), "word", "left")
    found = store.publish(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("w")).alias("form"), F.when(good, F.col("m")).alias("form_n")), "forms")
    roots = _last(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _last(links: DataFrame) -> DataFrame:
    """The end of each chain, by pointer doubling: n grows by the factor with each form, so a few rounds do."""
    while True:
        links = store.publish(links, "roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(on, "root", "left_semi").isEmpty():
            return links
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def lower_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows' id columns with ``run``, once for each maximal run of letters, A-Z in lower case."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def _drawn_deletion(doc_id: Column, run: Column) -> Column:
    """The run, in one of 199 (document, run) pairs without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    runs = lower_runs(docs).where(F.length("run") >= LEAST)  # a deletion makes no run longer
    return variants(word_counts(runs.select(_drawn_deletion(F.col("doc_id"), F.col("run")).alias("word"))))


_SQL = rf"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, run, count(*) AS k, length(run) AS len, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
  WHERE length(run) >= {LEAST} GROUP BY doc_id, run),
h AS MATERIALIZED (SELECT run, k, len, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(b)), lambda i: ((('0x' || substr(hex(b), 2 * (i // 8) + 1, 2))::BIGINT) >> (i % 8)) & 1)),
  lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)))) AS h FROM r),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (
  SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= 5),
x AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (SELECT DISTINCT a, b FROM (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT w.word, x.word FROM x JOIN w ON w.word = x.head || x.tail
  UNION ALL SELECT x.word, w.word FROM x JOIN w ON w.word = x.head || x.tail)),
f AS MATERIALIZED (SELECT w.word, w.n, count(p.b) AS n_near, first(p.b ORDER BY o.n DESC, p.b) AS near, max(o.n) AS near_n
  FROM w LEFT JOIN p ON p.a = w.word LEFT JOIN w o ON o.word = p.b GROUP BY w.word, w.n),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM f),
s(word, root) AS (SELECT word, word FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, s.root, g.n, g.n_near, g.form_n FROM g JOIN s ON s.word = g.word JOIN g e ON e.word = s.root AND e.form IS NULL"""

QUERIES = {"op11_spelling_variants": query}
ORACLES = {"op11_spelling_variants": _SQL}
