"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles (64-bit hashes), the set's 128-bit
   fingerprint and its k smallest values.  Equal sets collapse into one class.
2. Inverted lists of retained values generate overlaps.  A linked pair shares
   at least ``need`` retained values, so each class enters only the lists of
   its rarest ``size - need + 1`` values: common passages make no long lists
   unless they are most of a text.
3. Union sketches estimate the similarity and drop hopeless pairs; the rest is
   confirmed on full shingle sets, rebuilt from the texts.
4. Only components matter, so a list first compares its members with its center,
   the one whose values occur most.  Members at a quarter of similarity or more are
   the center's family; how they differ from it gives all their intersections, so
   links within a family are found exactly, in blocks.  A pair of a list with a
   member outside the family is a candidate of its own: short lists are joined
   with themselves, long ones compared sketch by sketch in blocks.

Sketches of sets up to ``k`` values are whole, where the filters are exact.
Beyond, a pair at the threshold is missed if fewer than ``LEAST_SHARED`` of 48
draws at 0.8 hit: some 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.graph import components
from corvane.llm.kernel import BLANK_WORDS, Words, blocks, mix, tidy

#: Values that a sketch retains, and those that a pair of partial sketches must share.
SKETCH, LEAST_SHARED = 48, 20
#: Percent of similarity from which a text is of the family of its list's center.
FAMILY = 25
#: Values of the union's sketch that a list's center and a member share before they are compared.
KIN_SHARED = 4
#: Lists up to this length are joined with themselves; longer ones are compared in blocks.
SHORT_LIST, BLOCK, CHUNK = 64, 512, 4096
#: Values of all rows of a block or chunk (32 MB), and values of a center that are compared at a time.
VALUES, WIDTH = 4_000_000, 4096
#: Rows, of some 100 bytes each, that are broadcast rather than joined by a shuffle.
BROADCAST_TEXTS = 200_000
#: Parts into which the pairs of one class are dealt.
SALTS = 16

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(words: Words, n_texts: int, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, of the whole sequence."""
    w, first = words.hash, words.first
    n = len(w)
    whole = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        if len(whole):
            whole = whole * _ODD[0] + w[j : n - size + 1 + j] * _ODD[1 + j % 7]
    whole = mix(whole)
    for d in range(n_texts):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for x in w[a:b]:
                short = mix(short * _ODD[7] ^ x)
            yield short
        else:
            yield np.zeros(0, dtype=np.uint64)


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set; equal for equal sets."""
    n = np.uint64(len(values))
    a, b = np.sum(values, dtype=np.uint64), np.sum(mix(values ^ _ODD[1]), dtype=np.uint64)
    return np.array(mix(np.array([a + n, b * _ODD[2] + n]))).astype(">u8").tobytes()


def _sketcher(text: str, size: int, schema: pa.Schema):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, words in blocks(batch.column(batch.schema.get_field_index(text)), BLANK_WORDS):
                    counts, keys, kept = [], [], []
                    for values in shingle_sets(words, b - a, size):
                        counts.append(len(values))
                        keys.append(fingerprint(values) if len(values) else None)
                        kept.append(values[:SKETCH].view(np.int64))
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(offsets, np.concatenate(kept))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists.cast(schema.field(4).type)], schema=schema)

    return run


def _plain(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, mark, text): id and mark together find a text, whatever ids repeat or are null."""
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))


def sketches(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(doc, mark, n_shingles, cls, sketch) of every row; mark is a hash of the text, cls is null without shingles."""
    schema = T.StructType().add("doc", docs.schema[key].dataType).add("mark", T.LongType()).add("n_shingles", T.LongType()).add("cls", T.BinaryType()).add("sketch", T.ArrayType(T.LongType()))
    return _plain(docs, text, key).mapInArrow(tidy(_sketcher("text", size, to_arrow_schema(schema))), schema)


def _needed(percent: int):
    """Retained values that a class shares with any partner at the threshold."""
    exact = F.col("n") <= SKETCH * percent // 100
    return F.when(exact, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(LEAST_SHARED)).cast("int")


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """(value, cls, n, weight): the inverted lists of the rarest retained values, lists of one left out.

    weight: how often the class's retained values occur in all, which is most
    for the text that a group of near copies comes from.
    """
    values = classes.select("cls", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(often, "value").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("by_df"))
    size = F.least(F.col("n"), F.lit(SKETCH))
    prefix = (size - _needed(percent) + 1) - (size - F.size("by_df"))  # values that no other class has come first
    rarest = F.slice("by_df", F.lit(1), F.greatest(F.lit(0), prefix).cast("int"))
    held = held.select("cls", "n", F.aggregate("by_df", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"), F.transform(rarest, lambda x: x["value"]).alias("prefix"))
    return held.select(F.explode("prefix").alias("value"), "cls", "n", "weight")


def _similar(percent: int, least: int):
    """Whether the union sketch of a and b leaves hope; exact where both sketches are whole."""
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    both = F.array_intersect("sketch_a", "sketch_b")
    in_union = F.size(F.array_intersect(F.slice(union, 1, SKETCH), both))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    return F.when(whole, F.size(both) * 100 >= F.size(union) * percent).otherwise(in_union >= least)


def _sizes_fit(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _estimate(pairs: DataFrame, classes: DataFrame, percent: int, least: int = LEAST_SHARED) -> DataFrame:
    """The pairs (a, b) that pass the union-sketch filter; a may be in very many."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "salt").distinct().join(side("a"), "a")
    met = salted.join(side("b"), "b").join(heads, ["a", "salt"])
    return met.where(_sizes_fit(percent) & _similar(percent, least)).select("a", "b")


def _comparer(size: int, schema: pa.Schema):
    """Streams rows sorted by (a, salt), the text of a first: compares it with each b.

    Gives the pairs at FAMILY percent or more: the size of each set, of the
    intersection, and how b differs from a: the places of the values of a that
    it lacks, and its own values.
    """

    def run(batches):
        head = values = last = None
        with np.errstate(over="ignore"):
            for batch in batches:
                cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for lo, hi, words in blocks(cols["text"], BLANK_WORDS):
                    a_ids, b_ids = cols["a"].slice(lo, hi - lo).to_pylist(), cols["b"].slice(lo, hi - lo).to_pylist()
                    out = []
                    for a, b, found in zip(a_ids, b_ids, shingle_sets(words, hi - lo, size)):
                        if not len(found) or fingerprint(found) != (b or a):
                            continue  # another text of the same id and mark
                        if b is None:
                            head, values, last = a, found, None
                        elif head == a and b != last:  # repeated rows come one after the other
                            last = b
                            at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                            same = values[at] == found
                            common = int(same.sum())
                            if 100 * common >= FAMILY * (len(values) + len(found) - common):
                                lacks = np.ones(len(values), dtype=bool)
                                lacks[at[same]] = False
                                out.append((a, b, len(values), len(found), common, np.flatnonzero(lacks), found[~same].view(np.int64)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


_PAIR = T.StructType().add("a", T.BinaryType()).add("b", T.BinaryType())
_COMPARED = T.StructType([*_PAIR.fields]).add("n_a", T.LongType()).add("n_b", T.LongType()).add("common", T.LongType()).add("lacks", T.ArrayType(T.IntegerType())).add("own", T.ArrayType(T.LongType()))


def _once(batches):
    """Of repeated rows, which give the same (a, b, salt) each, the first of a task."""
    seen = set()
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        fresh = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        if fresh:
            yield batch if len(fresh) == len(keys) else batch.take(pa.array(fresh))


def _compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have FAMILY percent of similarity or more, with what ``_comparer`` gives."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    heads = salted.select("a", F.lit(None).cast("binary").alias("b"), "salt", F.col("a").alias("cls")).distinct()
    wanted = heads.union(salted.select("a", "b", "salt", F.col("b").alias("cls")))
    wanted = _small(store.publish(wanted.join(classes.select("cls", "doc", "mark"), "cls").drop("cls"), "wanted"))  # else texts are dealt by document
    texts = docs.join(wanted, docs["doc"].eqNullSafe(wanted["doc"]) & (docs["mark"] == wanted["mark"])).select("a", "b", "salt", "text")
    texts = texts.mapInArrow(tidy(_once), texts.schema)
    dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(tidy(_comparer(size, to_arrow_schema(_COMPARED))), _COMPARED)


def _linked(percent: int):
    return F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent


def _gather(column, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows of a list column, and the row of each."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    size = offsets[rows + 1] - offsets[rows]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[rows], size)
    return flat[at], np.repeat(np.arange(len(rows)), size)


def _shared(left: tuple, right: tuple, shape: tuple[int, int]) -> np.ndarray:
    """How many values rows of the left and of the right have in common."""
    out = np.zeros(shape, dtype=np.int32)
    (lv, lr), (rv, rr) = left, right
    by = np.argsort(lv, kind="stable")
    lv, lr = lv[by], lr[by]
    lo = np.searchsorted(lv, rv)
    size = np.searchsorted(lv, rv, side="right") - lo
    for k in range(0, len(rv), 1 << 16):
        s = size[k : k + (1 << 16)]
        rows = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(lo[k : k + (1 << 16)], s)
        np.add.at(out, (lr[rows], np.repeat(rr[k : k + (1 << 16)], s)), 1)
    return out


def _pairs_table(pairs: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[0] for x in pairs], pa.binary()), pa.array([x[1] for x in pairs], pa.binary())], schema=schema)


def _sides(table: pa.Table):
    left = table["left"].to_numpy()
    return table["cls"].to_pylist(), table["n"].to_numpy(), np.unique(np.array(table["comp"].to_pylist(), dtype=object), return_inverse=True)[1], np.flatnonzero(left), np.flatnonzero(~left)


def _sketch_block(percent: int, schema: pa.Schema):
    """Of a block of a long list and a chunk of it: the pairs whose sketches leave hope, unless both are of the center's family."""

    def run(table: pa.Table) -> pa.Table:
        cls, n, comp, left, right = _sides(table)
        kin, sketch = table["kin"].to_numpy(), table["sketch"].combine_chunks()
        out = set()
        if len(left) and len(right):
            shared = _shared(_gather(sketch, left), _gather(sketch, right), (len(left), len(right)))
            small = np.minimum(n[left][:, None], n[right][None, :])
            large = np.maximum(n[left][:, None], n[right][None, :])
            least = np.minimum(LEAST_SHARED, -(-small * percent // 100))
            good = (shared >= least) & (small * 100 >= large * percent) & (comp[left][:, None] != comp[right][None, :]) & ~(kin[left][:, None] & kin[right][None, :])
            for i, j in np.argwhere(good):
                x, y = cls[left[i]], cls[right[j]]
                out.add((min(x, y), max(x, y)))
        return _pairs_table(list(out), schema)

    return run


def _family_block(percent: int, schema: pa.Schema):
    """Of a block of a family and a chunk of it: links enough to join what is linked.

    Members differ from the center by what they lack and their own values, so
    the size of each intersection is known exactly.
    """

    def run(table: pa.Table) -> pa.Table:
        cls, n, comp, left, right = _sides(table)
        lacks, own = table["lacks"].combine_chunks(), table["own"].combine_chunks()
        n_center = int(table["n_center"][0].as_py())
        out, parent = [], np.arange(comp.max() + 1)

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for k in range(0, len(right), 512):
            part = right[k : k + 512]
            if not len(left):
                break
            common, gone = np.zeros((len(left), len(part)), dtype=np.int64), [_gather(lacks, rows) for rows in (left, part)]
            for low in range(0, n_center, WIDTH):  # so that very long texts fit
                has = []
                for (place, row), rows in zip(gone, (left, part)):
                    one = np.ones((len(rows), min(WIDTH, n_center - low)), dtype=np.float32)
                    some = (place >= low) & (place < low + WIDTH)
                    one[row[some], place[some] - low] = 0
                    has.append(one)
                common += (has[0] @ has[1].T).astype(np.int64)
            common += _shared(_gather(own, left), _gather(own, part), (len(left), len(part)))
            union = n[left][:, None] + n[part][None, :] - common
            for i, j in np.argwhere((100 * common >= percent * union) & (comp[left][:, None] != comp[part][None, :])):
                x, y = root(comp[left[i]]), root(comp[part[j]])
                if x != y:
                    parent[x] = y
                    out.append((cls[left[i]], cls[part[j]]))
        return _pairs_table(out, schema)

    return run


def _small(table: DataFrame) -> DataFrame:
    """A published table of short rows, broadcast while it has few, so that a hot key's rows stay where they are."""
    return F.broadcast(table) if table.count() <= BROADCAST_TEXTS else table


def _dealt(members: DataFrame, key: str, left, weight, extra: list[str]) -> DataFrame:
    """Rows of each key in groups of some BLOCK left rows and CHUNK rows of all, or of VALUES by weight, if those are fewer: (key, block, chunk, left, ...)."""
    total = lambda c: F.sum(c.cast("bigint"))
    sizes = members.groupBy(key).agg(F.count("*").alias("rows"), total(left).alias("lefts"), total(weight).alias("values"), total(F.when(left, weight).otherwise(0)).alias("left_values")).where("lefts > 0")
    parts = lambda rows, values, most: F.greatest(F.ceil(F.col(rows) / most), F.ceil(F.col(values) / VALUES)).cast("int")
    sizes = _small(store.publish(sizes.select(key, parts("lefts", "left_values", BLOCK).alias("blocks"), parts("rows", "values", CHUNK).alias("chunks")), "sizes"))
    sized, place = members.join(sizes, key), F.xxhash64("cls", F.lit(1))
    lefts = sized.where(left).select(key, F.pmod(place, F.col("blocks")).cast("int").alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(True).alias("left"), *extra)
    rights = sized.select(key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(place, F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("left"), *extra)
    return lefts.union(rights).groupBy(key, "block", "chunk")


def _component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def _within_families(compared: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a center's family that are still apart."""
    members = _component(compared.select(F.col("a").alias("center"), F.col("n_a").alias("n_center"), F.col("b").alias("cls"), F.col("n_b").alias("n"), "lacks", "own"), comps)
    apart = members.groupBy("center", "comp").agg(F.count("*").alias("rows"))
    apart = apart.groupBy("center").agg(F.count("*").alias("comps"), F.max(F.struct("rows", "comp"))["comp"].alias("main")).where("comps > 1").select("center", "main")
    apart = _small(store.publish(apart, "apart"))
    members = store.publish(members.join(apart, "center"), "members")
    schema = to_arrow_schema(_PAIR)
    return _dealt(members, "center", F.col("comp") != F.col("main"), F.size("lacks") + F.size("own"), ["n_center", "cls", "n", "comp", "lacks", "own"]).applyInArrow(_family_block(percent, schema), _PAIR)


def _outside_families(lists: DataFrame, heads: DataFrame, compared: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a list that are still apart and not both of the family of its center."""
    kin = compared.select("a", F.col("b").alias("cls"), F.lit(True).alias("found"))
    placed = _component(lists.select("value", "cls", "n").join(heads, "value").join(kin, ["a", "cls"], "left"), comps)
    placed = placed.select("value", "cls", "n", "comp", (F.coalesce("found", F.lit(False)) | (F.col("a") == F.col("cls"))).alias("kin"))
    apart = placed.groupBy("value").agg(F.count("*").alias("long"), F.sum((~F.col("kin")).cast("int")).alias("strangers"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    placed = store.publish(placed.join(apart.where("strangers > 0 AND low <> high").select("value", "long"), "value"), "placed")
    short = placed.where(F.col("long") <= SHORT_LIST).select("value", "cls", "n", "comp", "kin")
    x = short.select("value", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), F.col("kin").alias("kin_a"))
    y = short.select("value", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("kin").alias("kin_b"))
    open_pair = (x["a"] < y["b"]) & (x["comp_a"] != y["comp_b"]) & ~(x["kin_a"] & y["kin_b"]) & _sizes_fit(percent)
    pairs = x.join(y, (x["value"] == y["value"]) & open_pair).select("a", "b").distinct()
    long = placed.where(F.col("long") > SHORT_LIST).drop("long").join(classes.select("cls", "sketch"), "cls")
    schema = to_arrow_schema(_PAIR)
    in_blocks = _dealt(long, "value", ~F.col("kin"), F.size("sketch"), ["cls", "n", "comp", "kin", "sketch"]).applyInArrow(_sketch_block(percent, schema), _PAIR)
    return pairs.union(in_blocks).distinct()


def _grouped(docs: DataFrame, text: str, key: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (cls, component_id, keeper) of all classes: keeper is the (doc, mark) that a component keeps."""
    store.ship(docs.sparkSession)
    plain, made = _plain(docs, text, key), []

    def publish(df: DataFrame, name: str) -> DataFrame:
        made.append(store.publish(df, name))
        return made[-1]

    drawn = store.publish(sketches(docs, text, key, words), "sketches")
    first = F.min(F.struct(F.col("doc").isNull().alias("without"), "doc", "mark")).alias("first")
    classes = drawn.where("cls IS NOT NULL").groupBy("cls").agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = publish(classes.select("cls", "first.doc", "first.mark", "n", "sketch"), "classes")
    lists = publish(_postings(classes, percent), "lists")
    heads = lists.groupBy("value").agg(F.max(F.struct("weight", "cls"))["cls"].alias("a"), F.count("*").alias("long")).where("long > 1").select("value", "a")
    pairs = publish(lists.join(heads, "value").where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "pairs")
    pairs = publish(_estimate(pairs, classes, FAMILY, KIN_SHARED), "pairs")
    compared = publish(_compare(pairs, classes, plain, words), "compared")
    comps = components(compared.where(_linked(percent)).select("a", "b"))
    among = publish(_within_families(compared, comps, percent), "links")
    across = publish(_outside_families(lists, heads, compared, classes, comps, percent), "pairs")
    across = publish(_estimate(across, classes, percent), "pairs")
    across = publish(_compare(across, classes, plain, words).where(_linked(percent)).select("a", "b"), "links")
    # The later links join whole components of the earlier ones.
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_comp"))
    later = among.union(across).join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(later.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    least = classes.select("cls", "doc", "mark").join(comps, F.col("cls") == F.col("node"), "left").select("cls", "doc", "mark", F.coalesce("component", "cls").alias("comp"))
    least = least.join(joined, F.col("comp") == F.col("node"), "left").select("cls", "doc", "mark", F.coalesce("component", "comp").alias("comp"))
    ids = least.groupBy("comp").agg(first).select("comp", F.col("first.doc").alias("component_id"), F.struct("first.doc", "first.mark").alias("keeper"))
    by_class = store.publish(least.join(ids, "comp").select("cls", "component_id", "keeper"), "by_class")
    for table in (*made, comps, joined):
        store.discard(table)
    return drawn, by_class


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; links are 100 * intersection >= percent * union.

    Null, empty and wordless texts have no shingles and stay alone.  Repeated
    rows share a class.  component_id is the least non-null id that a row
    reaches, its own for a row without shingles; kept is whether both are the
    same (two nulls are), so rows that share an id may all be kept:
    ``keep_one`` decides by row.  Other columns play no part.
    """
    drawn, by_class = _grouped(docs, text, key, words, percent)
    out = drawn.select("doc", "n_shingles", "cls").join(by_class.select("cls", "component_id"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: that of the least non-null id.

    Decisions go by id and text together, so rows that repeat an id, or have
    none, with other texts are decided on their own.  Of an id with several
    texts of one group the least hash of the text stays; of rows with the same
    id and text the one of the least hash of all columns stays.  All rows
    without shingles stay.
    """
    drawn, by_class = _grouped(docs, text, key, words, percent)
    rows = drawn.where("cls IS NOT NULL").groupBy("doc", "mark", "cls").agg(F.count("*").alias("times")).join(by_class.select("cls", "keeper"), "cls")
    same = F.col("doc").eqNullSafe(F.col("keeper.doc")) & (F.col("mark") == F.col("keeper.mark"))
    rows = store.publish(rows.where(~same | (F.col("times") > 1)).select(F.col("doc").alias("__cv_doc"), F.col("mark").alias("__cv_mark"), same.alias("__cv_stays")), "not_alone")
    on = docs[key].eqNullSafe(F.col("__cv_doc")) & (F.xxhash64(docs[text]) == F.col("__cv_mark"))
    alone = docs.join(_small(rows), on, "left_anti")
    repeated = docs.join(_small(rows.where("__cv_stays")), on, "left_semi")
    one = repeated.groupBy(F.col(key).alias("cv_id"), F.xxhash64(F.col(text)).alias("cv_mark")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("cv_row"))
    return alone.union(one.select("cv_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


#: All links by a join on shingles, then the least id reached.
_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

QUERIES = {"op2_near_duplicates": query}
ORACLES = {"op2_near_duplicates": _SQL}
