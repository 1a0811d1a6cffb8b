"""Secret scans over whole texts with a trigram inverted index, in DataFrame functions only.

1. From each rule's regular expression a Boolean trigram query is derived: an
   OR of ANDs of trigrams (lower case) that any match must hold.
2. Postings (trigram, document) are made for the queried trigrams; for each AND
   the postings are intersected by counting, which leaves candidate documents.
3. Only candidates are scanned with the rule.  A rule with an alternative that
   has no mandatory trigram scans every document.

A document is known by its id and a hash of its text, so repeated or null ids
do no harm; a hash collision can only add a candidate, and every candidate is
verified with the expression itself.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm import store

#: Alternatives that a derived query may have before a class counts as a gap.
MAX_ALTERNATIVES = 64
#: Candidates, of some 60 bytes each, that are broadcast to the texts.
BROADCAST_CANDIDATES = 300_000
#: Trigrams that one AND keeps: any subset of mandatory trigrams is sound.
MAX_TRIGRAMS = 6


def either_case(word: str) -> str:
    """The word as a pattern that takes ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.isascii() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """pattern: what Java, RE2 and Python read alike. value_group, min_value: drop matches whose group is shorter."""

    kind: str
    pattern: str
    value_group: int = 0
    min_value: int = 0


_VALUE = "[A-Za-z0-9+/_.=-]+"
_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The kinds of the contract, in its order.
BASE_RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE})", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Kinds that this operator adds.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

_GAP = None


def _join(left: list[tuple], right: list[tuple]) -> list[tuple]:
    if len(left) * len(right) > MAX_ALTERNATIVES:
        return [a + (_GAP,) for a in left]
    return [a + b for a in left for b in right]


def _walk(tree) -> list[tuple]:
    """Alternatives of a parsed expression; each is a run of characters (lower case) and gaps."""
    out: list[tuple] = [()]
    for op, arg in tree:
        if op is sre.LITERAL:
            step = [(chr(arg).lower(),)]
        elif op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
                else:
                    chars.clear()
                    break
            step = [(c,) for c in sorted(chars)] if 0 < len(chars) <= 8 else [(_GAP,)]
        elif op is sre.SUBPATTERN:
            step = _walk(arg[-1])
        elif op is sre.BRANCH:
            step = [x for branch in arg[1] for x in _walk(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            once = _walk(inner)
            if (low, high) == (0, 1):
                step = [(), *once]
            elif low == high and low <= 8:
                step = [()]
                for _ in range(low):
                    step = _join(step, once)
            elif low:
                step = _join([x + (_GAP,) for x in once], once)  # the last one may be another alternative
            else:
                step = [(_GAP,)]
        else:
            step = [(_GAP,)]
        out = _join(out, step)
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-case trigrams that any match holds; None if the text must be scanned anyway."""
    ands = set()
    for alternative in _walk(sre_parser.parse(pattern)):
        found: dict[str, None] = {}
        for i in range(len(alternative) - 2):
            if _GAP not in (piece := alternative[i : i + 3]):
                found["".join(piece)] = None
        if not found:
            return None
        ands.add(tuple(sorted(list(found)[:MAX_TRIGRAMS])))
    least = [x for x in ands if not any(set(y) < set(x) for y in ands)]  # an AND that asks for more than another adds nothing
    return [list(x) for x in sorted(least)]


def postings(docs: DataFrame, text: str, keys: list[str], trigrams: list[str]) -> DataFrame:
    """The inverted index for the queried trigrams: (trigram, *keys), each once."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = F.filter(F.array(*(F.lit(t) for t in trigrams)), lambda t: F.contains(F.col("__cv_low"), t))
    return docs.select(*keys, low.alias("__cv_low")).select(F.explode(held).alias("trigram"), *keys)


def candidates(index: DataFrame, keys: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(*keys, rules): documents whose postings satisfy a rule's trigram query."""
    spark = index.sparkSession
    rows = [(r.kind, i, t, len(ts)) for r in rules if (q := trigram_query(r.pattern)) for i, ts in enumerate(q) for t in ts]
    terms = spark.createDataFrame(rows, "kind string, part int, trigram string, need int")  # as large as the rules
    met = index.join(F.broadcast(terms), "trigram").groupBy(*keys, "kind", "part", "need").agg(F.countDistinct("trigram").alias("have"))
    return met.where("have = need").groupBy(*keys).agg(F.collect_set("kind").alias("__cv_kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of one rule, by code points, leftmost and not overlapping."""
    between = F.split(text, F.lit(rule.pattern), F.lit(-1))
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(rule.kind).alias("kind"), b.alias("end"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        keep = F.length(F.regexp_extract(pair["match"], rule.pattern, rule.value_group)) >= rule.min_value if rule.min_value else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(span(start, end)))).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(between, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` and ``secret_spans``: array<struct<start, kind, end>> sorted by start, then by the order of ``rules``.

    Null text counts as empty and has no spans; null or repeated keys and
    repeated rows are each scanned as they are.  A column ``secret_spans`` of
    the input is replaced.
    """
    docs = docs.drop("secret_spans")
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    body = F.coalesce(F.col(text), F.lit(""))
    by_index = [r for r in rules if trigram_query(r.pattern) is not None]
    keyed = docs.withColumn("__cv_hash", F.xxhash64(body))
    if by_index:
        small = docs.select(F.col(key).alias("__cv_key"), F.xxhash64(body).alias("__cv_khash"), F.col(text).alias("__cv_text"))
        trigrams = sorted({t for r in by_index for ts in trigram_query(r.pattern) for t in ts})
        index = postings(small, "__cv_text", ["__cv_key", "__cv_khash"], trigrams)
        found = store.publish(candidates(index, ["__cv_key", "__cv_khash"], rules), "candidates")
        if found.count() <= BROADCAST_CANDIDATES:  # else texts and candidates are dealt by document
            found = F.broadcast(found)
        same = keyed[key].eqNullSafe(found["__cv_key"]) & (keyed["__cv_hash"] == found["__cv_khash"])
        keyed = keyed.join(found, same, "left").drop("__cv_key", "__cv_khash")
    else:
        keyed = keyed.withColumn("__cv_kinds", F.lit(None).cast("array<string>"))
    parts = []
    for rule in rules:
        if rule in by_index:
            gate = F.array_contains(F.col("__cv_kinds"), rule.kind)
        else:
            gate = body.rlike(rule.pattern)
        parts.append(F.when(gate, _spans(body, rule)).otherwise(empty))
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    ordered = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), ranks[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = F.transform(F.array_sort(ordered), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    any_part = F.lit(False)
    for rule in rules:
        any_part = any_part | (F.array_contains(F.col("__cv_kinds"), rule.kind) if rule in by_index else body.rlike(rule.pattern))
    return keyed.withColumn("secret_spans", F.when(any_part, ordered).otherwise(empty)).drop("__cv_hash", "__cv_kinds")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``find_secrets`` with every run of overlapping spans replaced by one mark; rows without spans stay as they are."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    cut = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, cut).otherwise(F.col(text))).drop("secret_spans")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*(r.kind for r in BASE_RULES)))
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("secret_spans")).alias("spans"),
    )


def _sql() -> str:
    """The same spans by plain scans of every text."""
    parts = []
    for i, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        keep = f"len(regexp_extract(m[j], '{p}', {rule.value_group})) >= {rule.min_value}" if rule.min_value else "true"
        parts.append(f"""
  SELECT r, {i} AS k, '{rule.kind}' AS kind, a AS s, a + len(m[j]) AS e
  FROM (SELECT r, m, j, list_sum(list_transform(g[1:j], lambda x: len(x)))::BIGINT
                        + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: len(x))), 0)::BIGINT AS a
        FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g
              FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(m) + 1)) AS u(j)) WHERE {keep}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    base = "kind IN (" + ", ".join(f"'{r.kind}'" for r in BASE_RULES) + ")"
    piece = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
per AS (SELECT r, {counts}, string_agg({piece}, ',' ORDER BY s, k) FILTER ({base}) AS base,
               string_agg({piece}, ',' ORDER BY s, k) AS spans FROM hits GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)"""


QUERIES = {"op5_secret_scans": query}
ORACLES = {"op5_secret_scans": _sql()}
