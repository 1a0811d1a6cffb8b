"""Arrays, maps and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from corvane.functions.sampling import below, uniform


def pad_to(values: Column, n: Column | int, fill) -> Column:
    """The array with ``fill`` behind it up to n elements."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(n) - F.size(values))))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def _leaves(value, path: str, separator: str, containers: bool):
    if isinstance(value, dict):
        items = list(value.items())
    elif isinstance(value, list):
        items = list(enumerate(value))
    else:
        yield path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        return
    if containers or not items:
        yield path, json.dumps(value, ensure_ascii=False)
    for k, v in items:
        yield from _leaves(v, f"{path}{separator}{k}" if path else str(k), separator, containers)


def flatten_json(df: DataFrame, column: str, keys: list[str], separator: str = "/", containers: bool = False) -> DataFrame:
    """(*keys, path, value): the nodes of JSON texts, leaves only or with containers; text that isn't JSON gives no rows.

    Values are JSON, strings bare. An empty object or list is a leaf. Runs in
    Arrow batches: the depth of a document is not bounded by the plan.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", path string, value string"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                try:
                    document = json.loads(row[-1]) if row[-1] is not None else None
                except ValueError:
                    continue
                if row[-1] is not None:
                    rows += [(*row[:-1], p, v) for p, v in _leaves(document, "", separator, containers)]
            yield pd.DataFrame(rows, columns=[*keys, "path", "value"])

    return df.select(*keys, column).mapInPandas(run, schema)


#: Texts nested deeper aren't read by the JVM's parser.
DEEPEST = 1000


def node_array(document: Column, separator: str = "/") -> Column:
    """array<struct<path, kind, value, leaf>> by path: the nodes of a VARIANT, built level by level.

    kind: object, array or value.  value: JSON without white space, numbers in
    their shortest form, strings bare.  An empty object or array is a leaf.
    Object keys are sorted; a null gives null.  One row's nodes are held at once.
    """
    at = lambda n, k: F.when(n["path"] == "", k).otherwise(F.concat(n["path"], F.lit(separator), k))
    as_map = lambda n: F.try_variant_get(n["value"], "$", "map<string,variant>")
    as_list = lambda n: F.try_variant_get(n["value"], "$", "array<variant>")
    node = lambda path, value: F.struct(path.alias("path"), value.alias("value"))

    def below_it(n: Column) -> Column:
        fields = F.transform(F.map_entries(as_map(n)), lambda e: node(at(n, e["key"]), e["value"]))
        places = F.transform(as_list(n), lambda x, i: node(at(n, i.cast("string")), x))
        return F.coalesce(fields, places, F.array().cast("array<struct<path:string,value:variant>>"))

    def level(s: Column, _: Column) -> Column:
        deeper = F.struct(F.concat(s["done"], s["open"]).alias("done"), F.flatten(F.transform(s["open"], below_it)).alias("open"))
        return F.when(F.size(s["open"]) == 0, s).otherwise(deeper)

    def shown(n: Column) -> Column:
        def as_json(j: Column) -> Column:  # written once a node; its first character tells containers
            begins = F.substring(j, 1, 1)
            kind = F.when(begins == "{", "object").when(begins == "[", "array").otherwise("value")
            value = F.when(begins.isin("{", "["), j).when(F.is_variant_null(n["value"]), "null").otherwise(F.try_variant_get(n["value"], "$", "string"))
            return F.struct(n["path"].alias("path"), kind.alias("kind"), value.alias("value"), (~begins.isin("{", "[") | j.isin("{}", "[]")).alias("leaf"))

        return F.get(F.transform(F.array(F.to_json(n["value"])), as_json), F.lit(0))

    # No document has more levels than opening brackets.
    text = F.to_json(document)
    levels = F.least(F.length(text) - F.length(F.translate(text, "[{", "")) + 1, F.lit(DEEPEST + 1))
    nothing = F.array().cast("array<struct<path:string,value:variant>>")
    start = F.struct(nothing.alias("done"), F.array(node(F.lit(""), document)).alias("open"))
    return F.when(document.isNotNull(), F.array_sort(F.transform(F.aggregate(F.sequence(F.lit(1), levels), start, level)["done"], shown)))


def json_nodes(df: DataFrame, column: str, keys: list[str], separator: str = "/") -> DataFrame:
    """(*keys, path, kind, value, leaf): every node of JSON texts, all in the JVM, without a shuffle.

    A text that isn't JSON, repeats a key or is nested over 1,000 deep gives one
    row of the kind ``unreadable`` with null path and value; a null text gives none.
    """
    unreadable = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("leaf")))
    nodes = F.coalesce(node_array(F.try_parse_json(column), separator), F.when(F.col(column).isNotNull(), unreadable))
    return df.select(*keys, F.inline(nodes))


def draw_nodes(df: DataFrame, column: str, keys: list[str], seed: int, draws: int = 1, leaves_only: bool = False, separator: str = "/") -> DataFrame:
    """(*keys, draw, path, kind, value): nodes of each JSON text, drawn evenly with replacement, with all that is below them.

    A draw is a hash of (seed, keys, draw) over the nodes by path, so it doesn't
    depend on the partitioning.  Texts that are null or unreadable give no rows.
    """
    nodes = node_array(F.try_parse_json(column), separator)
    readable = df.where(F.try_parse_json(column).isNotNull())
    held = readable.select(*keys, (F.filter(nodes, lambda n: n["leaf"]) if leaves_only else nodes).alias("__nodes"))
    drawn = held.select(*keys, "__nodes", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")) if draws > 0 else held.limit(0).withColumn("draw", F.lit(0))
    one = F.get("__nodes", below(uniform(seed, *keys, "draw"), F.size("__nodes")))
    return drawn.withColumn("__node", one).select(*keys, "draw", "__node.path", "__node.kind", "__node.value")


def unflatten(pairs: dict[str, object]) -> object:
    """Nested value of dotted keys; nulls are dropped, keys 0..n-1 make a list."""
    root: dict = {}
    for key, value in pairs.items():
        if value is None or value != value:
            continue
        *above, last = key.split(".")
        node = root
        for part in above:
            node = node.setdefault(part, {})
        node[last] = value

    def settle(node):
        if not isinstance(node, dict):
            return node
        made = {k: settle(v) for k, v in node.items()}
        numbered = sorted(made, key=lambda k: (len(k), k))
        return [made[k] for k in numbered] if made and numbered == [str(i) for i in range(len(made))] else made

    return settle(root)


@F.pandas_udf(StringType())
def unflatten_json(pairs: pd.Series) -> pd.Series:
    """JSON of ``unflatten`` for JSON objects of dotted keys."""
    return pairs.map(lambda x: None if x is None else json.dumps(unflatten(json.loads(x)), ensure_ascii=False))


def config_hash(config: dict, volatile: tuple[str, ...] = (), length: int = 8) -> str:
    """Hex of the SHA-256 of a config as sorted JSON, volatile keys dropped."""
    import hashlib

    kept = {k: v for k, v in config.items() if k not in volatile}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:length]


def drop_null_columns(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns that hold no value, found in one pass, and the named ones."""
    kept = [c for c in df.columns if c not in also]
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(kept))).first() if kept else []
    return df.select(*(F.col(f"`{c}`") for c, n in zip(kept, counts) if n))
