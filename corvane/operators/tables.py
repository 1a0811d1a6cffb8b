"""Tables of runs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.operators.analytics import in_order


def latex(df: DataFrame, index: str, columns: list[str], order: list[str] | None = None, digits: int = 2) -> DataFrame:
    """(line_no, line): a LaTeX table in the given row order, ``--`` for nulls, rules around head and body."""
    cell = lambda c: F.coalesce(F.format_number(F.col(c), digits), F.lit("--"))
    key = in_order(F.col(index), order) if order else F.lit(0)
    rows = df.select(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(index).cast("string").alias("i"), F.concat(F.concat_ws(" & ", F.col(index).cast("string"), *(cell(c) for c in columns)), F.lit(r" \\")).alias("line"))).over(_everything())).alias("r")).limit(1)
    head = " & ".join([index, *columns]) + r" \\"
    before = [r"\begin{tabular}{l" + "r" * len(columns) + "}", r"\toprule", head, r"\midrule"]
    lines = F.concat(F.array(*(F.lit(x) for x in before)), F.transform("r", lambda x: x["line"]), F.array(F.lit(r"\bottomrule"), F.lit(r"\end{tabular}")))
    return rows.select(F.posexplode(lines).alias("line_no", "line"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as CSV text."""
    return df.select(F.to_csv(F.struct(*columns)).alias("line"))


def code_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, change) of two file tables (path, digest): added, removed or changed."""
    a, b = left.select("path", F.col("digest").alias("a")), right.select("path", F.col("digest").alias("b"))
    met = a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return met.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
