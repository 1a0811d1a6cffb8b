"""Text, JSON, LaTeX and Python trees."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.functions.text import frame_file, strip_latex_comments
from corvane.operators.graphs import module_levels
from corvane.operators.temporal import joined_text


def decode(content: bytes, path: str = "") -> str:
    """UTF-8, else Latin-1, which takes any byte; a place holder for binary content."""
    if b"\x00" in content:
        return f"[binary file {path}]"
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path relative to root, text) of the files with the extensions (all by default)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root)
    base = F.lit(root.removeprefix("file:").rstrip("/") + "/")
    files = files.select(F.regexp_replace(F.col("path"), "^file:(//)?", "").alias("full"), "content")
    relative = F.when(F.startswith(F.col("full"), base), F.substring(F.col("full"), F.length(base) + 1, F.length("full"))).otherwise(F.col("full"))
    if extensions:
        files = files.where(F.exists(F.array(*(F.lit(e) for e in extensions)), lambda e: F.endswith(F.col("full"), e)))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [decode(c, p) for c, p in zip(pdf["content"], pdf["path"])]})

    return files.select(relative.alias("path"), "content").mapInPandas(run, "path string, text string")


def tree_as_text(files: DataFrame) -> DataFrame:
    """(text): all files in order of path, each framed and ended by a separator; one row."""
    return joined_text(files.withColumn("corpus", F.lit(1)), ["corpus"], ["path"], F.concat(frame_file(F.col("path"), F.col("text")), F.lit("\n--- end of file ---")), "\n").select("text")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): one VARIANT a file, null if it isn't JSON."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def read_latex(spark: SparkSession, root: str) -> DataFrame:
    """(text): the .tex files of a project in order of path, comments stripped; one row."""
    files = read_tree(spark, root, (".tex",))
    return joined_text(files.withColumn("corpus", F.lit(1)), ["corpus"], ["path"], F.concat(F.lit("% "), F.col("path"), F.lit("\n"), strip_latex_comments(F.col("text"))), "\n\n").select("text")


def imports_of(source: str) -> list[str]:
    """Top-level names of a module's absolute imports, sorted; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names.update(a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            names.add(node.module.split(".")[0])
    return sorted(names)


@F.pandas_udf(ArrayType(StringType()))
def python_imports(source: pd.Series) -> pd.Series:
    return source.map(lambda s: imports_of(s or ""))


def read_table_json(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value): the cells of {"columns": [...], "data": [[...]]} files, values as JSON."""

    def run(batches):
        for pdf in batches:
            cells = []
            for text in pdf["value"]:
                table = json.loads(text)
                cells += [(i, c, json.dumps(v)) for i, row in enumerate(table["data"]) for c, v in zip(table["columns"], row)]
            yield pd.DataFrame(cells, columns=["row", "column", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "row long, column string, value string")


def question_items(spark: SparkSession, path: str, skip_first: bool = False) -> DataFrame:
    """(key, i, question, answer) of JSON objects {key: [{question, answer}]} or lists; ``skip_first`` leaves out element 0."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", "map<string, array<struct<question:string, answer:string>>>").alias("d"))
    rows = doc.select(F.explode("d").alias("key", "items")).select("key", F.posexplode("items").alias("i", "x"))
    return rows.where(F.col("i") > 0 if skip_first else F.lit(True)).select("key", "i", "x.question", "x.answer")


def read_repository(spark: SparkSession, root: str, package: str, most: int | None = None) -> DataFrame:
    """(path, module, level, text) of a package's Python files: level 0 imports none of its modules, others one more than the deepest they import.

    Modules above ``most`` are left out, and so are imports that only name the
    module itself; modules that import each other in a circle raise an error.
    """
    files = read_tree(spark, root, (".py",)).withColumn("module", F.concat_ws(".", F.lit(package), module_of(F.col("path"))))
    edges = files.select("module", F.explode(imported_modules(F.col("text"), F.col("module"))).alias("imports")).where("imports <> module")
    known = files.select("module")
    inside = edges.join(known.select(F.col("module").alias("imports")), "imports", "left_semi")
    return files.join(module_levels(known, inside, most), "module").select("path", "module", "level", "text")


def module_of(path) -> Column:
    """Dotted name of a file within its package; a package's own file has the package's name, the root's null."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.when(bare != "", F.replace(bare, F.lit("/"), F.lit(".")))


def absolute_imports(source: str, module: str) -> list[str]:
    """Dotted names that a module may import: of each import the module, and the names from it; relative ones from the module's place."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            parts = module.split(".")[: -node.level] if node.level else []
            base = ".".join([*parts, *([node.module] if node.module else [])])
            names.update([base, *(f"{base}.{a.name}" for a in node.names)])
    return sorted(n for n in names if n)


@F.pandas_udf(ArrayType(StringType()))
def imported_modules(source: pd.Series, module: pd.Series) -> pd.Series:
    return pd.Series([absolute_imports(s or "", m) for s, m in zip(source, module)])


def patient_items(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(patient, question_id, question, options, correct) of {patient: {questions: [{No, question, correct, answer_a..e}]}}; question_id is patient_No; ids keep those patients."""
    letters = [f"answer_{x}" for x in "abcde"]
    question = "struct<No:int, question:string, correct:string, " + ", ".join(f"{x}:string" for x in letters) + ">"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<questions: array<{question}>>>").alias("d"))
    rows = doc.select(F.explode("d").alias("patient", "p")).select("patient", F.explode("p.questions").alias("q"))
    rows = rows if ids is None else rows.where(F.col("patient").isin(*ids))
    return rows.select("patient", F.concat_ws("_", "patient", F.col("q.No").cast("string")).alias("question_id"), "q.question", F.array(*(f"q.{x}" for x in letters)).alias("options"), "q.correct")


def patient_notes(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(patient, name, birthday, diagnosis, note, text), a row a note, of {patient: {name, birthday, diagnosis, texts: {note: text}}}; ids keep those patients."""
    body = "struct<name:string, birthday:string, diagnosis:string, texts:map<string,string>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {body}>")).alias("patient", "p"))
    doc = doc if ids is None else doc.where(F.col("patient").isin(*ids))
    return doc.select("patient", "p.name", "p.birthday", "p.diagnosis", F.explode_outer("p.texts").alias("note", "text"))


def paper_sections(papers: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(paper, title, abstract, section, heading, text), a row a section, of (id, title, abstract, full_text struct<section_name, paragraphs>).

    A missing paragraph list or heading is empty; asked ids that aren't there raise ValueError.
    """
    kept = papers if ids is None else expect_rows(papers.where(F.col("id").isin(*ids)), len(set(ids)))
    zipped = F.arrays_zip(F.col("full_text.section_name").alias("heading"), F.col("full_text.paragraphs").alias("paragraphs"))
    rows = kept.select(F.col("id").alias("paper"), "title", "abstract", F.posexplode_outer(zipped).alias("section", "s"))
    return rows.select("paper", "title", "abstract", "section", F.coalesce("s.heading", F.lit("")).alias("heading"), F.coalesce(F.array_join("s.paragraphs", "\n"), F.lit("")).alias("text"))


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """The rows, after a check that there are exactly ``n``; else ValueError."""
    found = df.limit(n + 1).count()
    if found != n:
        raise ValueError(f"expected {n} rows, found {'more' if found > n else found}")
    return df
