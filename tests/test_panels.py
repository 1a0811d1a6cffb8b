"""Patients and papers as contexts."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import panels
from corvane.sources import files


def test_patients_from_file_to_contexts(spark, tmp_path):
    doc = {
        "p1": {"name": "A", "birthday": "1970-01-01", "diagnosis": "d", "texts": {f"n{i}": f"note {i} " * (1 + 30 * (i == 2)) for i in range(4)}, "questions": []},
        "p2": {"name": "B", "birthday": "1980-01-01", "texts": {"n0": "only"}}, "p3": {"name": "C", "texts": {}}, "p4": {"name": "D", "texts": {"n0": "x"}},
    }
    (tmp_path / "l.json").write_text(json.dumps(doc))
    notes = files.patient_notes(spark, f"{tmp_path}/l.json", ["p1", "p2", "p3"])
    who = notes.select("patient", "name", "birthday", "diagnosis").distinct()
    whole = {r.patient: r for r in panels.whole_contexts(who, notes, "patient", "note", "text", panels.tagged, panels.patient_frame).collect()}
    assert {p: r.n_parts for p, r in whole.items()} == {"p1": 4, "p2": 1, "p3": 0}
    assert whole["p2"].context == "<patient-record-p2>\nMedical record of B (ID: p2), born on 1980-01-01, diagnosis: unknown. It has 1 notes.\n<notes>\n<n0>\nonly\n</n0>\n</notes>\n</patient-record-p2>"
    drawn = lambda n: panels.drawn_contexts(who, notes.repartition(n), "patient", "note", "text", panels.tagged, panels.patient_frame, 400, 7, 2, 3, max_chars=50)
    got = drawn(1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, drawn(5).collect())) and sorted(r.draw for r in got) == list(range(400))
    share = sum(r.patient == "p1" for r in got)
    assert 150 < share < 250 and {r.n_parts for r in got if r.patient == "p1"} == {2, 3} and {r.n_parts for r in got if r.patient == "p2"} == {1}
    for r in got:
        for i in range(4):
            assert r.context.count(f"<n{i}>") <= 1
        if "<n2>" in r.context:
            inside = r.context.split("<n2>\n")[1].split("\n</n2>")[0]
            assert inside.startswith("... ") and inside.endswith(" ...") and len(inside) == 58 and inside[4:-4] in doc["p1"]["texts"]["n2"]


def test_papers_to_contexts(spark):
    schema = "id string, title string, abstract string, full_text struct<section_name: array<string>, paragraphs: array<array<string>>>"
    rows = [("a", "T", "abs", (["Intro", None], [["x", "y"], ["z"]])), ("b", None, None, ([], [])), ("c", "U", "abs", (["Only"], [["w"]]))]
    papers = spark.createDataFrame(rows, schema)
    sections = files.paper_sections(papers)
    assert [tuple(r)[3:] for r in sections.where("paper = 'a'").orderBy("section").collect()] == [(0, "Intro", "x\ny"), (1, "", "z")]
    heads = sections.select("paper", "title", "abstract").distinct()
    shown = sections.withColumn("text", F.concat_ws("\n", "heading", "text"))
    frame = lambda part, text: panels.tagged(F.concat(F.lit("section-"), part.cast("string")), text)
    got = {r.paper: r.context for r in panels.whole_contexts(heads, shown, "paper", "section", "text", frame, panels.paper_frame).collect()}
    assert got["c"] == "<paper>\n<title>\nU\n</title>\n<abstract>\nabs\n</abstract>\n<sections>\n<section-0>\nOnly\nw\n</section-0>\n</sections>\n</paper>"
    assert got["b"] == "<paper>\n<title>\n\n</title>\n<abstract>\n\n</abstract>\n<sections>\n\n</sections>\n</paper>"
    assert files.paper_sections(papers, ["a", "c"]).select("paper").distinct().count() == 2
    with pytest.raises(ValueError):
        files.paper_sections(papers, ["a", "missing"])


def test_draws_of_nothing_and_wrong_bounds(spark):
    none = spark.createDataFrame([], "r string, p int, text string")
    assert panels.draw_parts(none, "r", "p", 5, 1).count() == 0
    nulls = spark.createDataFrame([(None, 1, "x"), ("a", None, "y"), ("b", 1, None)], "r string, p int, text string")
    assert {r.r for r in panels.draw_parts(nulls, "r", "p", 5, 1).collect()} == {"b"}
    assert panels.draw_parts(nulls, "r", "p", 0, 1).count() == 0
    for least, most in ((0, 1), (2, 1)):
        with pytest.raises(ValueError):
            panels.draw_parts(nulls, "r", "p", 5, 1, least, most)
