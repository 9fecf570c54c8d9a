"""Registries, validation by mode, layers by box and DOCX blocks; evaluators, bundles, packages and compared runs on small tables."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from sitelens.operators import bundle, snapshots, validity
from sitelens.sources import registry


def test_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2}, 7]')
    (tmp_path / "b.json").write_text('{"id": 3}')
    (tmp_path / "c.json").write_text("{oops")
    (tmp_path / "d.json").write_text('"text"')
    (tmp_path / "e.json").write_text("[]")
    got = sorted((r.path[-6:-5], r.entry or "", r.error or "") for r in registry.read_registry(spark, str(tmp_path)).collect())
    assert got == [("a", "", "entry is not an object"), ("a", '{"id":1}', ""), ("a", '{"id":2}', ""), ("b", '{"id":3}', ""), ("c", "", "not JSON"), ("d", "", "no list or object")]


def test_validated(spark):
    rows = spark.createDataFrame([(1, "csv"), (2, "zip"), (3, "odd"), (4, None)], "source_id int, mode string")
    check = lambda ok: lambda x: x.select("source_id", F.lit(ok).alias("valid"), F.lit("seen").alias("message"))
    got = {r.source_id: (r.valid, r.message) for r in registry.validated(rows, {"csv": check(True), "zip": check(False)}).collect()}
    assert got == {1: (True, "seen"), 2: (False, "seen"), 3: (False, "unsupported mode: odd"), 4: (False, "unsupported mode: none")}


def test_layer_by_box(spark, tmp_path):
    rows = [(i, float(i), float(i), i + 1.0, i + 1.0) for i in range(10)] + [(99, None, None, None, None)]
    flat = spark.createDataFrame(rows, "feature_id int, xmin double, ymin double, xmax double, ymax double")
    flat.write.parquet(str(tmp_path / "flat"))
    flat.select("feature_id", F.struct(*registry.BBOX).alias("bbox")).write.parquet(str(tmp_path / "nested"))
    flat.select("feature_id").write.parquet(str(tmp_path / "none"))
    ids = lambda name, box=(2.5, 2.5, 3.5, 3.5): sorted(r.feature_id for r in registry.read_layer(spark, str(tmp_path / name), box).collect())
    assert ids("flat") == ids("nested") == [2, 3, 99]
    assert len(ids("none")) == len(ids("flat", None)) == 11
    plan = registry.read_layer(spark, str(tmp_path / "nested"), (0.0, 0.0, 1.0, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "xmax" in plan.split("PushedFilters")[1]


def docx(path, body, styles=None):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")


def test_docx(spark, tmp_path):
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    docx(tmp_path / "a.docx", p("Aims", "H1") + p(" ") + f"<w:tbl>{row('x', 'y')}{row('', '')}{row('1', '2')}</w:tbl>" + p("after"), '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style>')
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = sorted(((r.path[-6:], r.position, r.kind, r.text, r.heading, r.error is None) for r in registry.read_docx(spark, str(tmp_path)).collect()), key=str)
    assert got == [("a.docx", 0, "paragraph", "Aims", True, True), ("a.docx", 1, "table", "x | y\n1 | 2", False, True), ("a.docx", 2, "paragraph", "after", False, True), ("b.docx", None, None, None, None, False)]


def test_comparison(spark):
    finding = lambda i, status, **more: {"finding_id": i, "domain": "GRID", "status": status, **more}
    before = {"assessment_result": {"findings": [finding("f1", "CLEAR", evidence_ids=["e1"]), finding("f2", "UNKNOWN")], "dependencies": ["Grid offer"]}}
    after = {"assessment_result": {"findings": [finding("f1", "CONSTRAINED", evidence_ids=["e2"])], "dependencies": ["grid offer "]}, "human_reviews": [{"review_id": "r1"}]}
    rows = [("p", json.dumps({"planned_power_mw": 5, "project_id": "a"}), json.dumps(before), json.dumps({"planned_power_mw": 6, "project_id": "b"}), json.dumps(after))]
    found = snapshots.comparison(spark.createDataFrame(rows, "pair_id string, baseline_context string, baseline_result string, comparison_context string, comparison_result string"))
    s = found["summary"].first().asDict()
    assert len(s) == 24 and {k: v for k, v in s.items() if v and k != "pair_id"} == {
        "input_changes": 1, "domain_changes": 1, "removed_findings": 1, "changed_findings": 1, "new_reviews": 1, "new_evidence": 1, "removed_evidence": 1, "changed_dependencies": 1,
    }
    shown = found["inputs"].first()
    assert (shown.previous_display, shown.current_display) == ("5 MW", "6 MW") and found["inputs"].count() == 1


def test_package_errors(spark):
    sources = spark.createDataFrame([("s1",), ("s1",)], "source_id string")
    body = {"id": "k", "title": {}, "content": {"en": "x", "retrieval_text": "x"}, "quality": {"review_required": False, "evidence_level": "other"}, "sources": [{"source_id": "s9", "source_tier": "secondary"}]}
    records = spark.createDataFrame([("1", json.dumps(body)), ("2", json.dumps(body))], "row string, body string")
    flags = spark.createDataFrame([("1", json.dumps({"flag_id": "g", "source_id": "s8", "official_sources": ["s1", "s7"]}))], "row string, body string")
    codes = {r.code for r in validity.package_errors(sources, records, flags).collect()}
    assert {"DUPLICATE_SOURCE_ID", "DUPLICATE_RECORD_ID", "TITLE_NOT_ENGLISH", "EVIDENCE_NOT_PRIMARY", "UNKNOWN_SOURCE", "CITES_NON_PRIMARY", "FLAG_OF_UNKNOWN_SOURCE", "UNKNOWN_OFFICIAL_SOURCE"} <= codes
    assert "CONTENT_INCOMPLETE" not in codes and "DUPLICATE_FLAG_ID" not in codes


def test_bundle(spark):
    hits = spark.createDataFrame(
        [("p", "r1", "GRID", "Code", "d1", "CRU", "/x/a.pdf", "text", "PRIMARY", "CURRENT", None, None), ("p", "r2", "WATER", "", "d2", " ", None, "", "SUPPORTING_INDUSTRY", "HISTORICAL", "V", True)],
        "project_id string, record_key string, domain string, title string, document_id string, issuer string, source_path string, text string, source_class string, document_status string, verification_status string, review boolean",
    )
    a, b = bundle.policy_records(hits).orderBy("evidence_id").collect()
    assert (a.evidence_id, a.source_name, a.fact, a.confidence, a.limitation, a.verification_status) == ("rag-r1", "CRU — Code", "text", "HIGH", None, "UNVERIFIED")
    assert (b.source_name, b.fact, b.source_reference, b.confidence, b.human_review_required) == ("d2", "Retrieved evidence from d2", "r2", "MEDIUM", True)
    assert b.limitation.startswith("Policy version is not current")


def test_numbers_compare_as_written(spark):
    """50 and 50.0 differ, 5e1 is 50.0, and the order of keys does not count."""
    from sitelens.operators import diff

    rows = spark.createDataFrame([("50",), ("50.0",), ("5e1",), ('"50"',), ('{"b": 1, "a": [1, 1.0]}',), ('{"a":[1,1.0],"b":1}',), ("{oops",), (None,), ("null",)], "t string")
    got = [r.c for r in rows.select(diff.canonical(F.col("t")).alias("c")).collect()]
    assert got == ["50", "50.0", "50.0", '"50"', '{"a":[1,1.0],"b":1}', '{"a":[1,1.0],"b":1}', None, None, "null"]
    doc = spark.createDataFrame([(1, '{"p": 50.0, "n": {"x": {"y": null, "z": {}}, "w": []}, "s": "{}", "skip": {"a": 1}}'), (2, None), (3, "[1]")], "id int, doc string")
    leaves = diff.flatten_paths(doc, "doc", "id", skip=("skip",))
    assert sorted((r.id, r.path, r.value) for r in leaves.collect()) == [(1, "n.w", "[]"), (1, "n.x.y", "null"), (1, "n.x.z", "{}"), (1, "p", "50.0"), (1, "s", '"{}"')]
    side = lambda power: json.dumps({"assessment_result": {"findings": [{"finding_id": "f", "power": power}]}})
    pairs = spark.createDataFrame([("p", '{"planned_power_mw": 50}', side(50), '{"planned_power_mw": 50.0}', side(50.0))], "pair_id string, baseline_context string, baseline_result string, comparison_context string, comparison_result string")
    found = snapshots.comparison(pairs)
    assert [(r.change_kind, r.changed_fields) for r in found["items"].collect()] == [("changed", "power")]
    assert [r.change_kind for r in found["inputs"].collect()] == ["changed"]


def test_citations_and_plain_unknowns(spark):
    result = {
        "assessment_result": {"material_unknowns": [{"unknown_id": "u1"}, "free text"]},
        "explanation_result": {"source_citations": [{"document_id": "d1"}, {"source_path": "/a", "locator": "p1"}, {"note": "nothing"}, {"document_id": "d1", "page": 2}], "next_actions": [{"title": " Ask "}]},
        "evidence_bundle": {"records": [{"evidence_id": "e1", "domain": "GRID"}, {"evidence_id": " "}]},
        "human_reviews": [{"review_id": "r1", "evidence_ids": ["e1", "e2", "", 7]}],
    }
    runs = spark.createDataFrame([("x", json.dumps(result)), ("y", None), ("z", "{oops")], "run_id string, result string")
    got = {(r.section, r.identity): (r.matchable, json.loads(r.item)) for r in snapshots.all_items(runs, "run_id").collect()}
    assert got["citations", "d1"] == (True, {"document_id": "d1", "page": 2}) and sum(s == "citations" for s, _ in got) == 3
    assert [v[0] for (s, i), v in got.items() if s == "citations" and i != "d1"].count(False) == 1
    assert got["unknowns", "u1"][0] and [v for (s, i), v in got.items() if s == "unknowns" and i != "u1"] == [(True, {"value": "free text"})]
    assert got["evidence", "e1"][1] == {"evidence_id": "e1", "domain": "GRID"} and got["evidence", "e2"][1] == {"evidence_id": "e2"} and sum(s == "evidence" for s, _ in got) == 2
    assert got["reviews", "r1"][0] and sum(s == "actions" for s, _ in got) == 1
