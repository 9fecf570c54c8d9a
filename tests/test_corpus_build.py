"""A corpus build over files on disk: damaged ones are rows, all others are built, and the tables are one version."""

from __future__ import annotations

import json

from sitelens.__main__ import main
from sitelens.plans import corpus_build
from sitelens.sources import versions
from tests.test_pdf import OBJECTS, classic
from tests.test_registry import docx


def test_one_bad_document_stops_no_other(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "good.pdf").write_bytes(classic())
    (root / "bad.pdf").write_bytes(b"broken")
    (root / "half.pdf").write_bytes(classic(OBJECTS | {10: b"<< /Length 1 /Filter /DCTDecode >>\nstream\nx\nendstream"}))
    docx(root / "words.docx", "<w:p><w:r><w:t>Aims of the plan</w:t></w:r></w:p>")
    (root / "torn.docx").write_bytes(b"no archive")
    rows = [
        ("d1", "good.pdf", "PRIMARY", True, None),
        ("d2", "bad.pdf", "PRIMARY", True, None),
        ("d3", "half.pdf", "PRIMARY", True, None),
        ("d4", "words.docx", "CURATED", True, None),
        ("d5", "words.docx", "SUPPORTING_RESEARCH", True, None),
        ("d6", "torn.docx", "PRIMARY", True, None),
        ("d7", "gone.pdf", "PRIMARY", True, None),
        ("d8", "good.pdf", "PRIMARY", True, "d1"),
        ("d9", "good.pdf", "ARCHIVE", False, None),
        ("e1", "x/rag_records.jsonl", "CURATED", True, None),
        ("e2", "note.txt", "PRIMARY", True, None),
        ("e3", "good.pdf", "PRIMARY", None, None),
    ]
    documents = spark.createDataFrame(rows, "document_id string, source_path string, source_class string, retrieval_eligible boolean, duplicate_of string")
    target = f"file://{tmp_path}/built"
    assert corpus_build.build_corpus(spark, f"file://{root}", documents, target) == 0
    got = {r.document_id: r for r in versions.read(spark, target, "documents").collect()}
    assert {k: r.extraction_status for k, r in got.items()} == {
        "d1": "EXTRACTED", "d2": "FAILED", "d3": "FAILED", "d4": "SKIPPED_METADATA", "d5": "EXTRACTED", "d6": "FAILED", "d7": "FAILED", "d8": "DUPLICATE_SKIPPED",
        "d9": "SKIPPED_ARCHIVE", "e1": "CURATED_ATOMIC", "e2": "SKIPPED_METADATA", "e3": "SKIPPED_METADATA",
    }
    assert (got["d1"].page_count, got["d1"].chunk_count, got["d1"].no_text_pages) == (3, 2, [3]) and got["d5"].chunk_count == 1
    assert "header" in got["d2"].extraction_error and "DCTDecode" in got["d3"].extraction_error and got["d7"].extraction_error == "no page could be read"
    chunks = {r.chunk_id: r.chunk_text for r in versions.read(spark, target, "chunks").collect()}
    assert set(chunks) == {"d1-p0001-000", "d1-p0002-000", "d5-p0001-000"} and chunks["d5-p0001-000"] == "Aims of the plan"
    assert [tuple(r) for r in versions.read(spark, target, "no_text_pages").collect()] == [("d1", 3, "VISUAL_CONTENT")]
    assert {r.extraction_status: r.documents for r in versions.read(spark, target, "report").collect()}["FAILED"] == 4


def test_commands_from_files_to_searches(spark, tmp_path, capsys):
    root, corpus, index = tmp_path / "raw", f"file://{tmp_path}/corpus", f"file://{tmp_path}/index"
    root.mkdir()
    (root / "a.pdf").write_bytes(classic())
    docx(root / "b.docx", "<w:p><w:r><w:t>Water supply and drainage</w:t></w:r></w:p>")
    docx(root / "c.docx", "<w:p><w:r><w:t>Water supply and drainage</w:t></w:r></w:p>")
    rows = [(i, f"{i}.{kind}", "PRIMARY", True) for i, kind in (("a", "pdf"), ("b", "docx"), ("c", "docx"), ("z", "pdf"))]
    register = tmp_path / "register.jsonl"
    line = lambda i, path, kind, ok: json.dumps({"document_id": i, "source_path": path, "source_class": kind, "retrieval_eligible": ok})
    register.write_text("\n".join(line(*r) for r in rows[:3]))
    build = ["build", f"file://{root}", "--register", str(register), "--corpus", corpus]
    assert main(build) == 0 and "EXTRACTED\t3" in capsys.readouterr().out
    where = ["--corpus", corpus, "--index", index]
    assert main(["index", *where]) == 0 and capsys.readouterr().out.split() == ["MISSING"]
    assert main(["index", *where]) == 0 and capsys.readouterr().out.split() == ["READY"]
    assert main(["search", "grid power", "water", *where]) == 0
    hits = [x.split("\t") for x in capsys.readouterr().out.splitlines()[1:]]
    # Equal texts are one record.
    assert [(h[0], h[1], h[4]) for h in hits] == [("0", "1", "a.pdf"), ("1", "1", "b.docx")]
    register.write_text("\n".join(line(*r) for r in rows))
    assert main(build) == 1
    assert main(["index", *where]) == 0 and "READY" in capsys.readouterr().out
    (root / "b.docx").unlink()
    docx(root / "b.docx", "<w:p><w:r><w:t>Other words</w:t></w:r></w:p>")
    assert main(build) == 1 and main(["index", *where]) == 0 and "STALE" in capsys.readouterr().out
