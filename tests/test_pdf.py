"""PDF files written here by hand: tables and streams of cross-references, packed objects, fonts with maps, damaged files."""

from __future__ import annotations

import zlib

from sitelens.sources import pdf


def flat(data, extra=b""):
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), extra, packed)


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00C9> <0002> <0074> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
FORM = b"<< /Type /XObject /Subtype /Form /Length 26 >>\nstream\nBT /F1 9 Tf (in form) Tj ET\nendstream"
TEXT = rb"BT /F1 12 Tf 72 700 Td (Site \(one\)) Tj 0 -14 Td [(gr) 20 (id) -300 (power\041)] TJ T* (caf\351) Tj ET 0 0 10 10 re f 0 0 m 5 5 l S q BI /W 1 /H 1 ID (EI Tj) EI Q /X1 Do /X2 Do"
OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 11 0 R] /Count 3 /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 8 0 R /X2 9 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [10 0 R] /Annots [<< /Subtype /Link /A << /URI (http://x) >> >> << /Subtype /Text >>] >>",
    4: b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents 12 0 R >>",
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
    7: flat(CMAP),
    8: b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\n\x00\nendstream",
    9: FORM,
    10: flat(TEXT),
    11: b"<< /Type /Page /Parent 2 0 R >>",
    12: flat(b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 1 0 0 1 90 700 Tm <0011> Tj 1 0 0 1 72 680 Tm <0010> Tj ET"),
}


def classic(objects=OBJECTS, trailer=b"", damage=False):
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    for n, body in objects.items():
        places[n] = len(out) + 7 * damage
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
    return bytes(out) + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, trailer, at)


def modern():
    """Dictionaries in an object stream, the cross-reference in a stream with a predictor."""
    packed = {n: b for n, b in OBJECTS.items() if b"stream" not in b}
    plain = {n: b for n, b in OBJECTS.items() if n not in packed}
    heads, body = b"", b""
    for n, b in packed.items():
        heads += b"%d %d " % (n, len(body))
        body += b + b" "
    plain[20] = flat(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(heads)))
    out, rows = bytearray(b"%PDF-1.5\n"), {}
    for n, b in plain.items():
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    rows |= {n: (2, 20, i) for i, n in enumerate(packed)}
    at = len(out)
    rows[21] = (1, at, 0)
    table = [bytes([k]) + p.to_bytes(3, "big") + bytes([i]) for k, p, i in (rows.get(n, (0, 0, 0)) for n in range(22))]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True)) for r, above in zip(table, [bytes(5), *table], strict=False))
    return bytes(out) + b"21 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (flat(up, b"/Type /XRef /Size 22 /Root 1 0 R /W [1 3 1] /DecodeParms << /Predictor 12 /Columns 5 >>"), at)


WANT = [
    (1, "Site (one)\ngrid power!\ncafé\nin form\n", True, 1, 2, 1, 595.0, 842.0),
    (2, "Étb\na\n", True, 0, 0, 0, 842.0, 595.0),
    (3, "", False, 0, 0, 0, 595.0, 842.0),
]


def test_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(classic())
    (tmp_path / "sub" / "b.PDF").write_bytes(modern())
    (tmp_path / "c.pdf").write_bytes(classic(damage=True))
    (tmp_path / "d.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "e.pdf").write_bytes(classic(trailer=b"/Encrypt 5 0 R"))
    (tmp_path / "f.pdf").write_bytes(classic(OBJECTS | {10: b"<< /Length 3 /Filter /DCTDecode >>\nstream\nabc\nendstream"}))
    (tmp_path / "g.pdf").write_bytes(classic()[:300])
    (tmp_path / "h.pdf").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    got = {}
    for r in pdf.read_pdf(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    # Images of the page's own resources count: the picture is listed by all pages of this file.
    want = [(*w[:3], 1, *w[4:]) for w in WANT]
    for name in ("a.pdf", "b.PDF", "c.pdf"):
        rows = sorted(got[name], key=lambda r: r.page)
        assert [tuple(r)[1:9] for r in rows] == want and all(r.error is None for r in rows), name
    for name, part in (("d.pdf", "header"), ("e.pdf", "encrypted"), ("g.pdf", "")):
        (row,) = got[name]
        assert row.page is None and part in row.error
    # Spark lists no rows of empty files.
    assert "h.pdf" not in got
    assert [(r.page, bool(r.error)) for r in sorted(got["f.pdf"], key=lambda r: r.page)] == [(1, True), (2, False), (3, False)] and "note.txt" not in got
