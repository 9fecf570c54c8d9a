"""Pages of PDF files as rows: text, and counts of images, drawings and links.

Files are read by Spark's binary reader, so from any store Spark can open. A file is parsed by a small reader: cross-reference tables and
streams, objects in object streams, Flate data, page trees and the text operators of content streams, with ToUnicode maps or Windows
Latin text. Encrypted files, other filters and damaged files give one row with their error; a page that cannot be
read gives a row with its own. No text is recognised in images.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGES = "path string, page int, text string, has_text boolean, images int, drawings int, links int, width double, height double, error string"
_SPACE, _END = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R(?=[\s()<>\[\]{}/%]|$)")
_HEADING = re.compile(rb"\s*(\d+)\s+\d+\s+obj")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
PAINTS = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*"}
#: A word space in thousandths of the font size.
GAP = -200
MOST_NESTED = 12


class PdfError(ValueError):
    """What a file holds is no PDF that this reader understands."""


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    """A PDF name."""


class Operator(str):
    """A content stream's operator."""


@dataclass
class Stream:
    head: dict
    raw: bytes


class Scanner:
    """PDF objects of a byte string, one after another."""

    def __init__(self, raw: bytes, at: int = 0) -> None:
        self.raw, self.at = raw, at

    def blank(self) -> None:
        raw, at = self.raw, self.at
        while at < len(raw) and (raw[at] in _SPACE or raw[at] == 0x25):
            if raw[at] == 0x25:
                while at < len(raw) and raw[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        self.at = at

    def next(self, refs: bool = True) -> object:
        """The next object; ``EOFError`` behind the last, ``IndexError`` in one that is cut off."""
        self.blank()
        raw, at = self.raw, self.at
        if at >= len(raw):
            raise EOFError
        c = raw[at : at + 1]
        if c == b"/":
            end = self._word_end(at + 1)
            self.at = end
            return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), raw[at + 1 : end]).decode("latin-1"))
        if c == b"(":
            return self._text()
        if raw[at : at + 2] == b"<<":
            self.at += 2
            items = self._until(b">>", refs)
            return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}
        if c == b"<":
            end = raw.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9a-fA-F]", b"", raw[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]", refs)
        if c in b")>]}{":
            self.at += 1
            return self.next(refs)
        if refs and c.isdigit() and (m := _REF.match(raw, at)):
            self.at = m.end()
            return Ref(int(m[1]))
        end = self._word_end(at)
        self.at = max(end, at + 1)
        word = raw[at:end]
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _word_end(self, at: int) -> int:
        while at < len(self.raw) and self.raw[at] not in _END:
            at += 1
        return at

    def _until(self, close: bytes, refs: bool) -> list:
        out = []
        while True:
            self.blank()
            if self.raw.startswith(close, self.at):
                self.at += len(close)
                return out
            out.append(self.next(refs))

    def _text(self) -> bytes:
        raw, at, deep, out = self.raw, self.at + 1, 1, bytearray()
        while True:
            c = raw[at : at + 1]
            if not c:
                raise PdfError("a string has no end")
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(raw, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                c = raw[at + 1 : at + 2]
                out += b"" if c in b"\r\n" else _ESCAPES.get(c, c)
                at += 3 if raw[at + 1 : at + 3] == b"\r\n" else 2
                continue
            deep += (c == b"(") - (c == b")")
            at += 1
            if not deep:
                self.at = at
                return bytes(out)
            out += c


class File:
    """A PDF's objects by number, read when asked for."""

    def __init__(self, raw: bytes) -> None:
        if b"%PDF-" not in raw[:1024]:
            raise PdfError("no PDF header")
        self.raw, self.places, self.trailer, self.held = raw, {}, {}, {}
        try:
            at = int(re.search(rb"startxref\s+(\d+)", raw[raw.rindex(b"startxref") :])[1])
            while at is not None:
                at = self._table(at)
            # A table whose places hold other objects is damaged.
            assert all((m := _HEADING.match(raw, place)) and int(m[1]) == n for n, (place, holder) in self.places.items() if holder is None)
            assert isinstance(self.get(self.trailer["Root"]), dict)
        except (ValueError, KeyError, TypeError, IndexError, AssertionError, EOFError, zlib.error):
            self._search()
        if "Encrypt" in self.trailer:
            raise PdfError("the file is encrypted")

    def _search(self) -> None:
        """Objects found by their headings, where the cross-reference is damaged."""
        self.held, self.places = {}, {int(m[1]): (m.end(), None) for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.raw)}
        for m in re.finditer(rb"trailer\s*(?=<<)", self.raw):
            self.trailer |= Scanner(self.raw, m.end()).next()
        if "Root" not in self.trailer:
            root = next((n for n in self.places if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"), None)
            if root is None:
                raise PdfError("no catalogue of pages")
            self.trailer["Root"] = Ref(root)

    def _table(self, at: int) -> int | None:
        """Adds the entries of a cross-reference section that newer ones do not have; the place of the section before it."""
        if at in self.held:
            return None
        self.held[at] = None
        scan = Scanner(self.raw, at)
        head = scan.next()
        if head == "xref":
            while isinstance(first := scan.next(False), int):
                for n in range(first, first + scan.next(False)):
                    place, _, kind = scan.next(False), scan.next(False), scan.next(False)
                    if kind == "n":
                        self.places.setdefault(n, (place, None))
            own = scan.next()
            if isinstance(own.get("XRefStm"), int):
                self._table(own["XRefStm"])
        else:
            stream = self._object(at, None)
            own, data = stream.head, self.data(stream)
            widths = own["W"]
            ranges = own.get("Index") or [0, own["Size"]]
            spot = 0
            for first, count in zip(ranges[::2], ranges[1::2], strict=True):
                for n in range(first, first + count):
                    parts = []
                    for w in widths:
                        parts.append(int.from_bytes(data[spot : spot + w], "big"))
                        spot += w
                    kind = parts[0] if widths[0] else 1
                    if kind == 1:
                        self.places.setdefault(n, (parts[1], None))
                    elif kind == 2:
                        self.places.setdefault(n, (parts[2], parts[1]))
        self.trailer = own | self.trailer
        return own.get("Prev")

    def _object(self, at: int, number: int | None) -> object:
        scan = Scanner(self.raw, at)
        if m := _HEADING.match(self.raw, at):
            if number is not None and int(m[1]) != number:
                raise PdfError(f"object {number} is not in its place")
            scan.at = m.end()
        out = scan.next()
        scan.blank()
        if isinstance(out, dict) and self.raw.startswith(b"stream", scan.at):
            begin = scan.at + 6
            begin += 2 if self.raw.startswith(b"\r\n", begin) else 1
            size = self.get(out.get("Length"))
            if not isinstance(size, int) or self.raw[begin + size : begin + size + 20].lstrip()[:9] != b"endstream":
                size = self.raw.index(b"endstream", begin) - begin
            return Stream(out, self.raw[begin : begin + size])
        return out

    def get(self, value: object) -> object:
        """The object behind a reference; others as they are."""
        for _ in range(MOST_NESTED):
            if not isinstance(value, Ref):
                return value
            if value not in self.held:
                self.held[value] = None
                at, holder = self.places.get(value.number, (None, None))
                if at is not None:
                    self.held[value] = self._object(at, value.number) if holder is None else self._packed(holder, value.number)
            value = self.held[value]
        raise PdfError("references without an end")

    def _packed(self, holder: int, number: int) -> object:
        stream = self.get(Ref(holder))
        data = self.data(stream)
        heads = Scanner(data)
        for _ in range(self.get(stream.head["N"])):
            n, offset = heads.next(False), heads.next(False)
            if n == number:
                return Scanner(data, self.get(stream.head["First"]) + offset).next()
        return None

    def data(self, stream: Stream) -> bytes:
        """A stream's bytes behind its filters."""
        filters, parms = self.get(stream.head.get("Filter")), self.get(stream.head.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms]
        out = stream.raw
        for i, name in enumerate(filters):
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                out = zlib.decompressobj().decompress(out)
                p = self.get(parms[i]) if i < len(parms) else None
                if isinstance(p, dict) and p.get("Predictor", 1) >= 10:
                    out = _unpredicted(out, p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8, max(1, p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8))
            elif name in ("ASCIIHexDecode", "AHx"):
                out = Scanner(b"<" + out.rstrip(b">" + _SPACE) + b">").next()
            else:
                raise PdfError(f"filter {name}")
        return out

    def pages(self) -> Iterator[dict]:
        """The pages in order, with what they inherit."""
        root = self.get(self.trailer["Root"])
        todo, seen = [(root.get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            own = above | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "CropBox", "Rotate")}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield own | node


def _unpredicted(data: bytes, width: int, step: int) -> bytes:
    """Rows behind a PNG predictor."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda v: abs(guess - v))
            row[i] = (row[i] + (0, left, up, (left + up) // 2, nearest)[kind]) & 255
        out += row
        above = bytes(row.ljust(width, b"\0"))
    return bytes(out)


def _unicode_map(data: bytes) -> tuple[dict[int, str], int]:
    """Codes to text of a ToUnicode map, and the bytes of a code."""
    out, width, scan, stack = {}, 1, Scanner(data), []
    text = lambda b: b.decode("utf-16-be", "replace")
    while True:
        try:
            token = scan.next(False)
        except EOFError:
            return out, width
        if not isinstance(token, Operator):
            stack.append(token)
            continue
        if token == "endcodespacerange" and stack:
            width = max(len(b) for b in stack if isinstance(b, bytes))
        elif token == "endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(stack[::2], stack[1::2], strict=False)}
        elif token == "endbfrange":
            for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                low, high = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 0xFFFF)
                for n in range(low, high + 1):
                    if isinstance(to, list):
                        out |= {n: text(to[n - low])} if n - low < len(to) else {}
                    else:
                        out[n] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + n - low) & 0xFFFF).to_bytes(2, "big"))
        stack = []


class Page:
    """Text and counts of one page."""

    def __init__(self, file: File, page: dict) -> None:
        self.file, self.out, self.drawings, self.fonts, self.pictures = file, [], 0, {}, set()
        contents = file.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(file.data(s) for p in parts if isinstance(s := file.get(p), Stream))
        self._run(data, file.get(page.get("Resources")) or {}, 0)
        box = [float(file.get(v)) for v in file.get(page.get("CropBox") or page.get("MediaBox") or [0, 0, 612, 792])]
        size = abs(box[2] - box[0]), abs(box[3] - box[1])
        self.width, self.height = size[::-1] if (file.get(page.get("Rotate")) or 0) % 180 else size
        notes = [file.get(a) for a in file.get(page.get("Annots")) or []]
        self.links = sum(isinstance(a, dict) and a.get("Subtype") == "Link" for a in notes)
        self.text = "\n".join(line.rstrip() for line in "".join(self.out).split("\n")).strip("\n")
        self.text += "\n" if self.text else ""

    def _font(self, resources: dict, name: str) -> tuple[dict[int, str] | None, int]:
        font = self.file.get((self.file.get(resources.get("Font")) or {}).get(name)) or {}
        if isinstance(to := self.file.get(font.get("ToUnicode")), Stream):
            return _unicode_map(self.file.data(to))
        return None, 2 if font.get("Subtype") == "Type0" else 1

    def _show(self, raw: bytes, font: tuple[dict[int, str] | None, int]) -> None:
        table, width = font
        if table is None:
            # Codes of a composite font without a map are glyph numbers.
            self.out.append(raw.decode("cp1252", "replace") if width == 1 else "")
        else:
            self.out.append("".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)))

    def _break(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def _run(self, data: bytes, resources: dict, deep: int) -> None:
        objects = self.file.get(resources.get("XObject")) or {}
        self.pictures |= {v for v in objects.values() if isinstance(s := self.file.get(v), Stream) and s.head.get("Subtype") == "Image" and isinstance(v, Ref)}
        scan, stack, font, height = Scanner(data), [], (None, 1), None
        while True:
            try:
                token = scan.next(False)
            except EOFError:
                return
            if not isinstance(token, Operator):
                stack.append(token)
                continue
            if token in PAINTS:
                self.drawings += 1
            elif token == "Tf" and len(stack) >= 2:
                name = str(stack[-2])
                font = self.fonts[deep, name] if (deep, name) in self.fonts else self.fonts.setdefault((deep, name), self._font(resources, name))
            elif token in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                if token != "Tj":
                    self._break()
                self._show(stack[-1], font)
            elif token == "TJ" and stack and isinstance(stack[-1], list):
                for part in stack[-1]:
                    if isinstance(part, bytes):
                        self._show(part, font)
                    elif isinstance(part, int | float) and part < GAP and self.out and not self.out[-1].endswith((" ", "\n")):
                        self.out.append(" ")
            elif token in ("Td", "TD") and len(stack) >= 2 and stack[-1]:
                self._break()
            elif token == "Tm" and len(stack) >= 6:
                if height is not None and stack[-1] != height:
                    self._break()
                height = stack[-1]
            elif token in ("T*", "ET"):
                self._break()
            elif token == "BI":
                # An inline picture's bytes are skipped.
                end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, scan.at)
                scan.at = end.end() if end else len(data)
            elif token == "Do" and stack and deep < MOST_NESTED:
                form = self.file.get(objects.get(str(stack[-1])))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                    self._run(self.file.data(form), self.file.get(form.head.get("Resources")) or resources, deep + 1)
            stack = []


_FAILS = (ValueError, KeyError, TypeError, IndexError, AttributeError, EOFError, RecursionError, zlib.error)


def page_rows(path: str, raw: bytes) -> Iterator[tuple]:
    """A row of ``PAGES`` for each page, or one with the file's error."""
    nothing = (None,) * 7
    try:
        file = File(raw)
        pages = list(file.pages())
        if not pages:
            raise PdfError("no pages")
    except _FAILS as e:
        yield path, None, *nothing, f"{type(e).__name__}: {e}"
        return
    for n, page in enumerate(pages, 1):
        try:
            p = Page(file, page)
            yield path, n, p.text, bool(p.text.strip()), len(p.pictures), p.drawings, p.links, p.width, p.height, None
        except _FAILS as e:
            yield path, n, *nothing, f"{type(e).__name__}: {e}"


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """``PAGES`` of each PDF file under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in PAGES.split(", ")]

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, raw in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(page_rows(at, raw)), columns=names, dtype=object)

    return files.mapInPandas(pages, PAGES)
