"""GeoJSON collections of any size, one file read by many tasks.

Spark's text reader cuts a file into byte ranges and each range into fragments at closing braces. Whether a range begins inside a string,
and how deep, follows from all ranges before it: each range is summed up for both cases, a row a range, and the sums are composed in
order. With its beginning known a range gives the objects that lie in it whole; pieces of objects that reach over a border, two a
range at most, are put together by a group of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPE, _STRING, _PLAIN = re.compile(r"\\."), re.compile(r'"[^"]*"'), re.compile(r"[^\[\]{]")
#: Depth of an object in a list, or an object, of the top object.
INSIDE = 3
_SUMS = "path string, start long, ends_in_0 boolean, deeper_0 long, ends_in_1 boolean, deeper_1 long"
_PIECES = "path string, start long, kind long, text string"
WHOLE, TAIL, HEAD = 0, 1, 2


def _step(fragment: str, in_string: bool) -> tuple[bool, int, str]:
    """What a fragment and the brace behind it do: whether they end in a string, how much deeper, and the brackets outside strings."""
    text = _ESCAPE.sub("", fragment) if "\\" in fragment else fragment
    if in_string:
        head, quote, text = text.partition('"')
        if not quote:
            return True, 0, ""
    text = _STRING.sub("", text)
    text, quote, _ = text.partition('"')
    brackets = _PLAIN.sub("", text)
    deeper = brackets.count("{") + brackets.count("[") - brackets.count("]")
    return bool(quote), deeper - (not quote), brackets


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SUMS.split(", ")]
    sums: dict[tuple[str, int], list] = {}
    for key, fragment in _ranges(batches):
        own = sums.setdefault(key, [[False, 0], [True, 0]])
        for case in own:
            case[0], deeper, _ = _step(fragment, case[0])
            case[1] += deeper
    rows = [(*key, a[0], a[1], b[0], b[1]) for key, (a, b) in sums.items()]
    if rows:
        yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def _pieces(begins: dict[tuple[str, int], tuple[bool, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        key, in_string, depth, held, out = None, False, 0, [], []

        def end() -> None:
            # An object that has not ended goes on in the next range; what ran on from the range before and has no end yet does too.
            if held and key is not None:
                out.append((*key, HEAD if begun else TAIL, "".join(held)))

        begun = False
        for at, fragment in _ranges(batches):
            if at != key:
                end()
                key, (in_string, depth), held = at, begins[at], []
                begun = False
                inside = depth >= INSIDE
            before, (now_in, deeper, brackets) = depth, _step(fragment, in_string)
            if inside:
                held.append(fragment + "}")
            elif before < INSIDE and (spot := _opening(fragment, in_string, before)) is not None:
                held, inside, begun = [fragment[spot:] + "}"], True, True
            in_string, depth = now_in, before + deeper
            if inside and depth < INSIDE:
                out.append((*key, WHOLE if begun else TAIL, "".join(held)))
                held, inside, begun = [], False, False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})
                out = []
        end()
        if out:
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return run


def _opening(fragment: str, in_string: bool, depth: int) -> int | None:
    """Where an object at depth ``INSIDE`` opens in a fragment."""
    at = 0
    while at < len(fragment):
        c = fragment[at]
        if in_string:
            if c == "\\":
                at += 1
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = True
        elif c in "[{":
            depth += 1
            if c == "{" and depth == INSIDE:
                return at
        elif c == "]":
            depth -= 1
        at += 1
    return None


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: the objects that open at the third depth of each JSON file: those in lists of the top object, such as the
    features of a collection, and those in its objects."""
    cut = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    last, in_string, depth = None, False, 0
    # A row a range of the files.
    for r in cut.mapInArrow(_summed, _SUMS).orderBy("path", "start").collect():
        if r.path != last:
            last, in_string, depth = r.path, False, 0
        begins[r.path, r.start] = (in_string, depth)
        in_string, deeper = (r.ends_in_1, r.deeper_1) if in_string else (r.ends_in_0, r.deeper_0)
        depth += deeper
    pieces = cut.mapInArrow(_pieces(begins), _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("path", "text")
    # Heads open an object, tails go on with it, so the number of heads so far names the object. Two pieces a range at most.
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("object", F.sum((F.col("kind") == HEAD).cast("int")).over(Window.partitionBy("path").orderBy("start", "kind")))
    joined = parts.groupBy("path", "object").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.union(joined.select("path", "text"))
