"""Best-fit packing of documents into token sequences (operator 4).

One pass tokenizes whole texts and keeps only each piece's place, length and checksum. The packing
plan needs nothing but the histogram of piece lengths, at most ``capacity`` numbers whatever the
corpus size: pieces above a third of the capacity are matched greedily, the largest with the
largest partner that fits, at most two to a sequence; smaller ones go, largest first, to the
tightest gap left. Equal sequences are planned once with a multiplicity. The plan, a few thousand
rows, is joined back by each piece's rank among the pieces of its length.

Ranks come from counts of (length, salt) cells plus a row number inside a cell, so one length that
holds most pieces is still dealt over many tasks.

Defined results: a null text is empty and becomes one piece with the end token alone; repeated rows
are packed as often as they occur; a text longer than a sequence is cut into full pieces and a
first piece that may be shorter. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import row_keys, stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one cell of (length, salt), roughly; a length has as many salts as its pieces need.
CELL = 20_000

PIECES = "doc_id long, k1 long, k2 long, piece int, start long, length long, ids_crc32 long"


@cache
def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies back to bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def encoder(path: str):
    """The tokenizer of a byte-level BPE file: equal ids to the file's own library, several times faster.

    The ids of such a file ascend with the merge ranks, so its vocabulary doubles as a rank table.
    Added tokens found in a text keep their own id, as that library does by default.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    back = _byte_of_symbol()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity when cut."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``PIECES`` rows of every document. ``tokenizer`` is the path of a byte-level BPE file on each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out = []
            for doc, k1, k2, text in zip(batch["doc_id"], batch["k1"], batch["k2"], batch["text"], strict=True):
                ids = np.array([*(bpe.encode(text, allowed_special="all") if text else ()), end_id], "<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, k1, k2, p, start, length, zlib.crc32(ids[start : start + length])))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    k1, k2 = row_keys("doc_id", "text")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text").mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such) that use every piece of the histogram once.

    Fewest sequences for the large pieces (greedy matching is optimal for at most two to a bin),
    then best fit, largest first, for the small ones.
    """
    left = {n: c for n, c in counts.items() if c}
    third = capacity // 3
    bins: dict[tuple[int, ...], int] = {}
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                bins[(n,)] = bins.get((n,), 0) + left[n]
                left[n] = 0
                continue
            times = left[n] // 2 if mate == n else min(left[n], left[mate])
            left[n] -= times
            left[mate] -= times
            bins[(n, mate)] = bins.get((n, mate), 0) + times
    gaps: dict[int, dict[tuple[int, ...], int]] = {}
    for lengths, times in bins.items():
        gaps.setdefault(capacity - sum(lengths), {})[lengths] = times
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            gap = min((g for g, own in gaps.items() if g >= n and own), default=None)
            if gap is None:
                each = min(capacity // n, left[n])
                times = left[n] // each
                gaps.setdefault(capacity - each * n, {})
                key = (n,) * each
                own = gaps[capacity - each * n]
                own[key] = own.get(key, 0) + times
                left[n] -= times * each
                continue
            lengths, times = next(iter(gaps[gap].items()))
            fit = min(gap // n, left[n])
            used = min(times, left[n] // fit)
            if used == times:
                del gaps[gap][lengths]
            else:
                gaps[gap][lengths] = times - used
            own = gaps.setdefault(gap - fit * n, {})
            key = lengths + (n,) * fit
            own[key] = own.get(key, 0) + used
            left[n] -= fit * used
    return [(lengths, times) for own in gaps.values() for lengths, times in own.items()]


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``PIECES`` rows."""
    spark = cut_pieces.sparkSession
    # A number of the row deals equal rows apart; written, so that it stays the same in every use.
    cut_pieces = stored(cut_pieces.withColumn("deal", F.xxhash64("k1", "k2", "piece", F.monotonically_increasing_id())), "packing-pieces")
    cells = cut_pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in cells.collect()}
    salts = spark.createDataFrame([(n, -(-c // CELL)) for n, c in counts.items()], "length long, salts long")
    # Per length: ranges of ranks, each the pieces that one pattern takes at `each` a sequence.
    rows, base, taken = [], 0, dict.fromkeys(counts, 0)
    for lengths, times in plan(counts, capacity):
        at = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            rows.append((n, taken[n], taken[n] + each * times, base, each, at))
            taken[n] += each * times
            at += n * each
        base += times
    marks = sorted(rows)
    starts: dict[int, list[int]] = {}
    for r in marks:
        starts.setdefault(r[0], []).append(r[1])
    # At most a row for each length up to the capacity.
    salted = cut_pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("deal", "salts").cast("int")).drop("salts")
    sizes = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-cells")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("k1", "k2", "piece", "deal")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    held = spark.sparkContext.broadcast((marks, starts, [n for n in starts]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, starts, order = held.value
        first = dict(zip(order, np.cumsum([0, *(len(starts[n]) for n in order)])[:-1].tolist(), strict=True))
        table = np.array(marks, np.int64).reshape(-1, 6)
        # Ranges ascend by (length, first rank): one search finds a piece's range.
        for batch in batches:
            n, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            spot = np.empty(len(batch), np.int64)
            for length in np.unique(n):
                own = n == length
                spot[own] = first[int(length)] + np.searchsorted(starts[int(length)], rank[own], side="right") - 1
            _, begin, _, seq, each, at = table[spot].T
            k = rank - begin
            yield batch.assign(sequence_id=seq + k // each, offset=at + k % each * n)[
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            ].astype({"doc_id": "Int64"})

    return ranked.drop("salt", "before", "deal").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document of ``documents`` packed into sequences of at most ``capacity`` tokens."""
    return pack(pieces(documents, tokenizer, capacity), capacity)
