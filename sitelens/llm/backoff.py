"""Stupid-backoff language-model scores (operator 8).

Texts are dealt into chunks. A chunk lists its distinct n-grams of each order, dealt by n-gram hash
into partitions: the exploded n-grams. Each partition sums the lists of all chunks into its n-gram
count table and joins the table back to the lists, so every chunk receives the corpus counts of its
n-grams. The chunk then adds up ``S`` over its documents' words:

    S(w | context) = c(context w) / c(context)   if c(context w) >= MIN_COUNT
                   = ALPHA * S(w | shorter context)   else; order 1: c(w) / N.

An n-gram crosses the wire once a chunk, however often it occurs there, so a frequent word pair
costs one entry a chunk. Counts cover all documents of the table.

Defined results: a null text or one without words has 0 words and a null score; equal texts get
equal scores; repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import shuffle_parts
from sitelens.llm.textkit import U, mix, slices, words

ORDER = 3
#: Bits of an n-gram's hash. Of n distinct n-grams a share of about n / 2**56 has another one's hash.
HASH_BITS = 56
ALPHA = 0.4
MIN_COUNT = 2
#: Text bytes of a chunk and n-grams of a hash partition; both bound a task's memory.
CHUNK_BYTES = 8 << 20
PART_GRAMS = 2_000_000

LISTS = "chunk int, part int, gram_order int, n int, hashes binary, counts binary"
ANSWERS = "chunk int, part int, gram_order int, counts binary"
SCORES = "doc_id long, n_words long, backed_off long, log_score double, score double"


def _grams(hashes: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, per word position the hash of the n-gram that ends there; 0 where none does."""
    since = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds)) if len(hashes) else np.zeros(0, np.int64)
    out, run = [], np.zeros(len(hashes), U)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            shifted = np.zeros(len(hashes), U)
            shifted[n - 1 :] = hashes[: len(hashes) - n + 1]
            run = run + shifted * mix(np.array([n], U))[0]
            own = (mix(run) >> U(64 - HASH_BITS)) | U(1)
            own[since < n - 1] = 0
            out.append(own)
    return out


def _positions(texts: list[str | None], order: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    for first, past, buf, bounds in slices(texts):
        hashes, at = words(buf, bounds)
        yield first, past, _grams(hashes, at, order), at


def _distinct(texts: list[str | None], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    for _, _, grams, _ in _positions(texts, order):
        for n in range(order):
            parts[n].append(grams[n][grams[n] != 0])
    return [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, U), np.zeros(0, np.int64)) for p in parts]


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition's run begins and ends in sorted hashes: partitions are hash ranges."""
    edges = np.array([(p << HASH_BITS) // parts for p in range(1, parts)], U)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, large ones escaped: 255 and then eight bytes, in a second run."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(raw, "<i8", int(big.sum()), n)
    return out


def _squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the byte planes of their differences, without the planes that are all zero."""
    delta = np.diff(hashes, prepend=U(0)).astype("<u8")
    first = delta[:1].tobytes()
    planes = delta[1:].view(np.uint8).reshape(-1, 8) if len(delta) > 1 else np.zeros((0, 8), np.uint8)
    width = 8 - int((planes.max(axis=0, initial=0)[::-1] != 0).argmax()) if planes.any() else 0
    return bytes((width,)) + first + planes[:, :width].T.tobytes()


def _spread(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U)
    width = raw[0]
    planes = np.zeros((n, 8), np.uint8)
    planes[0] = np.frombuffer(raw, np.uint8, 8, 1)
    if n > 1 and width:
        planes[1:, :width] = np.frombuffer(raw, np.uint8, (n - 1) * width, 9).reshape(width, n - 1).T
    with np.errstate(over="ignore"):
        return np.cumsum(planes.view("<u8").ravel(), dtype=U)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes and words of each batch."""
    for batch in batches:
        found = [(len(buf), int(at[-1])) for _, _, buf, bounds in slices(batch["text"].tolist()) for at in (words(buf, bounds)[1],)]
        yield pd.DataFrame(found, columns=["bytes", "words"])


def score(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``SCORES`` of every row: summed log of S over the words and its mean per word as ``score``."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = rows.select("text").mapInPandas(_measured, "bytes long, words long").agg(F.sum("bytes").alias("b"), F.sum("words").alias("w")).first()
    size, words_total = sums.b or 0, float(sums.w or 1)
    chunks = max(1, -(-size // CHUNK_BYTES))
    parts = max(shuffle_parts(spark), -(-size * order // (6 * PART_GRAMS)))
    # Copies of one text are dealt apart: the id takes part in the hash.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int"))

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, (hashes, counts) in enumerate(_distinct(pdf["text"].tolist(), order), 1):
            cuts = _cuts(hashes, parts)
            for p in range(parts):
                lo, hi = cuts[p], cuts[p + 1]
                if hi > lo:
                    out.append((int(pdf["chunk"].iloc[0]), p, n, hi - lo, _squeezed(hashes[lo:hi]), _small(counts[lo:hi])))
        return pd.DataFrame(out, columns=[x.split()[0] for x in LISTS.split(", ")])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """One hash partition: its count tables, joined back to the lists of the chunks."""
        out = []
        for n, own in pdf.groupby("gram_order"):
            grams = [_spread(r.hashes, r.n) for r in own.itertuples()]
            every = np.concatenate(grams)
            table, place = np.unique(every, return_inverse=True)
            counts = np.bincount(place, np.concatenate([_large(r.counts, r.n) for r in own.itertuples()])).astype(np.int64)
            at = 0
            for r, g in zip(own.itertuples(), grams, strict=True):
                out.append((r.chunk, r.part, n, _small(counts[place[at : at + len(g)]])))
                at += len(g)
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    listed = dealt.groupBy("chunk").applyInPandas(lists, LISTS)
    answers = listed.groupBy("part").applyInPandas(answer, ANSWERS)

    def scored(key, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        texts = docs["text"].tolist()
        known = []
        for n, (hashes, _) in enumerate(_distinct(texts, order), 1):
            own = got[got["gram_order"] == n].sort_values("part")
            cuts = _cuts(hashes, parts)
            lengths = {p: cuts[p + 1] - cuts[p] for p in range(parts)}
            runs = [_large(r.counts, int(lengths[r.part])) for r in own.itertuples()]
            known.append((hashes, np.concatenate(runs) if runs else np.zeros(0, np.int64)))
        n_words, backed, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for first, past, grams, at in _positions(texts, order):
            if not len(grams[0]):
                continue
            value, open_, steps = np.zeros(len(grams[0])), np.ones(len(grams[0]), bool), np.zeros(len(grams[0]), np.int64)
            counts = []
            for n in range(order):
                hashes, own = known[n]
                c = np.zeros(len(grams[n]), np.int64)
                real = grams[n] != 0
                c[real] = own[np.searchsorted(hashes, grams[n][real])]
                counts.append(c)
            for n in range(order - 1, 0, -1):
                real = open_ & (grams[n] != 0)
                hit = real & (counts[n] >= min_count)
                context = np.concatenate([[1], counts[n - 1][:-1]])
                value[hit] += np.log(counts[n][hit] / context[hit])
                miss = real & ~hit
                value[miss] += np.log(alpha)
                steps[miss] += 1
                open_ &= ~hit
            value[open_] += np.log(counts[0][open_] / words_total)
            # Each text is summed by itself, so equal texts get equal sums.
            for i in range(past - first):
                logs[first + i] = value[at[i] : at[i + 1]].sum()
                backed[first + i] = steps[at[i] : at[i + 1]].sum()
            n_words[first:past] = np.diff(at)
        mean = np.where(n_words > 0, logs / np.maximum(n_words, 1), np.nan)
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_words": n_words, "backed_off": backed, "log_score": np.where(n_words > 0, logs, np.nan), "score": mean})

    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scored, SCORES)
    return out.withColumns({c: F.when(F.col("n_words") > 0, F.col(c)) for c in ("log_score", "score")})
