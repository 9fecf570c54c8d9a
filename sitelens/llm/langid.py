"""Language identification with bit-sliced Bloom filters (operator 1).

All languages' Bloom filters over byte n-grams share one array: row h holds a bitmask whose bit l
says whether language l has set position h, in as many 64-bit words as the languages need. One gather per hash, and-ed over the hashes, returns
every language that contains an n-gram. Per text and language the set bits are counted and the
false positives expected at that filter's fill are taken off; the corrected counts decide.

Learning uses a bounded sample: at most ``sample_docs`` whole texts a language, picked by a hash of
the id. Everything else covers all rows. Scoring is row by row, without a shuffle.

Defined results: ``und`` with score 0 for a null text or one without letters, and where no language
is learned or none has an n-gram; ties go to the first language in order; repeated rows get equal
results; rows with null text or lang teach nothing. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import held_out
from sitelens.llm.textkit import slices

UND = "und"
ORDERS = (3, 4)
HASHES = 2
LOG_ROWS = 18
SAMPLE_DOCS = 400
#: An n-gram enters a language's filter from this share of the language's n-grams on.
MIN_SHARE = 2e-5
#: Languages of one word of a mask.
WORD = 64

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _SPACE[_b] = 32


@dataclass
class LanguageFilters:
    """Bit-sliced filters: ``table[h]`` is the bitmask, word by word, of the languages with position h set."""

    languages: list[str]
    table: np.ndarray
    fill: np.ndarray
    log_rows: int = LOG_ROWS

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.log_rows)
        with np.errstate(over="ignore"):
            return [((grams * np.uint64(m)) >> shift).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:HASHES]]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and share of the corrected counts of each text."""
        names, share = [UND] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, share
        false = self.fill**HASHES
        for first, past, buf, bounds in slices(texts):
            seen, hits = np.zeros(past - first), np.zeros((past - first, len(self.languages)))
            for grams, starts in _grams(buf, bounds):
                rows = self.positions(grams)
                mask = self.table[rows[0]]
                for r in rows[1:]:
                    mask &= self.table[r]
                seen += np.diff(starts)
                for k in range(len(self.languages)):
                    total = np.zeros(len(mask) + 1, np.int64)
                    np.cumsum(_bit(mask, k), out=total[1:])
                    hits[:, k] += total[starts[1:]] - total[starts[:-1]]
            # Of n n-grams, h = true + (n - true) * false hit the filter.
            true = np.maximum(0, (hits - seen[:, None] * false) / (1 - false))
            whole = true.sum(axis=1)
            best = true.argmax(axis=1)
            for i in np.flatnonzero(whole > 0):
                text = texts[first + i]
                if text and _LETTER.search(text):
                    names[first + i], share[first + i] = self.languages[best[i]], true[i, best[i]] / whole[i]
            for i in np.flatnonzero(whole == 0):
                # Only false or no hits: the most raw hits decide, as long as there are letters.
                text = texts[first + i]
                if text and _LETTER.search(text):
                    names[first + i] = self.languages[int(hits[i].argmax())]
        return names, np.clip(share, 0, 1)


def _bit(mask: np.ndarray, k: int) -> np.ndarray:
    """Whether the bit of language ``k`` is set in each row of masks."""
    word, at = divmod(k, WORD)
    one = mask.dtype.type(1)
    return (mask[:, word] >> mask.dtype.type(at)) & one


def _grams(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-grams as integers, and each text's range; runs of non-letters count as one space."""
    plain = _SPACE[buf]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[bounds[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    plain = plain[keep].astype(np.uint64)
    ends = np.zeros(len(plain), np.int64)
    for n in ORDERS:
        packed = plain[: max(0, len(plain) - n + 1)].copy()
        for k in range(1, n):
            packed |= plain[k : len(plain) - n + 1 + k] << np.uint64(8 * k)
        packed |= np.uint64(n) << np.uint64(56)
        # Runs that span two texts start in the last n - 1 bytes of a text.
        inside = np.ones(len(packed), bool)
        for k in range(1, n):
            spots = at[1:] - k
            inside[spots[(spots >= 0) & (spots < len(packed))]] = False
        starts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(packed))]
        yield packed[inside], starts
    del ends


def learn(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, log_rows: int = LOG_ROWS) -> LanguageFilters:
    """Fits the filters on at most about ``sample_docs`` texts of each language that may teach."""
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    size = 1 << log_rows
    kind = next((t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= bits), np.uint64)
    filters = LanguageFilters(languages, np.zeros((size, max(1, -(-len(languages) // WORD))), kind), np.zeros(len(languages)), log_rows)
    if not languages:
        return filters
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(F.col("lang").isin(languages)).where(u < F.element_at(share, F.col("lang")))
    by_lang: dict[str, list[str]] = {k: [] for k in languages}
    for r in picked.select("lang", "text").limit(2 * sample_docs * len(languages)).toLocalIterator():
        by_lang[r.lang].append(r.text)
    for k, name in enumerate(languages):
        for grams in _all_grams(by_lang[name]):
            own, n = np.unique(grams, return_counts=True)
            own = own[n >= max(2, MIN_SHARE * len(grams))]
            for rows_at in filters.positions(own):
                filters.table[rows_at, k // WORD] |= kind(1 << k % WORD)
        filters.fill[k] = _bit(filters.table, k).mean()
    return filters


def _all_grams(texts: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in ORDERS]
    for _, _, buf, bounds in slices(texts):
        for k, (grams, _) in enumerate(_grams(buf, bounds)):
            parts[k].append(grams)
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def identify(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only the text decides."""
    held = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            names, share = model.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": names, "score": share})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
