"""Which texts hold which of many given phrases: an equi-join on anchors instead of a test of all pairs.

A phrase's anchor is a window of 2, 4, 8 ... 64 bytes from its middle, the longest that fits (1 byte for the shortest phrases). A text that holds the phrase has the
anchor among its own windows. Texts list only windows that pass a filter of bits of bounded size built from all anchors; those meet
the phrases by their hash, and the exact test decides. Any number of phrases takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sitelens.staging import staged

#: An anchor has 2**level bytes at most.
LEVELS = 6
#: Bits of the filter for each anchor, and its size at most (16 MB); a full filter lets more windows through and loses none.
BITS_EACH, FILTER_BITS = 32, 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _windows(raw: bytes, most: int) -> Iterator[np.ndarray]:
    """Per level the hash of the window of 2**level bytes that begins at each place; each level joins two windows of the one before."""
    own = _mixed(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1))
    for level in range(most + 1):
        yield own
        half = 1 << level
        if len(own) <= half:
            return
        with np.errstate(over="ignore"):
            own = _mixed(own[:-half] * _ODD + own[half:] + np.uint64(level + 1))


@F.pandas_udf(StructType([StructField("level", IntegerType()), StructField("hash", LongType())]))
def _anchor_of(phrases: pd.Series) -> pd.DataFrame:
    out = []
    for phrase in phrases:
        raw = phrase.encode()
        level = min(LEVELS, len(raw).bit_length() - 1)
        own = list(_windows(raw, level))[level]
        out.append((level, int(own[len(own) // 2].astype(np.int64))))
    return pd.DataFrame(out, columns=["level", "hash"])


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Bytes of a bit filter of a long column, gathered as bitmaps of bounded size."""
    bits = min(FILTER_BITS, 1 << max(15, (BITS_EACH * hashes.count()).bit_length()))
    # From 1 on: values of a bucket lie at places from 0 on.
    place = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    maps = hashes.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        begin = (row.bucket - 1) * 4096
        own = np.frombuffer(bytes(row.bits), np.uint8)[: len(out) - begin]
        out[begin : begin + len(own)] = own
    return out


def contained(texts: DataFrame, phrases: DataFrame, text_id: str = "record_id", text: str = "text", phrase_id: str = "flag_id", phrase: str = "original_claim") -> DataFrame:
    """``phrase_id, text_id`` of every phrase that occurs in a text, whole or inside words; null and empty phrases occur nowhere."""
    anchors = phrases.where(F.col(phrase) != "").select(phrase_id, phrase, _anchor_of(phrase).alias("_a")).select(phrase_id, phrase, "_a.*")
    anchors = staged(anchors, "containment-anchors")
    filtered = texts.sparkSession.sparkContext.broadcast(bit_filter(anchors, "hash"))
    levels = {r.level for r in anchors.select("level").distinct().collect()}  # seven at most

    def hits(values: pd.Series) -> pd.Series:
        bits = filtered.value
        mask = np.uint64(len(bits) * 8 - 1)

        def found(value: str | None) -> list[int]:
            if not value or not levels:
                return []
            out = []
            for level, own in enumerate(_windows(value.encode(), max(levels))):
                if level in levels:
                    at = own & mask
                    out.append(np.unique(own[bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]))
            return np.concatenate(out).view(np.int64).tolist() if out else []

        return values.map(found)

    listed = texts.select(text_id, text, F.pandas_udf(hits, ArrayType(LongType()))(text).alias("_hits")).where(F.size("_hits") > 0)
    met = listed.select(text_id, text, F.explode("_hits").alias("hash")).join(anchors, "hash")
    return met.where(F.contains(F.col(text), F.col(phrase))).select(phrase_id, text_id).distinct()
