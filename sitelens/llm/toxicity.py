"""Toxicity by a factorization machine over hashed terms (operator 9).

Terms are the words of a text and their first four bytes, hashed to 2**20 buckets. A bounded sample
of labelled documents teaches: every bucket in at least ``MIN_ROWS`` of its documents is a feature, whether
or not it is tied to the label by itself, since two terms may matter only together. The machine ``w0 + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).(x^2))`` over their presence learns the
linear weights and, through the factors, which pairs matter together. Scoring is row by row in
Arrow batches over whole texts, without a shuffle.

Defined results: null and empty texts score the bias alone; no labelled rows gives score 0;
repeated rows score alike; labels that are null, or of held-out or unknown documents, teach nothing;
of several labels of one document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitelens.llm.common import held_out
from sitelens.llm.textkit import slices, span_hashes, word_spans

LOG_BUCKETS = 20
PREFIX_BYTES = 4
#: A bucket of fewer sampled documents is no feature.
MIN_ROWS = 3
FACTORS = 8
#: At most about this many documents of each label teach.
SAMPLE_PER_LABEL = 4000
BATCH = 256
#: Passes over the sample, and mini-batches at least: first of the weights alone, so the factors learn what those
#: leave unexplained and not the noise of many terms, then of both.
LINEAR_EPOCHS, LINEAR_STEPS = 20, 200
EPOCHS, STEPS = 20, 200
RATE = 0.1
L2 = 1e-4
L2_FACTORS = 1e-2
#: A weight moves at ``G / (G + TIED)`` of the rate, and at this share at least.
TIED = 6.0
SLOWEST = 0.02
#: AdaGrad's sums of squares begin here, so a bucket of few documents moves by little at first.
START = 1e-3
SEED = 7


def term_buckets(texts: list[str | None], log_buckets: int = LOG_BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, past, buckets, bounds)`` of runs of texts: two hashed terms for each word."""
    shift = np.uint64(64 - log_buckets)
    for first, past, buf, bounds in slices(texts):
        starts, ends = word_spans(buf)
        whole, prefix = span_hashes(buf, (starts, ends), (starts, np.minimum(ends, starts + PREFIX_BYTES)))
        both = np.empty(2 * len(whole), np.int64)
        both[0::2] = whole >> shift
        both[1::2] = ((prefix ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD1342543DE82EF95)) >> shift
        yield first, past, both, 2 * np.searchsorted(starts, bounds)


@dataclass
class FactorizationMachine:
    """Bias, weights and factors over selected buckets; ``slot[b]`` is a bucket's feature or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The machine's output for ``n`` rows given their distinct features."""
        out = np.full(n, self.bias) + np.bincount(owner, self.weights[features], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[features, f]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for first, past, buckets, bounds in term_buckets(texts):
            slots = self.slot[buckets]
            at = np.flatnonzero(slots >= 0)
            owner = np.searchsorted(bounds, at, side="right") - 1
            own = np.unique(owner * len(self.weights) + slots[at])
            out[first:past] = self.margin(own % len(self.weights), own // len(self.weights), past - first)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _totals(at: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
    """Sums of each of ``values`` by ``at``, a row each."""
    return np.stack([np.bincount(at, x, n) for x in values])


def train(rows: list[np.ndarray], labels: np.ndarray, log_buckets: int = LOG_BUCKETS) -> FactorizationMachine:
    """Fits the machine to the distinct buckets of each row by AdaGrad over mini-batches."""
    size, n = 1 << log_buckets, len(rows)
    slot = np.full(size, -1, np.int32)
    everywhere, pos = np.zeros(size), np.zeros(size)
    for r, y in zip(rows, labels, strict=True):
        everywhere[r] += 1
        pos[r] += y
    n1 = labels.sum()
    if not n or n1 in (0, n):
        bias = -500.0 if not n or not n1 else 500.0
        return FactorizationMachine(slot, bias, np.zeros(1), np.zeros((1, FACTORS)))
    chosen = np.flatnonzero(everywhere >= MIN_ROWS)
    # G, how far a bucket's rate of label 1 departs from the whole sample's, sets how fast its weight moves;
    # factors move whatever it is.
    pos, neg, seen, base = pos[chosen], (everywhere - pos)[chosen], everywhere[chosen], n1 / n
    g = pos * np.log(np.maximum(pos, 1) / (seen * base)) + neg * np.log(np.maximum(neg, 1) / (seen * (1 - base)))
    slot[chosen] = np.arange(len(chosen))
    own = [s[s >= 0].astype(np.intp) for s in (slot[r] for r in rows)]
    rng = np.random.default_rng(SEED)
    m = max(1, len(chosen))
    pace = np.zeros(m)
    pace[: len(chosen)] = RATE * np.maximum(SLOWEST, g / (g + TIED))
    w, v, b = np.zeros(m), rng.normal(0, 0.01, (FACTORS, m)), np.log(n1 / (n - n1))
    gw, gv, gb = np.full(m, START), np.full((FACTORS, m), START), START
    steps = -(-n // BATCH)
    linear, both = (max(e, -(-least // steps)) for e, least in ((LINEAR_EPOCHS, LINEAR_STEPS), (EPOCHS, STEPS)))
    for epoch in range(linear + both):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            batch = order[start : start + BATCH]
            feats = np.concatenate([own[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(own[i]) for i in batch])
            margin = b + np.bincount(owner, w[feats], len(batch))
            if epoch >= linear:
                sums = _totals(owner, [f[feats] for f in v], len(batch))
                margin += 0.5 * ((sums**2).sum(axis=0) - np.bincount(owner, (v**2).sum(axis=0)[feats], len(batch)))
            off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels[batch]) / len(batch)
            pull = np.bincount(feats, off[owner], m)
            if epoch >= linear:
                dv = _totals(feats, [x[owner] for x in off * sums], m) + (L2_FACTORS - pull) * v
                gv += dv**2
                v -= 0.5 * RATE * dv / np.sqrt(gv)
            dw, db = pull + L2 * w, off.sum()
            gw += dw**2
            gb += db**2
            w -= pace * dw / np.sqrt(gw)
            b -= RATE * db / np.sqrt(gb)
    return FactorizationMachine(slot, float(b), w, np.ascontiguousarray(v.T))


def learn(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> FactorizationMachine:
    """Fits on at most about ``per_label`` documents of each label, picked by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.zeros(0))
    share = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, per_label / n)))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(u < F.element_at(share, F.col("toxic"))).limit(3 * per_label)
    texts = documents.select(F.col("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for first, past, buckets, bounds in term_buckets(batch["text"].tolist()):
                found += [np.unique(buckets[bounds[i] : bounds[i + 1]]).astype(np.int32).tobytes() for i in range(past - first)]
            yield pd.DataFrame({"sample": 0, "toxic": batch["toxic"], "terms": found})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """The whole sample, which ``per_label`` bounds, in one task: the driver holds only the machine."""
        order = sorted(range(len(rows)), key=lambda i: (rows["toxic"][i], len(rows["terms"][i]), rows["terms"][i]))
        m = train([np.frombuffer(rows["terms"][i], np.int32) for i in order], np.array([rows["toxic"][i] for i in order], float))
        return pd.DataFrame([(m.slot.tobytes(), float(m.bias), m.weights.tobytes(), m.factors.tobytes())], columns=["slot", "bias", "weights", "factors"])

    rows = texts.select("toxic", "text").mapInPandas(features, "sample int, toxic int, terms binary")
    got = rows.groupBy("sample").applyInPandas(fit, "slot binary, bias double, weights binary, factors binary").first()
    if got is None:
        return train([], np.zeros(0))
    weights = np.frombuffer(got.weights)
    return FactorizationMachine(np.frombuffer(got.slot, np.int32), got.bias, weights, np.frombuffer(got.factors).reshape(len(weights), -1))


def score_column(model: FactorizationMachine, text: Column | str, df: DataFrame) -> Column:
    """A column with each text's score; the model travels as a broadcast of fixed size."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(held.value.score(batch.tolist()))

    return score(text)


def score_documents(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; only the text decides."""
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score_column(model, "text", documents).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
