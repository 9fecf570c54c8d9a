"""N-gram Jaccard self-join with Bayesian candidate pruning (operator 5).

Documents become sets of hashed five-word shingles. Equal sets collapse into one class first, so
copies never meet each other. Candidates come from MinHash bands (``BANDS`` bands of ``ROWS``
values: a pair at the threshold is missed with probability ``(1 - t**ROWS)**BANDS``, about 5e-7).
Classes that share bands form families; inside a family, pairs are judged in blocks: MinHash values
are compared ``STEP`` at a time, a pair is dropped as soon as the posterior probability of reaching
the threshold (uniform prior) falls below ``TOLERANCE``, and the rest are verified exactly on their
whole shingle sets. Pairs never become rows: a block task returns each class's link count and a
spanning forest of the links, and the forest's connected components are the near-duplicate groups.

Hot cases: a group of equal texts is one class; a large family of near copies is cut into blocks of
``BLOCK`` classes whose pairs of blocks are separate tasks' units.

Defined results: a text of one to four words has one shingle, all its words; null texts and texts
without words have no links and are groups of their own; rows equal in id and text are copies of
each other; ``class_id`` is the least id of the group (null only where all its ids are null). Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import connected_components, discard, row_keys, stored
from sitelens.llm.textkit import U, mix, ngrams, slices, words

WORDS = 5
THRESHOLD = 0.8
ROWS = 6
BANDS = 48
STEP = 32
TOLERANCE = 1e-7
#: Classes of a block; a task holds two blocks' shingle sets.
BLOCK = 256

_N = ROWS * BANDS
_A = (mix(np.arange(1, _N + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, _N + 1001, dtype=U)) >> U(32)).astype(np.uint32)
_FOLD = mix(np.arange(5001, ROWS + 5001, dtype=U))
_SALT = mix(np.arange(9001, BANDS + 9001, dtype=U))

SIGNED = "doc_id long, k1 long, k2 long, s1 long, s2 long, bands array<long>"


def shingle_sets(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, past, buf, bounds in slices(texts):
        hashes, at = words(buf, bounds)
        grams, g = ngrams(hashes, at, n)
        for i in range(past - first):
            own = np.sort(grams[g[i] : g[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The ``ROWS * BANDS`` MinHash values of a non-empty set."""
    x = (shingles >> U(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048]
        for p in range(0, _N, 48):
            np.minimum(out[p : p + 48], (_A[p : p + 48, None] * part[None, :] + _B[p : p + 48, None]).min(axis=1), out=out[p : p + 48])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((values.reshape(BANDS, ROWS).astype(U) * _FOLD).sum(axis=1) ^ _SALT).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n values that keep a pair.

    With a uniform prior, m matches of n leave Beta(m + 1, n - m + 1); its upper tail from the
    threshold on is a binomial sum.
    """
    out = []
    for n in range(STEP, _N + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


class Block:
    """Shingle sets of some classes with their MinHash values."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.values = np.array([minhash(s) for s in sets]) if sets else np.zeros((0, _N), np.uint32)


def links(a: Block, b: Block, same: bool, threshold: float = THRESHOLD) -> np.ndarray:
    """Index pairs ``(i, j)`` of classes of two blocks that reach the threshold (i < j within one)."""
    size_a, size_b = a.sizes[:, None], b.sizes[None, :]
    keep = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-9
    if same:
        keep &= np.arange(len(a.sets))[:, None] < np.arange(len(b.sets))[None, :]
    i, j = np.nonzero(keep)
    got = np.zeros(len(i), np.int64)
    for n, least in least_matches(threshold):
        if not len(i):
            break
        for p in range(n - STEP, n, 8):
            got += (a.values[i, p : p + 8] == b.values[j, p : p + 8]).sum(axis=1)
        alive = got >= least
        i, j, got = i[alive], j[alive], got[alive]
    if not len(i):
        return np.zeros((0, 2), np.int64)
    common = _overlaps(a, b, i, j)
    exact = common >= threshold * (a.sizes[i] + b.sizes[j] - common) - 1e-9
    return np.stack([i[exact], j[exact]], axis=1)


def _overlaps(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs of sets."""
    if len(i) < 400:
        return np.array([len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    # Many pairs: sparse incidence over the shingles, multiplied in column chunks.
    ia, ib = np.unique(i), np.unique(j)
    names = np.concatenate([*(a.sets[x] for x in ia), *(b.sets[y] for y in ib)])
    owner = np.repeat(np.arange(len(ia) + len(ib)), np.concatenate([a.sizes[ia], b.sizes[ib]]))
    distinct, column = np.unique(names, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(ia), len(ib)), np.float32)
    for c in range(0, len(distinct), 4096):
        lo, hi = np.searchsorted(column, (c, c + 4096))
        part = np.zeros((len(ia) + len(ib), min(4096, len(distinct) - c)), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        total += part[: len(ia)] @ part[len(ia) :].T
    return total[np.searchsorted(ia, i), np.searchsorted(ib, j)].astype(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """``SIGNED`` rows: the id, the row's keys, the set's digest and its band keys (none without shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ones, twos, bands = [], [], []
            for own in shingle_sets(batch["text"].tolist()):
                if not len(own):
                    ones.append(0), twos.append(0), bands.append(np.zeros(0, np.int64))
                    continue
                d = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                ones.append(d[0]), twos.append(d[1]), bands.append(band_keys(minhash(own)))
            out = batch[["doc_id", "k1", "k2"]].astype({"doc_id": "Int64"})
            yield out.assign(s1=ones, s2=twos, bands=bands)

    k1, k2 = row_keys("doc_id", "text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInPandas(run, SIGNED)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (family, block a, block b) to link counts and forest edges of each unit."""
    held: list[pd.DataFrame] = []
    key = None

    def unit(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates(["s1", "s2"])
        if len(rows) < 2:
            return None
        sets = list(shingle_sets(rows["text"].tolist()))
        a, b, mine = rows["block_a"].iloc[0], rows["block_b"].iloc[0], rows["block"].to_numpy()
        left = np.flatnonzero(mine == a)
        right = left if a == b else np.flatnonzero(mine == b)
        one = Block([sets[x] for x in left])
        two = one if a == b else Block([sets[x] for x in right])
        pairs = links(one, two, a == b)
        if not len(pairs):
            return None
        x, y = left[pairs[:, 0]], right[pairs[:, 1]]
        copies = rows["copies"].to_numpy()
        n = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        root = list(range(len(rows)))

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
        top = np.array([find(p) for p in range(len(rows))])
        ids = rows["node"].to_numpy()
        linked = np.flatnonzero(n > 0)
        return pd.DataFrame({"node": ids[linked], "head": ids[top[linked]], "n": n[linked].astype(np.int64)})

    for batch in batches:
        codes = batch[["family", "block_a", "block_b"]].to_numpy()
        cuts = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            part = batch.iloc[lo:hi]
            if not len(part):
                continue
            if key is not None and tuple(codes[lo]) != key:
                out = unit(pd.concat(held))
                if out is not None:
                    yield out
                held = []
            key = tuple(codes[lo])
            held.append(part)
    if held:
        out = unit(pd.concat(held))
        if out is not None:
            yield out


def groups(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, k1, k2 (row keys), class_id, n_links and whether it is kept.

    ``n_links`` counts the other rows whose shingle sets reach the threshold, copies included.
    ``keep`` marks one (id, text) of each group: that of the least id, ties by the row keys.
    """
    spark = documents.sparkSession
    signed = stored(signatures(documents), "jaccard-signed")
    has = F.size("bands") > 0
    node = F.concat_ws(":", F.hex("s1"), F.hex("s2"))
    classes = stored(
        signed.where(has)
        .groupBy("s1", "s2")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first"),
            F.first("bands").alias("bands"),
        )
        .select(node.alias("node"), "s1", "s2", "copies", "first", "bands"),
        "jaccard-classes",
    )
    banded = classes.select("s1", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("s1").alias("least"), F.max("s1").alias("most")).where("least <> most").select("band", "least"), "jaccard-buckets")
    stars = banded.join(buckets, "band").where("s1 <> least").select(F.col("s1").alias("a"), F.col("least").alias("b"))
    family = stored(connected_components(stars, "jaccard-families").select(F.col("node").alias("s1"), F.col("component").alias("family")), "jaccard-family")
    sizes = stored(family.groupBy("family").agg(F.count("*").alias("m")), "jaccard-sizes")
    chosen = (
        classes.select("node", "s1", "s2", "copies", "first.k1", "first.k2")
        .join(family, "s1")
        .join(sizes, "family")
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("s1", "s2", F.lit(3)), F.col("blocks")).cast("int"))
    )
    k1, k2 = row_keys("doc_id", "text")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(k1.alias("k1"), k2.alias("k2"), "text")
    units = (
        texts.join(stored(chosen, "jaccard-chosen"), ["k1", "k2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "s1", "s2", "copies", "family", "block", "text", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"))
        .repartition("family", "block_a", "block_b")
        .sortWithinPartitions("family", "block_a", "block_b")
    )
    judged = stored(units.mapInPandas(_judge, "node string, head string, n long"), "jaccard-judged")
    linked = judged.groupBy("node").agg(F.sum("n").alias("n"))
    heads = stored(connected_components(judged.select(F.col("node").alias("a"), F.col("head").alias("b")), "jaccard-groups"), "jaccard-heads")
    named = classes.select("node", "s1", "s2", "copies", "first").join(heads, "node", "left").withColumn("group", F.coalesce("component", "node"))
    chief = stored(named.where("component is not null").groupBy("group").agg(F.min("first").alias("chief")), "jaccard-chief")
    final = stored(
        named.join(chief, "group", "left")
        .join(linked, "node", "left")
        .select("s1", "s2", F.coalesce("chief", "first").alias("chief"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"),
        "jaccard-final",
    )
    for t in (buckets, family, sizes, judged, heads, chief):
        discard(t)
    return _named_rows(signed, final)


def _named_rows(signed: DataFrame, final: DataFrame) -> DataFrame:
    """Class facts back on the rows. Only sets with copies can repeat, so hot sets join by salted keys."""
    salts = 32
    many = F.col("copies") > 1000
    right = final.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    hot = final.where(many).select("s1", "s2").withColumn("hot", F.lit(True))
    # Rows without shingles are no copies of each other; their own keys keep them apart in the joins.
    has = F.size("bands") > 0
    left = signed.select("doc_id", "k1", "k2", F.when(has, F.col("s1")).otherwise(F.col("k2")).alias("s1"), F.when(has, F.col("s2")).otherwise(F.col("k1")).alias("s2"))
    # At most rows / 1000 sets have over 1,000 copies; Spark broadcasts them only where they are small.
    left = left.join(hot, ["s1", "s2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k1", "k2"), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))
    joined = left.join(right, ["s1", "s2", "salt"], "left")
    keep = F.coalesce((F.col("chief.k1") == F.col("k1")) & (F.col("chief.k2") == F.col("k2")), F.lit(True))
    return joined.select(
        "doc_id",
        "k1",
        "k2",
        F.when(F.col("chief").isNull(), F.col("doc_id")).otherwise(F.col("chief.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        keep.alias("keep"),
    )
