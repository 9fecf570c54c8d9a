"""Exact top-k inner products by ball-tree branch and bound (operator 3).

Candidate vectors are dealt into shards of at most about ``SHARD_ROWS`` rows (a 64th of the rows, if
that is fewer); each shard is one task's unit and gets its own ball tree. Query vectors form blocks of bounded size that meet every shard
(the stated query set against all rows, in blocks). A first pass searches one shard per query block and
its kth scores are shared with all other shards as the scores to beat; a task that searches several shards
carries on the best scores of the blocks it met last. Inside a shard the queries of a block walk the tree from the root,
each to the child of the higher inner-product upper bound ``q.c + |q| r`` first, and leave a node whose bound is
below their current kth score, with all that is under it.

Defined results: components are whole numbers held in doubles, so every finite value takes part; scores beyond a
long's range count, and rank, as its ends; vectors that are null or hold a null or a non-finite component take no part;
vectors of other lengths count as padded with zeros; ties go to the smaller id; rows with a null id
take no part; repeated ids are separate candidates unless they are the query's own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import discard, stored

SCALE = 256
SHARD_ROWS = 65536
LEAST_SHARD_ROWS = 2048
BLOCK_ROWS = 1024
LEAF_ROWS = 64
#: Products of integers up to this size sum exactly in doubles (53 bits) in a matrix product.
_EXACT = 2.0**53

#: Stands for no score yet; its negative is a long as well. Scores lie inside ``_MOST`` of zero.
_NONE = -(2**63 - 1)
_MOST = 2**63 - 2
#: Query blocks whose scores a task carries from shard to shard.
CARRIED = 64

BLOCK = "block long, ids binary, dims int, data binary"
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v array<double>)`` with ``v = floor(scale * x)``, whole numbers, of the vectors that take part."""
    x = F.col(vector_col)
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    # From 2**53 on every double is whole; the built-in floor gives longs, which hold fewer values.
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < 2.0**53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _packed(rows: DataFrame, total: int, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of the id into blocks of about ``size`` rows, each block one binary row; the number of blocks."""
    blocks = max(1, -(-total // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        dims = max((len(v) for v in pdf["v"]), default=0)
        data = np.zeros((len(pdf), dims))
        for i, v in enumerate(pdf["v"]):
            data[i, : len(v)] = v
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "dims": [dims], "data": [data.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return stored(dealt.groupBy("block").applyInPandas(pack, BLOCK), name), blocks


class BallTree:
    """Nodes of a ball tree over whole-numbered vectors: centres, radii, children and the rows of leaves."""

    def __init__(self, data: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.data = data
        self.largest = float(np.abs(data).max(initial=0))
        # Scaled down, so squares of the largest doubles stay finite; bounds are scaled up again.
        self.unit = max(1.0, self.largest / 2.0**400)
        points = data / self.unit
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        centres, radii = [], []
        todo = [(np.arange(len(data)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            node = len(centres)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            centre = points[own].mean(axis=0)
            far = ((points[own] - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(float(np.sqrt(far.max(initial=0))))
            if len(own) <= leaf_rows or not far.any():
                self.children.append(None)
                self.rows.append(own)
                continue
            self.children.append((-1, -1))
            self.rows.append(None)
            a = points[own[far.argmax()]]
            b = points[own[((points[own] - a) ** 2).sum(axis=1).argmax()]]
            along = points[own] @ (b - a)
            half = np.argpartition(along, len(own) // 2)
            todo += [(own[half[: len(own) // 2]], node, 0), (own[half[len(own) // 2 :]], node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with the vectors of each node."""
        scale = max(1.0, float(np.abs(queries).max(initial=0)) / 2.0**400)
        q = queries / scale
        top = q @ self.centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radii[None, :]
        size = np.sqrt((q**2).sum(axis=1))[:, None] * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)[None, :]
        # Rounding moves a sum of products by no more than a small part of the product of the norms.
        with np.errstate(over="ignore"):
            return (top + 1e-9 * size) * scale * self.unit + 1e-6

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, cut to the range of a long."""
        own = self.data[rows]
        if float(np.abs(queries).max(initial=0)) * self.largest * max(1, own.shape[1]) < _EXACT:
            return (queries @ own.T).astype(np.int64)
        # Rare: whole numbers of any size.
        a, b = ([[int(x) for x in r] for r in m] for m in (queries, own))
        return np.array([[max(-_MOST, min(_MOST, sum(x * y for x, y in zip(r, c, strict=True)))) for c in b] for r in a], np.int64).reshape(len(a), len(b))


def _search(tree: BallTree, ids: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` (scores, ids) of each query in a shard that reach ``floor``; empty places hold id -1."""
    best, who = np.full((len(queries), k), _NONE, np.int64), np.full((len(queries), k), -1, np.int64)
    top = tree.bounds(queries)

    def score(rows: np.ndarray, own: np.ndarray) -> None:
        scores = tree.products(queries[own], rows)
        names = np.broadcast_to(ids[rows], scores.shape)
        scores = np.where((names == q_ids[own][:, None]) | (scores < floor[own][:, None]), _NONE, scores)
        s = np.concatenate([best[own], scores], axis=1)
        n = np.concatenate([who[own], np.where(scores == _NONE, -1, names)], axis=1)
        pick = np.lexsort((n, -s), axis=1)[:, :k]
        best[own], who[own] = np.take_along_axis(s, pick, 1), np.take_along_axis(n, pick, 1)

    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, own = todo.pop()
        # Bounds beyond a long's range compare as doubles with scores inside it, which is enough.
        own = own[top[own, node] >= np.maximum(best[own, -1], floor[own]).astype(float)]
        if not len(own):
            continue
        if tree.children[node] is None:
            score(tree.rows[node], own)
            continue
        left, right = tree.children[node]
        first = top[own, left] >= top[own, right]
        # The last pushed is the first visited: each query meets its better child before the other.
        todo += [(left, own[~first]), (right, own[~first]), (right, own[first]), (left, own[first])]
    return best, who


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.data).reshape(len(ids), row.dims)


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query: query_id, rank, vec_id, score.

    Both inputs are ``(vec_id, v array<double>)`` as ``quantised`` returns them. A query is never its
    own candidate. Fewer than ``k`` candidates give fewer rows.
    """
    total = vectors.count()
    size = shard_rows or min(SHARD_ROWS, max(LEAST_SHARD_ROWS, -(-total // 64)))
    shards, n = _packed(vectors, total, size, "shards")
    blocks, n_blocks = _packed(queries, queries.count(), block_rows, "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree_of, tree = None, None
        carried: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples():
                if tree_of != row.block:
                    tree_of, (ids, data) = row.block, _matrix(row)
                    tree = BallTree(data)
                q_ids = np.frombuffer(row.q_ids, np.int64)
                qs = np.frombuffer(row.q_data).reshape(len(q_ids), row.q_dims)
                if qs.shape[1] != tree.data.shape[1]:
                    qs, wide = _aligned(qs, data)
                    tree = BallTree(wide) if wide.shape[1] != tree.data.shape[1] else tree
                floor = np.maximum(np.frombuffer(row.floor, np.int64), carried.pop(row.q_block, _NONE))
                score, who = _search(tree, ids, q_ids, qs, k, floor)
                # The kth of one shard is a score to beat in the next; the block met longest ago is forgotten.
                carried[row.q_block] = np.maximum(floor, score[:, -1])
                if len(carried) > CARRIED:
                    del carried[next(iter(carried))]
                got = score > _NONE
                yield pd.DataFrame({"query_id": np.repeat(q_ids, got.sum(axis=1)), "vec_id": who[got], "score": score[got]})

    q = blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    home = F.pmod(F.col("q_block"), F.lit(n))
    named = shards.withColumn("pos", F.col("block"))
    q_len = (F.octet_length("q_ids") / 8).cast("int")
    lowest = F.unhex(F.repeat(F.lit(_NONE.to_bytes(8, "little", signed=True).hex()), q_len))
    parts = n
    first = stored(
        q.withColumn("pos", home).withColumn("floor", lowest).join(named.hint("shuffle_hash"), "pos").mapInPandas(search, HITS),
        "topk-first",
    )
    ranked = first.select("query_id", "vec_id", "score", F.row_number().over(_by_query()).alias("rank"))
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    floors = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))

    def shared(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each query block with the kth scores of its queries, as far as they are known."""
        if not len(left):
            return left.assign(floor=[])[["q_block", "q_ids", "q_dims", "q_data", "floor"]]
        known = dict(zip(right["query_id"], right["kth"], strict=True))
        ids = np.frombuffer(left["q_ids"].iloc[0], np.int64)
        floor = np.array([known.get(x, _NONE) for x in ids], np.int64)
        return left.assign(floor=[floor.tobytes()])[["q_block", "q_ids", "q_dims", "q_data", "floor"]]

    with_floor = q.groupBy("q_block").cogroup(floors.groupBy("block")).applyInPandas(shared, "q_block long, q_ids binary, q_dims int, q_data binary, floor binary")
    others = (
        with_floor.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .where(F.col("pos") != home)
        .repartition(parts, "pos")
        .join(named.repartition(parts, "pos"), "pos")
        .sortWithinPartitions("block", "q_block")
    )
    both = first.union(others.mapInPandas(search, HITS)) if n > 1 else first
    out = both.withColumn("rank", F.row_number().over(_by_query())).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
