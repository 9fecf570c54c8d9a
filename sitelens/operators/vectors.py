"""Vector operators: deterministic token embeddings, cosine scores, request batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitelens.functions import constants as K
from sitelens.functions.text import tokens

#: Queries and vectors of one block; a task holds a block of each and scores ``_CHUNK`` queries at a time.
QUERY_BLOCK, VECTOR_BLOCK, _CHUNK = 2048, 16384, 128


def mock_embedding(records: DataFrame, id_col: str, text_col: str, dims: int = K.MOCK_DIMENSION) -> DataFrame:
    """``id, dim, value``: signed token counts by hash, scaled to unit length (long form)."""
    token = records.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("token"))
    counted = token.groupBy("id", "token").agg(F.count("*").alias("n")).withColumn("h", F.sha2("token", 256))
    dim = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    cells = counted.groupBy("id", dim.alias("dim")).agg(F.sum(F.col("n") * sign).cast("double").alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return cells.withColumn("norm", norm).select("id", "dim", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(0.0).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, score``: dot product over the query's norm for every record (negatives included).

    ``queries(qid, q)`` is the request; it is broadcast and each record is read once.
    """
    scale = queries.withColumn("norm", F.sqrt(dot(F.col("q"), F.col("q"))))
    both = vectors.join(F.broadcast(scale))
    return both.select("qid", "id", F.round(F.when(F.col("norm") > 0, dot(F.col("vector"), F.col("q")) / F.col("norm")).otherwise(0.0), 6).alias("score"))


def _leading(row: np.ndarray, k: int) -> np.ndarray:
    """Places in ``row`` of all scores that may be among the first ``k`` once they are exact and rounded to 6 places; NaN is the largest."""
    if len(row) <= k:
        return np.arange(len(row))
    edge = np.partition(row, len(row) - k)[len(row) - k]
    if np.isnan(edge):
        return np.flatnonzero(np.isnan(row))
    most = np.abs(row[np.isfinite(row)]).max(initial=0.0)
    return np.flatnonzero(~(row < edge - 1.1e-6 - 1e-10 * most))


def _first(held: np.ndarray, q: np.ndarray, row: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the leading vectors, added up in the order of their components; of equal scores the first ``k``."""
    at = _leading(row, k)
    exact = np.cumsum(held[at] * q, axis=1)[:, -1] / norm
    order = np.argsort(-exact, kind="stable")
    at, exact = at[order], exact[order]
    new = np.ones(len(at), bool)
    new[1:] = (exact[1:] != exact[:-1]) & ~(np.isnan(exact[1:]) & np.isnan(exact[:-1]))
    place = np.arange(len(at))
    few = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return at[few], exact[few]


def _dense(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors without nulls by their dimension: their rows and a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = column.flatten()
    # The flat values leave null lists out.
    start = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    holes = np.append(0, np.cumsum(np.asarray(flat.is_null())))
    whole = (lengths > 0) & (holes[start + np.maximum(lengths, 0)] == holes[start])
    rows = {int(n): np.flatnonzero(whole & (lengths == n)) for n in np.unique(lengths[whole])}
    return {n: (at, values[start[at][:, None] + np.arange(n)]) for n, at in rows.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, id, score`` of :func:`cosine` for a few records of each query, among them the first ``k`` by score, then id.

    Blocks of queries meet blocks of vectors, each pair in one group, and leave what may be among the first; so nothing but
    those is sorted, and neither side is held whole by a task.
    """
    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    held = vectors.select("id", "vector", block(n_v, "id", "vector").alias("vb"), every(n_q).alias("qb"))
    asked = queries.select("qid", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("norm"), block(n_q, "qid", "q").alias("qb"), every(n_v).alias("vb"))
    schema = queries.select("qid").schema.add(vectors.schema["id"]).add("raw", DoubleType())

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")], null_placement="at_start"))
        dense, n = _dense(held["vector"]), len(held)
        q_at, v_at, raws = [], [], []

        def leave(q: int, at: np.ndarray, raw: np.ndarray) -> None:
            q_at.append(np.full(len(at), q))
            v_at.append(at)
            raws.append(pa.array(raw, pa.float64()))

        norms = np.asarray(asked["norm"].combine_chunks().fill_null(0.0))
        scored = np.isnan(norms) | (norms > 0)
        for q in np.flatnonzero(~scored):
            leave(q, np.arange(min(k, n)), np.zeros(min(k, n)))
        for size, (rows, matrix) in _dense(asked["q"]).items():
            at, own = dense.get(size, (np.empty(0, int), np.empty((0, size))))
            others = np.setdiff1d(np.arange(n), at)[:k] if len(at) < k else at[:0]
            use = np.flatnonzero(scored[rows])
            for c in range(0, len(use), _CHUNK):
                part = use[c : c + _CHUNK]
                with np.errstate(all="ignore"):
                    scores = matrix[part] @ own.T / norms[rows[part]][:, None]
                    for i, row in zip(part, scores, strict=True):
                        places, raw = _first(own, matrix[i], row, norms[rows[i]], k)
                        leave(rows[i], at[places], raw)
                        leave(rows[i], others, pa.nulls(len(others), pa.float64()))
        q_at, v_at = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (q_at, v_at))
        return pa.table({"qid": asked["qid"].take(pa.array(q_at)), "id": held["id"].take(pa.array(v_at)), "raw": pa.chunked_array(raws, pa.float64())})

    pairs = asked.groupBy("qb", "vb").cogroup(held.groupBy("qb", "vb")).applyInArrow(met, schema)
    return pairs.select("qid", "id", F.round("raw", 6).alias("score"))


def embedding_batches(records: DataFrame, id_col: str, size: Column, part: Column, max_items: int = K.MAX_BATCH_ITEMS, max_size: int = K.MAX_BATCH_TOKENS) -> DataFrame:
    """``id, part, batch, size``: the requests to an embedding service, in order of ids inside each part.

    A record opens a new batch when the open one holds ``max_items`` records or its size would pass ``max_size``;
    a record that is larger by itself is refused with an error. Which batch a record falls into depends on all before
    it in its part, so one pass over the sorted part carries the open batch from one Arrow batch to the next.
    """
    own = records.select(F.col(id_col).alias("id"), part.alias("part"), size.cast("long").alias("size"))
    schema = own.select("id", "part", F.lit(0).cast("long").alias("batch"), "size").schema

    def cut(frames):
        now, batch, items, total = None, 0, 0, 0
        for frame in frames:
            numbers = []
            for at, record, n in zip(frame["part"], frame["id"], frame["size"], strict=True):
                if n > max_size:
                    raise ValueError(f"record {record} has size {n}, above the limit of a batch, {max_size}")
                if at != now:
                    now, batch, items, total = at, 0, 0, 0
                elif items >= max_items or total + n > max_size:
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + n
                numbers.append(batch)
            frame["batch"] = numbers
            yield frame[["id", "part", "batch", "size"]]

    return own.repartition("part").sortWithinPartitions("part", "id").mapInPandas(cut, schema)
