"""Lexical index and BM25 over many queries at once.

Postings, lengths and corpus statistics are tables, so an index can be written once and searched
many times. Statistics cover the whole index, never only the eligible records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import constants as K
from sitelens.functions.text import plain_tokens, tokens
from sitelens.sources import versions

#: Pairs of a query and a chunk that one task of an overlap search counts.
PAIRS = 1_000_000


@dataclass
class LexicalIndex:
    """``postings(token, id, tf)``, ``lengths(id, dl)`` and one row ``stats(n, avgdl)``."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def term_frequencies(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, token, tf``; partial counts combine before the shuffle."""
    return records.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def document_lengths(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return records.select(F.col(id_col).alias("id"), F.size(tokens(text_col)).cast("long").alias("dl"))


def build_index(records: DataFrame, id_col: str, text_col: str) -> LexicalIndex:
    lengths = document_lengths(records, id_col, text_col)
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    return LexicalIndex(term_frequencies(records, id_col, text_col), lengths, stats)


def write_index(index: LexicalIndex, path: str, parts: int, vectors: DataFrame | None = None, digest: str = "") -> int:
    """Commits the index, postings dealt by token, and the records' vectors where there are any, as one version of ``path``.

    Searches read the version before until then. ``digest`` names the content it was made from.
    """
    tables = {"postings": index.postings.repartition(parts, "token").sortWithinPartitions("token"), "lengths": index.lengths, "stats": index.stats.coalesce(1)}
    n_vectors = vectors.count() if vectors is not None else 0
    if vectors is not None:
        tables["vectors"] = vectors
    return versions.commit(index.postings.sparkSession, path, tables, properties={"digest": digest, "vectors": str(n_vectors)})


def read_index(spark, path: str, version: int | None = None) -> LexicalIndex:
    """The index of the newest version, or of a given one."""
    version = versions.versions(spark, path)[-1] if version is None and versions.versions(spark, path) else version
    return LexicalIndex(*(versions.read(spark, path, name, version) for name in ("postings", "lengths", "stats")))


def index_state(spark, path: str, digest: str, records: int, with_vectors: bool) -> str:
    """``MISSING``, ``STALE`` (made from other content), ``INCOMPLETE`` (not a vector for each record where vectors are asked for) or ``READY``."""
    try:
        held = versions.state(spark, path)
    except versions.NoVersion:
        return "MISSING"
    if held["properties"].get("digest") != digest:
        return "STALE"
    return "INCOMPLETE" if with_vectors and int(held["properties"].get("vectors", 0)) != records else "READY"


def query_tokens(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """``qid, token``: the distinct tokens of each query."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(query_col))).alias("token"))


def document_frequencies(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``token, df, idf``."""
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(stats.select("n"))).select("token", "df", idf.alias("idf"))


def bm25(index: LexicalIndex, queries: DataFrame, k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """``qid, id, score`` (rounded to 6 places) of every record that shares a token with a query.

    The query side is the request, a handful of tokens, so it filters the postings as a broadcast before anything
    shuffles; frequencies are then counted from the matching postings alone.
    """
    asked = query_tokens(queries)
    wanted = index.postings.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    idf = document_frequencies(wanted, index.stats)
    scored = wanted.join(idf.select("token", "idf"), "token").join(index.lengths, "id").join(F.broadcast(index.stats.select("avgdl")))
    part = F.col("idf") * (F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))))
    return (
        scored.select("id", "token", part.alias("part"))
        .join(F.broadcast(asked), "token")
        .groupBy("qid", "id")
        .agg(F.round(F.sum("part"), 6).alias("score"))
    )


def ranked(scores: DataFrame, limit: int | None = None, by: str = "qid", score: str = "score", id_col: str = "id") -> DataFrame:
    """Adds ``rank`` from 1 in order of score, then id; keeps the first ``limit``."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id_col)))
    return out.where(F.col("rank") <= limit) if limit else out


def candidate_limit(top_k: int) -> int:
    return max(K.CANDIDATE_MULTIPLIER * top_k, K.MIN_CANDIDATES)


def overlap_search(chunks: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``qid, id, overlap, rank``: count of distinct shared plain tokens, zero left out.

    Nearly every chunk shares a word with nearly every query, so chunks are dealt to as many tasks as keep the pairs of one
    under ``PAIRS``, by the tokens that are asked for; pairs are counted and cut to the first ones there.
    """
    asked = queries.select("qid", F.explode(plain_tokens("query")).alias("token"))
    held = chunks.select(F.col(id_col).alias("id"), F.explode(plain_tokens(text_col)).alias("token"))
    held = held.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() * queries.count() // PAIRS))
    shared = held.repartition(parts, "id").join(F.broadcast(asked), "token").groupBy("qid", "id").agg(F.count("*").alias("overlap"))
    return ranked(shared, max(1, top_k), score="overlap")
