"""Queries ``opN_<name>`` over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import backoff, balltree, gif, hilbert, jaccard, langid, linededup, mixing, packing, phrases, sql, toxicity, trie, warc


def tokenizer_path() -> str:
    """The tokenizer file named by ``SITELENS_TOKENIZER``, else the installed public one."""
    import os

    import public_tokenizers

    return os.environ.get("SITELENS_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.quantised(_table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_columns(_table(spark, sf_dir, "documents"))


def op7_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"))


def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score(_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("log_score", "score")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", "text")


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations")).drop("rank", "subtree_end")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_language_id,
    op2_warc_revisits,
    op3_exact_top_k,
    op4_best_fit_packing,
    op5_ngram_jaccard,
    op6_gif_media,
    op7_raked_mix,
    op8_backoff_scores,
    op9_toxicity,
    op10_fuzzy_lines,
    op11_hilbert_shards,
    op12_prefix_trie,
    op13_phrase_collocations,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
