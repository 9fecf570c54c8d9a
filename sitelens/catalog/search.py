"""Search queries: tokens, BM25, vectors, fusion, groups, gaps and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog.base import RECORDS_SQL, policy_records, table
from sitelens.functions import constants as K
from sitelens.functions import rules
from sitelens.functions.text import citation, parsed_pages, tokens
from sitelens.operators import lexical, retrieval, vectors

_PROJECT = {"project_type": "data centre", "planned_power_mw": "50", "requested_mic_mva": "60", "country": "Ireland", "address": "the road and the town", "local_authority": "Fingal"}
QUERIES_TEXT = tuple((f"q{i + 1}", domain, template.format(**_PROJECT)) for i, (domain, template) in enumerate(K.QUERY_TEMPLATES))
#: A query in the words of the corpus.
PLAIN_QUERY = "the planning of and in is was for with under by que der les los"
LIMITS = {"authoritative": 5, "historical": 3, "curated": 3, "supporting": 3}
#: Vectors that are asked, against all.
_V = "vec_id % 100 = 0"


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_TEXT, "qid string, domain string, query string")


def _plain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q", PLAIN_QUERY)], "qid string, query string")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    return lexical.build_index(_docs(spark, d), "doc_id", "text")


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_ASKED = "select qid, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+(?:[.-][a-z0-9]+)*'))) as token from queries"
_QVALUES = "(values " + ", ".join(f"('{q}', '{d}', '{t}')" for q, d, t in QUERIES_TEXT) + ") as v(qid, domain, query)"
_BM25 = (
    f"tk as (select doc_id as id, unnest({_TOKENS}) as token from documents), tf as (select id, token, count(*) as tf from tk group by all), "
    f"dl as (select doc_id as id, len({_TOKENS}) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from dl), "
    "df as (select token, count(*) as df from tf group by token), "
    f"asked as ({_ASKED}), "
    "bm as (select qid, tf.id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) as score "
    "from asked join tf using (token) join df using (token) join dl on dl.id = tf.id cross join st group by qid, tf.id), "
    "lex as (select *, row_number() over (partition by qid order by score desc, id) as rank from bm)"
)
_TEMPLATE_SQL = f"with queries as (select * from {_QVALUES}), {_BM25}"
_PLAIN_SQL = f"with queries as (select 'q' as qid, '{PLAIN_QUERY}' as query), {_BM25}"


def token_counts(spark, d):
    own = tokens("text")
    return _docs(spark, d).select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"))


def term_frequencies(spark, d):
    return lexical.term_frequencies(_docs(spark, d), "doc_id", "text")


def document_frequency_idf(spark, d):
    index = _index(spark, d)
    return lexical.document_frequencies(index.postings, index.stats).withColumn("idf", F.round("idf", 6))


def corpus_stats(spark, d):
    return _index(spark, d).stats.withColumn("avgdl", F.round("avgdl", 6))


def bm25_topk(spark, d):
    return lexical.ranked(lexical.bm25(_index(spark, d), _plain(spark)), lexical.candidate_limit(10)).select("id", "score", "rank")


def bm25_batch(spark, d):
    return lexical.ranked(lexical.bm25(_index(spark, d), _queries(spark)), lexical.candidate_limit(10))


def exact_text_dedupe(spark, d):
    r = policy_records(_docs(spark, d))
    return retrieval.exact_text_dedupe(r, "id", F.col("text"), F.col("source_class"), F.col("document_status"))


def _request(historical=False, supporting=False, jurisdiction=None, authority=None, domains=(), governance=False) -> dict:
    text = lambda v: F.lit(v).cast("string")
    return {
        "governance": F.lit(governance),
        "include_historical": F.lit(historical),
        "include_supporting": F.lit(supporting),
        "jurisdiction": text(jurisdiction),
        "local_authority": text(authority),
        "workflow": text(None),
        "domains": F.array(*[F.lit(x) for x in domains]).cast("array<string>"),
        "legal_status": F.array().cast("array<string>"),
        "review_required": F.lit(None).cast("boolean"),
    }


def _record() -> dict:
    return {
        "eligible": F.col("eligible"),
        "source_class": F.col("source_class"),
        "status": F.col("document_status"),
        "review": F.col("review"),
        "legal_status": F.col("legal_status"),
        "jurisdiction": F.col("jurisdiction"),
        "detail": F.col("jurisdiction_detail"),
        "workflows": F.array().cast("array<string>"),
        "domains": F.col("domains"),
    }


_MODES = (("strict", False, False), ("historical", True, False), ("supporting", False, True))


def eligibility_filter(spark, d):
    r = policy_records(_docs(spark, d))
    cols = [rules.eligible(_record(), _request(h, s, "IRELAND", "Fingal", ("PLANNING", "GRID", "WATER"))).alias(m) for m, h, s in _MODES]
    return r.select("id", *cols)


def _kind_sql(historical: bool, supporting: bool) -> str:
    return (
        "case when source_class in ('RESTRICTED', 'ARCHIVE', 'GOVERNANCE') then false "
        "when source_class = 'PRIMARY' and document_status = 'CURRENT' then not review "
        f"when source_class = 'PRIMARY' then {str(historical).lower()} and document_status in ('PROPOSED', 'HISTORICAL', 'SUPERSEDED') "
        f"when source_class in ('CURATED', 'SUPPORTING_PUBLIC_BODY') then true when source_class in ('SUPPORTING_INDUSTRY', 'SUPPORTING_RESEARCH') then {str(supporting).lower()} else false end"
    )


_SCOPE_SQL = (
    "jurisdiction in ('IRELAND', 'LOCAL_AUTHORITY', 'EU') and (jurisdiction <> 'LOCAL_AUTHORITY' or lower(jurisdiction_detail) = 'fingal') "
    "and (len(domains) = 0 or list_has_any(domains, ['PLANNING', 'GRID', 'WATER']))"
)
_ELIGIBLE_SQL = f"with r as ({RECORDS_SQL}) select id, " + ", ".join(f"eligible and {_kind_sql(h, s)} and {_SCOPE_SQL} as {m}" for m, h, s in _MODES) + " from r"

_PLACES = ("grid policy in Blanchardstown", "water at Greystones", "policy in Cork", "swords and bray")


def jurisdiction_scope(spark, d):
    i = F.col("id")
    r = policy_records(_docs(spark, d)).withColumn("query", F.element_at(F.array(*[F.lit(x) for x in _PLACES]), (i % 4 + 1).cast("int")))
    asked = F.when(i % 6 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("IRELAND", "EU", "LOCAL_AUTHORITY")]), (i % 3 + 1).cast("int")))
    return r.select(
        "id",
        rules.local_authority_of(F.col("query"), F.lit(None).cast("string")).alias("local_authority"),
        rules.jurisdiction_allowed(F.col("jurisdiction"), asked).alias("allowed"),
    )


_JURISDICTION_SQL = (
    f"with r as ({RECORDS_SQL}), q as (select *, ['grid policy in blanchardstown', 'water at greystones', 'policy in cork', 'swords and bray'][id % 4 + 1] as query, "
    "case when id % 6 = 0 then null else ['IRELAND', 'EU', 'LOCAL_AUTHORITY'][id % 3 + 1] end as asked from r) "
    "select id, case when regexp_matches(query, '\\b(fingal|blanchardstown|swords|dublin 15)\\b') then 'Fingal' when regexp_matches(query, '\\b(wicklow|arklow|bray|greystones)\\b') then 'Wicklow' end as local_authority, "
    "case when asked is null then true when asked = 'IRELAND' then jurisdiction in ('IRELAND', 'LOCAL_AUTHORITY', 'EU') else jurisdiction = asked end as allowed from q"
)


def authority_order(spark, d):
    r = policy_records(_docs(spark, d))
    return r.select("id", rules.class_rank("source_class").alias("class_rank"), rules.status_rank("document_status").alias("status_rank"))


_CLASS_RANK_SQL = "case source_class " + " ".join(f"when '{k}' then {v}" for k, v in K.CLASS_RANK.items()) + " else 9 end"
_STATUS_RANK_SQL = "case document_status " + " ".join(f"when '{k}' then {v}" for k, v in K.STATUS_RANK.items()) + " else 9 end"


def token_overlap_search(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return lexical.overlap_search(_docs(spark, d), b, 10, "doc_id")


_FOLD_TOKENS = "list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'))"


def citation_format(spark, d):
    i = F.col("doc_id")
    pin = F.when(i % 4 == 0, F.concat(F.lit("pp. "), i.cast("string"), F.lit("–"), (i + 2).cast("string"))).when(i % 4 == 1, F.concat(F.lit("p. "), i.cast("string"))).when(i % 4 == 2, "Annex A")
    start, end = parsed_pages(pin)
    heading = F.when(i % 8 == 3, "Scope")
    base = _docs(spark, d).select("doc_id", start.alias("page_start"), end.alias("page_end"), heading.alias("h"), pin.alias("pin"), F.when(i % 5 > 0, F.col("source")).alias("issuer"))
    made = citation(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("issuer"), F.col("page_start"), F.col("page_end"), F.col("h"), F.col("pin"))
    return base.select("doc_id", "page_start", "page_end", made.alias("citation"))


_CITATION_SQL = (
    "with b as (select doc_id, case when doc_id % 4 = 0 then 'pp. ' || doc_id || '–' || (doc_id + 2) when doc_id % 4 = 1 then 'p. ' || doc_id when doc_id % 4 = 2 then 'Annex A' end as pin, "
    "case when doc_id % 8 = 3 then 'Scope' end as h, case when doc_id % 5 > 0 then source || ' — ' else '' end || 'Document ' || doc_id as prefix from documents), "
    "p as (select *, case when doc_id % 4 < 2 then doc_id::int end as page_start, case when doc_id % 4 = 0 then (doc_id + 2)::int when doc_id % 4 = 1 then doc_id::int end as page_end from b) "
    "select doc_id, page_start, page_end, case when page_start is not null and page_start = page_end then prefix || ', p. ' || page_start "
    "when page_start is not null then prefix || ', pp. ' || page_start || '–' || page_end when h is not null then prefix || ', section ' || h when pin is not null then prefix || ', ' || pin else prefix end as citation from p"
)


def mock_embedding(spark, d):
    return vectors.mock_embedding(_docs(spark, d), "doc_id", "text").withColumn("value", F.round("value", 6))


_MOCK_SQL = (
    f"with t as (select doc_id as id, unnest({_TOKENS}) as token from documents), c as (select id, token, count(*) as n, sha256(token) as h from t group by id, token), "
    "g as (select id, (('0x' || substr(h, 1, 8))::bigint % 64)::int as dim, sum(n * case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then 1 else -1 end)::double as raw from c group by all), "
    "w as (select *, sqrt(sum(raw * raw) over (partition by id)) as norm from g) select id, dim, round(case when norm > 0 then raw / norm else 0 end, 6) as value from w"
)


def _vector_query(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), v.where(_V).select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("q"))


def cosine_topk(spark, d):
    held, asked = _vector_query(spark, d)
    return lexical.ranked(vectors.nearest(held, asked, 10), 10)


_COSINE = (
    f"q as (select vec_id::varchar as qid, embedding::double[] as q from embeddings where {_V}), "
    "cs as (select qid, vec_id as id, round(list_dot_product(embedding::double[], q) / sqrt(list_dot_product(q, q)), 6) as score from embeddings cross join q), "
    "sem as (select *, row_number() over (partition by qid order by score desc, id) as rank from cs)"
)


def _semantic(spark, d) -> DataFrame:
    """Vectors as the semantic side of the searches: record i owns vector i."""
    return lexical.ranked(vectors.nearest(*_vector_query(spark, d), 50), 50)


def _lexical(spark, d) -> DataFrame:
    """The plain query's words as the lexical side of every search."""
    asked = table(spark, d, "embeddings").where(_V).select(F.col("vec_id").cast("string").alias("qid"))
    return asked.join(lexical.ranked(lexical.bm25(_index(spark, d), _plain(spark)), 50).drop("qid"))


def _fused(spark, d) -> DataFrame:
    return retrieval.fuse(_lexical(spark, d), _semantic(spark, d))


def rrf_fusion(spark, d):
    return _fused(spark, d)


_FUSED = (
    f"q as (select vec_id::varchar as qid, embedding::double[] as q from embeddings where {_V}), "
    "cs as (select qid, vec_id as id, round(list_dot_product(embedding::double[], q) / sqrt(list_dot_product(q, q)), 6) as score from embeddings cross join q), "
    "sem as (select *, row_number() over (partition by qid order by score desc, id) as rank from cs), "
    "l50 as (select q.qid, id, rank as lexical_rank from q, lex where rank <= 50), s50 as (select qid, id, rank as semantic_rank from sem where rank <= 50), "
    "fu as (select coalesce(l50.qid, s50.qid) as qid, coalesce(l50.id, s50.id) as id, lexical_rank, semantic_rank, round(coalesce(1.0::double / (60 + lexical_rank), 0) + coalesce(1.0::double / (60 + semantic_rank), 0), 9) as fusion "
    "from l50 full join s50 on l50.qid = s50.qid and l50.id = s50.id)"
)


def _grouped(spark, d) -> DataFrame:
    r = policy_records(_docs(spark, d)).select("id", "document_id", "source_class", "document_status")
    return retrieval.grouped_hits(_fused(spark, d).join(r, "id"), LIMITS)


def hybrid_search(spark, d):
    """Flagship: BM25 and vector ranks fused, grouped by authority and limited."""
    return _grouped(spark, d).select("qid", "id", "document_id", "authority_group", "group_rank", "rank", "fusion")


_GROUP_SQL = "case when source_class = 'PRIMARY' and document_status = 'CURRENT' then 'authoritative' when source_class = 'PRIMARY' then 'historical' when source_class = 'CURATED' then 'curated' else 'supporting' end"
_GROUPED = (
    f"{_PLAIN_SQL}, {_FUSED}, r as ({RECORDS_SQL}), h as (select fu.*, document_id, {_GROUP_SQL} as authority_group from fu join r using (id)), "
    "g as (select *, row_number() over (partition by qid, authority_group order by fusion desc, id) as group_rank from h), "
    "k as (select * from g where group_rank <= case authority_group when 'authoritative' then 5 else 3 end), "
    "o as (select *, row_number() over (partition by qid order by case authority_group when 'authoritative' then 0 when 'historical' then 1 when 'curated' then 2 else 3 end, group_rank) as rank from k)"
)


def comparison_candidates(spark, d):
    return retrieval.comparison_candidates(_grouped(spark, d)).select("qid", "comparison_type", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("document_ids"))


_COMPARISON_SQL = (
    f"{_GROUPED}, t as (select qid, document_id, authority_group, min(group_rank) as pos from o where authority_group in ('authoritative', 'historical') and group_rank <= 3 group by all), "
    "n as (select qid, string_agg(document_id::varchar, ',' order by pos) as ids, count(*) as c from t where authority_group = 'authoritative' group by qid), "
    "m as (select qid, string_agg(document_id::varchar, ',' order by pos) as ids, count(*) as c from t where authority_group = 'historical' group by qid) "
    "select qid, 'CROSS_SOURCE_COMPARISON_CANDIDATE' as comparison_type, ids as document_ids from n where c > 1 union all "
    "select qid, 'POLICY_VERSION_DIFFERENCE', n.ids || ',' || m.ids from n join m using (qid) where n.c > 0 and m.c > 0"
)

_REQUESTS = (("r1", "PLANNING", "Fingal"), ("r2", "WATER", "Wicklow"), ("r3", "RESPONSIBLE_AI", "Wicklow"), ("r4", "GRID", "Fingal County Council"), ("r5", "ENERGY", None))


def gap_detection(spark, d):
    asked = spark.createDataFrame(_REQUESTS, "qid string, domain string, local_authority string")
    r = policy_records(_docs(spark, d))
    hits = r.where((F.col("source_class") == "PRIMARY") & (F.col("document_status") == "CURRENT")).select(F.explode("domains").alias("domain")).distinct()
    found = asked.join(hits, "domain").select("qid", F.lit("authoritative").alias("authority_group"))
    return retrieval.local_source_gaps(r, asked).unionByName(retrieval.authoritative_gaps(asked, found))


_GAPS_SQL = (
    f"with r as ({RECORDS_SQL}), a as (select * from (values "
    + ", ".join(f"('{q}', '{d}', {'null' if x is None else repr(x)})" for q, d, x in _REQUESTS)
    + ") v(qid, domain, local_authority)), p as (select *, unnest(domains) as dom from r where source_class = 'PRIMARY' and document_status = 'CURRENT') "
    "select qid, domain, local_authority, 'NO_AUTHORITATIVE_LOCAL_SOURCE' as gap_type from a where local_authority is not null and not exists "
    "(select 1 from p where p.jurisdiction = 'LOCAL_AUTHORITY' and lower(p.jurisdiction_detail) = lower(a.local_authority) and p.dom = a.domain) "
    "union all select qid, domain, local_authority, 'NO_AUTHORITATIVE_SOURCE' from a where not exists (select 1 from p where p.dom = a.domain)"
)


def retrieval_eval(spark, d):
    ranked = lexical.ranked(lexical.bm25(_index(spark, d), _queries(spark)), 10)
    docs = _docs(spark, d).select("doc_id")
    gold = docs.select(F.concat(F.lit("q"), (F.col("doc_id") % 7 + 1).cast("string")).alias("qid"), F.col("doc_id").alias("id"), (F.col("doc_id") % 3 > 0).alias("required"))
    return retrieval.evaluate(ranked, gold)


_EVAL_SQL = (
    f"{_TEMPLATE_SQL}, gold as (select 'q' || (doc_id % 7 + 1) as qid, doc_id as id, doc_id % 3 > 0 as required from documents), "
    "h as (select g.qid, required, l.rank from gold g left join (select * from lex where rank <= 10) l on l.qid = g.qid and l.id = g.id) "
    "select qid, round(case when count(*) filter (required) > 0 then (count(*) filter (required and rank <= 5))::double / count(*) filter (required) else 0 end, 6) as recall_5, "
    "round(case when count(*) filter (required) > 0 then (count(*) filter (required and rank <= 10))::double / count(*) filter (required) else 0 end, 6) as recall_10, "
    "round(coalesce(1.0::double / min(rank), 0), 6) as rr from h group by qid"
)


def embedding_batches(spark, d):
    out = vectors.embedding_batches(_docs(spark, d), "doc_id", F.size(tokens("text")), F.col("doc_id") % 4, 32, 40000)
    return out.groupBy("part", "batch").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.min("id").alias("first_id"))


_BATCH_SQL = (
    f"with recursive s as (select doc_id as id, doc_id % 4 as part, len({_TOKENS})::bigint as size, row_number() over (partition by doc_id % 4 order by doc_id) as n from documents), "
    "b as (select part, n, id, size, 0::bigint as batch, 1 as held, size as total from s where n = 1 union all "
    "select s.part, s.n, s.id, s.size, case when b.held >= 32 or b.total + s.size > 40000 then b.batch + 1 else b.batch end, "
    "case when b.held >= 32 or b.total + s.size > 40000 then 1 else b.held + 1 end, case when b.held >= 32 or b.total + s.size > 40000 then s.size else b.total + s.size end "
    "from b join s on s.part = b.part and s.n = b.n + 1) "
    "select part, batch, count(*) as items, sum(size)::bigint as size, min(id) as first_id from b group by part, batch"
)

QUERIES = {
    "q01_token_counts": token_counts,
    "q02_term_frequencies": term_frequencies,
    "q03_document_frequency_idf": document_frequency_idf,
    "q04_corpus_stats": corpus_stats,
    "q05_bm25_topk": bm25_topk,
    "q06_bm25_batch": bm25_batch,
    "q07_exact_text_dedupe": exact_text_dedupe,
    "q08_eligibility_filter": eligibility_filter,
    "q09_jurisdiction_scope": jurisdiction_scope,
    "q10_authority_order": authority_order,
    "q11_token_overlap_search": token_overlap_search,
    "q12_citation_format": citation_format,
    "q13_mock_embedding": mock_embedding,
    "q14_cosine_topk": cosine_topk,
    "q15_rrf_fusion": rrf_fusion,
    "q16_grouped_limits": hybrid_search,
    "q17_comparison_candidates": comparison_candidates,
    "q18_gap_detection": gap_detection,
    "q19_retrieval_eval": retrieval_eval,
    "q20_embedding_batches": embedding_batches,
}

SQL = {
    "q01_token_counts": f"select doc_id, len({_TOKENS}) as n_tokens, len(list_distinct({_TOKENS})) as n_distinct from documents",
    "q02_term_frequencies": f"select doc_id as id, token, count(*) as tf from (select doc_id, unnest({_TOKENS}) as token from documents) group by all",
    "q03_document_frequency_idf": f"with t as (select distinct doc_id, unnest({_TOKENS}) as token from documents), n as (select count(*) as n from documents), "
    "d as (select token, count(*) as df from t group by token) select token, df, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)), 6) as idf from d, n",
    "q04_corpus_stats": f"select count(*) as n, round(avg(len({_TOKENS})), 6) as avgdl from documents",
    "q05_bm25_topk": f"{_PLAIN_SQL} select id, score, rank::int as rank from lex where rank <= 50",
    "q06_bm25_batch": f"{_TEMPLATE_SQL} select qid, id, score, rank::int as rank from lex where rank <= 50",
    "q07_exact_text_dedupe": f"with r as ({RECORDS_SQL}), k as (select *, sha256(trim(text, ' ')) as text_hash, {_CLASS_RANK_SQL} as c, {_STATUS_RANK_SQL} as s from r) "
    "select arg_min(id, (c, s, id)) as id, text_hash, count(*) as copies from k group by text_hash",
    "q08_eligibility_filter": _ELIGIBLE_SQL,
    "q09_jurisdiction_scope": _JURISDICTION_SQL,
    "q10_authority_order": f"with r as ({RECORDS_SQL}) select id, {_CLASS_RANK_SQL} as class_rank, {_STATUS_RANK_SQL} as status_rank from r",
    "q11_token_overlap_search": f"with h as (select doc_id as id, unnest({_FOLD_TOKENS}) as token from documents), a as (select item_id as qid, unnest({_FOLD_TOKENS}) as token from benchmark), "
    "s as (select qid, id, count(*) as overlap from h join a using (token) group by all), "
    "k as (select *, row_number() over (partition by qid order by overlap desc, id)::int as rank from s) select * from k where rank <= 10",
    "q12_citation_format": _CITATION_SQL,
    "q13_mock_embedding": _MOCK_SQL,
    "q14_cosine_topk": f"with {_COSINE} select qid, id, score, rank::int as rank from sem where rank <= 10",
    "q15_rrf_fusion": f"{_PLAIN_SQL}, {_FUSED} select qid, id, lexical_rank::int as lexical_rank, semantic_rank::int as semantic_rank, fusion from fu",
    "q16_grouped_limits": f"{_GROUPED} select qid, id, document_id, authority_group, group_rank::int as group_rank, rank::int as rank, fusion from o",
    "q17_comparison_candidates": _COMPARISON_SQL,
    "q18_gap_detection": _GAPS_SQL,
    "q19_retrieval_eval": _EVAL_SQL,
    "q20_embedding_batches": _BATCH_SQL,
}
