"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from sitelens.llm import mixing

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_MD5 = "md5('sitelens-page:' || coalesce(page_id::varchar, digest))"

OP2 = (
    "with p as (select page_id, coalesce(url, 'urn:sitelens:null') as url, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as digest from pages), "
    "o as (select *, case when n >= 1000 then max(page_id) over (partition by digest, n) end as original from p), "
    "r as (select *, coalesce(original > page_id, false) as revisit from o) "
    "select page_id, n as payload_bytes, digest as payload_digest, case when revisit then 'revisit' else 'response' end as record_type, case when revisit then original end as refers_to, "
    f"'<urn:uuid:' || substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-' || substr({_MD5}, 13, 4) || '-' || substr({_MD5}, 17, 4) || '-' || substr({_MD5}, 21, 12) || '>' as record_id, "
    "url as target_uri, case when revisit then 0 else n end as stored_bytes, true as block_ok from r"
)

OP3 = (
    "with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings where embedding is not null and vec_id is not null "
    "and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
    "s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), "
    "k as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) select query_id, rank, vec_id, score from k where rank <= 5"
)

OP5 = (
    f"with recursive w as (select doc_id, {_WORDS} as w from documents), "
    "s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w), "
    "n as (select doc_id, count(*) as n from s group by doc_id), "
    "c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all), "
    "l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where k >= 0.8 * (a.n + b.n - k) - 1e-9), "
    "r as (select doc_id, doc_id as head from documents union select l.y, r.head from r join l on l.x = r.doc_id) "
    "select doc_id, min(head) as class_id, (select count(*) from l where x = r.doc_id) as n_links from r group by doc_id"
)

_MISS2 = "(b.v is not null and c2.n < 2)"
_HIT3 = "(b.u is not null and c3.n >= 2)"
_LOWER = "case when b.v is not null and c2.n >= 2 then ln(c2.n::double / p.n) else case when b.v is null then 0 else ln(0.4::double) end + ln(a.n / total.n) end"
OP8 = (
    f"with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), t as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from d), "
    "b as (select r, w, lag(w) over (partition by r order by i) as v, lag(w, 2) over (partition by r order by i) as u from t), c1 as (select w, count(*) as n from t group by w), "
    "c2 as (select v, w, count(*) as n from b where v is not null group by v, w), c3 as (select u, v, w, count(*) as n from b where u is not null group by u, v, w), "
    "total as (select count(*)::double as n from t), "
    f"s as (select b.r, case when {_HIT3} then 0 else (b.u is not null)::int + {_MISS2}::int end as miss, "
    f"case when {_HIT3} then ln(c3.n::double / q.n) else case when b.u is null then 0 else ln(0.4::double) end + {_LOWER} end as x "
    "from b cross join total join c1 a on a.w = b.w left join c1 p on p.w = b.v left join c2 on c2.v = b.v and c2.w = b.w "
    "left join c2 q on q.v = b.u and q.w = b.v left join c3 on c3.u = b.u and c3.v = b.v and c3.w = b.w), "
    "g as (select r, count(*) as n_words, sum(miss)::bigint as backed_off, sum(x) as log_score from s group by r) "
    "select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(backed_off, 0) as backed_off, round(log_score, 6) as log_score, round(log_score / n_words, 6) as score from d left join g using (r)"
)

# The checksum of a conversation id, a step a bit: a byte goes in, then eight shifts.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"
)
OP12 = (
    "with own as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) as t from conversations where conv_id is not null group by conv_id), "
    f"h as (select conv_id, t, {_CRC} % 4 as h from own), "
    "built as (select a.conv_id, list_concat(case when b.t is null then [] else b.t[1:a.h::int] end, a.t[a.h::int + 1:]) as t from h a left join own b on b.conv_id = a.conv_id - a.conv_id % 20), "
    "m as (select conv_id, len(t) as size, unnest(range(0, len(t) + 1)) as depth, t from built), "
    "n as (select t[1:depth::int] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when size = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from m group by 1, 2), "
    "k as (select path[1:len(path) - 1] as path, count(*) as n_children from n where depth > 0 group by 1), "
    r"f as (select n.*, coalesce(n_children, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.path[-1].t, '[^\x20\x09-\x0D]+')) end as own from n left join k on k.path = n.path), "
    "up as (select path[1:d::int] as path, count(*) filter (n_children = 0) as n_leaves, sum(own)::bigint as saved_tokens from (select *, unnest(range(0, depth + 1)) as d from f) group by 1), "
    "o as (select f.*, n_leaves, saved_tokens, p.conv_id as parent_conv_id from f join up on up.path = f.path left join n p on f.depth > 0 and p.path = f.path[1:len(f.path) - 1]) "
    "select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from o"
)

OP13 = (
    r"with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents), "
    r"w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p), n as (select lang, sum(len(w))::bigint as n from w group by lang), "
    "s as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, 6)) as m) where len(w) >= m), "
    "f as (select lang, m, w[i:i + m - 1] as g, count(*) as a from s group by all having count(*) >= 100), "
    "x as (select lang, unnest([g[2:], g[:-2]]) as g, a from f where m > 2), longer as (select lang, g, max(a) as a from x group by all), "
    "c as (select f.* from f left join longer b on b.lang = f.lang and b.g = f.g where f.m > 1 and (b.a is null or b.a < f.a)), "
    "k as (select *, unnest(range(1, m)) as k from c), "
    "y as (select k.lang, k.g, k.a, l.a as l, r.a as r, n.n, k.k, (1000::hugeint * k.a * n.n // (l.a::hugeint * r.a))::bigint as score from k join n on n.lang = k.lang "
    "join f l on l.lang = k.lang and l.g = k.g[:k.k] join f r on r.lang = k.lang and r.g = k.g[k.k + 1:]), "
    "z as (select * from y qualify row_number() over (partition by lang, g order by score, k) = 1), "
    "t as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score from z) "
    "select * from t where rank <= 2000"
)

SQL = {"op2_warc_revisits": OP2, "op3_exact_top_k": OP3, "op5_ngram_jaccard": OP5, "op7_raked_mix": mixing.ORACLE_SQL, "op8_backoff_scores": OP8, "op12_prefix_trie": OP12, "op13_phrase_collocations": OP13}
