"""Operators 4, 5, 7, 8 and 10 and the pipeline against brute force, exact packing rules and SQL."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import backoff, common, jaccard, linededup, mixing, packing, queries, toxicity
from tests.llm.test_row_operators import DIR, odd_docs
from tests.oracle import connect, mismatch

DOC = "doc_id long, text string"


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def near_docs(spark, seed=2, groups=12):
    """Families of edited copies, exact copies, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [texts[0]] * 5 + ["one two", "one two", "", None, "three words here"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC), texts


def brute_jaccard(texts, n=5, t=0.8):
    sets = []
    for x in texts:
        w = plain_words(x)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= t * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs, texts = near_docs(spark)
    links, heads = brute_jaccard(texts)
    got = {r.doc_id: r for r in jaccard.groups(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == heads
    assert sum(r.keep for r in got.values()) == len(set(heads))


def test_jaccard_odd_rows(spark):
    docs = odd_docs(spark)
    got = jaccard.groups(docs).collect()
    assert len(got) == 8
    assert [r.n_links for r in got if r.doc_id == 1] == [1, 1]
    assert [r.n_links for r in got if r.doc_id in (2, 3)] == [0, 0]
    assert jaccard.groups(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """The chance that a pair of similarity 0.8 is dropped by the table of least matches is negligible."""
    for n, least in jaccard.least_matches():
        lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert lost < 1e-5
    assert jaccard.least_matches()[-1][1] > 150


def test_dense_and_sparse_overlaps_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(40)]
    block = jaccard.Block(sets)
    i, j = np.triu_indices(40, 1)
    got = jaccard._overlaps(block, block, i, j)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_the_files_own_library(spark):
    own, fast = tokenizer(), packing.encoder(queries.tokenizer_path())
    rows = [r.text for r in queries._table(spark, DIR, "documents").select("text").limit(200).collect()]
    rows += ["", " ", "a<|endoftext|>b", "don't  stop\n\n\t12,345 é ß 漢字 🙂", "\r\n x"]
    for t in rows:
        assert list(fast.encode(t, allowed_special="all")) == own.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(spark):
    docs = odd_docs(spark)
    got = packing.pack_documents(docs, queries.tokenizer_path()).toPandas()
    own = tokenizer()
    for r in docs.collect():
        ids = np.array([*(own.encode(r.text, add_special_tokens=False).ids if r.text else []), 2], "<u4")
        mine = got[(got.doc_id == r.doc_id) if r.doc_id is not None else got.doc_id.isna()].drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n]) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
        assert (mine.length.iloc[1:] == 1024).all()
    assert (got.doc_id == 1).sum() == 2
    laid = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((x.offset.to_numpy() == np.concatenate([[0], np.cumsum(x.length)[:-1]])).all() and x.length.sum() <= 1024 for _, x in laid)
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_plan_uses_every_piece_and_few_sequences():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randint(1, 1024) for _ in range(rng.randint(1, 400)))
        made = packing.plan(dict(counts))
        used = Counter()
        for lengths, times in made:
            assert sum(lengths) <= 1024 and times > 0 and sum(n > 341 for n in lengths) <= 2
            for n in lengths:
                used[n] += times
        assert used == counts
        total = sum(n * c for n, c in counts.items())
        # Never over 11/9 of the bound by size and by pieces above half a sequence.
        bound = max(-(-total // 1024), sum(c for n, c in counts.items() if n > 512))
        assert sum(t for _, t in made) <= bound * 11 / 9 + 1


def test_large_pieces_match_optimally():
    from itertools import permutations

    def best(items):
        return min(sum(1 for _ in _pairs(p)) for p in permutations(items))

    def _pairs(p):
        i = 0
        while i < len(p):
            i += 2 if i + 1 < len(p) and p[i] + p[i + 1] <= 1024 else 1
            yield i

    rng = random.Random(8)
    for _ in range(20):
        items = [rng.randint(342, 1024) for _ in range(6)]
        assert sum(t for _, t in packing.plan(Counter(items))) == best(items)


def test_backoff_equals_brute_force(spark):
    docs, texts = near_docs(spark, 5)
    w = [plain_words(t) for t in texts]
    for order in (2, 3):
        counts = [Counter(tuple(x[i : i + n]) for x in w for i in range(len(x) - n + 1)) for n in range(1, order + 1)]
        total = sum(counts[0].values())

        def s(x, i, n, counts=counts, total=total):
            if n == 1:
                return counts[0][(x[i],)] / total
            gram = tuple(x[i - n + 1 : i + 1])
            if i >= n - 1 and counts[n - 1][gram] >= 2:
                return counts[n - 1][gram] / counts[n - 2][gram[:-1]]
            return (1 if i < n - 1 else 0.4) * s(x, i, n - 1)

        got = {r.doc_id: r for r in backoff.score(docs, order=order).collect()}
        for i, x in enumerate(w):
            if not x:
                assert got[i].score is None and got[i].n_words == 0
            else:
                want = sum(math.log(s(x, k, order)) for k in range(len(x)))
                assert abs(got[i].log_score - want) < 1e-6 and abs(got[i].score - want / len(x)) < 1e-6


def test_backoff_query_counts_trigrams(spark, tmp_path):
    """A registered query looks at two words of context, and backs off twice."""
    texts = ["a b c", "a b c", "x b d", "x b d", "q w e"]
    spark.createDataFrame(list(enumerate(texts)), DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op8_backoff_scores"](spark, str(tmp_path)).collect()}
    # c follows b in two of four cases, but always after "a b".
    assert abs(got[0].log_score - math.log(2 / 15 * 1 * 1)) < 1e-5 and got[0].backed_off == 0
    assert abs(got[4].log_score - math.log(1 / 15 * 0.4 / 15 * 0.4 * 0.4 / 15)) < 1e-5 and got[4].backed_off == 3


def test_backoff_odd_rows_and_codecs(spark):
    docs = odd_docs(spark)
    got = backoff.score(docs).collect()
    assert len(got) == 8 and len({r.log_score for r in got if r.doc_id == 1}) == 1
    assert backoff.score(docs.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (backoff._spread(backoff._squeezed(h), len(h)) == h).all() if n else True
        c = rng.integers(1, 600, n)
        assert (backoff._large(backoff._small(c), n) == c).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert mismatch(queries.queries()[name](spark, DIR), connect(DIR), queries.oracle_sql()[name]) is None


def test_mixing_meets_margins_and_budget(spark):
    rows = [(i, "w " * (1 + i % 7), ("a", "b", "c")[i % 3 if i % 5 else 0], ("x", "y")[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = mixing.rake(mixing.cells_of(mixing.described(docs)), {"source": 0.0, "lang": 1.0, "topic": 1.0}).toPandas()
    assert np.allclose(cells.groupby("source").w.sum(), 1 / 3, atol=1e-6)
    got = mixing.sample(docs, keep=0.4).toPandas()
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.4) < 1e-3
    assert (got.probability <= 1).all() and len(got) == 600
    assert mixing.drawn(docs, keep=1.0).count() == 600


def test_mixing_meets_given_weights(spark):
    """Source weights from the caller hold after raking, beside the natural languages and topics; full cells give what they lack to others."""
    rng = random.Random(12)
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.rake(mixing.cells_of(mixing.described(docs)), {"lang": 1.0}, {"source": {"b": 0.6, "c": 0.1}}).toPandas()
    assert cells.groupby("source").w.sum().round(6).to_dict() == {"a": 0.3, "b": 0.6, "c": 0.1}
    assert np.allclose(cells.groupby("lang").w.sum(), cells.groupby("lang").t.sum() / cells.t.sum(), atol=1e-6)
    got = mixing.sample(docs, keep=0.5, targets={"source": {"b": 0.6, "c": 0.1}}).toPandas()
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.5) < 1e-3
    assert got[got.source == "b"].probability.max() == 1


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    assert mixing.sample(docs).count() == 8
    assert mixing.drawn(docs).columns == docs.columns
    assert mixing.sample(docs.limit(0)).count() == 0
    clash = docs.withColumns({"_source": F.lit("own"), "_P": F.lit(3)})
    kept = mixing.drawn(clash, keep=1.0)
    assert kept.columns == clash.columns and {tuple(r) for r in kept.select("_source", "_P").collect()} == {("own", 3)}


def brute_lines(texts):
    """Line numbers that go per document and the links, from the edit similarity of all pairs of lines."""
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            norm = " ".join(re.sub(r"[^\w]|_", " ", line.lower()).split())
            if len(norm.split()) >= 5:
                seen[norm].append((i, n))
    lines = sorted(seen, key=len)
    letters = [Counter(x) for x in lines]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links, close = [], []
    for j, longer in enumerate(lines):
        most = int(0.1 * len(longer) + 1e-9)
        for i in range(j - 1, -1, -1):
            if len(lines[i]) < len(longer) - most:
                break
            # An edit takes at most one letter away.
            if (letters[j] - letters[i]).total() <= most:
                close.append((i, j, lines[i], longer, most))
    pairs = pd.DataFrame(close, columns=["i", "j", "a", "b", "most"])
    for i, j in duckdb.sql("select i, j from pairs where levenshtein(a, b) <= most").fetchall():
        links.append((lines[i], lines[j]))
        root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (10**9, 0)), min(seen[line]))
    gone = defaultdict(set)
    for i, line in enumerate(lines):
        for spot in seen[line]:
            if spot != first[find(i)]:
                gone[spot[0]].add(spot[1])
    return gone, links


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(25)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            own = list(rng.choice(base))
            if rng.random() < 0.6:
                k = rng.randrange(len(own))
                own[k] = own[k][:-1] + rng.choice("xyz")
            text = " ".join(own)
            lines.append(text.upper() + "!" if rng.random() < 0.2 else text)
        texts.append("\n".join(lines))
    gone, links = brute_lines(texts)
    assert len(links) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    want, have = ({(i, n) for i, ns in d.items() for n in ns} for d in (gone, {i: r.removed_lines for i, r in got.items()}))
    assert len(want & have) >= 0.97 * len(want) and len(have - want) <= 0.01 * len(want)
    for i, t in enumerate(texts):
        assert got[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i].removed_lines)


def test_lines_found_of_all_pairs(spark):
    """Of the links that edit similarity alone gives on a whole table, nearly all end in one group; clean lines stay."""
    docs = queries._table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    gone, links = brute_lines(texts)
    got = {r.doc_id: set(r.removed_lines) for r in linededup.deduplicated(docs).collect()}
    ids = [r.doc_id for r in docs.collect()]
    want = {(ids[i], n) for i, ns in gone.items() for n in ns}
    have = {(i, n) for i, ns in got.items() for n in ns}
    assert len(links) > 20 and len(want & have) >= 0.95 * len(want) and len(have - want) <= 0.01 * len(want)
    found = linededup.occurrences(docs)
    groups = {r.node: r.component for r in linededup.line_groups(found).collect()}
    node = {r.norm: r.h1 for r in found.select("norm", "h1").distinct().collect()}
    assert sum(groups.get(node[a], a) == groups.get(node[b], b) for a, b in links) >= 0.9 * len(links)


def test_near_lines_of_every_length_meet(spark):
    """One changed word, or one more, is found in nearly all lines of any length; a changed digit counts as an edit."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    texts = []
    for n in [*range(8, 40), 60, 100, 300, 2000, 20000]:
        own = [word() for _ in range(n)]
        k = max(range(n), key=lambda i: len(own[i]))
        texts += [" ".join(own), " ".join([*own[:k], own[k][:-1] + "z", *own[k + 1 :]])]
        if n > 12:
            texts.append(" ".join([*own[: n // 2], "q", *own[n // 2 :]]))
    texts += ["invoice number 123 totals about 900 euros", "invoice number 777 totals about 12 euros", "invoice number 123 totals about 901 euros"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicated(docs).collect()}
    gone, _ = brute_lines([t if len(t) < 4000 else "" for t in texts])
    have = {i for i, r in got.items() if r and len(texts[i]) < 4000}
    assert len(have & set(gone)) >= 0.95 * len(gone) and not have - set(gone) and not got[len(texts) - 2]
    assert [got[i] for i, t in enumerate(texts) if len(t) > 4000] == [[], [0], [0]] * 2


def test_simhash_equals_plain_counts(spark):
    import xxhash

    rng = random.Random(4)
    lines = ["the cat sat on the mat", "one " * 40000, "a b c d e f", " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(20000))]
    rows = spark.createDataFrame([(i, " ".join(x.split())) for i, x in enumerate(lines)], "node long, norm string")
    got = {r.node: r.sim & (2**64 - 1) for r in linededup.simhashes(rows).collect()}
    for i, line in enumerate(lines):
        hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in line.split()]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_lines_of_scripts_without_spaces(spark):
    line = "東京都は日本の首都であり世界最大の都市の一つです"
    docs = spark.createDataFrame([(0, line), (1, line[:5] + "本" + line[6:]), (2, "北海道の冬は寒くて雪が多いことで知られています")], DOC)
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicated(docs).collect()}
    assert got == {0: [], 1: [0], 2: []}


def test_plain_lines_are_normalised_without_patterns(spark, monkeypatch):
    """Each code point is normalised as the pattern does it; lines whose letters have a case take no pattern."""
    rows = spark.range(1, 0x110000).where("not id between 55296 and 57343")
    one = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    low = rows.select("id", F.lower(F.concat(F.lit("ab"), one, F.lit("c "), one, one, F.lit(" é, - x"), one, F.lit(" |  1 ..")))).toDF("id", "low")
    # Decoding takes one of them, the byte order mark, away.
    assert low.where(F.length("low") < 20).count() <= 1
    want = low.select("id", linededup.normalised(F.col("low")).alias("want"))
    assert linededup.with_norm(low).join(want, "id").where("not norm <=> want").isEmpty()
    monkeypatch.setattr(linededup, "normalised", lambda low: F.lit("pattern"))
    lines = ["l'été, où il fait  chaud | ¡no! -- 12 ß", "日本 a b c d", "“a” b c d e", "ⓐb, c", "a line of many words and a circled ⓐ", " , ", ""]
    got = linededup.with_norm(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, low string")).orderBy("id").collect()
    assert [r.norm for r in got] == ["pattern"] * 5 + ["", ""]
    plain = spark.createDataFrame([("l'été, où il fait  chaud | 12 ß -  . - x",)], "low string")
    assert linededup.with_norm(plain).first().norm == "l été où il fait chaud 12 ß x"


def test_crowded_buckets_settle(spark):
    """Many different lines that share whole blocks of words: each family inside is still found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(20)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(12)]
        line = [x for i in range(12) for x in (shared[i], own[i])] + shared[12:]
        texts += [" ".join(line), " ".join([*line[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r.removed_lines for r in linededup.deduplicated(docs).collect()}
    assert sum(bool(got[i]) for i in range(1, 120, 2)) >= 54 and not any(got[i] for i in range(0, 120, 2))


def test_no_line_of_a_bucket_is_left_out(spark, monkeypatch):
    """All pairs of one crowded bucket that are similar and near by SimHash end in one group, in chains that miss the bucket's leader too; the bucket has several blocks."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared, lines = [word() for _ in range(20)], []
    for _ in range(30):
        own = [word() for _ in range(12)]
        line = [x for i in range(12) for x in (shared[i], own[i])] + shared[12:]
        for k in range(4):
            at = 2 * k + 1
            line = [*line[:at], word(), *line[at + 1 :]]
            lines.append(" ".join(line))
    found = spark.createDataFrame([(x,) for x in lines], "norm string").withColumn("h1", F.xxhash64("norm")).cache()
    monkeypatch.setattr(linededup, "block_keys", lambda rows: rows.select(F.col("h1").alias("node"), F.lit(1).cast("long").alias("key")))
    monkeypatch.setattr(linededup, "BLOCK", 64, raising=False)
    sims = linededup.simhashes(found.select(F.col("h1").alias("node"), "norm"))
    full = found.join(sims, found["h1"] == sims["node"]).drop("h1").cache()
    ends = [full.select(*[F.col(c).alias(f"{e}_{c}") for c in ("node", "norm", "sim")]) for e in ("a", "b")]
    pairs = ends[0].crossJoin(ends[1]).where(f"a_node < b_node and bit_count(a_sim ^ b_sim) <= {linededup.RADIUS}").where("levenshtein(a_norm, b_norm) <= floor(0.1 * greatest(length(a_norm), length(b_norm)) + 1e-9)")
    links = {(r.a_node, r.b_node) for r in pairs.select("a_node", "b_node").collect()}
    groups = {r.node: r.component for r in linededup.line_groups(found.select("h1", "norm")).collect()}
    assert len(links) > 60 and not [(a, b) for a, b in links if groups.get(a, a) != groups.get(b, b)]


def test_last_pairs_of_a_bucket_meet_in_rings(spark, monkeypatch):
    """A chain of lines that leaders miss is connected whole, though pairs that a nearer link has connected, or whose lengths rule a link out, are not compared."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(160)]
    lines = [" ".join(words[:n]) for n in range(60, 160)]
    found = spark.createDataFrame([(x,) for x in lines], "norm string").withColumn("h1", F.xxhash64("norm")).cache()
    monkeypatch.setattr(linededup, "block_keys", lambda rows: rows.select(F.col("h1").alias("node"), F.lit(1).cast("long").alias("key")))
    compared, real = [], linededup.verified
    chars = {r.h1: r.n for r in found.select("h1", F.length("norm").alias("n")).collect()}

    def counted(pairs, texts):
        compared.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return real(pairs, texts)

    monkeypatch.setattr(linededup, "verified", counted)
    groups = {r.node: r.component for r in linededup.line_groups(found.select("h1", "norm")).collect()}
    assert len(set(groups.values())) == 1 and len(groups) == len(lines)
    close = [(a, b) for a, b in compared if abs(chars[a] - chars[b]) <= int(0.1 * max(chars[a], chars[b]) + 1e-9)]
    linkable = sum(abs(m - n) <= int(0.1 * max(m, n) + 1e-9) for i, m in enumerate(chars.values()) for n in [*chars.values()][:i])
    assert len(close) == len(compared) and len(set(compared)) < 0.7 * linkable


def test_lines_odd_rows(spark):
    docs = odd_docs(spark)
    got = linededup.deduplicated(docs, "lines", "gone")
    rows = got.collect()
    assert len(rows) == 8 and got.columns == [*docs.columns, "lines", "gone"]
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[2].lines == 0 and by[3].text == "" and by[5].text == "12 34 !!"
    assert linededup.deduplicated(docs.limit(0)).count() == 0
    clash = docs.withColumns({"_k1": F.lit("own"), "_K2": F.lit("mine"), "_lines": F.lit(5), "n_words": F.lit(1)})
    kept = linededup.deduplicated(clash, "lines", "gone")
    assert kept.columns[: len(clash.columns)] == clash.columns and {tuple(r) for r in kept.select("_k1", "_K2", "_lines", "n_words").collect()} == {("own", "mine", 5, 1)}
    with pytest.raises(ValueError, match="column"):
        linededup.deduplicated(docs.withColumn("Gone", F.lit(1)), "lines", "gone")


def test_filter_loses_no_key(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"))
    wanted = rows.where("k % 3 = 0")
    assert linededup._maybe_in(rows, "k", wanted).join(wanted, "k", "left_semi").count() == wanted.count()
    assert linededup._maybe_in(rows, "k", wanted).count() < 1800


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)] + [(300, i) for i in range(301, 350)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100} and {got[i] for i in range(300, 350)} == {300}
    assert 200 not in got


def test_pipeline_stages(spark, tmp_path):
    """Each stage works on what its predecessor kept; its decisions are those of its operator."""
    docs = queries._table(spark, DIR, "documents")
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, DIR), "test-stage")
        now[name] = (docs, out)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == list(now)
    for name in list(now)[:-1]:
        assert now[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = now["toxicity"]
    model = toxicity.learn(before, queries._table(spark, DIR, "labels"))
    good = toxicity.score_documents(before, model).where("predicted = 0")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in good.collect())
    before, after = now["line dedup"]
    kept = {r.doc_id: r for r in after.collect()}
    whole = {r.doc_id: r.text for r in before.collect()}
    own = {r.doc_id: r for r in linededup.deduplicated(before).collect()}
    assert {i: r.text for i, r in kept.items()} == {i: r.text for i, r in own.items() if not (r.removed_lines and not re.search(r"\S", r.text))}
    assert all(r.n_chars == len(r.text) for i, r in kept.items() if r.text != whole[i])
    # Of equal lines one occurrence is left.
    lines = Counter(n for r in kept.values() for line in r.text.split("\n") if len((n := " ".join(re.sub(r"[^\w]|_", " ", line.lower()).split())).split()) >= 5)
    assert max(lines.values()) == 1 and len(kept) < len(whole)
    before, after = now["n-gram jaccard"]
    rows = before.orderBy("doc_id").collect()
    _, heads = brute_jaccard([r.text for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[h].doc_id for h in heads})
    before, after = now["mixing"]
    drawn = mixing.sample(before, keep=corpus_pipeline.MIX_KEEP).where("drawn")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in drawn.collect())
    before, after = now["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_pipeline_takes_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = common.stored(out, "odd-stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() >= docs.count()


def test_near_duplicate_stage_keeps_columns_and_repeats(spark):
    """Columns of any name come back as they were; rows equal in id and text stay together."""
    docs, texts = near_docs(spark, 4, 4)
    marked = docs.withColumns({"_k1": F.lit("own"), "_K2": F.lit("mine")})
    twice = marked.withColumn("batch", F.lit(1)).union(marked.withColumn("batch", F.lit(2)))
    _, heads = brute_jaccard(texts)
    got = corpus_pipeline.near_duplicate_stage(spark, twice, DIR)
    assert got.columns == twice.columns
    assert Counter((r.doc_id, r["_k1"], r["_K2"], r.batch) for r in got.collect()) == Counter((h, "own", "mine", b) for h in set(heads) for b in (1, 2))


def test_stages_of_an_empty_table(spark):
    docs = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
