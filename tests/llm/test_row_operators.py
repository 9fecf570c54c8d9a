"""Operators 1, 2, 3, 6 and 9: brute force, exact round trips, held-out accuracy, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from sitelens.llm import balltree, gif, langid, textkit, toxicity, warc
from sitelens.llm.queries import _table, queries

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def odd_docs(spark):
    """Nulls in each column, empty and long texts, repeated rows, an extra column of a clashing name."""
    rows = [
        (1, "the cat sat on the mat and the dog ran " * 4, "en", "a", 1, "x"),
        (1, "the cat sat on the mat and the dog ran " * 4, "en", "a", 1, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, "x"),
        (None, "der hund und die katze sind im haus und der garten", "de", "b", 1, "x"),
        (5, "12 34 !!", "en", "a", 1, "x"),
        (6, "wort " * 50000, "de", "b", 1, "x"),
        (7, "der hund lief und die katze schlief im haus " * 3, "de", None, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_language_is_right_on_held_out_rows(spark):
    got = queries()["op1_language_id"](spark, DIR).join(_table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.held_out.equals(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3
    empty = docs.limit(0)
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}


def test_filters_have_no_false_negatives():
    model = langid.LanguageFilters(["a", "b"], np.zeros(1 << 10, np.uint8), np.zeros(2), 10)
    grams = np.unique(np.concatenate(langid._all_grams(["some words of a text"])))
    for rows in model.positions(grams):
        model.table[rows] |= 2
    assert all((model.table[rows] & 2).all() for rows in model.positions(grams))


def test_more_languages_than_a_mask_word(spark):
    """Seventy languages are all learned; those beyond the 64th are found like the others."""
    rng = random.Random(6)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(40)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 70 and model.table.shape[1] == 2
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_counts_equal_plain_sets():
    """Corrected counts and the decision against plain sets of n-grams and the same arithmetic."""
    texts = {"a": "one two three four five six seven", "b": "uno dos tres cuatro cinco seis siete"}
    model = langid.LanguageFilters(["a", "b"], np.zeros((1 << 12, 1), np.uint8), np.zeros(2), 12)
    for k, t in enumerate(texts.values()):
        for grams in langid._all_grams([t]):
            for rows in model.positions(np.unique(grams)):
                model.table[rows, 0] |= 1 << k
        model.fill[k] = (model.table[:, 0] >> k & 1).mean()
    probe = "three cuatro seis seven dos"
    counts = np.zeros(2)
    total = 0
    for grams in langid._all_grams([probe]):
        total += len(grams)
        for g in grams:
            for k in range(2):
                counts[k] += all(model.table[r[0], 0] >> k & 1 for r in model.positions(np.array([g])))
    false = model.fill**langid.HASHES
    true = np.maximum(0, (counts - total * false) / (1 - false))
    names, share = model.score([probe])
    assert names[0] == "ab"[int(true.argmax())] and share[0] == pytest.approx(true.max() / true.sum())


def test_warc_round_trip(spark):
    long, short = "x" * 1000, "y" * 999
    rows = [(1, "u", long, 0), (9, None, long, 0), (4, "u", long, 0), (2, "u", short, 0), (3, "u", short, 0), (5, "u", None, 0), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 90, 0), (None, "u", "z", 0), (7, "ü", "é" * 600, 0)]
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, size int")).collect()}
    assert len(got) == len(rows) and all(r.block_ok for r in got.values())
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 4, 9, 2, 3)] == [("revisit", 9), ("revisit", 9)] + [("response", None)] * 3
    assert got[1].stored_bytes == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, none).count() == 0


def test_warc_broken_archive_raises():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"))


def brute_top(rows, queries_, k):
    out = []
    for q, a in queries_:
        scored = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) / 7 for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6)]
    v = balltree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ints = [(r.vec_id, r.v) for r in v.collect()]
    assert len(ints) == 330
    got = balltree.top_k(v, v.where("vec_id % 10 = 0"), k=5, shard_rows=60, block_rows=12)
    want = brute_top(ints, [x for x in ints if x[0] % 10 == 0], 5)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_top_k_of_large_components(spark):
    """No finite vector is dropped; products beyond a double's whole numbers are exact, beyond a long's they are its ends."""
    rows = [(0, [1e14, 1.0]), (1, [1e6, -1.0]), (2, [1e6, 2.0]), (3, [-1e30, 0.0]), (4, [0.5, 0.5]), (5, [1e6, 3.0])]
    v = balltree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = {r.vec_id: [int(x) for x in r.v] for r in v.collect()}
    assert set(ints) == set(range(6))
    cut = lambda x: max(-(2**63 - 2), min(2**63 - 2, x))
    for q in (0, 4):
        want = sorted(((-cut(sum(a * b for a, b in zip(ints[q], ints[i], strict=True))), i) for i in ints if i != q))
        got = sorted((r.rank, r.vec_id, r.score) for r in balltree.top_k(v, v.where(f"vec_id = {q}"), k=5, shard_rows=3).collect())
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_tree_walk_visits_few_leaves():
    """Bounds hold for every node, and a query near one cluster leaves most of the tree unvisited."""
    rng = np.random.default_rng(2)
    data = np.concatenate([np.floor(rng.normal(c * 400, 20, (200, 8))) for c in range(12)])
    tree = balltree.BallTree(data, 16)
    queries = np.floor(rng.normal(0, 300, (20, 8)))
    top = tree.bounds(queries)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (tree.products(queries, rows) <= top[:, [node]]).all()
    seen = []
    plain = tree.products
    tree.products = lambda q, rows: seen.append(len(q)) or plain(q, rows)
    best, _ = balltree._search(tree, np.arange(len(data)), np.full(20, -1), queries, 3, np.full(20, balltree._NONE))
    assert np.array_equal(best, -np.sort(-(queries @ data.T).astype(np.int64), axis=1)[:, :3])
    assert sum(seen) < 0.5 * 20 * sum(r is not None for r in tree.rows)


def test_top_k_small_and_empty(spark):
    v = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, v array<long>")
    assert [tuple(r) for r in balltree.top_k(v, v.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 11)]
    assert balltree.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_lzw_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 255, 576, 5760, 40000):
        for k in (1, 2, 30, 256):
            data = bytes(rng.randrange(k) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data)) == data


def gif_of(*frames, palette=bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))):
    """A 2x2 file with a four-colour palette from (disposal, transparent, samples) frames."""
    out = b"GIF89a" + bytes((2, 0, 2, 0, 0x81, 0, 0)) + palette
    for disposal, transparent, samples in frames:
        out += b"\x21\xf9\x04" + bytes((disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0))
        out += b"\x2c" + bytes((0, 0, 0, 0, 2, 0, 2, 0, 0)) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_gif_palette_transparency_and_disposal():
    red, green, blank = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    frames = list(gif.decode(gif_of((1, None, [1, 1, 1, 1]), (3, 0, [2, 0, 0, 0]), (2, 0, [0, 2, 0, 0]), (1, 0, [0, 0, 0, 1]))))
    assert [f.delay_cs for f in frames] == [5] * 4
    assert frames[0].canvas.reshape(4, 4).tolist() == [red] * 4
    assert frames[1].canvas.reshape(4, 4).tolist() == [green, red, red, red]
    assert frames[2].canvas.reshape(4, 4).tolist() == [red, green, red, red]
    assert frames[3].canvas.reshape(4, 4).tolist() == [blank, blank, blank, red]


def test_gif_rejects_broken_files():
    for raw in (b"", b"GIF89a" + b"\0" * 7 + b"\x99", gif_of((1, None, [1, 1, 1, 1]))[:-6]):
        with pytest.raises((ValueError, Exception)):
            assert list(gif.decode(raw)) and False


def test_media_columns(spark):
    docs = odd_docs(spark)
    got = gif.media_columns(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 8
    for r in got.itertuples():
        raw = (texts[None if r.doc_id is None or r.doc_id != r.doc_id else r.doc_id] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert sum(r.histogram) >= len(padded)
    assert got[got.doc_id == 1].drop_duplicates("media_sha256").shape[0] == 1


def test_toxicity_held_out(spark):
    got = queries()["op9_toxicity"](spark, DIR).join(_table(spark, DIR, "labels").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50
    assert (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_learns_a_pair():
    """Two terms matter only together: the linear weights alone cannot tell."""
    rng = random.Random(5)
    rows, ys = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({10 * a + 1, 100 * b + 2, rng.randrange(200, 400)})))
        ys.append(float(a == b))
    model = toxicity.train(rows, np.array(ys), 10)
    slot = [model.slot[r] for r in rows]
    margin = np.array([model.margin(s[s >= 0], np.zeros((s >= 0).sum(), int), 1)[0] for s in slot])
    assert (((margin > 0) == np.array(ys)).mean()) > 0.95


def test_toxicity_leaves_out_no_term_for_its_label_tie():
    """Every bucket of three or more documents is a feature, and a pair holds on rows not learned from."""
    rng = random.Random(6)

    def drawn(n):
        rows, ys = [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            rows.append(np.array(sorted({10 * a + 1, 100 * b + 2, *rng.sample(range(1000, 7000), 10)})))
            ys.append(float(a == b))
        return rows, np.array(ys)

    rows, ys = drawn(3000)
    model = toxicity.train(rows, ys, 13)
    often, n = np.unique(np.concatenate(rows), return_counts=True)
    assert (n >= 3).sum() > 4096 and (model.slot[often[n >= 3]] >= 0).all()
    rows, ys = drawn(500)
    slot = [model.slot[r] for r in rows]
    margin = np.array([model.margin(s[s >= 0], np.zeros((s >= 0).sum(), int), 1)[0] for s in slot])
    assert ((margin > 0) == ys).mean() > 0.9


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0), (7, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.score_documents(docs, toxicity.learn(docs, labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in none)


def test_words_and_ngrams_match_a_plain_version():
    texts = ["The the, Ünder 4a", None, "a b c d e f", "x", ""]
    seen = {}
    for first, past, buf, bounds in textkit.slices(texts, 8):
        hashes, at = textkit.words(buf, bounds)
        grams, g_at = textkit.ngrams(hashes, at, 5)
        for i in range(past - first):
            seen[first + i] = (hashes[at[i] : at[i + 1]].tolist(), g_at[i + 1] - g_at[i])
    assert [len(seen[i][0]) for i in range(5)] == [4, 0, 6, 1, 0]
    assert [int(seen[i][1]) for i in range(5)] == [1, 0, 2, 1, 0]
    assert seen[0][0][0] == seen[0][0][1]
