"""Operators 11 to 13: sharding, prefix trie and phrases against brute force, SQL and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelens.llm import hilbert, phrases, trie
from sitelens.llm.prefixsum import prefix_sums
from sitelens.llm.queries import _table, oracle_sql, queries
from tests.llm.test_row_operators import DIR, odd_docs
from tests.oracle import connect, mismatch

# Prefix sums


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), i, rng.choice([None, 1, 5, 700])) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(7)
    got = {r.b: r.s for r in prefix_sums(df, ["a", "b"], {"s": "v"}, "test").collect()}
    so_far = 0
    for _, b, v in sorted(rows):
        assert got[b] == so_far
        so_far += v or 0
    assert prefix_sums(df.limit(0), ["a"], {"s": "v"}, "test").count() == 0


# Operator 11


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
    index = hilbert.hilbert_index(points, bits)
    assert sorted(index) == list(range(1 << (dims * bits)))
    walk = points[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def _holds(rows, docs, law):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert all(0 <= s < 16 for s in shards)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    if law == "rows":
        counts = [len(shards.get(i, [])) for i in range(16)]
        assert max(counts) - min(counts) <= 1
    else:
        most, mean = max(r["size"] for r in rows), sum(r["size"] for r in rows) / 16
        assert all(abs(sum(r["size"] for r in shards.get(i, [])) - mean) <= most for i in range(16))
    assert all(r.law == law and r.grown_shard is None for r in rows)


@pytest.mark.parametrize("law", hilbert.LAWS)
def test_shards_hold_their_law(spark, law):
    docs = _table(spark, DIR, "documents")
    rows = hilbert.document_shards(docs, law=law).collect()
    _holds(rows, docs.collect(), law)
    # Runs of the curve: shards do not overlap.
    ends = [(min(r.curve for r in rows if r.shard == s), max(r.curve for r in rows if r.shard == s)) for s in sorted({r.shard for r in rows})]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_registered_shards(spark):
    _holds(queries()["op11_hilbert_shards"](spark, DIR).collect(), _table(spark, DIR, "documents").collect(), "rows")


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark)
    for law in hilbert.LAWS:
        _holds(hilbert.document_shards(docs, law=law).collect(), docs.collect(), law)
        assert hilbert.document_shards(docs.limit(0), law=law).count() == 0
    one = spark.createDataFrame([(7, "same text", "en", "s")] * 5000, "doc_id long, text string, lang string, source string")
    _holds(hilbert.document_shards(one).collect(), one.collect(), "rows")
    with pytest.raises(TypeError):
        hilbert.sharded(spark.createDataFrame([(1.5, 1)], "x double, size long"), ["x"], "size")


def test_cells_follow_quantiles(spark):
    rows = [("hot", i) for i in range(600)] + [(f"v{i:03d}", i) for i in range(300)] + [(None, 1)] * 100
    df = spark.createDataFrame(rows, "name string, n long")
    keys = df.select(hilbert._sortable(df.name, df.schema["name"].dataType).alias("d0"))
    least, cells = hilbert.cell_edges(keys, ["d0"], 3)["d0"]
    # Nulls and the hot value begin in the first eighth of the rows, the others behind seven tenths.
    assert (least, cells) == (["", "sv000", "sv050", "sv175"], [0, 5, 6, 7])


def test_pruned_reading(spark, tmp_path):
    docs = _table(spark, DIR, "documents").withColumnRenamed("n_chars", "Bytes")
    manifest = hilbert.write_shards(docs, f"file://{tmp_path}/s", ["lang", "source", "Bytes"]).collect()
    assert sum(m["rows"] for m in manifest) == 1000
    where = {"lang": ("de", "de"), "Bytes": (0, 1500)}
    got = hilbert.read_shards(spark, f"file://{tmp_path}/s", ["lang", "source", "Bytes"], where)
    want = docs.where("lang = 'de' and Bytes <= 1500")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    read = {r["_shard"] for r in got.select("_shard").collect()}
    boxes = [m for m in manifest if m.min_0 <= "de" <= m.max_0 and m.min_2 <= 1500]
    assert read <= {m["_shard"] for m in boxes} and len(boxes) <= 10  # of 16; runs of ids would need them all


# Operator 12


def _brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += gain
            leaves[n[:d]] += children[n] == 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, score string"


def _talks(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        texts = ["hello there you", "a b c d", "", None, "x\ty  z"]
        length = 3 if kind < 0.4 else rng.randint(1, 6)
        for t in range(length):
            text = "common first turn" if t == 0 and kind < 0.6 else "same" if kind < 0.4 else rng.choice(texts)
            rows.append((c * rng.choice([1, 1, 3]) if kind >= 0.4 else 5000 + c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if kind >= 0.6 else "user", text, "s"))
    seen, out = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out + [(None, 1, "user", "lost", "s")]


def test_trie_equals_brute_force(spark):
    rows = _talks()
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == _brute_trie([r[:4] for r in rows])
    # Preorder intervals: a subtree is the run of nodes from its top to its end, one deeper at least.
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(len(order)))
    for r in order:
        inside = order[r["rank"] + 1 : r["subtree_end"]]
        assert all(x.depth > r.depth for x in inside)
        assert r["subtree_end"] == len(order) or order[r["subtree_end"]].depth <= r.depth
        assert r.n_leaves == sum(x.n_children == 0 for x in [r, *inside])


def test_trie_equals_sql(spark):
    assert mismatch(queries()["op12_prefix_trie"](spark, DIR), connect(DIR), oracle_sql()["op12_prefix_trie"]) is None


def test_long_runs_of_equal_conversations(spark, monkeypatch):
    """A third of all conversations are equal: their ids are hashed in chunks over several ranges."""
    monkeypatch.setattr(trie, "CHUNK_CHARS", 200)
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} of {c}") for c in range(3000) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(r)[:8] for r in got), key=str) == _brute_trie(rows)


def test_trie_of_odd_rows(spark):
    df = spark.createDataFrame(_talks(n=5), TURNS)
    assert trie.conversation_trie(df.limit(0)).count() == 0
    # All turns taken from an absent base: a conversation without turns still is a member of the root.
    lone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1)
    got = trie.conversation_trie(spark.createDataFrame([(lone, 1, "user", "hi", "s")], TURNS)).collect()
    assert [tuple(r)[:8] for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    # Repeated rows are turns of their own; a very long text is one turn.
    twice = [(20, 1, "user", "word " * 200_000, "s")] * 2
    assert sorted((tuple(r)[:8] for r in trie.conversation_trie(spark.createDataFrame(twice, TURNS)).collect()), key=str) == _brute_trie([r[:4] for r in twice])


def test_nodes_carry_their_texts(spark):
    df = spark.createDataFrame([(20, 1, "user", "hi"), (20, 2, "bot", None), (40, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    nodes = trie.with_texts(trie.trie(trie.sequences(df)), df).orderBy("rank").collect()
    assert [(r.depth, r.role, r.text, r.n_convs) for r in nodes] == [(0, None, None, 2), (1, "user", "hi", 2), (2, "bot", "", 1)]


# Operator 13

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute_phrases(docs, least, most, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, total in n.items():
        own = f[lang]
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        gone = {y[i : i + m] for y, b in found.items() for m in range(2, len(y)) for i in range(len(y) - m + 1) if 100 * b >= 100 * found[y[i : i + m]]}
        rows = []
        for p in set(found) - gone:
            score, k = min((1000 * own[p] * total // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -own[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], total, -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_phrases_equal_sql(spark):
    assert mismatch(queries()["op13_phrase_collocations"](spark, DIR), connect(DIR), oracle_sql()["op13_phrase_collocations"]) is None


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    """With ordinary shards, and with very small ones, whose lists are added up."""
    docs = _table(spark, DIR, "documents")
    if small:
        monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
        docs = docs.repartition(13)
    got = phrases.collocations(docs, 4, 5, 400).collect()
    assert sorted(map(tuple, got)) == _brute_phrases([(r.lang, r.text) for r in docs.collect()], 4, 5, 400)


def test_phrases_of_odd_rows(spark):
    rows = [(1, "A b\tc  d. a B c d", "x", "s")] * 3 + [(2, None, "x", "s"), (3, "", None, "s"), (4, "Été là\x0bété là! ÉTÉ là", None, "s"), (5, "a b " * 60_000, "y", "s"), (6, "b c;c b c", "und", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, N string")
    for least in (1, 2, 3):
        got = phrases.collocations(docs, least, 5, 100).collect()
        assert sorted(map(tuple, got)) == _brute_phrases([(r[2], r[1]) for r in rows], least, 5, 100)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_automaton_counts_all_substrings():
    rng = random.Random(4)
    for _ in range(60):
        runs = [([rng.randint(0, 2) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
        automaton, want = phrases.SuffixAutomaton(), Counter()
        for r, weight in runs:
            automaton.add(r, weight)
            for i in range(len(r)):
                for n in range(1, min(5, len(r) - i) + 1):
                    want[tuple(r[i : i + n])] += weight
        got = list(automaton.substrings(1, 5))
        assert len(got) == len(want) and {tuple(s): n for s, n in got} == want
