"""Phrases in texts by anchors, against a plain test of all pairs."""

from __future__ import annotations

import random

from sitelens.operators import containment

TEXTS, CLAIMS = "record_id long, text string", "flag_id long, original_claim string"


def test_contained_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "same text"), (903, "same text"), (904, "x" * 300_000 + "needle")]
    claims = [(i, word()) for i in range(60)]
    for i in range(60, 200):
        t = rng.choice(texts[:150])[1]
        at, size = rng.randrange(len(t) + 1), rng.choice([1, 2, 3, 7, 8, 30, 64, 65, 200])
        claims.append((i, t[at : at + size]))
    claims += [(300, None), (301, ""), (302, "same text"), (303, "same text"), (304, "xneedle"), (305, "needles")]
    want = {(c, t) for c, claim in claims if claim for t, text in texts if text and claim in text}
    got = containment.contained(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame(claims, CLAIMS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    # A full filter lets more windows through and loses none.
    monkeypatch.setattr(containment, "FILTER_BITS", 1 << 8)
    small = containment.contained(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(claims, CLAIMS))
    assert {tuple(r) for r in small.collect()} == want


def test_no_claims_and_no_texts(spark):
    texts, claims = spark.createDataFrame([(1, "text")], TEXTS), spark.createDataFrame([(1, "text")], CLAIMS)
    assert containment.contained(texts, claims.limit(0)).count() == 0
    assert containment.contained(texts.limit(0), claims).count() == 0
