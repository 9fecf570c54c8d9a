"""Phrase collocations (operator 13).

Texts are lower-cased in A to Z and cut into pieces at punctuation and line ends, pieces into words at spaces and tabs. For
each language, phrases of 2 to ``MOST_WORDS`` words that occur ``MIN_COUNT`` times are scored by their least likely cut.

A phrase is frequent only if all its parts are, so the shards list few substrings: words are counted first, then pairs of
frequent words, then triples of frequent pairs, each by one pass over the texts. From a pass to the next goes a filter of bits
of bounded size that may let infrequent ones through but holds back no frequent one; where there are so many that the filter
is full, the next pass lists more and counts the same.

In the last pass each shard builds a generalised suffix automaton over its runs of frequent triples, equal runs once with
their number. Its states are classes of substrings with equal end positions; counts go up along the suffix links, and each
state lists its substrings of bounded depth. The lists are added up over all shards. A phrase's suffix link leads to the phrase
without its first word, the mirrored link to that without its last: where counts agree along a link every occurrence of the shorter one is
one of the longer, and the shorter one goes.

Counts are exact: their keys are the words themselves, hashes serve the filters alone. Scores are computed in decimals of 38 digits, which
hold texts of 10^15 words.

Defined results: a null text has no words, a null language is ``und`` and counts with documents of that name; equal rows count
as often as they occur; a table without frequent phrases gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import discard, stored
from sitelens.llm.textkit import U, mix, span_hashes

MIN_COUNT = 100
MOST_WORDS = 5
TOP = 2000
#: A filter has so many bits for each member, and at most ``FILTER_BITS`` (16 MB).
BITS_EACH, FILTER_BITS = 16, 1 << 27
#: Bytes of text taken at once, entries that a shard holds before it lists them, and words of an automaton.
SLICE, HELD, AUTOMATON = 1 << 19, 1 << 21, 1 << 16
#: Candidates are ranked in so many parts of a language first.
PARTS = 64

#: Spaces between words, and what ends a piece.
SPACES, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

COUNTS = "lang string, phrase string, hash long, n long"


class Shard:
    """Words of a run of texts of one language: hashes, spans and whether the next word is in the same piece."""

    def __init__(self, lang: str, texts: list[str | None]) -> None:
        self.buf = _LOWER[np.frombuffer(b"\n".join((t or "").encode() for t in texts) + b"\n", np.uint8)]
        kind = _KIND[self.buf]
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        (self.hashes,) = span_hashes(self.buf, (self.starts, self.ends))
        # Languages have their own hashes.
        self.hashes ^= mix(np.array([zlib.crc32(lang.encode()) + 1], U))[0]
        piece = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(piece), bool)
        self.follows[:-1] = piece[1:] == piece[:-1]

    def phrases(self, first: np.ndarray, words: int) -> list[bytes]:
        """The texts of the phrases of so many words that begin at the given words."""
        raw = self.buf.tobytes()
        out = [raw[s:e] for s, e in zip(self.starts[first].tolist(), self.ends[first + words - 1].tolist(), strict=True)]
        return out if words == 1 else [b" ".join(p.replace(b"\t", b" ").split()) if b"\t" in p or b"  " in p else p for p in out]

    def pairs(self) -> np.ndarray:
        """A hash of each word and the next."""
        with np.errstate(over="ignore"):
            return mix(self.hashes[:-1] * U(3) + mix(self.hashes[1:]))

    def triples(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(pairs[:-1] * U(5) + mix(pairs[1:]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """The texts of each language in slices; a text is never cut."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= SLICE:
                yield lang, Shard(lang, held.pop(lang))
                sizes[lang] = 0
        for lang, texts in held.items():
            yield lang, Shard(lang, texts)


def _rows(lang: str | None, phrases: pa.Array | None, hashes: np.ndarray | None, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, step = len(counts), 1 << 16
    for at in range(0, n, step):
        k = min(step, n - at)
        texts = phrases[at : at + k] if phrases is not None else pa.nulls(k, pa.string())
        own = pa.array(hashes[at : at + k].view(np.int64)) if hashes is not None else pa.nulls(k, pa.int64())
        langs = pa.array([lang] * k, pa.string())
        yield pa.RecordBatch.from_arrays([langs, texts, own, pa.array(counts[at : at + k].astype(np.int64))], names=["lang", "phrase", "hash", "n"])


class _Listed:
    """Phrases with their counts as arrays, listed when many are held."""

    def __init__(self) -> None:
        #: Per language the hashes, counts, lengths and texts of each slice.
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]] = {}
        self.size = 0

    def add(self, lang: str, shard: Shard, first: np.ndarray, hashes: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
        distinct, at, counts = np.unique(hashes, return_index=True, return_counts=True)
        texts = shard.phrases(first[at], words)
        self.held.setdefault(lang, []).append((distinct, counts, np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)))
        self.size += len(distinct)
        if self.size >= HELD // 4:
            yield from self.listed()

    def listed(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.held):
            hashes, counts, lengths, texts = zip(*self.held.pop(lang), strict=True)
            distinct, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            offsets = np.zeros(len(back) + 1, np.int32)
            np.cumsum(np.concatenate(lengths), out=offsets[1:])
            every = pa.Array.from_buffers(pa.binary(), len(back), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])
            yield from _rows(lang, every.take(pa.array(first)).cast(pa.string()), distinct, np.bincount(back, np.concatenate(counts)).astype(np.int64))
        self.size = 0


class _Hashed:
    """Hashes with their counts, listed when many are held."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= HELD:
            yield from self.listed()

    def listed(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            hashes, counts = np.unique(np.concatenate(self.held), return_counts=True)
            yield from _rows(None, None, hashes, counts)
        self.held, self.size = [], 0


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U(len(bits) * 8 - 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _frequent(found: DataFrame) -> np.ndarray:
    """The filter of the ``hash`` values of ``found``, gathered as bitmaps of bounded size."""
    n = found.count()
    bits = min(FILTER_BITS, 1 << max(15, (BITS_EACH * n).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(bits - 1).cast("long"))
    # Values from 1 on lie in buckets from 1 on, at places from 0 on.
    maps = found.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        where = (row.bucket - 1) * 4096
        own = np.frombuffer(bytes(row.bits), np.uint8)[: len(out) - where]
        out[where : where + len(own)] = own
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    listed, totals = _Listed(), Counter()
    for lang, shard in _shards(batches):
        if len(shard.hashes):
            totals[lang] += len(shard.hashes)
            yield from listed.add(lang, shard, np.arange(len(shard.hashes)), shard.hashes, 1)
    yield from listed.listed()
    for lang, n in totals.items():
        yield from _rows(lang, None, None, np.array([n]))


def _linked(shard: Shard, words: np.ndarray) -> np.ndarray:
    """Whether both words of each pair in a piece may be frequent."""
    ok = _passes(words, shard.hashes)
    return shard.follows[:-1] & ok[:-1] & ok[1:]


def _pair_hashes(words: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed()
        for _, shard in _shards(batches):
            if len(shard.hashes) > 1:
                yield from hashed.add(shard.pairs()[_linked(shard, words)])
        yield from hashed.listed()

    return run


def _pairs_and_triples(words: np.ndarray, pairs: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, hashed = _Listed(), _Hashed()
        for lang, shard in _shards(batches):
            if len(shard.hashes) < 2:
                continue
            own = shard.pairs()
            hit = _linked(shard, words) & _passes(pairs, own)
            first = np.flatnonzero(hit)
            if len(first):
                yield from listed.add(lang, shard, first, own[first], 2)
                yield from hashed.add(shard.triples(own)[hit[:-1] & hit[1:]])
        yield from listed.listed()
        yield from hashed.listed()

    return run


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers, each with a weight."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        #: A place in ``letters`` where the state's substrings end.
        self.end, self.letters = [-1], []

    def _state(self, length: int, end: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        self.end.append(end)
        return len(self.link) - 1

    def _split(self, p: int, letter: int, q: int) -> int:
        """A state of its own for the shorter substrings of ``q``, those that ``letter`` leads to from ``p`` on."""
        clone = self._state(self.length[p] + 1, self.end[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(letter) == q:
            self.next[p][letter] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for letter in sequence:
            self.letters.append(letter)
            q = self.next[last].get(letter)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, letter, q)
            else:
                new = self._state(self.length[last] + 1, len(self.letters) - 1, {}, 0)
                p = last
                while p >= 0 and letter not in self.next[p]:
                    self.next[p][letter] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][letter]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, letter, q)
                last = new
            self.count[last] += weight

    def substrings(self, least: int, most: int) -> Iterator[tuple[list[int], int]]:
        """Each distinct substring of ``least`` to ``most`` letters with the weight of its end positions."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        for s in range(1, len(self.link)):
            end = self.end[s] + 1
            for n in range(max(least, self.length[self.link[s]] + 1), min(most, self.length[s]) + 1):
                yield self.letters[end - n : end], self.count[s]


def _substrings(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, dict[bytes, int]] = {}
        runs: dict[str, Counter] = {}
        sizes: Counter = Counter()

        def listed(lang: str) -> Iterator[pa.RecordBatch]:
            automaton, names = SuffixAutomaton(), list(vocabulary.pop(lang, {}))
            for sequence, weight in runs.pop(lang, Counter()).items():
                automaton.add(np.frombuffer(sequence, np.int32).tolist(), weight)
            sizes[lang] = 0
            phrases, counts = [], []
            for letters, n in automaton.substrings(3, most):
                phrases.append(b" ".join([names[i] for i in letters]))
                counts.append(n)
                if len(counts) == 1 << 16:
                    yield from _rows(lang, pa.array(phrases, pa.binary()).cast(pa.string()), None, np.array(counts))
                    phrases, counts = [], []
            yield from _rows(lang, pa.array(phrases, pa.binary()).cast(pa.string()), None, np.array(counts, np.int64))

        for lang, shard in _shards(batches):
            if len(shard.hashes) < 3:
                continue
            own = shard.pairs()
            hit = _linked(shard, words) & _passes(pairs, own)
            at = np.flatnonzero(hit[:-1] & hit[1:])
            at = at[_passes(triples, shard.triples(own)[at])]
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            begins, ends = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1] + 3
            used = np.zeros(len(shard.hashes) + 1, np.int32)
            np.add.at(used, begins, 1)
            np.add.at(used, ends, -1)
            place = np.flatnonzero(np.cumsum(used[:-1]) > 0)
            distinct, first, back = np.unique(shard.hashes[place], return_index=True, return_inverse=True)
            known = vocabulary.setdefault(lang, {})
            ids = np.array([known.setdefault(w, len(known)) for w in shard.phrases(place[first], 1)], np.int32)
            letters = np.zeros(len(shard.hashes), np.int32)
            letters[place] = ids[back]
            found = runs.setdefault(lang, Counter())
            for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                sequence = letters[b:e].tobytes()
                if sequence not in found:
                    sizes[lang] += e - b
                found[sequence] += 1
            if sizes[lang] >= AUTOMATON:
                yield from listed(lang)
        for lang in list(runs):
            yield from listed(lang)

    return run


def phrase_counts(documents: DataFrame, least: int = MIN_COUNT, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, a)`` of all frequent words and phrases, and ``(lang, n)``, the number of words of each language."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = lambda f, keys: docs.mapInArrow(f, COUNTS).groupBy(*keys).agg(F.sum("n").alias("n"), *([] if "hash" in keys else [F.min("hash").alias("hash")]))
    words = stored(counted(_words, ["lang", "phrase"]).where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases-words")
    singles = words.where("phrase is not null")
    context = documents.sparkSession.sparkContext
    share = lambda found: context.broadcast(_frequent(found))
    w = share(singles.select("hash"))
    p = stored(docs.mapInArrow(lambda it: _pair_hashes(w.value)(it), COUNTS).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases-pairs")
    pairs = share(p.select("hash"))
    both = stored(counted(lambda it: _pairs_and_triples(w.value, pairs.value)(it), ["lang", "phrase", "hash"]).where(F.col("n") >= least), "phrases-triples")
    triples = share(both.where("phrase is null").select("hash"))
    longer = counted(lambda it: _substrings(w.value, pairs.value, triples.value, most)(it), ["lang", "phrase"]).where(F.col("n") >= least)
    every = singles.select("lang", "phrase", "n").union(both.where("phrase is not null").select("lang", "phrase", "n"))
    if most > 2:
        every = every.union(longer.select("lang", "phrase", "n"))
    frequent = stored(every.withColumnRenamed("n", "a"), "phrases-frequent")
    totals = stored(words.where("phrase is null").select("lang", "n"), "phrases-totals")
    for t in (words, p, both):
        discard(t)
    for b in (w, pairs, triples):
        b.destroy()
    return frequent, totals


def collocations(documents: DataFrame, least: int = MIN_COUNT, most: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    frequent, totals = phrase_counts(documents, least, most)
    phrases = frequent.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    many = F.col("size") > 1
    links = phrases.where("size > 2").select("lang", F.explode(F.array(part(F.lit(2), F.col("size") - 1), part(F.lit(1), F.col("size") - 1))).alias("phrase"), "a")
    longest = links.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = phrases.where(many).join(longest, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda end, name: frequent.select("lang", F.col("phrase").alias(end), F.col("a").alias(name))
    known = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast(cast(a as decimal(15,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as long)")
    lowest = known.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.min("a").alias("a"), F.min("n").alias("n"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Two steps: no task ranks all candidates of a language.
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
