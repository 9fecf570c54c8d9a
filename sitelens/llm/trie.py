"""Prefix trie of conversations (operator 12).

Conversations are sequences of turns; each distinct sequence of first turns is a node. Turns become 128-bit codes, and the
conversations are sorted by their arrays of codes, dealt by ranges: conversations of one node then lie next to each other, those
that end at it first. A node's interval of positions is the least and greatest position among its members. Nodes sorted by
first position and depth are in preorder, so a subtree is a run of nodes. Each node opens at its own place and
closes behind the last node of its interval; with prefix sums over these events, what a subtree holds is the sum at its
closing less the sum at its opening, without visiting it.

Hot nodes (the root, a common first turn) are counts, minima and maxima that combine before they shuffle. The ids of those
that end at one node are hashed as the sorted rows stream by; only runs that cross a border between two ranges, or are very long,
go on as chunks of text to a second pass. SHA-256 reads its input in order, so the chunks of one node are read by one task,
streamed, in bounded memory.

A conversation is one row with 24 bytes a turn; its texts are not in it.

Defined results: null conversation ids take no part; a null role or text is empty; turns are ordered with null first, and turns of
one number by their codes; repeated rows are turns of their own; an empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import discard, stored
from sitelens.llm.prefixsum import prefix_sums
from sitelens.llm.textkit import U, mix

WORD = r"[^\x20\x09-\x0D]+"
#: A run's ids leave in chunks of so many characters.
CHUNK_CHARS = 1 << 18
TURNS = "array<struct<turn:bigint,c1:bigint,c2:bigint,words:bigint>>"
#: Rows of the pass over the sorted conversations.
NODE, DIGEST, CHUNK = 0, 1, 2
PASSED = "kind int, h1 long, h2 long, p1 long, p2 long, c1 long, c2 long, depth long, pos long, conv_id long, words long, chunk string"
NO_IDS = hashlib.sha256(b"").hexdigest()


def _codes() -> tuple[Column, Column]:
    parts = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(13), *parts)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as codes and word counts."""
    c1, c2 = _codes()
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), c1.alias("c1"), c2.alias("c2"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Each conversation with the first h turns of the first of its family of ids before its own turns after h; h is the id's crc32
    modulo ``shared``."""
    base = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, shared).alias("base"))
    joined = convs.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % family).join(base, "base_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("base", 1, h), F.array().cast(TURNS)), own).alias("turns"))


class _Ends:
    """Hashes runs of equal paths as their conversation ids stream by."""

    def __init__(self) -> None:
        self.path, self.first, self.whole = None, True, False
        self.parts: list[str] = []
        self.chars = self.start = 0

    def take(self, path: tuple[int, int], ids: list[int], pos: int) -> Iterator[tuple]:
        if path != self.path:
            yield from self.close(False)
            # What the first run of a range holds may have begun in the range before.
            self.whole, self.path, self.start = not self.first, path, pos
            self.first = False
        for at in range(0, len(ids), 4096):
            text = ",".join(map(str, ids[at : at + 4096]))
            if not self.parts:
                self.start = pos + at
            self.parts.append(text)
            self.chars += len(text) + 1
            if self.chars >= CHUNK_CHARS:
                self.whole = False
                yield self._chunk()

    def close(self, last: bool) -> Iterator[tuple]:
        if self.path is None or not self.parts:
            return
        if self.whole and not last:
            yield (DIGEST, *self.path, self.start, hashlib.sha256(",".join(self.parts).encode()).hexdigest())
            self.parts, self.chars = [], 0
        else:
            yield self._chunk()

    def _chunk(self) -> tuple:
        out = (CHUNK, *self.path, self.start, ",".join(self.parts))
        self.parts, self.chars = [], 0
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on each sorted conversation's path, and what the runs of equal paths end in."""
    from pyspark import TaskContext

    base, ends = TaskContext.get().partitionId() << 33, _Ends()
    names = [x.split()[0] for x in PASSED.split(", ")]

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        full = [pa.array(columns[c], pa.string() if c == "chunk" else pa.int32() if c == "kind" else pa.int64()) if c in columns else pa.nulls(n, pa.string() if c == "chunk" else pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays(full, names=names)

    def ended(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            kind, h1, h2, pos, chunk = (list(x) for x in zip(*found, strict=True))
            yield rows({"kind": kind, "h1": h1, "h2": h2, "pos": pos, "chunk": chunk}, len(found))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        key, counts = batch.column("key"), batch.column("words")
        values = key.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).view(U)
        words = counts.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(counts.offsets.to_numpy())
        at = np.zeros(n + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        conv = np.repeat(np.arange(n), lengths)
        depth = np.arange(len(words), dtype=np.int64) - at[:-1][conv] + 1
        paths, parents, full = [], [], []
        with np.errstate(over="ignore"):
            for k in range(2):
                # A path's hash is the sum of its turns' hashes, each mixed with its depth.
                own = mix(values[:, k] ^ mix(depth.astype(U) * U(2) + U(k)))
                total = np.zeros(len(own) + 1, U)
                np.cumsum(own, out=total[1:])
                begun = total[at[:-1]]
                paths.append(total[1:] - begun[conv])
                parents.append(total[:-1] - begun[conv])
                full.append(total[at[1:]] - begun)
        pos = base + np.arange(n, dtype=np.int64)
        base += n
        yield rows({"kind": np.zeros(n, np.int32), "h1": np.zeros(n, np.int64), "h2": np.zeros(n, np.int64), "depth": np.zeros(n, np.int64), "pos": pos, "conv_id": ids, "words": np.zeros(n, np.int64)}, n)
        if len(words):
            yield rows(
                {
                    "kind": np.zeros(len(words), np.int32),
                    "h1": _signed(paths[0]),
                    "h2": _signed(paths[1]),
                    "p1": _signed(parents[0]),
                    "p2": _signed(parents[1]),
                    "c1": _signed(values[:, 0]),
                    "c2": _signed(values[:, 1]),
                    "depth": depth,
                    "pos": pos[conv],
                    "conv_id": ids[conv],
                    "words": words,
                },
                len(words),
            )
        f1, f2 = _signed(full[0]), _signed(full[1])
        change = np.flatnonzero(np.concatenate([[True], (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])]))
        found: list[tuple] = []
        for lo, hi in zip(change, np.append(change[1:], n), strict=True):
            found += ends.take((int(f1[lo]), int(f2[lo])), ids[lo:hi].tolist(), int(pos[lo]))
        yield from ended(found)
    yield from ended(list(ends.close(True)))


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a node, of its chunks in order."""
    node, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["h1", "h2", "ends_sha256"])

    for batch in batches:
        for h1, h2, chunk in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "chunk")), strict=True):
            if (h1, h2) != node:
                if node is not None:
                    yield out()
                node, digest = (h1, h2), hashlib.sha256(chunk.encode())
            else:
                digest.update(b"," + chunk.encode())
    if node is not None:
        yield out()


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of ``convs(conv_id, turns)``: their hashes and last turn's code, members, children, interval and subtree sums.

    ``rank`` is a node's place in preorder and ``subtree_end`` that of the first node behind its subtree.
    """
    flat = F.flatten(F.transform("turns", lambda t: F.array(t["c1"], t["c2"])))
    rows = convs.select("conv_id", flat.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    passed = stored(ordered.mapInArrow(_passed, PASSED), "trie-passed")
    once = {c: F.min(c).alias(c) for c in ("p1", "p2", "c1", "c2", "depth", "conv_id", "words")}
    nodes = stored(
        passed.where(F.col("kind") == NODE).groupBy("h1", "h2").agg(*once.values(), F.count("*").alias("n_convs"), F.min("pos").alias("first"), F.max("pos").alias("last")),
        "trie-nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    chunks = passed.where(F.col("kind") == CHUNK).select("h1", "h2", "pos", "chunk")
    joined = chunks.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "pos").mapInArrow(_joined_hashes, "h1 long, h2 long, ends_sha256 string")
    digests = passed.where(F.col("kind") == DIGEST).select("h1", "h2", F.col("chunk").alias("ends_sha256")).union(joined)
    known = nodes.join(parents, ["p1", "p2"], "left").join(children, ["h1", "h2"], "left").join(digests, ["h1", "h2"], "left")
    known = known.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_IDS))})
    known = stored(known, "trie-known")
    deepest = (1 << 62) - 1
    opened = known.select("h1", "h2", F.col("first").alias("pos"), "depth", F.lit(1).cast("long").alias("one"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    closed = known.select("h1", "h2", F.col("last").alias("pos"), F.lit(deepest).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("one", "leaf", "saved")])
    events = prefix_sums(opened.union(closed), ["pos", "depth", "h1", "h2"], {"rank": "one", "leaves": "leaf", "tokens": "saved"}, "trie-events")
    after, before = F.col("depth") == deepest, F.col("depth") != deepest
    grew = lambda c: F.sum(F.when(after, F.col(c)).otherwise(-F.col(c)))
    sums = events.groupBy("h1", "h2").agg(F.max(F.when(before, F.col("rank"))).alias("rank"), F.max(F.when(after, F.col("rank"))).alias("subtree_end"), grew("leaves").alias("n_leaves"), grew("tokens").alias("saved_tokens"))
    out = stored(known.drop("first", "last").join(sums, ["h1", "h2"]), "trie-out")
    for t in (passed, nodes, known, events):
        discard(t)
    return out


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turns (null for the root)."""
    c1, c2 = _codes()
    texts = conversations.select(c1.alias("c1"), c2.alias("c2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.join(texts.dropDuplicates(["c1", "c2"]), ["c1", "c2"], "left")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations with the contract's columns, and each node's preorder rank and subtree end."""
    convs = stored(sequences(conversations), "trie-convs")
    nodes = trie(rebuilt(convs))
    discard(convs)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "rank", "subtree_end")
