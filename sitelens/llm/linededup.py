"""Fuzzy line deduplication across a corpus (operator 10, native).

Lines of at least ``MIN_WORDS`` words are normalised: lower case, runs of letters, marks and digits joined
by single spaces; characters of scripts without spaces are words of their own. Equal normalised lines
collapse first. Two lines are linked when their edit similarity, ``1 - levenshtein / longer length`` over the
normalised lines, is at least ``SIMILARITY``; connected groups keep their earliest occurrence (least id,
then line number) and all others go. DataFrame functions only.

Candidates come from pigeonhole blocks over the words of a line. The words are dealt to blocks by their hash;
a changed word touches at most two blocks, so lines that differ in fewer than half as many words as there are
blocks share one whole. The number of blocks grows by two fifths with each doubling of the length, and lines just below a doubling have both
numbers. A block's key is the superimposed code of its words; blocks of little text have none. Lines of fewer than
``SHORT_WORDS`` words also have one key for all their words and one for all but each. Blocks cut from one 64-bit SimHash
found half of the links only (a changed word of ten moves nine bits), so SimHashes serve another end: pairs
more than ``RADIUS`` bits apart are not compared.

Each line meets its bucket's leader, the line of least hash; those that are not connected to it by then meet the
leader among themselves, ``ROUNDS`` times. Two lines that both reach a leader are connected through it. In buckets that
hold several groups even then, all pairs of lines of different groups meet, block by block, so that none that
shares a bucket is left out: the pairs nearest by SimHash first, in ``RINGS``, since most links are among them and a link
makes the pairs of the two groups that it joins needless. Pairs of lines that stay in different groups are all compared.

Defined results: lines of fewer words always stay and null texts stay null; rows equal in id and text count
as one document and come back as often as they went in, with the same lines; null ids come last in
the order; an empty table gives an empty one. Columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import connected_components, discard, private, release, row_keys, shuffle_parts, stored

MIN_WORDS = 5
SIMILARITY = 0.9
#: Lines of fewer words have keys of all words but one; lines of ``BLOCK_WORDS`` and more have blocks.
SHORT_WORDS, BLOCK_WORDS = 16, 10
#: Blocks of a line of up to twice ``BLOCK_CHARS`` characters, and how many times as many from each doubling on.
BLOCKS, BLOCK_CHARS, GROWTH = 3, 100, 1.4
#: A word of more than ``COMMON`` letters sets three bits of a block's code, another one, and one of fewer than
#: ``LEAST_BYTES`` none; codes of few bits are no key.
COMMON, LEAST_BYTES, LEAST_BITS = 3, 3, 10
#: Lines of edit similarity 0.9 rarely differ in more bits of 64; unrelated ones do in 32 on average.
RADIUS = 20
#: The last pairs of buckets meet in rings: those of up to so many bits apart, then those of the next ring that are not connected by then.
RINGS = (4, 8, RADIUS)
#: Meetings with a leader before that.
ROUNDS = 2
#: Lines of a bucket in one block; the last pairs of a bucket are formed by two blocks at a time.
BLOCK = 1024
#: A filter on wanted rows has so many bits for each and is broadcast up to ``FILTER_BITS`` (32 MB); beyond, rows shuffle.
BITS_EACH, FILTER_BITS = 64, 1 << 28
#: Tables of two longs of up to so many rows are broadcast themselves.
BROADCAST_ROWS = 400_000
#: Scripts that do not separate words.
SPACELESS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"

#: The bytes that circled letters begin with in UTF-8; those have a case but are no letters.
CIRCLED = b"\xe2\x93"


def normalised(low: Column) -> Column:
    """Words of a lower-case line joined by single spaces."""
    # Only text of more than 1.3 bytes a character can hold enough of those scripts to matter.
    apart = F.when(F.octet_length(low) * 10 > F.length(low) * 13, F.regexp_replace(low, SPACELESS, " $1 ")).otherwise(low)
    return F.trim(F.regexp_replace(apart, r"[^\p{L}\p{M}\p{N}]+", " "))


def with_norm(lines: DataFrame) -> DataFrame:
    """``lines`` with ``norm``, the ``normalised`` form of their column ``low``, which goes.

    A pattern is slow, so ``mask`` blanks all but digits and letters that have a case. Where that takes no bytes away, only ASCII was
    blanked and the rest are letters and digits, unless some are circled; other lines take the pattern.
    """
    rows = _once(lines, "blank", F.mask("low", F.lit(None), F.lit(None), F.lit(None), F.lit(" ")))
    few = F.octet_length("low") * 10 <= F.length("low") * 13
    plain = few & (F.octet_length("blank") == F.octet_length("low")) & ((F.octet_length("low") == F.length("low")) | ~F.contains(F.col("low").cast("binary"), F.lit(CIRCLED)))
    rows = _once(rows, "single", F.when(plain, F.replace("blank", F.lit("  "), F.lit(" "))))
    double = lambda c: F.contains(c, F.lit("  "))
    rows = _once(rows, "joined", F.when(double(F.col("single")), F.replace("single", F.lit("  "), F.lit(" "))).otherwise(F.col("single")))
    joined = F.when(double(F.col("joined")), F.regexp_replace("joined", "  +", " ")).otherwise(F.col("joined"))
    return _once(rows, "norm", F.when(F.col("joined").isNull(), normalised(F.col("low"))).otherwise(F.trim(joined))).drop("low", "blank", "single", "joined")


def has_words(n: int) -> Column:
    """Whether ``norm`` has at least ``n`` words; looks no farther than those."""
    return F.octet_length(F.substring_index("norm", " ", n - 1)) < F.octet_length("norm")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column through a generator, so the optimizer cannot copy its expression into later ones."""
    return rows.select(*rows.columns, F.explode(F.array(value)).alias(name))


def keyed(documents: DataFrame) -> DataFrame:
    k1, k2 = row_keys("doc_id", "text")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")


def occurrences(documents: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, line_no, norm, h1, h2`` of every line that takes part."""
    lines = keyed(documents).select("k1", "k2", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = _once(lines, "low", F.lower("line")).drop("line")
    rows = with_norm(lines).where(has_words(MIN_WORDS))
    return rows.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(11), "norm")})


def block_keys(found: DataFrame) -> DataFrame:
    """``node, key`` of the lines ``found(h1, norm)``; words of a line, and of its copies, combine before they shuffle."""
    level = F.greatest(F.lit(0), F.floor(F.log2(F.length("norm") / BLOCK_CHARS)).cast("int"))
    rows = _once(found.where(has_words(BLOCK_WORDS)).select("h1", "norm"), "level", level)
    edge = F.length("norm") >= SIMILARITY * BLOCK_CHARS * F.pow(F.lit(2.0), F.col("level") + 1)
    levels = F.when(edge, F.array("level", F.col("level") + 1)).otherwise(F.array("level"))
    count = F.transform(levels, lambda n: F.round(BLOCKS * F.pow(F.lit(GROWTH), n)).cast("long"))
    dealt = rows.select("h1", "norm", F.explode(count).alias("blocks")).select("h1", "blocks", F.explode(F.split("norm", " ")).alias("w"))
    dealt = dealt.where(F.octet_length("w") >= LEAST_BYTES).select("h1", "blocks", F.length("w").alias("letters"), F.xxhash64("w").alias("x"))
    one = lambda at: f"shiftleft(1L, cast(shiftrightunsigned(x, {at}) & 63 as int))"
    coded = dealt.select(
        "h1",
        F.expr("shiftleft(blocks, 32) | pmod(shiftrightunsigned(x, 20), blocks)").alias("block"),
        F.expr(f"if(letters > {COMMON}, {one(0)} | {one(6)} | {one(12)}, {one(0)})").alias("bits"),
    )
    coded = coded.groupBy("h1", "block").agg(F.bit_or("bits").alias("code")).where(F.bit_count("code") >= LEAST_BITS)
    keys = coded.select(F.col("h1").alias("node"), F.xxhash64("block", "code").alias("key"))
    short = found.where(~has_words(SHORT_WORDS))
    short = _once(short.select("h1", "norm"), "hs", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    short = _once(short, "whole", F.aggregate("hs", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h)))
    left = F.concat(F.array("whole"), F.transform("hs", lambda h: h.bitwiseXOR(F.col("whole"))))
    # These need no combining: copies of a line repeat its keys, and only keys of different lines go on.
    return keys.union(short.select(F.col("h1").alias("node"), F.explode(left).alias("key")))


def simhashes(texts: DataFrame) -> DataFrame:
    """``node, sim, chars``: the 64-bit SimHash of all words of ``texts(node, norm)``, two counters of 31 bits in a long, and the text's length."""
    words = texts.select("node", "norm", F.length("norm").alias("chars")).select("node", "chars", F.explode(F.split("norm", " ")).alias("w"))
    words = words.select("node", "chars", F.xxhash64("w").alias("x"))
    sums = [F.sum(F.expr(f"(shiftrightunsigned(x, {b}) & 1L) | shiftleft(shiftrightunsigned(x, {b + 32}) & 1L, 31)")).alias(f"c{b}") for b in range(32)]
    low = " | ".join(f"if(2 * (c{b} & 2147483647L) > n, {1 << b}L, 0L)" for b in range(32))
    high = " | ".join(f"if(2 * shiftrightunsigned(c{b}, 31) > n, shiftleft(1L, {b + 32}), 0L)" for b in range(32))
    counted = words.groupBy("node").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), *sums)
    return counted.select("node", F.expr(f"({low}) | ({high})").alias("sim"), "chars")


def _most(a: str, b: str) -> str:
    """The edits that lines of ``a`` and ``b`` characters may differ by."""
    return f"cast(floor({1 - SIMILARITY:.6f} * greatest({a}, {b}) + 1e-9) as int)"


def _maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in ``wanted``, by a bit filter with a size checked before it is broadcast; none that is in it is lost."""
    bits = 1 << max(15, (BITS_EACH * wanted.count()).bit_length())
    if bits > FILTER_BITS:
        return rows
    at = F.pmod(F.col(key), F.lit(bits))
    held = wanted.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_spot", F.bitmap_bit_position(at))
    joined = joined.join(F.broadcast(held), "_bucket")
    byte = "ascii(decode(substring(_bits, cast(_spot div 8 as int) + 1, 1), 'ISO-8859-1'))"
    return joined.where(F.expr(f"getbit(cast({byte} as long), cast(_spot % 8 as int)) = 1")).select(*rows.columns)


def _matched(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows joined to ``wanted`` by ``key``, of which at most few rows shuffle: ``wanted`` is broadcast up to ``BROADCAST_ROWS``,
    and beyond that filters the rows by bits first."""
    if wanted.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), key)
    return _maybe_in(rows, key, wanted.select(key)).join(wanted, key)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of line nodes whose texts reach the edit similarity.

    Common words at both ends are cut off first, which leaves the distance as it is. Pairing the words left, in order, bounds
    the distance from above: the words that one line has more go in at the place where that costs least. Only pairs beyond
    the bound need the distance itself.
    """
    side = lambda end, name: texts.select(F.col("node").alias(end), F.col("norm").alias(name))
    both = pairs.select("a", "b").join(side("a", "ta"), "a").join(side("b", "tb"), "b")
    both = both.withColumn("most", F.expr(_most("length(ta)", "length(tb)"))).where("abs(length(ta) - length(tb)) <= most")
    # Few bytes but much work: dealt evenly, whatever one leader's share is.
    both = both.repartition(shuffle_parts(pairs.sparkSession))
    both = _once(_once(both, "wa", F.split("ta", " ")), "wb", F.split("tb", " ")).drop("ta", "tb")
    differ = "array_position(zip_with({}, {}, (x, y) -> not (x <=> y)), true) - 1"
    both = _once(both, "head", F.expr(f"cast({differ.format('wa', 'wb')} as int)"))
    both = _once(both, "tail", F.expr(f"cast(least({differ.format('reverse(wa)', 'reverse(wb)')}, size(wa) - head, size(wb) - head) as int)"))
    rest = lambda w: F.expr(f"slice({w}, head + 1, size({w}) - head - tail)")
    both = _once(_once(both, "ra", rest("wa")), "rb", rest("wb")).drop("wa", "wb")
    both = both.selectExpr("a", "b", "most", "if(size(ra) <= size(rb), ra, rb) as ra", "if(size(ra) <= size(rb), rb, ra) as rb")
    apart = "zip_with(ra, {}, (x, y) -> if(x = y, 0, levenshtein(x, y)))"
    both = _once(_once(both, "more", F.expr("size(rb) - size(ra)")), "left", F.expr(apart.format("slice(rb, 1, size(ra))")))
    both = _once(both, "right", F.expr(f"if(more = 0, left, {apart.format('slice(rb, more + 1, size(ra))')})"))
    # With the extra words before word i + 1 and not before word i, pair i counts from the left and the extra words move on by one.
    step = "zip_with(zip_with(left, right, (x, y) -> x - y), zip_with(slice(rb, more + 1, size(ra)), slice(rb, 1, size(ra)), (x, y) -> length(x) - length(y)), (x, y) -> x + y)"
    start = "aggregate(right, 0, (s, d) -> s + d) + aggregate(slice(rb, 1, more), 0, (s, w) -> s + length(w) + 1)"
    both = _once(both, "start", F.expr(start))
    moved = f"aggregate({step}, named_struct('at', start, 'least', start), (s, d) -> named_struct('at', s.at + d, 'least', least(s.least, s.at + d)), s -> s.least)"
    both = _once(both, "close", F.expr(f"if(more = 0, start, {moved}) <= most"))
    closed = lambda w: f"concat(array_join({w}, ' '), if(size({w}) > 0, ' ', ''))"
    both = _once(_once(both, "ra_text", F.expr(f"if(close, '', {closed('ra')})")), "rb_text", F.expr(f"if(close, '', {closed('rb')})"))
    return both.where("close or levenshtein(ra_text, rb_text, most) >= 0").select("a", "b")


def _meetings(rows: DataFrame) -> DataFrame:
    """``key, node, leader`` of the ``rows(key, node)`` in buckets of several lines."""
    heads = stored(rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader"), "lines-heads")
    out = stored(_matched(rows, "key", heads).distinct(), "lines-hits")
    discard(heads)
    return out


def _apart(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """The meetings whose line is not connected to its leader yet."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    joined = hits.join(of("node"), "node", "left").join(of("leader"), "leader", "left")
    return joined.where(F.coalesce("_node", "node") != F.coalesce("_leader", "leader")).select("key", "node")


def _mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``key, node, part, blocks`` of the ``rows(key, node)`` in buckets that hold lines of several groups."""
    rows = rows.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = stored(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lines-mixed")
    out = stored(_matched(rows, "key", mixed), "lines-rest")
    discard(mixed)
    return out


def _ring(mixed: DataFrame, sims: DataFrame, above: int, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of lines of different groups that share a bucket, are more than ``above`` and up to ``radius`` bits apart by
    their SimHashes and not too different in length."""
    rows = mixed.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), "blocks").cast("int")).join(sims, "node")
    side = lambda end, i, j, span: rows.select("key", F.explode(span).alias(j), F.col("block").alias(i), *[F.col(c).alias(f"{end}_{c}") for c in ("node", "part", "sim", "chars")])
    first = side("a", "i", "j", F.sequence(F.col("block"), F.col("blocks") - 1))
    second = side("b", "j", "i", F.sequence(F.lit(0), F.col("block")))
    bits = F.bit_count(F.col("a_sim").bitwiseXOR(F.col("b_sim")))
    near = first.join(second.hint("merge"), ["key", "i", "j"]).where("a_part <> b_part and (i < j or a_node < b_node)").where((bits > above) & (bits <= radius))
    near = near.where(f"abs(a_chars - b_chars) <= {_most('a_chars', 'b_chars')}")
    return stored(near.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b")).distinct(), "lines-pairs")


def _joined(pairs: DataFrame, texts: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``groups`` with the links among ``pairs``."""
    links = stored(verified(pairs, texts), "lines-links")
    if groups is not None and links.isEmpty():
        discard(links)
        return groups
    out = stored(connected_components(links, "lines-cc", groups), "lines-groups")
    for old in (links, *((groups,) if groups is not None else ())):
        discard(old)
    return out


def line_groups(found: DataFrame) -> DataFrame:
    """``node, component`` of the lines ``found(h1, norm)`` that are linked to any other."""
    keys = stored(block_keys(found), "lines-keys")
    release(keys.sparkSession)
    hits = whole = _meetings(keys)
    discard(keys)
    release(keys.sparkSession)
    nodes = stored(hits.select("node").distinct(), "lines-nodes")
    texts = found.select(F.col("h1").alias("node"), "norm")
    texts = stored(_matched(texts, "node", nodes).dropDuplicates(["node"]), "lines-texts")
    sims = stored(simhashes(texts), "lines-sims")
    discard(nodes)
    side = lambda end: sims.select(F.col("node").alias(end), F.col("sim").alias(f"_{end}"), F.col("chars").alias(f"{end}_chars"))
    groups = None
    for _ in range(ROUNDS):
        if groups is not None:
            left = stored(_apart(hits, groups), "lines-left")
            hits = _meetings(left)
            discard(left)
            if hits.isEmpty():
                break
        pairs = hits.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= RADIUS)
        groups = _joined(near.where(f"abs(a_chars - b_chars) <= {_most('a_chars', 'b_chars')}"), texts, groups)
    rows, above = whole, -1
    for radius in RINGS:
        mixed = _mixed(rows, groups)
        if rows is not whole:
            discard(rows)
        rows = mixed
        if rows.isEmpty():
            break
        pairs = _ring(rows, sims, above, radius)
        groups = _joined(pairs, texts, groups)
        discard(pairs)
        above = radius
    for t in (*((hits,) if hits is not whole else ()), whole, rows, texts, sims):
        discard(t)
    return groups


def removals(documents: DataFrame) -> DataFrame:
    """``k1, k2, removed array<int>``: the line numbers that go, for each document that loses any."""
    found = stored(occurrences(documents), "lines-found")
    groups = line_groups(found)
    places = found.select("k1", "k2", "doc_id", "line_no", "h1", "h2")
    counted = places.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    named = counted.join(groups, counted["h1"] == groups["node"], "left").where("component is not null or copies > 1")
    named = stored(named.select("h1", "h2", F.coalesce("component", "h1").alias("group")), "lines-named")
    affected = stored(places.join(named, ["h1", "h2"]), "lines-affected")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "line_no")
    kept = stored(affected.groupBy("group").agg(F.min(order).alias("kept")), "lines-kept")
    gone = affected.join(kept, "group")
    gone = gone.where((F.col("kept.k1") != F.col("k1")) | (F.col("kept.k2") != F.col("k2")) | (F.col("kept.line_no") != F.col("line_no")))
    out = stored(gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "lines-removed")
    for t in (found, groups, named, affected, kept):
        discard(t)
    return out


def deduplicated(documents: DataFrame, n_lines: str = "n_lines", removed: str = "removed_lines") -> DataFrame:
    """``documents`` with their removed lines taken out of ``text``, and two more columns of the given names: the
    number of lines a document had and the numbers, from 0, of those that went."""
    taken = {c.lower() for c in documents.columns}
    if {n_lines.lower(), removed.lower()} & taken:
        raise ValueError(f"{n_lines!r} or {removed!r} is a column of the documents already")
    gone = removals(documents)
    c1, c2, all_lines = private(documents, "k1"), private(documents, "k2"), private(documents, "lines")
    k1, k2 = row_keys("doc_id", "text")
    rows = documents.withColumns({c1: k1, c2: k2})
    joined = rows.join(gone.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("removed").alias(removed)), [c1, c2], "left")
    # Numbers of a null removed list stay null, so the lines of documents that lose none are not cut apart twice.
    joined = _once(joined, all_lines, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), removed)
    left = F.array_join(F.transform(stay, lambda i: F.element_at(all_lines, i + 1)), "\n")
    return joined.select(
        *[F.when(F.col(removed).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in documents.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).alias(n_lines),
        F.coalesce(removed, F.array().cast("array<int>")).alias(removed),
    )
