"""Mixing sources to target weights by iterative proportional fitting (operator 7, native).

Documents are counted once into cells of (source, language, topic) with their tokens; the cells are
few and pre-aggregate before they shuffle. Raking scales the cells' token weights to the source,
language and topic marginals in turn until they hold; the factor of a cell, calibrated so
that the expected tokens meet the budget with no probability above 1, is the probability with which
each of its documents is sampled. Marginals are given by the caller for any axis; the others are tempered natural shares. A document's uniform number comes from a hash of its id, so a
rerun draws the same sample. DataFrame functions only.

Defined results: null source or language is the category ``(none)``; a null or empty text has no
tokens, the topic of an empty text, and its cell's probability (0 tokens leave a cell its natural
factor 1); categories that a given marginal does not name share what it leaves of 1 as they do by nature, or get
nothing where it leaves nothing; rows of equal id are drawn together; ties cannot arise as each row is judged alone. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import discard, private, stored

AXES = ("source", "lang", "topic")
#: The first phrase found names the topic.
TOPICS = (("license", "licen"), ("contact", "@"), ("web", "http"))
OTHER = "prose"
NONE = "(none)"
#: Target share of a category: its natural share to this power, normalised. 1 keeps the natural mix.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Raking ends when no weight moves by more than this, and after so many rounds at the latest: marginals that
#: contradict each other, as no cells join them, never hold all at once.
TOLERANCE = 1e-9
MOST_ROUNDS = 500
#: Expected share of all tokens that the sample holds.
KEEP = 0.5


def topic_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, phrase in TOPICS:
        hit = F.contains(low, F.lit(phrase))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def tokens_of(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's digest (null ids share one)."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(NONE))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def described(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of each row."""
    named = lambda c: F.coalesce(F.col(c), F.lit(NONE)).alias(c)
    return documents.select("doc_id", named("source"), named("lang"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("t"), F.count("*").alias("n"))


def _target(cells: DataFrame, axis: str, temper: dict[str, float], given: dict[str, float] | None) -> DataFrame:
    """``category, target_<axis>`` of the categories with tokens; a table as small as the cells are."""
    own = cells.groupBy(axis).agg(F.sum("t").alias("raw")).where("raw > 0")
    if given is None:
        own = own.join(F.broadcast(own.agg(F.sum("raw").alias("whole")))).withColumn("raw", F.pow(F.col("raw") / F.col("whole"), F.lit(float(temper[axis])))).drop("whole")
    else:
        left = max(0.0, 1.0 - sum(given.values()))
        named = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
        known = F.col(axis).isin(*given)
        others = own.where(~known).agg(F.sum("raw").alias("others"))
        own = own.join(F.broadcast(others)).withColumn("raw", F.when(known, F.element_at(named, F.col(axis))).otherwise(F.lit(left) * F.col("raw") / F.col("others"))).drop("others")
    whole = own.agg(F.sum("raw").alias("whole"))
    return own.join(F.broadcast(whole)).select(F.col(axis).alias("category"), F.when(F.col("whole") > 0, F.col("raw") / F.col("whole")).otherwise(0.0).alias(f"target_{axis}"))


def rake(cells: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds ``f``, the raked weight of each cell over its tokens (1 where it has none).

    Shares are of all tokens. ``targets`` gives the marginal of an axis, such as ``{"source": {"a": 0.6}}``; an axis without
    one has its tempered natural shares.
    """
    temper, targets = TEMPER | (temper or {}), targets or {}
    everything = cells.agg(F.sum("t").alias("total"))
    now = cells.join(F.broadcast(everything)).withColumn("w", F.when(F.col("total") > 0, F.col("t") / F.col("total")).otherwise(0.0))
    for axis in AXES:
        target = _target(cells, axis, temper, targets.get(axis))
        now = now.join(F.broadcast(target), now[axis] == target["category"], "left").drop("category")
    now = stored(now, "mixing-cells")
    for _ in range(MOST_ROUNDS):
        after = now.withColumn("before", F.col("w"))
        for axis in AXES:
            after = after.withColumn("sum", F.sum("w").over(Window.partitionBy(axis)))
            after = after.withColumn("w", F.when(F.col("sum") > 0, F.col("w") * F.col(f"target_{axis}") / F.col("sum")).otherwise(0.0)).drop("sum")
        # Written each round: the plan stays one round long.
        after = stored(after, "mixing-cells")
        moved = after.agg(F.max(F.abs(F.col("w") - F.col("before")))).first()[0] or 0.0
        discard(now)
        now = after.drop("before")
        now._stored_at = after._stored_at
        if moved <= TOLERANCE:
            break
    natural = F.col("t") / F.col("total")
    return now.withColumn("f", F.when(natural > 0, F.col("w") / natural).otherwise(1.0))


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``p``: ``min(1, c f)`` with c such that the expected tokens are ``keep`` of all, or as near as cells of weight allow.

    Each step finds the c that the cells below 1 must bear; c only grows, so the set of full cells does, and the steps
    end when it stays as it is. A step reads two sums.
    """
    every = raked.agg(F.sum("t")).first()[0] or 0.0
    scale, full = 0.0, -1.0
    while True:
        at_one = F.col("f") * F.lit(scale) >= 1
        got = raked.where("f > 0").agg(F.sum(F.when(at_one, F.col("t"))).alias("full"), F.sum(F.when(~at_one, F.col("t") * F.col("f"))).alias("rest")).first()
        now, rest = got.full or 0.0, got.rest or 0.0
        if now == full or rest <= 0:
            break
        full, scale = now, max(scale, (keep * every - now) / rest)
    return raked.withColumn("p", F.when(F.col("f") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(scale if every else keep) * F.col("f"))))


def probabilities(rows: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``source, lang, topic, f, p`` of each cell of ``described`` rows, written. The rows are counted once."""
    cells = stored(cells_of(rows), "mixing-counts")
    raked = rake(cells, temper, targets)
    out = stored(calibrate(raked, keep).select(*AXES, "f", F.round("p", 6).alias("p")), "mixing-p")
    discard(cells)
    return out


def sample(documents: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per input row: doc_id, its cell, tokens, raked weight, probability and whether it is drawn."""
    rows = described(documents)
    # A cell of a third of all rows is split by AQE's skew join: both sides are plain shuffles.
    joined = rows.join(probabilities(rows, keep, temper, targets), list(AXES))
    return joined.select(
        "doc_id",
        *AXES,
        "tokens",
        F.round("f", 6).alias("weight"),
        F.col("p").alias("probability"),
        (uniform(F.col("doc_id")) < F.col("p")).alias("drawn"),
    )


def drawn(documents: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of ``documents`` with all their columns."""
    cell = [private(documents, a) for a in AXES]
    share = private(documents, "p")
    p = probabilities(described(documents), keep, temper, targets).select(*[F.col(a).alias(c) for a, c in zip(AXES, cell, strict=True)], F.col("p").alias(share))
    named = dict(zip(cell, (F.coalesce("source", F.lit(NONE)), F.coalesce("lang", F.lit(NONE)), topic_of(F.col("text"))), strict=True))
    return documents.withColumns(named).join(p, cell).where(uniform(F.col("doc_id")) < F.col(share)).select(*documents.columns)


def _oracle() -> str:
    case = " ".join(f"when contains(low, '{phrase}') then '{name}'" for name, phrase in TOPICS)
    parts = [
        "d as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, lower(coalesce(text, '')) as low, "
        "len(regexp_extract_all(coalesce(text, ''), '\\S+'))::bigint as tokens from documents)",
        f"r as (select doc_id, source, lang, case {case} else '{OTHER}' end as topic, tokens from d)",
        "c as (select source, lang, topic, sum(tokens)::double as t from r group by all)",
        "tot as (select sum(t) as total from c)",
    ]
    for a in AXES:
        parts.append(f"s_{a} as (select {a}, pow(sum(t) / max(total), {TEMPER[a]}) as raw from c, tot group by {a} having sum(t) > 0)")
        parts.append(f"g_{a} as (select {a}, raw / (select sum(raw) from s_{a}) as target_{a} from s_{a})")
    joins = " ".join(f"left join g_{a} using ({a})" for a in AXES)
    parts.append(f"w0 as (select c.*, total, case when total > 0 then t / total else 0 end as w, target_source, target_lang, target_topic from c cross join tot {joins})")
    k = 0
    # SQL has no loop that ends by a test of sums; so many rounds are past the point where six digits move.
    for _ in range(30):
        for a in AXES:
            parts.append(
                f"w{k + 1} as (select * replace (case when sum(w) over (partition by {a}) > 0 then w * target_{a} / sum(w) over (partition by {a}) else 0 end as w) from w{k})"
            )
            k += 1
    parts.append(f"p0 as (select source, lang, topic, t, case when t > 0 then w / (t / total) else 1 end as f from w{k})")
    parts.append(
        "o as (select f, coalesce(sum(t) over (order by f desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as taken, "
        "sum(t * f) over (order by f desc, source, lang, topic rows between current row and unbounded following) as rest, sum(t) over () as every from p0 where t > 0)"
    )
    parts.append(f"s as (select max(c) as c from (select f, greatest(0, {KEEP} * every - taken) / rest as c from o where rest > 0) where c * f <= 1)")
    parts.append("p as (select source, lang, topic, f, case when f <= 0 then 0 else least(1.0, coalesce(c, 1e9) * f) end as p from p0, s)")
    return (
        "with " + ", ".join(parts) + " select doc_id, source, lang, topic, tokens, round(f, 6) as weight, round(p, 6) as probability, "
        "(('0x' || substr(md5('mix:' || doc_id::varchar), 1, 8))::bigint / 4294967296.0) < round(p, 6) as drawn "
        "from r join p using (source, lang, topic)"
    )


ORACLE_SQL = _oracle()
