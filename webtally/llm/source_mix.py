"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of the words of the mix. Its documents get as many whole
copies as their expected number of copies has; the rest, a fraction, is the probability of one copy
more. Documents are ranked by the odds of a random number divided by the odds of that
probability, and the first are taken until their words fill what whole copies left of the
target. So the sample has a fixed size, in words, and document ``i`` is in it with about its
own probability. The document that would overshoot is passed over, and further rounds fill what
remains with the next ones that fit, until it is less than ``TOLERANCE`` of the target.

Expected copies are the same for all documents of a source, or go by a ``weight`` of each
document: then they are ``min(cap, level * weight)``, with the level that makes the source's words
meet its target.

Targets: sources in order of their name, NULL last, have the weights of ``cycle`` in turn and
share ``share`` of all words by them. No target is above ``cap`` times its source; what
that leaves over is shared by the others, until none is above.

A rank is cut by counting words per bucket of ranks, then within the one bucket of each source
where its target is met, until that holds ``LEAF`` rows at most: no task sees a whole source.
Random numbers are hashes of id and text, so reruns agree.

Defined results: NULL and empty texts have size 0 and are taken 0 words. NULL is a source of
its own. Rows equal in id, text, source and weight have the same rank and are taken alike,
whole groups of them at a time. A NULL or negative weight counts as 0. A source without
words has target 0; one whose documents with words all have the weight 0 is not taken.
Documents of any length are taken whole or not. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.ordering import numbered
from webtally.llm.workspace import stored

# Fixed value: a word is a run of anything but these blanks.
WORD = r"[^\x20\x09-\x0D]+"

SHARE = 1.5
CYCLE = (5, 2, 1)
CAP = 2
TOLERANCE = 0.001
ROUNDS = 8
# Rows among which a rank is cut in one task, and how finely a bucket of ranks is divided, at most so often.
LEAF = 1000
FINER = 256
LEVELS = 6
# Tables with one row per source are broadcast up to so many of them, and else joined on source and salt.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def random_number(key: Column, text: Column, seed: int = 0) -> Column:
    """A number between 0 and 1, both excluded, with 52 bits of a digest."""
    parts = (F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def _matched(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Every row with the one row of ``table`` for its source, wherever a source's rows are."""
    if small:
        return rows.join(F.broadcast(table), "place")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["place", "_salt"]).drop("_salt")


def source_targets(sizes: DataFrame, share: float = SHARE, cycle: Sequence[int] = CYCLE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` with the ``place`` of each source, from 0, and its ``target``."""
    table = numbered(sizes, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod("place", F.lit(len(cycle))).cast("int"))
    table = stored(table.withColumn("_weight", weight), "mix-places")
    most = F.lit(cap) * F.col("source_size")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:
        above = level * F.col("_weight") > most
        state = table.agg(
            F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("_weight"))), F.count(F.when(above, 1))
        ).first()
        if state[1] is None or state[2] == capped:
            break
        # the first look only adds up the weights
        capped = -1 if capped is None else state[2]
        level = (total - (state[0] or 0)) / state[1]
    target = F.least(most.cast("double"), F.lit(level) * F.col("_weight"))
    return table.select("source", "source_size", "place", target.alias("target"))


def _copies(rows: DataFrame, targets: DataFrame, cap: float, weighted: bool, small: bool) -> DataFrame:
    """Rows with ``expected`` copies: the level of a source times the weight of a document, ``cap`` at most."""
    if not weighted:
        known = targets.withColumn("level", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")))
        return _matched(rows, known, small).withColumn("expected", F.coalesce("level", F.lit(0.0))).drop("level")
    levels, before = targets.withColumn("level", F.lit(0.0)), None
    expected = F.col("level") * F.col("weight")
    while True:
        above = (expected > cap) & (F.col("size") > 0)
        sums = _matched(rows, levels, small).groupBy("place").agg(
            F.sum(F.when(above, F.col("size") * cap).otherwise(0.0)).alias("_full"),
            F.sum(F.when(~above, F.col("size") * F.col("weight")).otherwise(0.0)).alias("_rest"),
            F.count(F.when(above, 1)).alias("_above"),
        )
        state = stored(levels.drop("level").join(sums, "place"), "mix-levels")
        # where all are full the level goes beyond any weight, unless nothing has one
        level = F.when(F.col("_rest") > 0, (F.col("target") - F.col("_full")) / F.col("_rest"))
        level = level.otherwise(F.when(F.col("_above") > 0, F.lit(1e300)).otherwise(F.lit(0.0)))
        full = state.agg(F.coalesce(F.sum("_above"), F.lit(0))).first()[0]
        if full == before:
            break
        before = full if before is not None else -1
        levels = stored(state.withColumn("level", level).drop("_full", "_rest", "_above"), "mix-levels")
    return _matched(rows, levels, small).withColumn("expected", F.least(F.lit(float(cap)), expected)).drop("level")


def _cut(rows: DataFrame, gaps: DataFrame, small: bool, most: int) -> DataFrame:
    """``place, gap, threshold, inclusive, words``: the rank up to which the rows of a source fit into its gap.

    ``rows`` has ``place, rank, size, u``, ``most`` of them at most per source, and ``gaps`` has ``place, gap``.
    """
    # from 0 to 1, below 1 by rounding, and never falling where the rank grows
    fine = F.least(F.col("rank") / (1 + F.col("rank")), F.lit(1 - 2.0**-53))
    state = gaps.select("place", "gap", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("below"))
    open_rows = rows
    for level in range(1, LEVELS + 1):
        here = F.floor(fine * float(FINER ** (level - 1)))
        open_rows = _matched(rows, state, small).where((F.col("size") <= F.col("gap")) & (here == F.col("bucket")))
        if level > 1 or most > LEAF:
            most = open_rows.groupBy("place").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= LEAF or level == LEVELS:
            break
        buckets = open_rows.groupBy("place", "gap", "below", F.floor(fine * float(FINER**level)).alias("next")).agg(
            F.sum("size").alias("words")
        )
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("place").orderBy("next"))
        # the bucket in which the gap is filled, or the last one where it never is
        fits = F.col("upto") <= F.col("gap")
        order = F.struct(fits, F.when(fits, -F.col("next")).otherwise(F.col("next")))
        reached = F.min_by(F.struct("next", "before"), order)
        found = buckets.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        state = stored(
            found.groupBy("place", "gap").agg(reached.alias("at")).select(
                "place", "gap", F.col("at.next").alias("bucket"), F.col("at.before").alias("below")
            ),
            "mix-buckets",
        )
    groups = open_rows.groupBy("place", "gap", "below", "rank").agg(F.sum("size").alias("words"))
    upto = F.col("below") + F.sum("words").over(Window.partitionBy("place").orderBy("rank"))
    fitting = groups.withColumn("upto", upto).withColumn("fits", F.col("upto") <= F.col("gap"))
    last = fitting.groupBy("place", "gap").agg(
        F.max(F.when(F.col("fits"), F.col("rank"))).alias("threshold"),
        F.min("rank").alias("_first"),
        F.max(F.when(F.col("fits"), F.col("upto"))).alias("words"),
        F.min("below").alias("_below"),
    )
    # where not even the first of the bucket fits, the threshold is just below it
    return last.select(
        "place",
        "gap",
        F.coalesce("threshold", F.col("_first")).alias("threshold"),
        F.col("threshold").isNotNull().alias("inclusive"),
        F.coalesce("words", "_below").alias("words"),
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    cycle: Sequence[int] = CYCLE,
    cap: int = CAP,
    weight: str | None = None,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``: how often the mix has each document, and its words."""
    own_key, own_text = docs[f"`{key}`"], docs[f"`{text}`"]
    own_weight = F.lit(1.0) if weight is None else F.greatest(F.coalesce(docs[f"`{weight}`"].cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = stored(
        docs.select(
            own_key.alias("doc_id"),
            docs[f"`{source}`"].alias("source"),
            F.coalesce(F.regexp_count(own_text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            own_weight.alias("weight"),
            random_number(own_key, own_text, seed).alias("u"),
        ),
        "mix-sizes",
    )
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source-sizes")
    targets = stored(source_targets(sizes, share, cycle, cap), "mix-targets")
    n_sources, n_bytes = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    small = n_sources <= MAX_BROADCAST_SOURCES and n_bytes <= 8 << 20

    names = targets.select(F.col("source").alias("_name"), "place")
    if small:
        placed = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name")))
    else:
        salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")
        placed = sized.join(salted, F.col("source").eqNullSafe(F.col("_name")) & (salt == F.col("_salt"))).drop("_salt")
    placed = placed.drop("source", "_name")

    expected = _copies(placed, targets.drop("source"), cap, weight is not None, small)
    whole = F.floor("expected")
    chance = F.col("expected") - F.col("whole")
    rank = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    ranked = expected.withColumn("whole", whole).withColumn("rank", F.when((chance > 0) & (F.col("size") > 0), rank))
    ranked = stored(ranked.drop("weight", "expected"), "mix-ranked")

    # One row per source, rewritten each round: what is left to fill, and the cuts made so far.
    spent = ranked.groupBy("place").agg(F.sum(F.col("whole") * F.col("size")).alias("_spent"), F.count("rank").alias("n_ranked"))
    no_cuts = F.array().cast("array<struct<gap:double,threshold:double,inclusive:boolean>>").alias("cuts")
    state = targets.join(spent, "place").select("place", "target", (F.col("target") - F.col("_spent")).alias("gap"), no_cuts, "n_ranked")
    state = stored(state, "mix-state")
    is_open = (F.col("gap") > F.col("target") * TOLERANCE) & (F.col("gap") >= 1)
    candidates = ranked.where("rank IS NOT NULL").select("place", "rank", "size", "u")

    def taken(c: Column) -> Column:
        reached = F.when(c["inclusive"], F.col("rank") <= c["threshold"]).otherwise(F.col("rank") < c["threshold"])
        return (F.col("size") <= c["gap"]) & reached

    for _ in range(ROUNDS):
        most = state.where(is_open).agg(F.max("n_ranked")).first()[0]
        if not most:
            break
        left = _matched(candidates, state.where(is_open).select("place", "cuts"), small)
        left = left.where(~F.exists("cuts", taken)).drop("cuts")
        cut = _cut(left, state.where(is_open).select("place", "gap"), small, most).drop("gap")
        new = state.join(cut, "place", "left")
        made = F.array(F.struct("gap", "threshold", "inclusive"))
        state = stored(
            new.select(
                "place",
                "target",
                (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"),
                F.when(F.col("words").isNull(), F.col("cuts")).otherwise(F.concat("cuts", made)).alias("cuts"),
                # without a document that fits there is nothing more to do for the source
                F.when(F.col("words").isNotNull(), F.col("n_ranked")).alias("n_ranked"),
            ),
            "mix-state",
        )

    extra = F.when(F.col("rank").isNotNull() & F.exists("cuts", taken), 1).otherwise(0)
    result = _matched(ranked, state.select("place", "cuts"), small).withColumn("copies", (F.col("whole") + extra).cast("bigint"))
    return result.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
