"""Mixing sources to target token weights by entropy balancing.

Each source gets a target number of words (its weight's share of ``share`` x all words, capped at
``cap`` x its own size, the excess shared again: a water level over the sources).  Documents get
rates between 0 and ``cap`` that meet the targets and stay as close as possible, in bounded entropy,
to rate ``cap / 2``: the convex dual has one variable per source, and its solution is the
exponential tilt ``rate / (cap - rate) = exp(lambda_s * size / mean size_s)``.  The dual is solved by
distributed Newton iterations, safeguarded by a bracket: each is one aggregate per source over the
(source, size) histogram.

Rates are then rounded into whole copies.  Per source one systematic sequence runs over the sizes
from large to small: a size class gets the copies ``round(R) - round(R_before)`` of its running rate
R, so neighbouring sizes balance each other, and a few single copies are then added or taken where
that brings the source nearer to its target.  Inside a class the copies are spread evenly by the
documents' places in it, in order of a hash of id and text.  Running sums are made of counts per (source, size) and 256 slices of each,
never by passing a source through one task.  All sums are of integers, so reruns agree to the copy.

Defined results: a NULL text has size 0; a NULL source is a source of its own and comes last; ids
may be NULL; rows repeated with one id are documents of their own; a table without words takes
nothing; an empty table gives an empty result; other columns are ignored or, with ``carry``,
passed through as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import text_or_empty, written

_ONE = 1 << 32  # rates are multiples of 2**-32
_SCALE = 1e6  # words and their derivatives are summed in millionths
SLICES = 256
NEWTON_STEPS = 60
CORRECTIONS = 3


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column: every word becomes one letter, white space goes."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to one row per source (``skey``, ``source``, ``source_size``).

    Weights repeat over the sources in code point order, NULL last.  The water level is that of the
    first source, in ascending order of ``cap * size / weight``, whose cap is not below it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    rows = sources.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = share * F.sum("source_size").over(every)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                           / F.sum("w").over(onward))
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))
                  ).over(every)["level"]
    return rows.withColumn("top", first).select(
        "skey", "source", "source_size", F.least("most", F.coalesce(F.col("top") * F.col("w"), F.col("most")))
        .alias("target"))


def _rate(lam, size, mean, cap: float):
    z = F.least(F.greatest(lam * size / mean, F.lit(-700.0)), F.lit(700.0))
    return cap / (F.lit(1.0) + F.exp(-z))


def balanced_rates(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Dual variables ``lam`` per source (``skey``): Newton steps inside a shrinking bracket.

    ``histogram``: ``skey``, ``size``, ``n``.  A source at its cap or without words needs no solution.  What
    ``NEWTON_STEPS`` steps leave open is bisected to convergence: until the words meet the target, the bracket is as
    narrow as a double can tell, or all rates are at their bounds.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
    state = written(targets.where(open_).select(
        "skey", "target", F.col("mean"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), "dual")
    step = 0
    while not state.where(~F.col("done")).isEmpty():
        step += 1
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        words = F.sum(F.round(F.col("n") * F.col("size") * r * _SCALE).cast("decimal(38,0)")).cast("double") / _SCALE
        slope = F.sum(F.round(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / cap) * _SCALE)
                      .cast("decimal(38,0)")).cast("double") / _SCALE
        sums = (histogram.where("size > 0").join(state.select("skey", "lam", "mean"), "skey").groupBy("skey")
                .agg(words.alias("words"), slope.alias("slope")))
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # outside the bracket, or without a slope: halve it, or double the step where one end is open
        reach = F.greatest(F.abs("lam") * 2, F.lit(1.0))
        guarded = (F.when((newton > F.coalesce("low2", F.col("lam") - reach))
                          & (newton < F.coalesce("high2", F.col("lam") + reach)), newton)
                   .when(F.col("low2").isNull(), F.col("lam") - reach)
                   .when(F.col("high2").isNull(), F.col("lam") + reach)
                   .otherwise((F.col("low2") + F.col("high2")) / 2))
        if step > NEWTON_STEPS:
            guarded = (F.when(F.col("low2").isNull(), F.col("lam") - reach).when(F.col("high2").isNull(), F.col("lam") + reach)
                       .otherwise((F.col("low2") + F.col("high2")) / 2))
        narrow = F.coalesce(F.col("high2") - F.col("low2") <= F.abs("lam") * 1e-15 + 1e-300, F.lit(False))
        close = (F.abs(gap) <= F.col("target") * 1e-9 + 0.01) | narrow | (F.abs("lam") > 1e12)
        state = written(state.join(sums, "skey").withColumn("low2", low).withColumn("high2", high).select(
            "skey", "target", "mean",
            F.when(close | F.col("done"), F.col("lam")).otherwise(guarded).alias("lam"),
            F.col("low2").alias("low"), F.col("high2").alias("high"), (close | F.col("done")).alias("done")), "dual")
    return state.select("skey", "lam")


def _corrected(sizes: DataFrame, cap: int) -> DataFrame:
    """One copy more or less in the size class of every source that brings its words nearest to the target."""
    own = Window.partitionBy("skey")
    over = F.sum(F.col("copies") * F.col("size")).over(own) - F.col("target")
    gain = F.abs("over") - F.abs(F.abs(F.col("over")) - F.col("size"))
    can = F.when(F.col("over") > 0, F.col("copies") > 0).otherwise(F.col("copies") < cap * F.col("n"))
    sizes = sizes.withColumn("over", over).withColumn("gain", F.when(can & (gain > 0), gain))
    best = F.row_number().over(own.orderBy(F.desc_nulls_last("gain"), "size"))
    step = F.when((best == 1) & F.col("gain").isNotNull(), -F.signum("over").cast("long")).otherwise(F.lit(0))
    return sizes.withColumn("step", step).withColumn("copies", F.col("copies") + F.col("step")).drop(
        "over", "gain", "step")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                carry: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    ``taken = copies * size`` words; with ``carry`` the input row comes along in the struct ``row``.
    """
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
        word_count(text_or_empty(text_col)).alias("size"), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("h"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    slices = written(rows.groupBy("skey", "source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "slices")
    histogram = written(slices.groupBy("skey", "source", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = histogram.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                                      F.sum("n").alias("docs"))
    targets = written(source_targets(sources.drop("docs"), weights, share, float(cap))
                      .join(sources.select("skey", (F.col("source_size") / F.col("docs")).alias("mean")), "skey"),
                      "targets")
    duals = balanced_rates(histogram, targets, float(cap))

    solved = targets.join(duals, "skey", "left").select("skey", "source_size", "target", "mean", "lam")
    rate = (F.when(F.col("lam").isNotNull(), _rate(F.col("lam"), F.col("size"), F.col("mean"), float(cap)))
            .when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0)))
    fixed = F.least(F.round(rate * _ONE), F.lit(float(cap) * _ONE)).cast("decimal(20,0)")
    sizes = histogram.select("skey", "size", "n").join(solved, "skey").withColumn("rate", fixed)
    upto = Window.partitionBy("skey").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,0)")).over(upto)
    half = F.lit(_ONE // 2)
    sizes = sizes.withColumn("upto", running.cast("decimal(38,0)")).withColumn("copies", (
        F.floor((F.col("upto") + half) / F.lit(_ONE))
        - F.floor((F.col("upto") - F.col("n") * F.col("rate") + half) / F.lit(_ONE))).cast("long"))
    for _ in range(CORRECTIONS):
        sizes = _corrected(sizes, cap)
    sizes = sizes.select("skey", "size", F.col("n").alias("docs"), F.col("copies").alias("total"), "source_size",
                         "target")
    within = Window.partitionBy("skey", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = (slices.select("skey", "size", "slice",
                            F.coalesce(F.sum("n").over(within), F.lit(0)).alias("skip"))
              .join(sizes, ["skey", "size"]))
    # rows with NULL or one repeated id are dealt to the slices by their texts, too
    nth = Window.partitionBy("skey", "size", "slice").orderBy("h", F.col(id_col))
    ranked = rows.join(places, ["skey", "size", "slice"]).withColumn("j", F.col("skip") + F.row_number().over(nth) - 1)
    turns = [F.expr(f"(j + {k}) * total div docs") for k in (1, 0)]
    copies = (turns[0] - turns[1]).cast("long")
    return ranked.select(id_col, "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                         copies.alias("copies"), *(["row"] if carry else []))
