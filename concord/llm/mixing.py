"""Mixing sources to target weights by temperature, in DataFrame expressions only.

A source with token share p gets the weight p^x / sum p^x. The exponent x is bisected to the largest value in [0, 1] whose
weights have at least the target entropy, or to the smallest one under which no source has to be repeated more than the
repetition limit. The budget is the tokens of one full pass over the source that is repeated least, so that every document
is used at least once, or a number given.

Weights become budgets, budgets become blocks: a source with budget b and n tokens gives floor(b / n) full blocks, each a
permutation of all its documents, and a last block that takes documents in the order of their permutation while they fit
the rest. A permutation is the order of a seeded hash. The last block's end is a hash value found by adding up tokens over
4096 ranges of the hash and then, within the one range where the budget ends, document by document; so no source meets in
one task, and which copies a document has follows from its own hash and its source's line of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, sized, unused

BUCKETS = 4096
STEPS = 12  # passes over the sources
CUTS = 16  # parts of the interval that a pass tells apart: four bisections


def tokens_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    blank = r"[\x20\x09-\x0D]+"
    return F.coalesce(F.size(F.filter(F.split(text, blank), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _hash(id_: Column, epoch: Column, seed: int) -> Column:
    """The place of a document in the permutation of an epoch: 0 to 2^52 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), id_), 12)


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, passes: float | None = None) -> float:
    """Bisects the exponent; a pass is one aggregate over the sources (share > 0), however many they are, and halves the
    interval four times.

    target_entropy: bits. Without one, the smallest exponent under which the most repeated source has at most max_repeats
    times the repetitions of the least repeated one, or, with passes (the budget over all tokens), at most max_repeats
    repetitions. Where even exponent 0 or 1 doesn't reach the target it is that one.
    """
    power, share = lambda x: F.pow("share", F.lit(x)), F.col("share")

    def reached(points: list[float]) -> list[bool]:
        """Whether the weights at a point are even enough (entropy), or still too even (repetitions)."""
        if target_entropy is not None:
            found = sources.agg(*[f for x in points for f in (F.sum(power(x)), F.sum(power(x) * x * F.log2("share")))]).first()
            return [z is None or math.log2(z) - e / z >= target_entropy for z, e in zip(found[::2], found[1::2], strict=True)]
        least = (lambda x: F.sum(power(x)) / passes) if passes is not None else (lambda x: F.min(power(x) / share))
        found = sources.agg(*[f for x in points for f in (least(x), F.max(power(x) / share))]).first()
        return [low is None or high > low * max_repeats * (1 + 1e-12) for low, high in zip(found[::2], found[1::2], strict=True)]

    low, high = 0.0, 1.0  # reached at low, not at high
    even, plain = reached([0.0, 1.0])
    if plain:
        return 1.0
    if not even:
        return 0.0
    for _ in range(STEPS):
        points = [low + (high - low) * i / CUTS for i in range(1, CUTS)]
        edges = [low, *(x for x, yes in zip(points, reached(points), strict=True) if yes)]
        low, high = edges[-1], [*points, high][len(edges) - 1]
    return low if target_entropy is not None else high


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float = 2.0, budget: float | None = None, seed: int = 42) -> DataFrame:
    """(source, tokens, share, weight, budget, epochs, whole, last): one row per source.

    epochs = budget / tokens, whole its integral part, and a document is in the last block if its hash there is at most
    last (-1: none is). Null sources are a source of their own. Sources without a token have share and weight 0, and one
    whole block, so that their documents are kept. An empty table gives no row.

    budget: tokens of the mixture. With one and no target entropy, max_repeats bounds every source's epochs; a budget over
    max_repeats times all tokens can't keep to it and is an error. With a target entropy the limit isn't looked at.
    """
    narrow = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), tokens_of(F.col(f"`{text_col}`")).alias("n"))
    narrow = durable(narrow)
    sums = narrow.groupBy("source").agg(F.sum("n").alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = durable(sums.withColumn("share", F.when(F.lit(total) > 0, F.col("tokens") / F.lit(float(max(1, total)))).otherwise(0.0)))
    live = sources.where("share > 0")
    passes = budget / total if budget is not None and total else None
    if passes is not None and target_entropy is None and passes > max_repeats * (1 + 1e-12):
        raise ValueError(f"a budget of {budget:g} tokens needs more than {max_repeats:g} passes over {total} tokens")
    x = exponent(live, target_entropy, max_repeats, passes)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(x))).otherwise(0.0)
    z = live.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / z)
    if budget is None:
        budget = live.agg(F.max(F.col("tokens") / (power / z))).first()[0] or 0.0
    # a hair more than the sum, so that the source the budget comes from has its full block
    weighted = weighted.withColumn("budget", F.col("weight") * budget * (1 + 1e-12))
    weighted = weighted.withColumn("epochs", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0))
    weighted = durable(weighted.withColumn("whole", F.floor("epochs").cast("int")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0.0)))

    known = sized(weighted.select("source", "whole", "rest"))
    left = narrow.alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.source", "d.n", "rest", _hash(F.col("d.id"), F.col("whole"), seed).alias("h"))
    left = left.where("rest > 0").withColumn("bucket", F.shiftrightunsigned("h", 40))
    by_bucket = durable(left.groupBy("source", "rest", "bucket").agg(F.sum("n").alias("n"), F.max("h").alias("h")))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = by_bucket.withColumn("upto", F.sum("n").over(order))
    full = run.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max("h").alias("h"))
    ends = sized(run.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("end")).select("source", "end.*"))
    inside = left.alias("l").join(ends.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")) & (F.col("l.bucket") == F.col("e.bucket"))).select("l.source", "l.n", "l.rest", "l.h", "before")
    inside = inside.groupBy("source", "rest", "before", "h").agg(F.sum("n").alias("n"))
    within = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    fine = within.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max("h").alias("h"))
    last = full.unionByName(fine).groupBy("source").agg(F.max("h").alias("last")).withColumnRenamed("source", "s")
    out = weighted.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return durable(out.select("source", "tokens", "share", "weight", "budget", "epochs", "whole", F.coalesce("last", F.lit(-1)).alias("last")))


def mix(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 42, epoch_out: str = "mix_epoch", key_out: str = "mix_key") -> DataFrame:
    """Each input row once for each block that takes it, with epoch_out (the number of the block within its source) and
    key_out (0 to 1): ordering by key_out interleaves all sources at their weights over the whole length of the mixture.

    Rows of one id share their places; rows equal in all columns are repeated alike. Columns of the two names are replaced.
    """
    keep = [c for c in docs.columns if c not in (epoch_out, key_out)]
    mine = {c: unused(docs, f"__{c}") for c in ("source", "whole", "last", "epochs")}
    source, whole, last, epochs = (F.col(c) for c in mine.values())
    known = sized(lines.select(*[F.col(c).alias(name) for c, name in mine.items()]))
    joined = docs.select(*[F.col(f"`{c}`") for c in keep]).join(known, F.col(f"`{source_col}`").eqNullSafe(source))
    id_ = F.col(f"`{id_col}`")
    extra = (last >= 0) & (_hash(id_, whole, seed) <= last)
    blocks = F.filter(F.sequence(F.lit(0), whole), lambda e: (e < whole) | extra)
    rows = joined.withColumn(epoch_out, F.explode(blocks))
    place = (F.col(epoch_out) + _hash(id_, F.col(epoch_out), seed) / F.lit(float(2**52))) / F.greatest(epochs, F.lit(1e-300))
    return rows.withColumn(key_out, F.least(place, F.lit(1.0))).select(*[F.col(f"`{c}`") for c in keep], epoch_out, key_out)
