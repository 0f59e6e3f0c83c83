"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

GRID = 33


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k = 0 .. cap - 1: a uniform number above k of them means k repetitions.

    Terms are summed through their logarithms, so no rate is too large.
    """
    if math.isinf(rate):
        return [-1.0] * cap
    if rate <= 0:
        return [1.0] * cap
    out, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
    return out


def mean_repeats(rate: float, cap: int) -> float:
    return sum(1 - c for c in poisson_steps(rate, cap)) if not math.isinf(rate) else float(cap)


def rate_for(mean: float, cap: int) -> float:
    """The rate at which min(Poisson, cap) has this mean; infinite where the cap does not allow it."""
    if mean <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    lo, hi = 0.0, 1.0
    while mean_repeats(hi, cap) < mean:
        if hi > 64 * cap + 1024:  # every document comes the greatest number of times, to the last digit
            return math.inf
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_repeats(mid, cap) < mean else (lo, mid)
    return hi


def _uniform(seed: int) -> Column:
    """A number in [0, 1) from the hash of seed, mix and document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix", "doc_id"), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) for every mix.

    ``docs`` is (doc_id, source, tokens), ``targets`` (mix, source, target_share, max_repeats).
    A mix is to hold ``total_tokens`` (by default as many as the documents of its sources), each
    source its share of them.  A source too small for that gives every document ``max_repeats``
    times, and what it really gives is reported.

    selection: (mix, source, doc_id, repeat_no, tokens, shuffle_key), in the order of
    ``shuffle_key``, a hash that spreads all copies over the whole mix.
    shares: (mix, source, target_share, target_tokens, tokens, actual_share, max_repeats, n_docs,
    n_used, is_short, exact_up_to), a row for each target, also where the source has no document;
    ``exact_up_to`` is the largest total at which this source is not short.

    Method: a document's number of repetitions is the Poisson quantile of its hashed uniform
    number, cut at ``max_repeats``.  The rate first gives the wanted mean under that cut; as few
    large documents can still miss the share, the rate is then moved - twice, over a grid, one
    aggregation each for all sources - to where the realised tokens come nearest to the target.
    The targets are a small table (a row per mix and source) and are read by the driver; nothing
    else is.  Documents without source, id or tokens are never used; a repeated document row
    counts as another document with the same draw; a target with a null or negative share, or no
    positive max_repeats, gets nothing.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").select("doc_id", "source", "tokens")
    sizes = {r["source"]: (r["tokens"], r["n"]) for r in docs.join(targets.select("source").distinct(), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    rows = [r.asDict() for r in targets.select("mix", "source", "target_share", "max_repeats").distinct().collect()]
    per_mix: dict[str, int] = {}
    for r in rows:
        per_mix[r["mix"]] = per_mix.get(r["mix"], 0) + sizes.get(r["source"], (0, 0))[0]
    plan = []
    for r in rows:
        cap, share = max(int(r["max_repeats"] or 0), 0), max(float(r["target_share"] or 0), 0.0)
        wanted = share * (per_mix[r["mix"]] if total_tokens is None else total_tokens)
        have = sizes.get(r["source"], (0, 0))[0]
        rate = rate_for(wanted / have, cap) if have and cap else 0.0
        plan.append({"mix": r["mix"], "source": r["source"], "cap": cap, "share": share, "wanted": wanted, "have": have, "rate": rate})

    drawn = lambda steps: docs.join(F.broadcast(steps), "source").withColumn("u", _uniform(seed))  # noqa: E731  (one row per target)
    live = [p for p in plan if p["have"] and p["cap"] and 0 < p["rate"] < math.inf]
    spread = 2.0
    for _ in range(2 if live else 0):
        grid = [[p["rate"] * spread ** ((g - GRID // 2) / (GRID // 2)) for g in range(GRID)] for p in live]
        steps = spark.createDataFrame(
            [(p["mix"], p["source"], [poisson_steps(x, p["cap"]) for x in rates]) for p, rates in zip(live, grid)], "mix string, source string, steps array<array<double>>"
        )
        at = lambda g: F.size(F.filter(F.col("steps")[g], lambda c: F.col("u") > c))
        sums = drawn(steps).groupBy("mix", "source").agg(*[F.sum(F.col("tokens") * at(g)).alias(f"s{g}") for g in range(GRID)]).collect()
        got = {(r["mix"], r["source"]): [r[f"s{g}"] for g in range(GRID)] for r in sums}
        for p, rates in zip(live, grid):
            if found := got.get((p["mix"], p["source"])):
                best = min(range(GRID), key=lambda g: (abs(found[g] - p["wanted"]), abs(g - GRID // 2)))
                p["rate"] = rates[best]
        spread = 2.0 ** (2 / (GRID // 2))

    steps = spark.createDataFrame(
        [(p["mix"], p["source"], poisson_steps(p["rate"], p["cap"]) if p["rate"] else []) for p in plan], "mix string, source string, steps array<double>"
    )
    counted = drawn(steps).select("mix", "source", "doc_id", "tokens", F.size(F.filter("steps", lambda c: F.col("u") > c)).alias("n")).where("n > 0")
    counted = stage(counted, "mix")
    key = F.xxhash64(F.lit(seed + 1), "mix", "doc_id", "repeat_no")
    selection = (
        counted.select("mix", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("repeat_no"), "tokens")
        .withColumn("shuffle_key", key)
        .repartitionByRange("mix", "shuffle_key").sortWithinPartitions("mix", "shuffle_key")
    )
    used = counted.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("n_used"))
    asked = spark.createDataFrame(
        [(p["mix"], p["source"], p["share"], p["wanted"], p["cap"], sizes.get(p["source"], (0, 0))[1], p["wanted"] > p["cap"] * p["have"], p["cap"] * p["have"] / p["share"] if p["share"] else None) for p in plan],
        "mix string, source string, target_share double, target_tokens double, max_repeats int, n_docs bigint, is_short boolean, exact_up_to double",
    )
    joined = asked.join(used, ["mix", "source"], "left").na.fill(0, ["tokens", "n_used"])
    totals = joined.groupBy("mix").agg(F.sum("tokens").alias("all_tokens"))
    shares = joined.join(totals, "mix").select(
        "mix", "source", "target_share", "target_tokens", "tokens",
        F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "max_repeats", "n_docs", "n_used", "is_short", "exact_up_to",
    )
    return selection, shares
