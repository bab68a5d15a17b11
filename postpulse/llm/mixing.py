"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import fresh, named

_BITS = 52  # of the hash that make the uniform number; exact in a double


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... as far as a number of 52 bits can tell it from 1."""
    if rate <= 0:
        return [1.0]
    total, k, steps = 0.0, 0, []
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        steps.append(total)
        if k > rate and total >= 1 - 2.0 ** -_BITS or k > rate + 40 * math.sqrt(rate) + 60:
            return steps
        k += 1


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``:``."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") / 2.0 ** _BITS


def rates(docs: DataFrame, weights: dict[str, float], *, rest: float = 0.0,
          total: float | None = None, source: str = "source", text: str = "text"
          ) -> dict[str | None, float]:
    """Mean repetitions of each source: its target share of ``total`` bytes over its own bytes.

    One aggregate over all documents, of at most ``len(weights) + 1`` rows: sources that
    ``weights`` doesn't name (null too) are one class, with the weight ``rest``. Weights count in
    proportion, over the classes that have bytes. ``total`` is the bytes of the corpus by default.
    """
    if any(w < 0 or not math.isfinite(w) for w in [*weights.values(), rest]):
        raise ValueError("weights must be finite and not negative")
    known = F.when(named(source).isin(list(weights)), named(source))
    size = F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long")
    sizes = {r[0]: r[1] for r in
             docs.select(known.alias("s"), size.alias("b")).groupBy("s").agg(F.sum("b")).collect()}
    wanted = {s: w for s, w in [*weights.items(), (None, rest)] if sizes.get(s)}
    whole, share = total if total is not None else sum(sizes.values()), sum(wanted.values())
    return {s: w / share * whole / sizes[s] for s, w in wanted.items() if w and share}


def replicate(docs: DataFrame, weights: dict[str, float], *, rest: float = 0.0,
              total: float | None = None, seed: int = 0, key: str = "doc_id",
              source: str = "source", text: str = "text", copy: str = "copy") -> DataFrame:
    """Every document as often as a Poisson number says, all copies in one random order.

    Input: any table with the named columns; all its columns are kept, with ``copy`` (int, from 1)
    behind them; a column of that name is replaced. A document's number comes from
    inverting the Poisson distribution of its source's rate at a uniform number that depends
    on ``seed`` and ``key`` alone, so a repeated run and a retried task give the same copies.

    Null key: the text's MD5 stands for it. Null text counts no bytes. Null and unlisted sources
    share ``rest``. Sources with a weight but without bytes get no copy. Repeated rows of one key
    get the same number each. An empty table gives an empty table.

    The rates are numbers in the plan, so no source, however large, is gathered anywhere; copies
    are dealt out by a hash of key, text and copy number, and partitions that equal rows make large
    are split as they are read.
    """
    mean = rates(docs, weights, rest=rest, total=total, source=source, text=text)
    base = docs.drop(*[c for c in docs.columns if c.lower() == copy.lower()])
    identity = F.coalesce(named(key).cast("string"), F.md5(named(text).cast("binary")), F.lit(""))
    drawn, steps = fresh(base, "_drawn"), F.lit(None).cast("array<double>")
    for s, rate in mean.items():
        fits = ~F.coalesce(named(source).isin(list(weights)), F.lit(False)) if s is None \
            else named(source) == s
        # One text: a source of few bytes has a high rate, and as many steps.
        listed = F.split(F.lit(",".join(map(repr, poisson_cdf(rate)))), ",").cast("array<double>")
        steps = F.when(fits, listed).otherwise(steps)
    at = uniform(F.lit(str(seed)), identity)
    count = F.coalesce(F.size(F.filter(named(drawn), lambda c: at >= c)), F.lit(0))
    copies = base.withColumn(drawn, steps).withColumn(drawn, count).where(named(drawn) > 0)
    rows = copies.select(
        *map(named, base.columns), F.explode(F.sequence(F.lit(1), named(drawn))).alias(copy)
    )
    place = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), identity, F.xxhash64(named(text)), named(copy))
                  .cast("binary"))
    spot = fresh(rows, "_place")
    dealt = rows.withColumn(spot, place).hint("rebalance", named(spot))
    return dealt.sortWithinPartitions(spot).drop(spot)
