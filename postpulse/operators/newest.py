"""Newest N rows by exact selection over histograms: no sort, no limit, no gathering of rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16  # log2 of the bins that one look tells apart


def newest(df: DataFrame, n: int, by: str, day: str | None = None) -> DataFrame:
    """The ``n`` rows with the highest ``by`` (all, if there are fewer), in no order.

    The same for every ``n``: exactly ``n`` rows; of rows that share the lowest value that
    still counts any may be taken; null values come last. ``by`` is a number, date or time.

    Only values of ``by`` are looked at: the n-th highest is found by histograms (``nth_highest``), a
    small fixed number of aggregates whatever ``n`` is. The rows are then plain filters on
    ``by``, which skip Parquet row groups and keep the scan's partitions. Of rows that share
    the last value, those with the highest hash are taken in the same way; only rows that are equal
    in every column are counted and repeated.

    ``day``: the column by which the store is partitioned; newest then means the newest day
    first, and ``by`` within a day. Days are counted without reading any column, newer
    days are taken whole by pruning, and values are looked at in the last one only.
    """
    rank_of(df, by)  # tells a type that has no order of this kind
    if day is None:
        return _highest(df, n, by)
    counts = sorted(df.groupBy(day).count().collect(), key=lambda r: (r[0] is not None, r[0]),
                    reverse=True)
    held, whole, last = 0, [], None
    for value, count in counts:
        if held + count > n:
            last = (value,)
            break
        held += count
        whole.append(value)
    if last is None:
        return df
    kept = [d for d in whole if d is not None]
    rest = df.where(F.col(day).eqNullSafe(F.lit(last[0])))
    edge = _highest(rest, n - held, by)
    return df.where(F.col(day) >= F.lit(min(kept))).union(edge) if kept else edge


def _highest(df: DataFrame, n: int, by: str) -> DataFrame:
    if n <= 0:
        return df.where(F.lit(False))
    value = F.col(f"`{by}`")
    rank, back = rank_of(df, by)
    found = nth_highest(df.select(rank.alias("v")), n)
    if found is None:  # fewer values than n
        known = df.where(value.isNotNull())
        missing = n - known.count()
        return known.union(_some(df.where(value.isNull()), missing)) if missing else known
    lowest, above, equal = back(found[0]), *found[1:]
    if n - above == equal:
        return df.where(value >= lowest)
    return df.where(value > lowest).union(_some(df.where(value == lowest), n - above))


def _some(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows of ``df``: those of the highest hashes, and of rows with one hash, which are
    equal rows, as many copies as needed."""
    mark = row_hash(df)
    found = nth_highest(df.select(mark.alias("v")), n)
    if found is None:
        return df
    lowest, above, equal = found
    if n - above == equal:
        return df.where(mark >= F.lit(lowest))
    last = df.where(mark == F.lit(lowest))
    # Rows of one hash: equal ones but for a collision, so a second hash tells them apart, and the
    # running count over its few values is short.
    kept = last.select(row_hash(df, 1).alias("h"), F.struct("*").alias("row")).groupBy("h").agg(
        F.any_value("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    before = F.expr("sum(copies) OVER (ORDER BY h) - copies")
    left = F.greatest(F.least(F.col("copies"), F.lit(n - above) - F.col("before")), F.lit(0))
    copies = kept.withColumn("before", before).where(left > 0)
    rows = copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return df.where(mark > F.lit(lowest)).union(rows.select("row.*"))


def row_hash(df: DataFrame, salt: int = 0) -> Column:
    """A 64-bit hash of all columns, of any type."""
    def plain(field: T.StructField) -> Column:
        c = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, T.MapType):
            return F.to_json(F.struct(F.sort_array(F.map_entries(c))))
        return c

    return F.xxhash64(F.lit(salt), *map(plain, df.schema.fields))


def rank_of(df: DataFrame, by: str) -> tuple[Column, Callable[..., Column]]:
    """The values of ``by`` as longs, doubles or decimals in the same order, and the way back, to
    a literal of its own type, which Parquet filters take."""
    kind, c = df.schema[by].dataType, F.col(f"`{by}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long"), lambda x: F.date_from_unix_date(F.lit(x).cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), lambda x: F.timestamp_micros(F.lit(x).cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        # Not by way of a zone, in whose changes of the clock two times would be one.
        start = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        return F.expr(f"timestampdiff(MICROSECOND, {start}, `{by}`)"), lambda x: F.lit(
            str(datetime(1970, 1, 1) + timedelta(microseconds=x))).cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        plain = "long" if isinstance(kind, T.IntegralType) else \
            "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else kind
        return c.cast(plain), lambda x: F.lit(x).cast(kind)
    raise TypeError(f"{by} must be a number, a date or a time")


def nth_highest(values: DataFrame, n: int, col: str = "v") -> tuple | None:
    """(the n-th highest value, how many are higher, how many are equal); None if there are fewer.

    ``col`` holds longs, doubles or decimals; nulls don't count, NaN is highest. Each look is one
    aggregate: it counts the values in some 2^BITS bins of the range that is left, with the lowest
    and highest of each, and goes on within the bin that holds the n-th, until all values there
    are equal. Longs take one look for the ends and at most four for 64 bits; what a task
    sends on is at most one row for each bin.
    """
    v, kind = F.col(col), values.schema[col].dataType
    exact = isinstance(kind, T.LongType)
    known = values.where(v.isNotNull())
    if isinstance(kind, T.DoubleType):
        # What can't be cut into equal bins: the ends are told apart first.
        inf = float("inf")
        sort = F.when(F.isnan(v), 3).when(v == inf, 2).when(v == -inf, 0).otherwise(1)
        sizes = {r[0]: r[1] for r in known.groupBy(sort.alias("s")).count().collect()}
        above = 0
        for s, value in ((3, float("nan")), (2, inf), (1, None), (0, -inf)):
            if above + sizes.get(s, 0) >= n:
                if value is not None:
                    return value, above, sizes[s]
                found = _within(known.where(sort == 1), n - above, v, exact)
                return found[0], found[1] + above, found[2]
            above += sizes.get(s, 0)
        return None
    return _within(known, n, v, exact)


def _within(known: DataFrame, n: int, v: Column, exact: bool) -> tuple | None:
    low, high, count = known.agg(F.min(v), F.max(v), F.count(F.lit(1))).first()
    if count < n:
        return None
    above, equal = 0, count
    while low != high:
        inside = known.where((v >= F.lit(low)) & (v <= F.lit(high)))
        bins = inside.groupBy(_bin(v, low, high, exact).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for r in sorted(bins, key=lambda r: r["b"], reverse=True):
            if above + r["n"] >= n:
                low, high, equal = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    return low, above, equal


def _middle(low: Decimal, high: Decimal) -> Decimal:
    """A number of the same scale, below ``high``."""
    with localcontext() as wide:
        wide.prec = 80
        unit = Decimal(1).scaleb(min(low.as_tuple().exponent, high.as_tuple().exponent))
        return ((low + high) / 2).quantize(unit, ROUND_FLOOR)


def _bin(v: Column, low, high, exact: bool) -> Column:
    """A number that never falls as ``v`` rises, with at most some 2^BITS values, at least two."""
    if exact:
        return F.shiftright(v, max(0, (high - low).bit_length() - BITS))
    wide = float(high) - float(low)
    if not math.isfinite(wide) or wide <= 0:  # too wide, or of too many digits, for doubles
        middle = _middle(low, high) if isinstance(low, Decimal) else low / 2 + high / 2
        return (v > F.lit(middle)).cast("int")
    share = (v.cast("double") - F.lit(float(low))) / F.lit(wide)
    return F.least(F.floor(share * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1))
