"""Histogram, exact median and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdrift import constants as C

def histogram(
    df: DataFrame,
    value: str,
    bins: int = C.HISTOGRAM_BINS,
    value_range: tuple[float, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts in equal bins; the last bin includes its upper end.

    Without ``value_range`` the bins span the data.  Values outside a given range are
    not counted.  Bins without rows give no row.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    if value_range is None:
        ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        rows = rows.withColumn("_ends", ends.select(F.struct("lo", "hi")).scalar())
        lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    else:
        lo, hi = F.lit(float(value_range[0])), F.lit(float(value_range[1]))
        rows = rows.where(x.between(lo, hi))
    # a single value spans one unit around itself
    low = F.when(lo == hi, lo - 0.5).otherwise(lo)
    width = F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo)
    position = F.floor((x - low) / width * bins).cast("int")
    return rows.groupBy(*by, F.least(position, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def order_key(x: Column) -> Column:
    """A 64-bit integer in the order of the doubles: the sign and magnitude bits of x, negatives
    reflected; -0.0 and 0.0 share 0, NaN is last.  Built from exact steps (powers of two)."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    normal = (e + 1023).cast("bigint") * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("bigint")
    tiny = (a * float(2.0 ** 537) * float(2.0 ** 537)).cast("bigint")  # subnormal: the bits are a / 2**-1074
    bits = (
        F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(a == 0.0, F.lit(0)).when(a == float("inf"), F.lit(2047 << 52))
        .when(a < float(2.0 ** -1022), tiny).otherwise(normal)
    )
    return F.when(F.isnan(x) | (x >= 0), bits).otherwise(-bits - 1)


_DIGIT = 16


def median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """Exact median of a column in one row, for any number of rows (null if there are none).

    Radix selection: each double gets an order-preserving 64-bit key, and four counting passes
    find its 16-bit digits from the top, each over the rows whose higher digits are already
    known, with at most 65,536 counts per rank sought.  Nothing is ranked in one task and no
    step can miss; the two middle values are averaged as ``quantile_cont`` does.
    """
    spark = df.sparkSession
    x = F.col("x")
    keyed = df.select(F.col(value).cast("double").alias("x")).where(x.isNotNull()).select("x", order_key(x).alias("k"))
    keyed = keyed.select("x", "k", F.col("k").bitwiseXOR(F.lit(-(1 << 63))).alias("u")).persist()
    try:
        n = keyed.count()
        if n == 0:
            return spark.range(1).select(F.lit(None).cast("double").alias(out))
        wanted = {(n + 1) // 2: [0, (n + 1) // 2], (n + 2) // 2: [0, (n + 2) // 2]}  # rank -> [prefix, rank left]
        for step in range(64 // _DIGIT):
            shift = 64 - _DIGIT * step
            prefix = F.shiftrightunsigned("u", shift) if step else F.lit(0).cast("bigint")
            digit = F.shiftrightunsigned("u", shift - _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1))
            prefixes = sorted({p for p, _ in wanted.values()})
            counts = keyed.where(prefix.isin(prefixes)).groupBy(prefix.alias("p"), digit.alias("d")).agg(F.count("*").alias("c"))
            table: dict[int, list[tuple[int, int]]] = {}
            for r in counts.collect():
                table.setdefault(r["p"], []).append((r["d"], r["c"]))
            for state in wanted.values():
                left = state[1]
                for d, c in sorted(table[state[0]]):
                    if left <= c:
                        state[0], state[1] = (state[0] << _DIGIT) | d, left
                        break
                    left -= c
        keys = [p - (1 << 64) if p >= 1 << 63 else p for p in (wanted[(n + 1) // 2][0], wanted[(n + 2) // 2][0])]
        found = {r["u"]: r["x"] for r in keyed.where(F.col("u").isin(keys)).groupBy("u").agg(F.min("x").alias("x")).collect()}
        middle = [found[k] for k in keys]
    finally:
        keyed.unpersist()
    return spark.range(1).select(F.lit((middle[0] + middle[1]) / 2).cast("double").alias(out))


def summary(df: DataFrame, value: str) -> DataFrame:
    """Count, least, greatest, mean and exact median of a column in one row."""
    df = df.select(F.col(value).cast("double").alias(value))
    x = F.col(value)
    stats = df.agg(
        F.count(x).alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean")
    )
    return stats.withColumn("median", F.lit(median(df, value).first()[0]).cast("double"))


def conditional_max(df: DataFrame, value: str, condition: Column, out: str) -> DataFrame:
    """Largest value among the rows that meet the condition."""
    return df.agg(F.max(F.when(condition, F.col(value))).alias(out))
