"""Running totals, ranks and exact quantiles without one task per group.

A group (a site, a class, the whole table) may hold most of the rows, so windows never partition
on it alone. Rows are first reduced to one per (group, ordering value), range-partitioned on that
pair, and the partition number becomes a bucket: a big group spans many buckets, small groups share
one. A running total is the total of the earlier buckets plus a window inside the bucket. The number
of buckets is spark.sql.shuffle.partitions, the setting that is already sized to the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.runtime import cut, join_small


def bucket_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_buckets(df: DataFrame, keys: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """Add `_bucket`, increasing in `order` within every key. `df` has one row per (keys, order).

    The numbers are written out with the rows, so a recomputed task cannot renumber them.
    """
    spread = df.repartitionByRange(buckets or bucket_count(df), *keys, order)
    return cut(spread.withColumn("_bucket", F.spark_partition_id()))


def running_within_buckets(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                           descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Running totals when `df` already has one row per (keys, order) and a `_bucket` column.

    Without the column each group is one window: only for tables whose size has been checked.
    """
    keys = list(keys)
    if "_bucket" not in df.columns:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if descending else F.col(order).asc())
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(c).over(w).alias(prefix + c) for c in sums])

    def direction(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    per_bucket = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}")
                                                    for c in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(prefix + c) for c in sums])


def running_log_sums(df: DataFrame, keys: Sequence[str], order: str, log: str, descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Running log-sum-exp of `log` over one row per (keys, order) with a `_bucket`.

    The pair (largest logarithm, sum scaled to it) is a monoid: buckets are reduced to one each, the pairs before every bucket are scanned per key
    (one row per bucket), and rows are scanned inside their bucket. No spread of the logarithms makes a sum overflow or vanish.
    """
    keys = list(keys)
    fields = [*df.schema.fields]
    scaled = F.max(log).over(Window.partitionBy(*keys, "_bucket"))
    ends = df.select(*keys, "_bucket", F.col(log).alias("_l"), scaled.alias("_m")).groupBy(*keys, "_bucket", "_m").agg(F.sum(F.exp(F.col("_l") - F.col("_m"))).alias("_s"))
    ends = ends.select(*keys, "_bucket", (F.col("_m") + F.log("_s")).alias("_end"))
    turn = -1 if descending else 1

    def scan(values: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(turn * by.astype(np.float64), kind="stable")
        return at, np.logaddexp.accumulate(values[at]) if len(at) else values

    def before(t: pa.Table) -> pa.Table:
        at, run = scan(t.column("_end").to_numpy(), t.column("_bucket").to_numpy())
        return t.take(pa.array(at)).select([*keys, "_bucket"]).append_column("_before", pa.array(np.concatenate([[-np.inf], run[:-1]])))

    def inside(t: pa.Table) -> pa.Table:
        at, run = scan(t.column(log).to_numpy(), t.column(order).to_numpy())
        rows = t.take(pa.array(at))
        return rows.select([f.name for f in fields]).append_column(prefix + log, pa.array(np.logaddexp(run, rows.column("_before").to_numpy())))

    named = lambda fs: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fs)
    offsets = ends.groupBy(*keys).applyInArrow(before, f"{named(f for f in fields if f.name in (*keys, '_bucket'))}, _before double")
    return df.join(offsets, [*keys, "_bucket"]).groupBy(*keys, "_bucket").applyInArrow(inside, f"{named(fields)}, `{prefix}{log}` double")


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive running totals of `sums` over distinct values of `order`, per `keys`.

    Ties share one total (RANGE semantics). Returns one row per (keys, order).
    """
    one = df.groupBy(*keys, order).agg(*[F.sum(c).alias(c) for c in sums])
    return running_within_buckets(with_buckets(one, keys, order), keys, order, sums, descending, prefix).drop("_bucket")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles of a column that may not fit one task."""
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    counted = running_totals(src.select(*keys, F.col(value).alias("_v"), F.lit(1).cast("bigint").alias("_n")),
                             keys, "_v", ["_n"])
    counted = cut(counted)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    pos = totals
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        pos = pos.withColumn(f"_lo_{name}", F.floor(at)).withColumn(f"_fr_{name}", at - F.floor(at))
    joined = join_small(counted, pos, keys)
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index <= last), F.col("_v")))

    outs = []
    for name in probs:
        lo, fr = F.col(f"_lo_{name}"), F.col(f"_fr_{name}")
        v0 = at(lo)
        v1 = at(F.least(lo + 1, F.col("_total") - 1))
        outs.append((v0 + F.first(fr) * (v1 - v0)).alias(name))
    out = joined.groupBy(*keys).agg(*outs)
    return out if by else out.drop("_all")


def hashed_rank(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, name: str = "rank") -> DataFrame:
    """0-based position of each row in a seeded pseudo-random order of its group.

    The order is the hash of (seed, ids), so it is the same after a retry. Hash ranges are the
    buckets, hence even; only their counts are ranked across buckets.
    """
    keys = list(keys)
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    bits = max(8, bucket_count(df).bit_length())
    hashed = df.withColumn("_h", h).withColumn("_bucket", F.shiftrightunsigned(F.col("_h"), 64 - bits))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_h", *ids)
    return (hashed.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_h", "_bucket", "_o"))


def fold_ids(df: DataFrame, k: int, keys: Sequence[str] = ("site",), ids: Sequence[str] = ("id",), seed: int = 0,
             name: str = "fold") -> DataFrame:
    """Balanced fold numbers 0..k-1 within each group."""
    return hashed_rank(df, keys, ids, seed, "_rank").withColumn(name, (F.col("_rank") % k).cast("int")).drop("_rank")


def train_test_split(df: DataFrame, test_size: float = 0.2, keys: Sequence[str] = ("site",), strata: Sequence[str] = (),
                     ids: Sequence[str] = ("id",), seed: int = 0) -> DataFrame:
    """Mark ceil(test_size * n) rows per group (and stratum) as test, exactly."""
    groups = [*keys, *strata]
    sizes = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).alias("_test_n"))
    ranked = join_small(hashed_rank(df, groups, ids, seed, "_rank"), sizes, groups)
    return ranked.withColumn("is_test", F.col("_rank") < F.col("_test_n")).drop("_rank", "_test_n")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-based area under the ROC curve with average ranks; null when one class is absent."""
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    pos = F.col(label).cast("bigint")
    run = running_totals(src.select(*keys, F.col(score).alias("_v"), pos.alias("_p"), (F.lit(1) - pos).alias("_q")),
                         keys, "_v", ["_p", "_q"])
    # A positive beats every negative strictly below it and half of those tied with it.
    wins = F.col("_p") * (F.col("cum__q") - F.col("_q") + F.col("_q") / F.lit(2.0))
    out = run.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    out = out.select(*keys, F.when((F.col("_np") > 0) & (F.col("_nq") > 0),
                                   F.col("_w") / (F.col("_np").cast("double") * F.col("_nq"))).alias("auc"),
                     F.col("_np").alias("n_pos"), F.col("_nq").alias("n_neg"))
    return out if by else out.drop("_all")
