"""Ordered computations that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The helpers
here cut every key into blocks along its order, work per ``(key, block)``, and
pass only one small row per block across the block borders. Results equal the
plain window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 4096
GROUP_ROWS = 200_000

_COMBINE = {
    "sum": lambda before, inside: F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)),
    "min": lambda before, inside: F.least(before, inside),
    "max": lambda before, inside: F.greatest(before, inside),
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def null_safe(left: list[str], right: list[str]) -> Column:
    """Join condition under which nulls of a key are equal."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def block_of(index: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense non-negative index."""
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(rows)).cast("bigint")


def prefix_aggregate(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum/min/max per key, in two levels.

    ``bucket`` must never decrease along ``order``. Bucket totals are combined
    on the map side, so the only per-key window runs over one row per bucket.
    Rows with a null key or a null bucket stay: nulls are one key, and come first.
    With ``inclusive=False`` the current row is left out (NULL on the first row
    for min/max, 0 for sum).
    """
    work = df.select("*", bucket.alias("_bucket"), *[v.alias(f"_in_{name}") for name, (_, v) in outputs.items()])
    totals = work.groupBy(*keys, "_bucket").agg(
        *[_AGG[fn](f"_in_{name}").alias(f"_t_{name}") for name, (fn, _) in outputs.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_bucket", F.row_number().over(W.partitionBy(*keys).orderBy("_bucket")).alias("_nth"),
        *[_AGG[fn](f"_t_{name}").over(earlier).alias(f"_before_{name}") for name, (fn, _) in outputs.items()],
    ).filter("_nth > 1").drop("_nth").withColumn("_head", F.lit(True))
    # What lies before a bucket enters it as its first row; a join would deal the rows out once more.
    inside = W.partitionBy(*keys, "_bucket").orderBy(F.desc("_head"), *order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    both = work.withColumn("_head", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    done = both.select(
        *df.columns, "_head",
        *[
            _COMBINE[fn](F.first(f"_before_{name}").over(inside), _AGG[fn](f"_in_{name}").over(inside)).alias(f"_out_{name}")
            for name, (fn, _) in outputs.items()
        ],
    )
    return done.filter("NOT _head").select(*df.columns, *[F.col(f"_out_{name}").alias(name) for name in outputs])


def dense_index(
    df: DataFrame, keys: list[str], bucket: Column, order: list, out: str, start: int = 0
) -> DataFrame:
    """``row_number`` per key (from ``start``) without one task per key."""
    ranked = prefix_aggregate(df, keys, bucket, order, {"_rank": ("sum", F.lit(1))})
    return ranked.select(*df.columns, (F.col("_rank") - F.lit(1 - start)).alias(out))


def with_neighbors(
    df: DataFrame,
    keys: list[str],
    index: str,
    cols: list[str],
    before: bool = True,
    after: bool = True,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev_<col>`` / ``next_<col>`` of the rows at ``index`` -1 / +1.

    ``index`` is dense per key. Rows on a block border are copied into the next
    block, so each window partition holds at most ``rows + 2`` rows. Nulls of a key are one
    key. Rows without an index stay and have no neighbours.
    """
    home = block_of(index, rows)
    pos = F.pmod(F.col(index), F.lit(rows))
    copies = F.array(home)
    if before:
        copies = F.when(pos == rows - 1, F.array(home, home + 1)).otherwise(copies)
    if after:
        copies = F.when((pos == 0) & (home > 0), F.array(home, home - 1)).otherwise(copies)
    if before and after and rows == 1:
        raise ValueError("blocks need at least two rows")
    spread = df.select("*", home.alias("_home"), F.explode(copies).alias("_block"))
    w = W.partitionBy(*keys, "_block").orderBy(index)
    extra, placed = [], F.col(index).isNotNull()
    for c in cols:
        if before:
            extra.append(F.when(placed, F.lag(c).over(w)).alias(f"prev_{c}"))
        if after:
            extra.append(F.when(placed, F.lead(c).over(w)).alias(f"next_{c}"))
    return spread.select("*", *extra).filter("_home <=> _block").drop("_home", "_block")


_FINE = 1 << 14


def _value_bucket(col: Column) -> Column:
    """Monotone integer bucket of a double: about 700 per doubling; NaN above infinity."""
    size = F.floor(F.log(F.abs(F.when(F.abs(col) < float("inf"), col))) * 1024).cast("bigint") + F.lit(1 << 20)
    far = F.lit(1 << 40)
    return (
        F.when(F.isnan(col), far + 1)
        .when(col == float("inf"), far)
        .when(col == float("-inf"), -far)
        .when(col == 0, F.lit(0).cast("bigint"))
        .when(col > 0, size)
        .otherwise(-size)
    )


def _fine_bucket(col: Column) -> Column:
    """Monotone split of one :func:`_value_bucket` into ``_FINE`` parts."""
    size = F.log(F.abs(F.when((col != 0) & (F.abs(col) < float("inf")), col))) * 1024
    part = F.floor((size - F.floor(size)) * _FINE).cast("bigint")
    return F.coalesce(F.when(col < 0, -part).otherwise(part), F.lit(0).cast("bigint"))


def exact_percentiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Linear-interpolated percentiles per key: ``{out: (column, p in 0..1)}``.

    Keys of up to ``group_rows`` rows are sorted in one array each. Longer keys go through buckets instead,
    with equal results: nulls are left out (a key of nulls only gives null), NaN counts
    as the largest value. Rows whose key is null are one key. Which keys are long is
    decided in the plan.
    """
    marks = [f"_long_{c}" for c in keys]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = sizes.filter(F.col("_n") > group_rows).select(*[F.col(c).alias(m) for c, m in zip(keys, marks)])
    same = null_safe(keys, marks)
    short = _grouped_percentiles(df.join(long_keys, same, "left_anti"), keys, wanted)
    return short.unionByName(_bucket_percentiles(df.join(long_keys, same, "left_semi"), keys, wanted))


def _lerp(lo: Column, hi: Column, pos: Column) -> Column:
    """Between two neighbours in rank, as SQL's ``quantile_cont`` rounds it: one fused multiply-add.

    Neighbours may be one rounding step apart, and the result is compared with them, so the last bit counts.
    """
    part = pos - F.floor(pos)
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, F.lit(1.0) - part, hi * part).cast("double")
    return F.when((part == 0) | lo.eqNullSafe(hi), lo).otherwise(fused)


def _grouped_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    columns = sorted({c for c, _ in wanted.values()})
    found = df.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.col(c).cast("double") + 0.0)).alias(f"_p_{c}") for c in columns]
    )

    def pick(column: str, p: float):
        values = F.col(f"_p_{column}")
        pos = F.lit(float(p)) * (F.size(values) - 1)
        return F.when(F.size(values) > 0, _lerp(F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int")), pos))

    return found.select(*keys, *[pick(c, p).alias(out) for out, (c, p) in sorted(wanted.items())])


def _bucket_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The same for long keys, with no buffer that grows with the key.

    A histogram (combined on the map side) finds the bucket of each wanted order
    statistic, a second one the part of that bucket. Only the values of those parts
    are ranked, after equal values have been merged.
    """
    columns = sorted({c for c, _ in wanted.values()})
    # No negative zero; keys travel as one text, so that nulls join.
    slim = df.select(F.to_json(F.struct(*keys)).alias("_key"), *keys, *[(F.col(c).cast("double") + 0.0).alias(c) for c in columns])
    names, keys = keys, ["_key"]
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns]))
    values = (
        slim.select(*keys, long.alias("m"))
        .select(*keys, "m.metric", "m.value", _value_bucket(F.col("m.value")).alias("bucket"))
        .withColumn("part", _fine_bucket(F.col("value")))
        .filter(F.col("value").isNotNull())
    )
    specs = F.array(
        *[
            F.struct(F.lit(out).alias("out"), F.lit(c).alias("metric"), F.lit(float(p)).alias("p"))
            for out, (c, p) in sorted(wanted.items())
        ]
    )
    # The ranks wanted of a metric, before and after each percentile's position.
    ranks = F.flatten(
        F.transform(
            F.filter(specs, lambda t: t["metric"] == F.col("metric")),
            lambda t: F.array(
                F.struct(t["out"].alias("out"), F.lit(False).alias("upper"), F.floor(t["p"] * (F.col("n") - 1)).alias("r")),
                F.struct(t["out"].alias("out"), F.lit(True).alias("upper"), F.ceil(t["p"] * (F.col("n") - 1)).alias("r")),
            ),
        )
    )
    group = [*keys, "metric"]
    hist = values.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    per_metric = W.partitionBy(*group)
    first = hist.withColumn("n", F.sum("cnt").over(per_metric)).withColumn("need", ranks)
    first = _holding(first, per_metric.orderBy("bucket"), F.lit(0)).select(*group, "bucket", "base", "n", "need")
    inner = [*group, "bucket"]
    crowd = values.join(first, inner).groupBy(*inner, "part").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.first(c).alias(c) for c in ("n", "need")], F.first("base").alias("under")
    )
    second = _holding(crowd, W.partitionBy(*inner).orderBy("part"), F.col("under")).select(
        *inner, "part", "base", "n", "need"
    )
    inner = [*inner, "part"]
    merged = values.join(second, inner).groupBy(*inner, "value").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.first(c).alias(c) for c in ("n", "need")], F.first("base").alias("under")
    )
    hit = _holding(merged, W.partitionBy(*inner).orderBy("value"), F.col("under")).withColumn("x", F.explode("need"))
    picks = []
    for out in wanted:
        for upper in (False, True):
            mine = (F.col("x.out") == out) & (F.col("x.upper") == upper)
            picks.append(F.max(F.when(mine, F.col("value"))).alias(f"_{'hi' if upper else 'lo'}_{out}"))
        picks.append(F.max(F.when(F.col("x.out") == out, F.col("n"))).alias(f"_n_{out}"))

    def blend(out: str, p: float):
        pos = F.lit(float(p)) * (F.col(f"_n_{out}") - 1)
        return _lerp(F.col(f"_lo_{out}"), F.col(f"_hi_{out}"), pos).alias(out)

    found = hit.groupBy(*keys).agg(*picks).select(*keys, *[blend(out, p) for out, (_, p) in sorted(wanted.items())])
    return slim.select("_key", *names).distinct().join(found, "_key", "left").drop("_key")


def _holding(counted: DataFrame, order, under: Column) -> DataFrame:
    """Rows of a histogram that hold a wanted rank; ``base`` rows lie before each, ``need`` are its ranks."""
    upto = F.sum("cnt").over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        counted.withColumn("top", upto + under)
        .withColumn("base", F.col("top") - F.col("cnt"))
        .withColumn("need", F.filter("need", lambda x: (x["r"] >= F.col("base")) & (x["r"] < F.col("top"))))
        .filter(F.size("need") > 0)
    )
