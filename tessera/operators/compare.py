"""Comparison of two builds of a benchmark, and the reports around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import scratch


def compare_builds(base: DataFrame, other: DataFrame, keys: list[str], show: list[str], metrics: list[str]) -> DataFrame:
    """Join two builds on all keys and average each metric over the join's rows, per shown group.

    A key with k1 and k2 repeats weighs k1 * k2 in a coarser group. Both sides are summed per key first, and
    the join product's sums follow from those, so the product itself is never made. Null keys don't match."""

    def sums(df: DataFrame, tag: str) -> DataFrame:
        per = [a for m in metrics for a in (F.sum(m).alias(f"{m}_{tag}"), F.count(m).alias(f"{m}_{tag}_n"))]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{tag}"), *per)

    def mean(m: str, own: str, far: str) -> Column:
        weight = F.col(f"n_{far}")
        return F.try_divide(F.sum(F.col(f"{m}_{own}") * weight), F.sum(F.col(f"{m}_{own}_n") * weight)).alias(f"avg_{m}_{own}")

    both = sums(base, "base").join(sums(other, "other"), keys)
    out = both.groupBy(*show).agg(*(mean(m, a, b) for m in metrics for a, b in (("base", "other"), ("other", "base"))))
    for m in metrics:
        out = out.withColumn(f"ratio_{m}", F.try_divide(f"avg_{m}_other", f"avg_{m}_base"))
    return out.orderBy(*show)


def half_up(c, places: int) -> Column:
    """A value rounded in plain double arithmetic, so that any engine gives the same bits."""
    return F.floor(c * 10.0**places + 0.5) / 10.0**places


def varying_columns(df: DataFrame) -> DataFrame:
    """(column_name, shown): shown unless the column has one value throughout, null being a value. One pass, no distinct counts."""
    flags = [((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(c) for c in df.columns]
    one = df.agg(*(F.coalesce(f, F.lit(False)).alias(c) for f, c in zip(flags, df.columns, strict=True)))
    return one.unpivot([], df.columns, "column_name", "shown")


def auto_show(df: DataFrame, hide: tuple[str, ...] = ()) -> DataFrame:
    """Df without its constant columns and those to hide; the column list is the only thing that comes to the driver."""
    shown = {r["column_name"] for r in varying_columns(df).where("shown").collect()}
    return df.select(*(c for c in df.columns if c in shown and c not in hide))


def shortened(df: DataFrame, key: str) -> DataFrame:
    """A2, A4: key cut to the length of its shortest value, with the lengths found."""
    lengths = df.agg(F.min(F.length(key)).alias("min_len"), F.max(F.length(key)).alias("max_len"))
    return df.join(F.broadcast(lengths)).withColumn(key, F.substring(F.col(key), F.lit(1), F.col("min_len")))


def test_name(n_prompt: str, n_gen: str, depth: str) -> Column:
    """Pp, tg or pp+tg with their sizes, and the depth where there is one."""
    pp, tg = F.concat(F.lit("pp"), F.col(n_prompt).cast("string")), F.concat(F.lit("tg"), F.col(n_gen).cast("string"))
    name = F.when(F.col(n_gen) == 0, pp).when(F.col(n_prompt) == 0, tg).otherwise(F.concat(pp, F.lit("+"), tg))
    return F.when(F.col(depth) > 0, F.concat(name, F.lit("@d"), F.col(depth).cast("string"))).otherwise(name)


def yes_no(c) -> Column:
    """P5."""
    return F.when(c, "Yes").otherwise("No")


def collapsed(c: str) -> Column:
    """A comma list of equal names as `Nx name`."""
    parts = F.split(F.col(c), ",\\s*")
    return F.when((F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1), F.concat(F.size(parts).cast("string"), F.lit("x "), parts[0])).otherwise(F.col(c))


def top_groups(df: DataFrame, keys: list[str], value: str, second: str, optional: Column, by: str, n: int) -> DataFrame:
    """A5, O3: count, max and mean of two measures, mean of an optional third (0 if never there), and the top n groups by one of them."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("max_a"), F.avg(value).alias("avg_a"), F.max(second).alias("max_b"), F.avg(second).alias("avg_b"), F.coalesce(F.avg(optional), F.lit(0.0)).alias("avg_c")
    )
    return out.orderBy(F.col(by).desc(), *keys).limit(n)


def support(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Supported where every case is, partially where any is, else unsupported."""
    state = F.when(F.bool_and(ok), "supported").when(F.bool_or(ok), "partially").otherwise("unsupported")
    return df.groupBy(*keys).agg(state.alias("state"))


def support_across(df: DataFrame, op: str, backend: str) -> DataFrame:
    """On how many of all backends an op was recorded."""
    total = df.agg(F.count_distinct(backend).alias("n_backends"))
    return df.groupBy(op).agg(F.count_distinct(backend).alias("n_recorded")).join(F.broadcast(total)).withColumn("everywhere", F.col("n_recorded") == F.col("n_backends"))


def pivot_last(df: DataFrame, row: str, column: str, value: str, order: str, columns: list[str]) -> DataFrame:
    """A row per `row`, a column per value of `column`; of repeated records the last by order counts."""
    return df.groupBy(row).pivot(column, columns).agg(F.max_by(value, order))


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two inputs by their place, with `pos`. Raises where the lengths differ.

    Places come from a distributed numbering: rows are range-sorted, counted per partition, and numbered within it."""
    left, right = numbered(a, order_a), numbered(b, order_b)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return left.join(right, "pos")


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with a gapless number from 0 in the order of columns that tell rows apart, without sorting it all in one task.

    Explicit ranges of the first column (bounds from its quantiles, at most one number per partition to the driver)
    are counted; each range starts where the ones before it end."""
    key = order[0]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[key]
    numeric = F.col(key).cast("double") if kind not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    bounds = sorted(set(df.select(numeric.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length())))) if bounds else None
    cuts = F.array(*(F.lit(float(b)) for b in bounds)) if bounds else None
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(cuts, a + s - 1) < numeric, a + s).otherwise(a)) if bounds else F.lit(0)
    ranged = df.withColumn("_range", at)
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def pattern_rows(pattern: str) -> list[tuple[int, int]]:
    """`get,skip,get,...` as half-open ranges of places to keep."""
    out, at = [], 0
    for i, size in enumerate(int(x) for x in pattern.split(",")):
        if i % 2 == 0:
            out.append((at, at + size))
        at += size
    return out


def select_pattern(df: DataFrame, pos: str, pattern: str) -> DataFrame:
    """A range predicate, not a range join: the pattern is a constant."""
    keep = F.lit(False)
    for lo, hi in pattern_rows(pattern):
        keep = keep | ((F.col(pos) >= lo) & (F.col(pos) < hi))
    return df.where(keep)


def overlap(ref: Column, hyp: Column) -> Column:
    """The share of reference words, repeats counted, that the hypothesis has; no reference words: 1 if there is no hypothesis either, else 0."""
    hits = F.size(F.filter(ref, lambda w: F.array_contains(hyp, w)))
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(ref))


def words(c) -> Column:
    """Split at white space, without empties."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def throughput(df: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Totals, means, a ratio of sums, and the depth sum that n requests of n tokens give."""
    n = F.col(tokens)
    return df.agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum(tokens).cast("bigint").alias("sum_tokens"), F.avg(tokens).alias("avg_tokens"), F.sum(seconds).alias("sum_seconds"), F.max(seconds).alias("max_seconds"),
        F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_second"), F.sum(n * n + n * (n + 1) / 2).cast("bigint").alias("depth_sum"),
    )


_BINS = 10_000


def histogram(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """Counts in bins of a width from 0 on, empty bins included; the last bin is closed on the right."""
    top = df.agg(F.greatest(F.ceil(F.max(F.col(value)) / width), F.lit(1)).cast("bigint").alias("n_bins"))
    got = df.where(F.col(value) >= 0).join(F.broadcast(top)).groupBy(F.least(F.floor(F.col(value) / width), F.col("n_bins") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Bins in blocks, so that no row holds them all, however far out the greatest value is.
    blocks = top.select("n_bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bins") - 1) / _BINS))).alias("block"))
    bins = blocks.select(F.explode(F.sequence(F.col("block") * _BINS, F.least((F.col("block") + 1) * _BINS, F.col("n_bins")) - 1)).alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def series(df: DataFrame, keys: list[str], x: str, ys: list[str]) -> DataFrame:
    """A plot's lines: per group, the points sorted by x."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(x, *ys))).alias("points"))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with where they first stood."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def reachable(spark, edges: DataFrame, start, levels: int = 8) -> DataFrame:
    """(node, depth) of all that (child, parent) edges reach from start; shortest depth, whatever cycles there are.

    From the last nodes that were new, `levels` joins at a time; each such round is written to the shared folder, until a round
    finds no new node."""
    edges = edges.select("child", "parent").where("parent is not null").distinct()
    known = scratch.stored(spark.range(1).select(F.lit(start).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth")), "reached")
    last = known
    while True:
        step, found = last, None
        for _ in range(levels):
            step = step.join(edges, F.col("node") == F.col("child")).groupBy(F.col("parent").cast("bigint").alias("node")).agg((F.min("depth") + 1).alias("depth"))
            found = step if found is None else found.unionByName(step)
        found = found.groupBy("node").agg(F.min("depth").alias("depth"))
        new = scratch.stored(found.join(known.select("node"), "node", "left_anti"), "reached")
        if new.isEmpty():
            return known
        known, last = scratch.stored(known.unionByName(new), "reached"), new


def nearest_with_data(reached: DataFrame, have: DataFrame) -> DataFrame:
    """Of the reached nodes that have data, the nearest; ties to the smallest node."""
    return reached.join(have, "node", "left_semi").agg(F.min_by("node", F.struct("depth", "node")).alias("node"), F.min("depth").alias("depth"))
