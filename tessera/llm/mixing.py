"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, gone through as often as its
target asks (twice at most). A document's virtual finish time is the cumulative size of its source up to
and with it, divided by the source's target. All queues together are served in the order of finish
times until the total budget is spent, so every source comes near its target at any moment.

Cumulative sums over a source, and over all items, are taken in ranges: sums per range, running sums
over the small table of ranges, then sums within a range. No source is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, dropped, packed, row_keys, shards, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Documents in one range of the shuffled order of a source, or of the order of finish times.
RANGE = 20_000
SEED = "mix"


def words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of sizes(source, size), one row per source.

    Sources by code point, null last, weigh WEIGHTS in turn. A target is the level times the weight, or
    REPEATS times the source's size if that is less; of the levels that fit when the k sources
    of smallest size per weight are full, the greatest is the one at which all add up to the budget."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # From here on there is a row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    most = weighed.withColumn("most", F.lit(float(REPEATS)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy())
    level = most.withColumn("level", (budget - full) / rest).withColumn("level", F.max("level").over(Window.partitionBy()))
    return level.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with `cum`: the sum of size over its key's rows in the order (range, *order), up to and with each row."""
    sums = df.groupBy(*keys, "range").agg(F.sum("size").alias("in_range"))
    before = sums.withColumn("before", F.coalesce(F.sum("in_range").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [*keys, "range"]
    own = F.sum("size").over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.join(before.drop("in_range"), on).withColumn("cum", F.col("before") + own).drop("before", "range")


def mix(docs: DataFrame, seed: str = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, passes, taken) for each row of docs(doc_id, text, source); keys: columns to give back too.

    Null texts have size 0, null is a source of its own. Documents of size 0 are never served. The order
    of a source is that of the MD5 of id and seed, so reruns agree. Rows alike in id and size stand
    side by side; those that the cut falls between go by their cumulative size. An empty table gives an empty
    result. Extra columns are left aside."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    narrow = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")).alias("h"), *keys)
    sizes = stored(narrow, "sizes")
    goal = stored(targets(sizes).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "targets")
    total = goal.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    ranges = shards(spark, sizes.count(), RANGE)
    salted = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges, 32).alias("range")
    both = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select("doc_id", "size", "h", "sid", "source_size", "target", salted, *keys)
    queue = stored(_running(both, ["sid"], ["h", "doc_id", "size"]), "queue")
    dropped(sizes)

    items = queue.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("finish", _finish(F.col("pass")))
    items = items.select("finish", "h", "doc_id", "pass", "size", F.floor(F.col("finish") * ranges).alias("range"))
    sums = items.groupBy("range").agg(F.sum("size").alias("in_range"))
    reach = sums.withColumn("upto", F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    budget = F.lit(SHARE) * F.lit(total)
    edge = reach.where(F.col("upto") > budget).orderBy("range").limit(1).collect()
    if not edge:  # the budget holds everything
        passes = F.when(F.col("size") > 0, REPEATS).otherwise(0)
    else:
        at, before = edge[0]["range"], edge[0]["upto"] - edge[0]["in_range"]
        run = F.sum("size").over(Window.orderBy("finish", "h", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = items.where(F.col("range") == at).withColumn("run", run).where(F.col("run") + before > budget).orderBy("finish", "h", "doc_id", "pass").limit(1).collect()[0]
        # The first item that doesn't fit; whatever comes before it is taken.
        taken = lambda k: F.struct(_finish(F.lit(k)), F.col("h"), F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), F.lit(k)) < F.struct(F.lit(last["finish"]), F.lit(last["h"]), F.lit(last["doc_id"] if last["doc_id"] is not None else -(2**63)).cast("long"), F.lit(last["pass"]))
        passes = F.when(F.col("size") > 0, sum((taken(k).cast("int") for k in range(REPEATS)), F.lit(0))).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", passes.alias("passes"), *keys).withColumn("taken", F.col("size") * F.col("passes"))


def _finish(k):
    return (F.col("cum") + k * F.col("source_size")).cast("double") / F.col("target")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR || ':{SEED}') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, (SELECT max(level) FROM l) * weight) AS target FROM l),
q AS (
  SELECT doc_id, size, h, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, size, h, k, (cum + k * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS p(k) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, k ROWS UNBOUNDED PRECEDING) AS run FROM i),
n AS (SELECT doc_id, count(*) AS passes FROM r WHERE run <= 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.passes, 0))::BIGINT AS taken FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; those it doesn't take, or that have no words, go.

    A row is known by the file and place it is read from, so rows that repeat an id, or all of a row, are served each by its own passes. All
    columns of docs are kept, whatever their names; an empty table stays empty."""
    docs, (file, at) = row_keys(docs, "rows")
    keyed = packed(docs, "doc_id", "text", "source", file.alias("row_file"), at.alias("row_at"))
    passes = mix(keyed, keys=("row_file", "row_at")).where("passes > 0").select("row_file", "row_at", F.sequence(F.lit(1), "passes").alias("passes"))
    # The hint keeps texts from being sorted, and the plan the same whether ids are few or many.
    out = keyed.select("row", "row_file", "row_at").join(passes.hint("shuffle_hash"), ["row_file", "row_at"])
    return out.select("row", F.explode("passes").alias("pass")).select("row.*")
