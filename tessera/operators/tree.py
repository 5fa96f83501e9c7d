"""A store of conversations as trees of messages, and sequence operators on cells of a cache.

messages(id, convId, parent, timestamp, role, content); ids are unique, parent null at a root. A message's place among its
siblings is that of its timestamp, then id; children are derived, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import scratch


class CycleError(ValueError):
    pass


def _closure(messages: DataFrame, starts: DataFrame, down: bool = False) -> DataFrame:
    """(start, id, dist): each start(id) and all above it, or all below it.

    By doubling: a table of 4^k-th ancestors is joined with itself for the next one, and what is reached in fewer than 4^k steps with
    it for what is reached in fewer than 4^(k+1). So rounds grow with the logarithm of the depth. Each round is written to
    the shared folder. A message that is its own ancestor raises CycleError."""
    far, near = ("id", "up") if down else ("up", "id")
    hop = messages.where("parent is not null").select("id", F.col("parent").alias("up")).join(messages.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up")
    reached = starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("bigint").alias("dist"))
    size, span, held = None, 1, []

    def twice(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(F.col("id").alias("up"), F.col("up").alias("_to")), "up").select("id", F.col("_to").alias("up"))

    def moved(by: DataFrame, steps: int) -> DataFrame:
        return reached.join(by.select(F.col(near).alias("id"), F.col(far).alias("_to")), "id").select("start", F.col("_to").alias("id"), (F.col("dist") + steps).alias("dist"))

    while True:
        two = twice(hop, hop)
        three = twice(two, hop)
        reached = scratch.stored(reached.unionByName(moved(hop, span)).unionByName(moved(two, 2 * span)).unionByName(moved(three, 3 * span)), "reached")
        hop = scratch.stored(twice(two, two), "hops")
        span *= 4
        for old in held:
            scratch.dropped(old)
        held = [reached, hop]
        if hop.isEmpty():
            scratch.dropped(hop)
            return reached
        if size is None:
            size = messages.count()
        if span > size:
            raise CycleError("a message is its own ancestor")


def path(spark, messages: DataFrame, leaf: str | None = None, conv=None) -> DataFrame:
    """R2: the messages from a leaf up to its root, system first, then by time. Unknown leaf: the latest message of the conversation, or nothing if none is named."""
    start = messages.where(F.col("id") == F.lit(leaf)).select("id").limit(1)
    if leaf is None or start.isEmpty():
        own = messages.where(F.col("convId") == F.lit(conv).cast("bigint"))  # none is named: null, which equals nothing
        start = own.orderBy(F.col("timestamp").desc(), "id").select("id").limit(1)
    return messages.join(_closure(messages, start).select("id"), "id").orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "timestamp")


def paths(messages: DataFrame, spark) -> DataFrame:
    """(leaf, id, up) of all leaves at once."""
    leaves = messages.join(messages.select(F.col("parent").alias("id")), "id", "left_anti").select("id")
    return _closure(messages, leaves).select(F.col("start").alias("leaf"), "id", F.col("dist").alias("up"))


def last_child(messages: DataFrame) -> DataFrame:
    return messages.where("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("timestamp", "id")).alias("child"))


def leaf_of(spark, messages: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, leaf): following the last child from each start(id), by doubling: who has no child points to itself."""
    child = last_child(messages).select(F.col("parent").alias("id"), F.col("child").alias("to"))
    hop = messages.select("id").join(child, "id", "left").select("id", F.coalesce("to", "id").alias("to"))
    size, span, before = None, 1, None
    while True:
        for _ in range(2):  # four times as far
            hop = hop.join(hop.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to"))
        hop, span = scratch.stored(hop, "leaves"), 4 * span
        if before is not None:
            scratch.dropped(before)
        before = hop
        if hop.select(F.col("to").alias("parent")).join(last_child(messages), "parent", "left_semi").isEmpty():
            return starts.join(hop, "id").select(F.col("id").alias("start"), F.col("to").alias("leaf"))
        if size is None:
            size = messages.count()
        if span > size:
            raise CycleError("a message is its own ancestor")


def descendants(spark, messages: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, depth) of all below each start(id), itself left out."""
    return _closure(messages, starts, down=True).where("dist > 0").select("start", "id", F.col("dist").alias("depth"))


def siblings(messages: DataFrame) -> DataFrame:
    """Each message's place among its siblings, how many there are, and the ones before and after."""
    own = Window.partitionBy("convId", "parent")
    order = own.orderBy("timestamp", "id")
    return messages.select("convId", "id", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(own).alias("n_siblings"), F.lag("id").over(order).alias("previous"), F.lead("id").over(order).alias("next"))


def with_branch(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages added below existing ones; those whose parent isn't there are refused."""
    have = messages.select(F.col("id").alias("parent"))
    return messages.unionByName(new.join(have, "parent", "left_semi"))


def delete_cascading(spark, messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Without the starts and all below them."""
    gone = descendants(spark, messages, starts).select("id").unionByName(starts.select("id"))
    return messages.join(gone, "id", "left_anti")


def delete_reparenting(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Without the starts; their children hang where they hung. A start may not be the child of another."""
    gone = messages.join(starts, "id", "left_semi").select(F.col("id").alias("parent"), F.col("parent").alias("_grand"), F.lit(True).alias("_gone"))
    out = messages.join(starts, "id", "left_anti").join(gone, "parent", "left")
    return out.withColumn("parent", F.when(F.col("_gone"), F.col("_grand")).otherwise(F.col("parent"))).select(*messages.columns)


def fork(spark, messages: DataFrame, leaf: str, conv: int) -> DataFrame:
    """The path to a leaf as a conversation of its own, with new ids and parents to match."""
    own = path(spark, messages, leaf)
    new = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c), F.lit(f"@{conv}")))
    return own.select(new("id").alias("id"), F.lit(conv).cast("bigint").alias("convId"), new("parent").alias("parent"), "timestamp", "role", "content")


def imported(have: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, counts): rows whose id is there already are skipped."""
    fresh = new.join(have.select("id"), "id", "left_anti")
    counts = new.join(have.select("id", F.lit(True).alias("_there")), "id", "left").agg(F.count_if(F.col("_there").isNull()).alias("imported"), F.count_if("_there").alias("skipped"))
    return have.unionByName(fresh), counts


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """0 for conversations without messages."""
    n = messages.groupBy("convId").agg(F.count(F.lit(1)).alias("n"))
    return conversations.join(n, conversations["id"] == n["convId"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_messages"))


# Cells of a cache: cells(seq, pos, cell).


def remove_range(cells: DataFrame, seq, lo: int, hi: int) -> DataFrame:
    """Positions lo to hi (open end) of a sequence; a seq below 0 means all."""
    inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
    return cells.where(~(inside if seq < 0 else inside & (F.col("seq") == seq)))


def copy_range(cells: DataFrame, source: int, to: int, lo: int, hi: int) -> DataFrame:
    """The cells are shared, not copied."""
    return cells.unionByName(cells.where((F.col("seq") == source) & (F.col("pos") >= lo) & (F.col("pos") < hi)).withColumn("seq", F.lit(to).cast("bigint"))).distinct()


def keep_only(cells: DataFrame, seq: int) -> DataFrame:
    """R12."""
    return cells.where(F.col("seq") == seq)


def shift_range(cells: DataFrame, seq: int, lo: int, hi: int, by: int) -> DataFrame:
    """Positions moved; what falls below 0 goes."""
    inside = (F.col("seq") == seq) & (F.col("pos") >= lo) & (F.col("pos") < hi)
    return cells.withColumn("pos", F.when(inside, F.col("pos") + by).otherwise(F.col("pos"))).where("pos >= 0")


def divide_range(cells: DataFrame, seq: int, lo: int, hi: int, by: int) -> DataFrame:
    """R14."""
    inside = (F.col("seq") == seq) & (F.col("pos") >= lo) & (F.col("pos") < hi)
    return cells.withColumn("pos", F.when(inside, F.floor(F.col("pos") / by)).otherwise(F.col("pos")))


def span_of(cells: DataFrame) -> DataFrame:
    """W18."""
    return cells.groupBy("seq").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
