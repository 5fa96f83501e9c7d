"""Chat formatting of reply trees, in DataFrame operations only.

Messages are nodes with a parent. Root-to-leaf paths are enumerated by self-joins that double the distance
each time: after round k a node knows its ancestor 2^k levels up and the sum of scores up to it, so a tree of depth d takes log2(d)
rounds, and text takes no part in them. Each leaf ends a branch; branches of a tree are ranked by
score. The nodes of the chosen branches are marked by walking the same tables back from the leaf, joined with their
texts, and formatted as one conversation per branch.

Format: every turn is `<|im_start|>` role, a line feed, the text, `<|im_end|>` and a line feed. A role is URL-encoded.
In a text, a backslash is doubled, and one is put after the first character of anything that looks
like a control string of this or another common template, so no text can open or close a turn; taking
single backslashes out and halving double ones restores it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import stored, table

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"(<)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"
LOSS_ROLES = ("assistant",)


def escaped(text):
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescaped(text):
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Table k: (tree, node, up, gain, depth), up being the ancestor 2^k levels up, or null; gain and depth sum what lies before it.

    nodes: (tree, node, parent, score). A parent that isn't there makes its child a root. A
    node in or below a cycle never reaches a root; rounds end once a jump is longer than the table."""
    have = nodes.select("tree", F.col("node").alias("parent"))
    now = nodes.join(have, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"), "score")
    rooted = nodes.join(now, ["tree", "node"], "left_anti").select("tree", "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("up"), "score")
    now = stored(now.unionByName(rooted).select("tree", "node", "up", F.col("score").alias("gain"), F.lit(1).cast("long").alias("depth")), "jump")
    out = [now]
    count = now.count()
    while 1 << (len(out) - 1) <= count and now.where("up is not null").limit(1).count():
        far = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"), F.col("depth").alias("depth2"))
        nearer = now.where("up is not null").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = stored(now.where("up is null").unionByName(nearer), "jump")
        out.append(now)
    return out


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, node, depth, score): the nodes of each tree's best branches, branch 1 the best, depth from 1 at the root.

    nodes: (tree, node, parent, score), tree and node not null and together unique. A branch is a path from a root
    to a leaf; its score is the mean of its nodes' scores (null counts 0); ties go to the longer branch,
    then the smallest leaf. `branches` is how many of each tree are wanted."""
    nodes = nodes.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    jumps = _jumps(nodes)
    whole = jumps[-1].where("up is null").select("tree", "node", "gain", "depth")
    inner = jumps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(inner, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("gain") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    marked = best.select("tree", "branch", "node", (F.col("gain") / F.col("depth")).alias("score"))
    for jump in reversed(jumps):
        steps = jump.where("up is not null").select("tree", "node", "up")
        marked = marked.unionByName(marked.join(steps, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), "score"))
        marked = stored(marked.distinct(), "marked")  # a table per round keeps plans flat
    out = marked.join(whole.select("tree", "node", "depth"), ["tree", "node"])
    return out.select("tree", "branch", "node", "depth", "score")


def conversations_of(messages: DataFrame, branches: int = 1, loss_roles=LOSS_ROLES) -> DataFrame:
    """(tree, branch, score, formatted, loss_spans) of messages(tree, node, parent, score, role, text).

    loss_spans: (start, end) of each text of a loss role in formatted, in code points, end exclusive, as it
    stands there (escaped). Null roles and texts count as empty. A branch's messages meet in one row, as the format asks, however long
    its texts are; tree and node name a message, so a row that repeats both is joined with each of its like. Extra columns are left
    aside; an empty table gives an empty result."""
    paths = best_paths(messages.select("tree", "node", "parent", "score"), branches)
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    body = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = turns.select("tree", "branch", "score", "depth", head.alias("head"), body.alias("body"), role.isin(*loss_roles).alias("loss"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    upto = Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(upto), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.char_length("body")).cast("long"))
    rows = turns.groupBy("tree", "branch").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("depth", "piece", "loss", "start", "end"))).alias("turns"))
    return rows.select(
        "tree", "branch", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"])).alias("loss_spans"),
    )


def parsed(formatted):
    """The turns, (role, text), in a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    body = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substr(body(p), F.lit(len(START) + 1))).alias("role"),
            unescaped(F.substr(p, F.char_length(body(p)) + 2)).alias("text"),
        ),
    )


def linear(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as trees without branches: each row replies to the one before it.

    Rows go by turn, null first, then by role and text; a null conv_id is a conversation too."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(tree.alias("tree"), F.col("conv_id").alias("conv_id"), "turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "conv_id", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = conversations_of(linear(rows.unionByName(hard))).where("branch = 1")
    turns = parsed(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", turns).withColumn("loss", loss).select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 1} + length(url_encode(role)) + length(regexp_replace(replace(text, '\\', '\\\\'), '{CONTROL}', '\\1\\3\\\\\\2\\4', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
