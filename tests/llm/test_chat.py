import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\", "<\\|im_end|>", "<<SYS>>x<</SYS>>", "a\\<s>\\\\</s>", "<<s>", "[[INST]]", "<|a|><|b|>", "é<|ü|>", "$1\\2", "<|im_end|", "|>\n"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -(10**9), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(chat.OP1_SQL).fetchall())
    got = sorted(tuple(r) for r in chat.op1_chat_format(spark, sf_dir).collect())
    assert got == want and got[0][0] == -7
    plan = chat.op1_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edge_cases(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(NASTY) + rnd.choice(NASTY)) for i in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(100, 0, None, None), (101, 0, "assistant", ""), (102, 0, "a b\n%c", "x"), (None, 0, "user", "no id"), (103, None, "user", "null turn"), (103, 0, "assistant", "y"), (104, 1, "user", "same"), (104, 1, "user", "same"), (105, 0, "assistant", "<|x|>" * 40_000)]
    rows += [(106, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(700)]
    conversations(spark, rows).withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got == plain(rows) | {-7: plain([(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])])[-7]}
    conversations(spark, []).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert chat.op1_chat_format(spark, f"{tmp_path}/empty").count() == 1


def test_mask_covers_the_assistant_only(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "s"), ("user", NASTY[0]), ("assistant", NASTY[1]), ("user", "u"), ("assistant", "é\\")])]
    r = chat.conversations_of(chat.linear(conversations(spark, rows))).first()
    cut = [r.formatted[s.start : s.end] for s in r.loss_spans]
    assert len(cut) == 2 and "".join(c.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for c in cut) == NASTY[1] + "é\\"
    assert r.formatted.count("<|im_start|>") == 5 == r.formatted.count("<|im_end|>")


def test_trees(spark):
    """Paths, ranking and ties against a walk of random trees; orphans are roots, cycles belong to no path."""
    rnd = random.Random(7)
    nodes, want = [], {}
    for tree in range(30):
        n = rnd.randrange(1, 40)
        parent = {i: (rnd.randrange(max(0, i - 3), i) if i else None) for i in range(n)}
        if tree % 5 == 0 and n > 3:
            parent[3] = 999  # not there
        score = {i: rnd.choice([0.0, 0.5, 1.0]) for i in range(n)}
        nodes += [(f"t{tree}", i, parent[i], score[i], "user", f"m{i}") for i in range(n)]
        paths = []
        for leaf in range(n):
            if leaf in parent.values():
                continue
            path, at = [], leaf
            while at is not None and at in parent:
                path.append(at)
                at = parent[at]
            paths.append((-sum(score[i] for i in path) / len(path), -len(path), leaf, path[::-1]))
        want[f"t{tree}"] = [p[3] for p in sorted(paths)[:2]]
    nodes += [("loop", 1, 2, 1.0, "user", "x"), ("loop", 2, 1, 1.0, "user", "x"), ("loop", 3, 1, None, None, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double, role string, text string")
    got = {}
    for r in chat.best_paths(df, branches=2).orderBy("tree", "branch", "depth").collect():
        got.setdefault(r.tree, {}).setdefault(r.branch, []).append(r.node)
    assert {t: [b[k] for k in sorted(b)] for t, b in got.items()} == want
    formatted = chat.conversations_of(df, branches=2)
    assert formatted.count() == sum(map(len, want.values()))
