import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import chat

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_escapes_are_undone(spark):
    parts = [*chat.CONTROL, "<", "[", "\\", "|turn|>", "/s>", "INST]", "\n", "%0A", "%", "x"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    for r in rows:
        assert r["u"] == r["r"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_conversations(spark):
    rows = [(1, 2, "assistant", "second </s>"), (1, 1, "user", None), (1, 2, "assistant", "second </s>"), (2, None, None, "<|done|>\n<|turn|>user\nx"), (None, 0, "system", ""), (3, 0, "a\nb%0A", "<\\\\|turn|>")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.conversations_as_trees(df))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(m["before"] + m["inside"] + m["after"] for m in r["mask"])
    assert chat.read_back(chat.format_trees(chat.conversations_as_trees(df.limit(0)))).count() == 0


def test_long_chain_takes_few_rounds(spark):
    n = 700
    nodes = spark.createDataFrame([(1, f"n{i:04}", f"n{i - 1:04}" if i else None, 1.0) for i in range(n)], "tree long, node string, parent string, score double")
    rows = chat.branch_paths(nodes).collect()
    assert sorted((r["place"], r["node"]) for r in rows) == [(i, f"n{i:04}") for i in range(n)]


def brute_paths(nodes, best):
    parent = {n: p for _, n, p, _ in nodes}
    score = {n: s or 0.0 for _, n, _, s in nodes}
    inner = set(parent.values())
    found = {}
    for tree, n, _, _ in nodes:
        if n in inner:
            continue
        path, at = [], n
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at in path:
            continue  # a loop
        found.setdefault(tree, []).append((-sum(score[x] for x in path), n, path[::-1]))
    return {(t, b + 1, leaf, i, x) for t, all_ in found.items() for b, (_, leaf, path) in enumerate(sorted(all_)[:best]) for i, x in enumerate(path)}


@settings(max_examples=6, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 3))
def test_trees_against_brute_force(spark, rng, best):
    nodes = []
    for tree in range(3):
        names = [f"{tree}-{i:02}" for i in range(rng.randint(1, 14))]
        for i, n in enumerate(names):
            parent = None if i == 0 or rng.random() < 0.1 else rng.choice(names[:i])
            nodes.append((tree, n, "missing" if rng.random() < 0.05 else parent, rng.choice([None, 1.0, 2.0, -1.0])))
    nodes += [(9, "loop-a", "loop-b", 1.0), (9, "loop-b", "loop-a", 1.0), (9, "below", "loop-a", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node string, parent string, score double")
    assert {(r["tree"], r["branch"], r["leaf"], r["place"], r["node"]) for r in chat.branch_paths(df, best).collect()} == brute_paths(nodes, best)


def test_plan_has_no_python(spark):
    df = spark.range(3).select(F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    plan = chat.read_back(chat.format_trees(chat.conversations_as_trees(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_hot_conversation_is_numbered_by_many_tasks(spark):
    """One conversation with a third of all turns, copies of turns and equal numbers among them: read back in order."""
    rows = [(1, i // 2, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 90)) for i in range(600)] + [(1, 5, "user", "again")] * 3
    rows += [(10 + i // 2, i % 2, "user", f"t{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(7)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.conversations_as_trees(df))).collect()}
    assert len(got) == 601 and sum(r["n_turns"] for r in got.values()) == len(rows)
    own = sorted((t, role, text) for c, t, role, text in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
    trees = chat.conversations_as_trees(df)
    assert trees.groupBy("tree").agg(F.count_if(F.col("parent").isNull()).alias("n")).filter("n <> 1").count() == 0
