"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parents. Self-joins that double their reach each time give every
message its depth, root and the score of the path down to it, in a number of rounds
that is the logarithm of the deepest reply; every leaf is a branch, branches of a
tree are ranked by score, and the kept jumps of 1, 2, 4, ... replies enumerate each
chosen path from its leaf to the root without a message met twice. Each chosen path
is formatted as one conversation.

The template marks turns with control strings. Inside texts and roles, a control
string gets a backslash after its first character (one more than it has), which is
undone on reading; no other text changes.

Rounds are checkpointed in the shared folder and hold ids and numbers only. Turns
meet in two steps, first runs of RUN turns, so that a hot conversation's turns are
put together by many tasks; what remains in one row is what the formatted
conversation itself is.

Defined cases: null texts and roles are empty; a parent that is missing makes a root;
messages on a loop of parents, and below it, are in no path; of equal scores the
least leaf wins; turns with equal numbers go by role, then text; repeated rows are
turns as often as they are there; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed
from quern.operators.chunking import in_corpus_order

OPEN, CLOSE = "<|turn|>", "<|done|>"
#: Strings of this and other templates that never stand in a text unescaped.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>")
ASSISTANT = "assistant"
#: Turns that are put together before a conversation is.
RUN = 64

_REST = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL)
_FIRST = r"[<\[]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})\\(\\*)({_REST})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE + "\n"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text, before, inside, after>> of a formatted conversation: unescaped role and text, and the
    characters of the formatted turn before, inside and after its text. These lengths, turn by turn, are the loss
    mask in run-length form: what is inside an assistant's turn is under it, all else is not.
    """
    pieces = F.filter(F.split(formatted, r"<\|done\|>\n", -1), lambda p: p != "")
    marks = len(OPEN)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        text = F.substring(piece, line + 1, F.char_length(piece))
        return F.struct(unescape_role(F.substring(piece, F.lit(marks + 1), line - marks - 1)).alias("role"), unescape(text).alias("text"), line.alias("before"), F.char_length(text).alias("inside"), F.lit(len(CLOSE) + 1).alias("after"))

    return F.transform(pieces, turn)


def branch_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """nodes(tree, node, parent, score) to (tree, branch, leaf, node, place): the messages of the ``best`` branches of each tree.

    ``node`` is unique and not null; place counts from 0 at the root; branch is the rank by score.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    # up: where the jump of 2 ** k replies leads (null beyond the root); depth and total: over the replies jumped
    own = lambda up: ("tree", "node", up.alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    # messages without a parent need no join, and all would meet in one task of it
    jump = nodes.filter("parent is not null").join(known, "parent", "left").select(*own(F.when(F.col("there"), F.col("parent"))))
    jump = checkpointed(jump.unionByName(nodes.filter("parent is null").select(*own(F.col("parent")))))
    # messages that have met their root are set aside, so a round is as large as what still is on its way
    rooted, going, jumps, most = jump.filter("up is null"), jump.filter("up is not null"), [], jump.count()
    while 1 << len(jumps) <= most and not going.isEmpty():
        jumps.append(going.select("node", "up"))
        known = rooted.unionByName(going)
        above = known.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        jump = checkpointed(going.join(above, "up").select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")))
        rooted, going = rooted.unionByName(jump.filter("up is null")), jump.filter("up is not null")
    leaves = rooted.join(nodes.select(F.col("parent").alias("node")).filter("node is not null").distinct(), "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    if best == 1:  # an aggregate, so that a tree with many leaves needs no sort in one task
        chosen = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("less"), "node")).alias("first")).select("tree", F.lit(1).alias("branch"), F.col("first.node").alias("leaf"))
    else:
        chosen = leaves.select("tree", F.row_number().over(order).alias("branch"), F.col("node").alias("leaf")).filter(F.col("branch") <= best)
    paths = chosen.select("tree", "branch", "leaf", F.col("leaf").alias("node"))
    for up in reversed(jumps):
        paths = checkpointed(paths.unionByName(paths.join(up, "node").select("tree", "branch", "leaf", F.col("up").alias("node"))))
    return paths.join(rooted.select("node", (F.col("depth") - 1).alias("place")), "node").select("tree", "branch", "leaf", "node", "place")


def format_paths(paths: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formatted: one row a path. ``paths`` has keys, node and place, ``messages`` node, role and text."""
    turns = paths.join(messages.select("node", "role", "text"), "node").select(*keys, "place", format_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("turn"))
    put = lambda what, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(what).alias("what")))), lambda x: x["what"]), "")
    run = F.floor(F.col("place") / RUN).alias("run")
    runs = turns.groupBy(*keys, run).agg(put("turn", "place").alias("part"))
    return runs.groupBy(*keys).agg(put("part", "run").alias("formatted"))


def conversations_as_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(tree, node, parent, score, role, text) of conversations whose turns answer each other in order.

    A node is the turn's place in the order of all turns, made by ranges of it, so the turns of a hot
    conversation are numbered by many tasks; the first turns, one number a conversation, have no parent.
    """
    rows = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), "role", "text")
    placed = in_corpus_order(rows, "tree", "turn", "role", "text").drop("turn")
    first = placed.groupBy("tree").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    rooted = placed.join(first, "pos", "left")
    return rooted.select("tree", F.col("pos").alias("node"), F.when(F.col("first").isNull(), F.col("pos") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, branch, leaf, formatted) of messages(tree, node, parent, score, role, text)."""
    return format_paths(branch_paths(messages.select("tree", "node", "parent", "score"), best), messages, ["tree", "branch", "leaf"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, all of it read from the formatted text; mask is the loss mask in run-length form."""
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    lost = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    loss = F.array_join(F.transform(lost, lambda t: t["text"]), "")
    rows = formatted.select("tree", "formatted", turns_of(F.col("formatted")).alias("turns"))
    rows = rows.select("tree", "formatted", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), loss.alias("loss"), F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("loss"), t["before"].alias("before"), t["inside"].alias("inside"), t["after"].alias("after"))).alias("mask"))
    return rows.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "mask")
