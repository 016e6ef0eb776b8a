"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by their parent ids. Iterative self-joins with doubled steps list the
ancestors of every leaf (a tree of depth d takes log2(d) + 1 rounds, cycles or not), branches are
ranked by the sum of their messages' scores, and each chosen root-to-leaf path becomes one
conversation. Roots take no part in the joins on parents, so their null parents meet nowhere.

Template: every turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``. Inside roles and texts a
backslash is doubled, and the four control strings get a backslash after their first character,
so that no control string is left and reading back is exact. The loss mask is a list of
intervals of code points that cover the texts of assistant turns.

Defined results: a null role or text is empty; a null score counts as 0; equal scores are
ranked by leaf id; a message whose parent is missing or null is a root; a message without an id
is left out; messages on a cycle, and those whose ancestors lead into one, have no root and form
no path; of several rows with one id the least by parent, score, role and text (nulls first)
counts; texts of any length are formatted whole; other columns are not read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.runtime import Scratch

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = (CLOSE, OPEN, END, START)


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in _CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def one_per_id(messages: DataFrame) -> DataFrame:
    """(msg_id and those of parent_id, score, role, text that are there), one row for every id."""
    there = [c for c in ("parent_id", "score", "role", "text") if c in messages.columns]
    rows = messages.where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.min(F.struct(*there)).alias("_m"))
    return rows.select("msg_id", *[F.col(f"_m.{c}").alias(c) for c in there])


def paths(messages: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of every tree: (root, leaf, score, depth_left, msg_id), a row per message.

    ``messages`` has msg_id, parent_id and score. ``depth_left`` is the number of steps from the
    message to the leaf. Each round doubles the length of the steps that are joined. Rounds end
    when no message has so many ancestors, or when doubling the step leaves as many messages with
    so many ancestors as before: as every depth up to the greatest occurs, those then hang on cycles.
    """
    return _paths(scratch.save(one_per_id(messages.select("msg_id", "parent_id", "score")), "ids"), scratch, top)


def _paths(messages: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    links = messages.select("msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    child = links.where("parent_id is not null")
    ids = links.select(F.col("msg_id").alias("parent_id"))
    child = scratch.save(child.join(ids, "parent_id", "left_semi").select("msg_id", "parent_id", "score"), "children")
    leaves = links.select("msg_id").join(child.select(F.col("parent_id").alias("msg_id")), "msg_id", "left_anti")
    # jump: message -> ancestor `step` steps above; walk: leaf -> ancestors fewer than `step` steps above
    jump = child.select("msg_id", F.col("parent_id").alias("up"))
    walk = leaves.select(F.col("msg_id").alias("leaf"), F.col("msg_id"), F.lit(0).cast("long").alias("depth_left"))
    step, round_no, n = 1, 0, jump.count()
    while n:
        further = walk.join(jump, "msg_id").select("leaf", F.col("up").alias("msg_id"), (F.col("depth_left") + step).alias("depth_left"))
        walk = scratch.save(walk.unionByName(further), f"walk{round_no}")
        above = jump.select(F.col("msg_id").alias("up"), F.col("up").alias("further"))
        jump = scratch.save(jump.join(above, "up").select("msg_id", F.col("further").alias("up")), f"jump{round_no}")
        before, n = n, jump.count()
        if n == before:
            break
        if round_no:
            scratch.drop(f"walk{round_no - 1}", f"jump{round_no - 1}")
        step, round_no = step * 2, round_no + 1
    if n:
        walk = walk.join(jump.select(F.col("msg_id").alias("leaf")), "leaf", "left_anti")
    scored = walk.join(links.select("msg_id", "score"), "msg_id")
    branches = scored.groupBy("leaf").agg(F.sum("score").alias("score"), F.max(F.struct("depth_left", "msg_id"))["msg_id"].alias("root"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("score").desc(), "leaf"))
    chosen = branches.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    return walk.join(chosen, "leaf").select("root", "leaf", "score", "depth_left", "msg_id")


def render(turns: DataFrame, by: list[str]) -> DataFrame:
    """One row per conversation (columns ``by``): n_turns, formatted, loss_spans.

    ``turns`` has ``at`` (an order that is unique within the conversation), role and text.
    """
    wrapped = turns.select(
        *by,
        "at",
        F.concat(F.lit(START), escape(F.col("role")), F.lit(OPEN)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learnt"),
    )
    grouped = wrapped.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "learnt"))).alias("t"))
    tail = len(CLOSE + END)
    marks = F.aggregate(
        F.transform("t", lambda x: F.struct(F.length(x["head"]).cast("long").alias("h"), F.length(x["body"]).cast("long").alias("b"), F.coalesce(x["learnt"], F.lit(False)).alias("l"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["b"] + tail).alias("at"),
            F.when(x["l"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["h"]).alias("start"), (a["at"] + x["h"] + x["b"]).alias("stop"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return grouped.select(
        *by,
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + END))), "").alias("formatted"),
        marks.alias("loss_spans"),
    )


def format_trees(messages: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(root, leaf, score, n_turns, formatted, loss_spans) of the best paths; ``messages`` has msg_id, parent_id, score, role, text."""
    messages = scratch.save(one_per_id(messages), "messages")
    turns = _paths(messages, scratch, top).join(messages.select("msg_id", "role", "text"), "msg_id")
    return render(turns.withColumn("at", -F.col("depth_left")), ["root", "leaf", "score"])


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part):
        # regexp_extract with (?s) would do, but two splits are cheaper on long texts
        pieces = F.split(part, r"\[INST\]")
        role = F.substring(F.get(pieces, 0), len(START) + 1, 1 << 30)
        body = F.get(pieces, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.lit(1), F.length(body) - len(CLOSE))).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as reply chains: each turn replies to the one before it.

    Turns with equal numbers follow each other by role and text; repeated rows are kept.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.withColumn("n", F.row_number().over(order))
    named = lambda n: F.struct(F.col("conv_id"), n.cast("int").alias("n"))
    return numbered.select(
        named(F.col("n")).alias("msg_id"),
        F.when(F.col("n") > 1, named(F.col("n") - 1)).alias("parent_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )
