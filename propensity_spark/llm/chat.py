"""Reply trees formatted as conversations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensity_spark.llm.common import stored

#: A turn is HEAD, the url-encoded role, a line feed, the escaped text, END and a line feed.
HEAD, END = "### ", "</turn>"


def escape(text: Column) -> Column:
    """A backslash goes before every backslash, between the first two of three number signs and into an end mark.

    What comes out contains neither "###" nor END. unescape() gives the text back.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=##)", r"#\\")
    return F.regexp_replace(text, "</(?=turn>)", r"<\\/")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of conversations without branches: every turn replies to the one before it.

    Turns with the same number, and NULL ones first, are ordered by role and text; equal rows are turns of their own.
    """
    order = [F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    place = F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long")
    numbered = turns.select(F.col(conv).alias("conv_id"), F.col("role"), F.col("text"), place.alias("message_id"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return numbered.withColumn("parent_id", parent).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """conv_id, root_id, path (1 is the best), leaf_id, place (1 is the root) and message_id of chosen paths' messages.

    messages: conv_id, message_id, parent_id (NULL or missing in the conversation: a root), score. A branch's score is
    the mean score of its messages (NULL: 0); each root's leaves are ranked by it, ties by the deeper and then the
    smaller leaf id, and the `per_tree` best are chosen. Self-joins double the reach of every message: after k of them
    each knows its ancestor 2^k steps up and the sum of scores until there, or, if it is no deeper than that, its root.
    Only the deeper ones are joined again, so d levels take log2(d) joins; the same steps, taken back from the widest,
    list the messages of the chosen paths, each once. Messages that are their own ancestors lie on no path from a
    root. conv_id may be NULL; messages without id are left out.
    """
    nodes = messages.where(F.col("message_id").isNotNull()).select(
        F.struct("conv_id", F.col("message_id").alias("id")).alias("node"),
        F.struct("conv_id", F.col("parent_id").alias("id")).alias("up"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"))
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    first = stored(nodes.join(known, "up", "left").select(
        "node", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there").isNull(), F.col("node"))
        .alias("root"), "sum", F.lit(1).cast("long").alias("depth")), "replies")
    inner = first.where(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
    # `open_`: messages below the reach, with the ancestor at it (`up`); `done`: those that know their root.
    done, open_, steps = first.where(F.col("up").isNull()), first.where(F.col("up").isNotNull()), []
    total = left = open_.count()
    while left and 1 << len(steps) <= 2 * total:  # beyond that only rings are left
        steps.append(open_.select("node", "up"))
        above = done.unionByName(open_).select(
            F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"),
            F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        more = stored(open_.join(above, "up").select(
            "node", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("sum") + F.col("sum2")).alias("sum"),
            (F.col("depth") + F.col("depth2")).alias("depth")), "replies")
        done, open_ = done.unionByName(more.where(F.col("up").isNull())), more.where(F.col("up").isNotNull())
        left = open_.count()
    leaves = done.join(inner, "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(
        F.desc(F.col("sum") / F.col("depth")), F.desc("depth"), "node"))
    # Spark's window group limit cuts each task's part of a root with very many leaves to the best before the shuffle.
    best = leaves.withColumn("path", rank).where(F.col("path") <= per_tree)
    members = best.select(F.col("node").alias("leaf"), "root", F.col("path").cast("long"), "node")
    for up in reversed(steps):
        members = stored(members, "members")
        members = members.unionByName(members.join(up, "node").drop("node").withColumnRenamed("up", "node"))
    members = members.join(done.select("node", F.col("depth").alias("place")), "node")
    return members.select(
        F.col("root.conv_id").alias("conv_id"), F.col("root.id").alias("root_id"), "path",
        F.col("leaf.id").alias("leaf_id"), "place", F.col("node.id").alias("message_id"))


def format_conversations(messages: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: conv_id, root_id, path, n_turns, formatted, loss_spans.

    messages: conv_id, message_id, parent_id, role, text, score (see paths()). loss_spans are the ranges [start, end)
    of code points of `formatted` that hold the escaped texts of the role `learn`, in order. NULL roles and texts are
    empty; a NULL conv_id is a conversation like any other. A path is one row, as its text is one value.
    """
    key = F.struct("conv_id", F.col("message_id").alias("id")).alias("node")
    own = messages.where(F.col("message_id").isNotNull()).select(
        key, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(HEAD), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    turns = paths(messages, per_tree).withColumn("node", key).join(own, "node").select(
        "conv_id", "root_id", "path", "place", "role", head.alias("head"), body.alias("body"))
    chunk = F.concat("head", "body", F.lit(END + "\n"))
    before = Window.partitionBy("conv_id", "root_id", "path").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("chunk", chunk).withColumn("start", start)
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    rows = placed.groupBy("conv_id", "root_id", "path").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("chunks"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn, span))).alias("loss_spans"))
    return rows.select("conv_id", "root_id", "path", "n_turns",
                       F.array_join(F.col("chunks.chunk"), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    parts = F.split(formatted, END + "\n", -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(parts, lambda part: F.struct(
        F.url_decode(F.substr(F.split(part, "\n", 2)[0], F.lit(len(HEAD) + 1))).alias("role"),
        unescape(F.split(part, "\n", 2)[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
