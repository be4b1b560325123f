"""Reply trees to conversations.

Messages form trees (message, parent).  Every root-to-leaf path is found by
iterative self-joins with doubling: round k joins each message's ancestor at
distance 2^k with itself, and the path of each leaf with the ancestors at
that distance, so a chain of n messages takes log2(n) rounds and the total
of path rows is the total length of the paths.  Branches are ranked by the
mean score of their messages; each chosen path becomes one conversation.

Template: ``<|start|>role\\n`` text ``<|end|>\\n``.  Inside roles and texts
``\\``, ``<`` and ``[`` are written ``\\s``, ``\\l`` and ``\\b`` (a line end in a
role ``\\n``); so no control
string that contains ``<`` or ``[`` can appear there, neither this template's
nor those of others, and the original comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.text import whole
from basketry.session import stage

START, END = "<|start|>", "<|end|>\n"


def escape(col: Column) -> Column:
    col = F.replace(col, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(col, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def _escape_role(col: Column) -> Column:
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def unescape(col: Column) -> Column:
    # backslashes last: until then each one starts an escape
    col = F.replace(F.replace(col, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(col, F.lit("\\s"), F.lit("\\"))


def _ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up): the k-th has each message's ancestor at
    distance 2^k; the last is empty, or else holds the messages on or below
    a cycle."""
    known = messages.select("tree", F.col("node").alias("parent"))
    up = messages.filter("parent IS NOT NULL").select("tree", "node", "parent").join(known, ["tree", "parent"])
    out = [stage(up.select("tree", "node", F.col("parent").alias("up")), "up")]
    total = messages.count()
    while out[-1].take(1) and 1 << len(out) - 1 <= total:
        low = out[-1].select("tree", F.col("up").alias("mid"), "node")
        high = out[-1].select("tree", F.col("node").alias("mid"), "up")
        out.append(stage(low.join(high, ["tree", "mid"]).select("tree", "node", "up"), "up"))
    return out


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) of ``messages(tree, node, parent)``: the nodes
    on the path of each leaf, dist counted from the leaf.

    A message whose parent is null or missing starts a tree.  Messages on or
    below a cycle have no root and are left out.  (tree, node) must be unique.
    """
    *ups, last = _ancestors(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).distinct()
    path = (messages.select("tree", "node").join(last, ["tree", "node"], "left_anti")
            .join(parents, ["tree", "node"], "left_anti")
            .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist")))
    for k, up in enumerate(ups):
        more = path.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        path = stage(path.unionByName(more), "path")
    return path


def best_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, dist): paths ranked within their tree
    by mean message score (null score: 0), best first, ties by leaf; ``keep``
    paths a tree, all if None."""
    path = paths(messages)
    scored = path.join(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("s")), ["tree", "node"])
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = scored.groupBy("tree", "leaf").agg(F.avg("s").alias("score")).withColumn("rank", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.filter(F.col("rank") <= keep)
    return path.join(ranked, ["tree", "leaf"])


def one_row_each(messages: DataFrame) -> DataFrame:
    """One row per (tree, node): of repeated rows the least by role, text,
    parent and score, nulls first."""
    kept = F.min(F.struct("role", "text", "parent", "score")).alias("m")
    return messages.groupBy("tree", "node").agg(kept).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def format_trees(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per chosen path of ``messages(tree, node, parent, role, text,
    score)``: tree, leaf, rank, score, formatted, loss (array of
    <start, length> in code points: the assistants' texts), n_turns.

    Null role and null text: empty.  Null score: 0.  Rows need a node; of
    rows that share tree and node one is read (``one_row_each``); extra
    columns are not read.  Empty table: no rows.
    """
    messages = one_row_each(messages)
    # as a struct, a null tree equals itself in joins
    messages = messages.withColumn("tree", F.struct("tree"))
    body = messages.select("tree", "node", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    chosen = best_paths(messages, keep).join(body, ["tree", "node"])
    turns = chosen.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), _escape_role(F.col("role")).alias("role"),
                                             escape(F.col("text")).alias("text"),
                                             (F.col("role") == "assistant").alias("loss")))).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    fixed = len(START) + 1 + len(END)
    # running length of the turns before, and the spans of the marked texts
    walk = F.aggregate(
        "turns", F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["n"] + F.length(t["role"]) + F.length(t["text"]) + fixed).alias("n"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["n"] + len(START) + F.length(t["role"]) + 1).alias("start"), F.length(t["text"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return (turns.withColumn("pieces", piece).withColumn("walk", walk)
            .select("tree.tree", "leaf", "rank", "score", F.array_join("pieces", "").alias("formatted"),
                    F.col("walk.spans").alias("loss"), F.size("turns").cast("long").alias("n_turns")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    raw = F.filter(F.split(formatted, "<\\|end\\|>\\n"), lambda x: x != F.lit(""))
    inside = F.transform(raw, lambda x: F.substring(x, len(START) + 1, 2**31 - 1))
    return F.transform(inside, lambda x: F.struct(
        unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def threads(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before.
    Ties and null turns are ordered by (turn, role, text), nulls first; rows
    with a null tree form one conversation."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    base = rows.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"),
                       F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return (base.withColumn("node", F.row_number().over(order).cast("long"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
            .select("tree", "node", "parent", "role", "text", F.lit(None).cast("double").alias("score")))
