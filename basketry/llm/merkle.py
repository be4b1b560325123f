"""Merkle manifest of a dataset: a digest per row, per group and for all,
with the siblings that prove each row.

A leaf is the SHA-256 of a row's fields.  Within a group the leaves ascend by
id; every 16 consecutive nodes become their hash until one, the subroot, is
left; the subroots, ordered by group, likewise give the root.

Bitmap-rank index: the leaves are never sorted.  Each group's ids are merged
into a compressed bitmap (only 64-bit words with a bit set are kept) whose
popcount directory says how many rows lie before a word: sums within 1,024
words, then within 65,536 entries of each higher level, so no window holds
more than that whatever the ids are.  A leaf's coordinate is the directory's
sum plus the bits set below its own.  Words in which an id occurs more than
once, and rows without id, are ranked further by leaf digest.

Coordinates give every node its slot: a block of 256 nodes is a keyed slot
array, filled without a sort, that takes two levels at once.  Blocks are
bounded, so a group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ordinal import range_ordinal, running_totals
from basketry.session import stage

RUN = 16                   # nodes that become one
SPAN = RUN * RUN           # nodes of a block
STEPS = (10, 16, 16)       # directory levels above the words: bits of a word's number
NO_ID = -(1 << 58)         # the word of rows without id, before all others
COPIES = 4096              # equal rows that are numbered in one go


def sized(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*(sized(f) for f in fields)), 256)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def bitmap_words(rows: DataFrame) -> DataFrame:
    """(grp, word, bits, c): the compressed bitmaps of ``rows(grp, word,
    bit)`` and the rows of each word, merged before the shuffle."""
    return rows.groupBy("grp", "word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"), F.count("*").alias("c"))


def directory(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` with ``before`` (rows of the group in lower words), and (grp,
    n) of every group."""
    levels, t = [], words.withColumn("k", F.col("word"))
    for step in STEPS:
        t = t.withColumn("up", F.shiftright("k", step))
        w = Window.partitionBy("grp", "up").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(t.withColumn("within", F.coalesce(F.sum("c").over(w), F.lit(0))))
        t = t.groupBy("grp", F.col("up").alias("k")).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("grp").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    base = t.select("grp", F.col("k").alias("up"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    for level in reversed(levels):
        found = level.join(base, ["grp", "up"]).withColumn("before", F.col("before") + F.col("within"))
        base = found.select("grp", F.col("k").alias("up"), "before")
    return found.select("grp", "word", "bits", "c", "before"), t.groupBy("grp").agg(F.sum("c").alias("n"))


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(grp, id, leaf, ...)`` with ``r``, each leaf's place in its
    group from 0, and (grp, n).  Rows without id come first; rows that share
    an id go by leaf digest, equal rows in any order."""
    keys = rows.columns
    rows = rows.select("*", F.coalesce(F.shiftright("id", 6), F.lit(NO_ID)).alias("word"),
                       F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int").alias("bit"))
    words = stage(bitmap_words(rows), "bitmap")
    words, totals = directory(words)
    words = stage(words, "directory")
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))  # the bits below
    at = rows.join(words.filter("c = bit_count(bits)"), ["grp", "word"]).select(
        *keys, (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(lower))).alias("r"))
    shared = words.filter("c > bit_count(bits)").select("grp", "word", "before")
    if shared.isEmpty():
        return at, totals
    once = (rows.join(shared, ["grp", "word"]).groupBy(*keys, "word", "bit", "before").agg(F.count("*").alias("m"))
            .withColumn("nth", F.concat(F.lpad(F.col("bit").cast("string"), 2, "0"), F.col("leaf"))))
    bucket = F.col("bit") * 256 + F.conv(F.substring("leaf", 1, 2), 16, 10).cast("int")  # digests are even
    once = running_totals(stage(once, "shared"), "nth", bucket, ["m"], ["grp", "word"])
    first = once.withColumn("first", F.col("before") + F.col("m_cum") - F.col("m"))
    pieces = first.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(COPIES).cast("long"))))
    pieces = pieces.repartition("grp", "word", "nth", "piece")  # many equal rows: over many tasks
    more = pieces.select(*keys, F.explode(F.sequence(
        F.col("first") + F.col("piece"), F.col("first") + F.least(F.col("piece") + COPIES, F.col("m")) - 1)).alias("r"))
    return at.unionByName(more), totals


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of blocks of ``nodes(grp, r, n, node)``; ``node`` is a
    struct with a digest, ``n`` the nodes of the group, ``most`` the largest
    n.  Each round is (grp, block, n, kids, mid, top); the last has one block
    per group, whose ``top`` is the group's root."""
    rounds = []
    while True:
        slots = F.map_from_entries(F.collect_list(F.struct(F.pmod("r", F.lit(SPAN)).cast("int"), F.col("node"))))
        b = nodes.groupBy("grp", F.expr(f"r div {SPAN}").alias("block")).agg(F.first("n").alias("n"), slots.alias("slots"))
        b = b.select("grp", "block", "n", F.transform(F.sequence(F.lit(0), F.size("slots") - 1), lambda i: F.col("slots")[i]).alias("kids"))
        b = b.withColumn("mid", F.transform(
            F.sequence(F.lit(0), F.expr(f"int((size(kids) - 1) div {RUN})")),
            lambda j: F.sha2(_joined(F.transform(F.slice("kids", j * RUN + 1, F.lit(RUN)), lambda k: k["digest"])), 256)))
        top = (F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).when(F.col("n") <= RUN, F.col("mid")[0])
               .otherwise(F.sha2(_joined(F.col("mid")), 256)))
        b = stage(b.withColumn("top", top), "blocks")
        rounds.append(b)
        if most <= SPAN:
            return rounds
        most = -(-most // SPAN)
        nodes = b.select("grp", F.col("block").alias("r"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"),
                         F.struct(F.col("top").alias("digest")).alias("node"))


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, r, node, path, ...) of every node of the first round: ``path``
    lists, level by level, the siblings left and right of it.  ``above`` has
    (grp, path) of each group's root and further columns to carry down."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    paths = above.withColumn("block", F.lit(0).cast("long"))
    side = lambda c: _joined(F.transform(c, lambda k: k["digest"]))
    for b in reversed(rounds):
        def path(i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            one = F.struct(side(F.slice("kids", run * RUN + 1, i - run * RUN)).alias("left"),
                           side(F.slice("kids", i + 2, run * RUN + (RUN - 1) - i)).alias("right"))
            two = F.struct(_joined(F.slice("mid", F.lit(1), run)).alias("left"),
                           _joined(F.slice("mid", run + 2, F.lit(RUN))).alias("right"))
            own = F.when(F.col("n") == 1, F.array().cast("array<struct<left:string,right:string>>")).when(
                F.col("n") <= RUN, F.array(one)).otherwise(F.array(one, two))
            return F.concat(own, F.col("path"))

        each = F.transform("kids", lambda k, i: F.struct(
            (F.col("block") * SPAN + i).alias("r"), k.alias("node"), path(i).alias("path")))
        down = b.join(paths, ["grp", "block"]).select("grp", *more, F.explode(each).alias("x")).select("grp", *more, "x.*")
        paths = down.select("grp", *more, F.col("r").alias("block"), "path")
    return down


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, grp (the group's value), position (in its
    group), leaf, the ``extra`` columns, path, subroot, root.

    ``extra`` names further columns that depend on the row's ``fields``
    alone.  Null fields hash as ``-``.  Null group: a group of its own, the
    first.  Null ids: first in their group, by leaf digest; repeated ids: by
    leaf digest; equal rows each have a position and row.  Empty table: no
    rows.  Other columns are not read, whatever their names.
    """
    extra = extra or {}
    at = lambda c: F.col(f"`{c}`")
    # a letter before the group: null sorts first and joins like any other
    grp = F.coalesce(F.concat(F.lit("g"), at(group_col).cast("string")), F.lit(""))
    leaves = stage(docs.select(grp.alias("grp"), at(id_col).cast("long").alias("id"),
                               leaf_hash(*(at(c) for c in fields)).alias("leaf"),
                               *(c.alias(f"x_{n}") for n, c in extra.items())), "leaves")
    rows, totals = ranked(leaves)
    totals = stage(range_ordinal(totals, ["grp"], "place"), "groups")
    most, groups = totals.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    node = F.struct(F.col("leaf").alias("digest"), "id", *(f"x_{n}" for n in extra))
    # the sum of a group's rows joins by its value; skewed groups are split by Spark
    rounds = climb(rows.join(totals.select("grp", "n"), "grp").select("grp", "r", "n", node.alias("node")), most)
    tops = rounds[-1].select("grp", F.col("top").alias("subroot")).join(totals, "grp").select(
        F.lit("").alias("grp"), F.col("place").alias("r"), F.lit(groups).cast("long").alias("n"),
        F.struct(F.col("subroot").alias("digest"), "grp").alias("node"))
    over = climb(tops, groups)
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = descend(over, over[-1].select("grp", none.alias("path"), F.col("top").alias("root"))).select(
        F.col("node.grp").alias("grp"), "path", F.col("node.digest").alias("subroot"), "root")
    return descend(rounds, above).select(
        F.col("node.id").alias("id"), F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias("grp"),
        F.col("r").alias("position"), F.col("node.digest").alias("leaf"),
        *(F.col(f"node.x_{n}").alias(n) for n in extra), "path", "subroot", "root")


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return _joined(F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_leaf(lower: Column) -> Column:
    """The leaf after tampering, for ids whose crc32 is divisible by five;
    else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_hash(*(lower if c == "text" else F.col(c) for c in FIELDS)))
