"""Benchmark decontamination by winnowing, with DataFrame functions only.

A benchmark item's windows are its runs of ``window`` consecutive words (an
item with fewer words is one window).  On both sides the minimum k-gram hash
of every ``window - k + 1`` consecutive k-grams is kept.  Two texts that
share a window share all its k-grams and so the kept minimum: every shared
span of ``window`` words has a fingerprint in common.  Fingerprints are
joined, each hit is extended to all windows around it, and the extended
windows are joined, word for word, with the items' windows.

Documents are read once.  A fixed-size bit table of the benchmark's
fingerprints drops most k-grams before anything leaves the row; what is left
is a few rows per contaminated passage.  The benchmark's side is broadcast
only while its counted rows are within ``BROADCAST_ROWS``; beyond that the
same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.bitmap import bitmap, maybe
from basketry.llm.text import ascii_lower, split_words, whole
from basketry.session import stage

NOT_ITEM_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 50_000


def item_words(text: Column) -> Column:
    return split_words(ascii_lower(whole(text)), NOT_ITEM_WORD)


def _gram(words: str, i: Column, w: Column, k: int) -> Column:
    """Hash of the k words from position i on, w being the first."""
    return F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k)))


def _grams(words: str, k: int) -> Column:
    """Hashes of all k-grams, by position."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
                       lambda w, i: _gram(words, i, w, k))


def _kept(grams: str, j: Column, span: int) -> Column:
    """Is the gram at j the least of some ``span`` consecutive ones?"""
    least = [F.least(*(F.get(grams, j + (d + e)) for e in range(span))) for d in range(1 - span, 1)]
    inside = [F.when((j + d >= 0) & (j + (d + span) <= F.size(grams)), x) for d, x in zip(range(1 - span, 1), least)]
    return F.get(grams, j) == F.greatest(*inside)


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if it is small; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(fingerprints(g, len), windows(win, len, items)) of a benchmark."""
    span = window - k + 1
    rows = (items.select(F.col(item_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w"))
            .withColumn("n", F.size("w")).filter("n > 0").withColumn("len", F.least("n", F.lit(window)))
            .withColumn("grams", _grams("w", k)))
    windows = (rows.select("item", "len", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("len")), lambda i: F.array_join(F.slice("w", i + 1, F.col("len")), " "))).alias("win"))
        .groupBy("win", "len").agg(F.collect_set("item").alias("items")))
    full = rows.filter(F.col("n") >= window).select(F.lit(window).alias("len"), F.explode(F.filter(
        F.transform("grams", lambda g, j: F.when(_kept("grams", j, span), g)), lambda g: g.isNotNull())).alias("g"))
    short = rows.filter(F.col("n") < window).select("len", F.xxhash64(F.get("w", F.lit(0)), *(
        F.when(F.col("len") > j, F.get("w", F.lit(j))) for j in range(1, k))).alias("g"))
    return full.unionByName(short).distinct(), windows


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row per input row: id, n_words, hits (sorted array of
    <start, length>: the windows found), n_hit (words inside them), items
    (sorted ids, as strings, of items with a window found).

    Null text: no words.  Null id: kept as null.  Repeated rows get a row
    each.  Items without words never match; an item id that is null matches
    words but is not listed.  An empty benchmark hits nothing.  Other columns
    are not read.
    """
    prints, windows = benchmark_windows(items, item_col, item_text_col, window, k)
    prints, windows = stage(prints, "prints"), stage(windows, "windows")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _hits(rows, "text", prints, windows, window, k)
    words = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    return out.select("id", "n_words", F.sort_array("hits").alias("hits"), F.size(words).cast("long").alias("n_hit"),
                      F.array_sort("items").alias("items"))


def _hits(docs: DataFrame, text_col: str, prints: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """(rid, id, n_words, hits, items) of ``docs(rid, id, text)``."""
    lens = sorted(r["len"] for r in prints.select("len").distinct().collect())  # at most `window` values
    rows = (docs.select("rid", "id", item_words(F.col(text_col)).alias("w"))
            .withColumn("n_words", F.size("w").cast("long")).withColumn("grams", _grams("w", k)))
    found = []
    for m in lens:
        bits = bitmap(prints.filter(F.col("len") == m), "g")
        if m >= k:
            at = F.filter(F.transform("grams", lambda g, j: F.when(maybe(bits, g), j)), lambda j: j.isNotNull())
        else:
            # short items: the same hash as in benchmark_windows, absent words as nulls
            pad = [F.lit(None).cast("string")] * (k - m)
            at = F.filter(F.transform("w", lambda w, i: F.when(
                (i + m <= F.size("w")) & maybe(bits, F.xxhash64(w, *(F.get("w", i + j) for j in range(1, m)), *pad)), i)),
                lambda i: i.isNotNull())
        if m == window:
            span = window - k + 1
            at = F.filter(at, lambda j: _kept("grams", j, span))
            found.append(F.transform(at, lambda j: F.struct(
                F.lit(m).alias("len"), F.get("grams", j).alias("g"), F.greatest(j - (m - k), F.lit(0)).alias("at"),
                F.slice("w", F.greatest(j - (m - k), F.lit(0)) + 1, j + m - F.greatest(j - (m - k), F.lit(0))).alias("ctx"))))
        else:
            lead = min(m, k)
            found.append(F.transform(at, lambda j: F.struct(
                F.lit(m).alias("len"),
                F.xxhash64(*(F.get("w", j + i) for i in range(lead)), *([F.lit(None).cast("string")] * (k - lead))).alias("g"),
                j.alias("at"), F.slice("w", j + 1, F.lit(m)).alias("ctx"))))
    shape = "array<struct<len:int,g:bigint,at:int,ctx:array<string>>>"
    candidates = F.concat(*found) if found else F.array()
    one = (rows.select("rid", "id", "n_words", candidates.cast(shape).alias("c"))
           .select("rid", "id", "n_words", F.explode_outer("c").alias("c"))
           # rows without a candidate get a key of their own, so they spread
           .select("rid", "id", "n_words", "c", F.coalesce("c.g", F.xxhash64("rid")).alias("g"), F.coalesce("c.len", F.lit(0)).alias("len")))
    met = one.join(_sized(prints.withColumn("met", F.lit(True))), ["g", "len"], "left")
    around = F.when(F.col("met"), F.transform(
        F.sequence(F.lit(0), F.size("c.ctx") - F.col("len")),
        lambda i: F.struct((F.col("c.at") + i).alias("start"), F.array_join(F.slice("c.ctx", i + 1, F.col("len")), " ").alias("win"))))
    met = met.withColumn("around", F.when(F.size("c.ctx") >= F.col("len"), around))
    extended = (met.select("rid", "id", "n_words", "len", F.explode_outer("around").alias("x"))
                .select("rid", "id", "n_words", "len", F.col("x.start").alias("start"),
                        F.coalesce("x.win", F.concat(F.lit("\n"), F.col("rid").cast("string"))).alias("win")))
    hits = extended.join(_sized(windows), ["win", "len"], "left")
    return hits.groupBy("rid").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", F.col("len").alias("length")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; all columns
    and their names are kept.  Rows are told apart by id and text hash, so a
    null or repeated id is no matter."""
    key = [F.col(id_col).alias("_id"), F.xxhash64(whole(F.col(text_col))).alias("_hash")]
    rows = docs.select(F.struct(*key).alias("key"), F.col(text_col).alias("text"))
    bad = (contaminated(rows, items, "key", "text", item_col, item_text_col, window, k)
           .filter("n_hit > 0").select("id._id", "id._hash").distinct())
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *key)
    return (row.alias("a").join(bad.alias("b"), F.expr("a._id <=> b._id AND a._hash = b._hash"), "left_anti").select("_row.*"))
