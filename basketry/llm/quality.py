"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Words and word pairs are hashed into ``buckets`` counters.  Two multinomials
are estimated: the trusted target from labelled good documents and the raw
corpus from all documents.  A document's score is the mean over its n-grams
of log(target / raw), so length does not matter.  Every document is held
against one threshold, set from the labelled sample; nothing is random.

Every label counts: up to ``BROADCAST_ROWS`` labelled documents travel to the
texts, beyond that the texts of labelled documents are joined by a shuffle and
staged once.  Counts are summed per bucket before the shuffle, and the score
table has ``buckets`` entries at any size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import split_words, whole
from basketry.session import release, stage

BUCKETS = 1 << 16
BROADCAST_ROWS = 500_000  # labelled documents: 30 MB
GOOD_LOSS = 0.002   # share of labelled good documents that the threshold may cost
STEP = 1000         # threshold steps per unit of score
SYMBOLS = "[#*$%&|<>]"
_PLACE = 30         # bits for a position; no Spark string holds more words


def buckets_of(words: Column, buckets: int) -> Column:
    """Counters of all words and word pairs."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                      lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def label_table(labels: DataFrame) -> DataFrame:
    """(id, trusted, good) of every labelled document.  Several label rows of
    a document: good only if all say so.  Null quality: not good; null toxic:
    not toxic.  Null ids are left out."""
    one = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
           .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")))
    return one.select("id", ((F.col("q") > 0) & (F.col("t") <= 0)).alias("trusted"), (F.col("q") > 0).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS, smooth: float = 1.0, broadcast_rows: int = BROADCAST_ROWS) -> dict:
    """Score table and threshold.  Without a trusted document the table is
    zero and the threshold lets everything pass."""
    told = label_table(labels)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = split_words(F.col("text")).alias("w")
    if told.limit(broadcast_rows + 1).count() <= broadcast_rows:
        told = F.broadcast(told)
        held, labelled = None, rows.join(told, "id")
        read = rows.join(told, "id", "left").select(F.coalesce("trusted", F.lit(False)).cast("long").alias("t"), F.lit(1).alias("n"), words)
    else:
        held = labelled = stage(rows.join(told, "id"), "labelled")
        read = (rows.select(F.lit(0).cast("long").alias("t"), F.lit(1).alias("n"), words)
                .unionByName(labelled.filter("trusted").select(F.lit(1).cast("long").alias("t"), F.lit(0).alias("n"), words)))
    grams = read.select("t", "n", F.explode(buckets_of(F.col("w"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("n").alias("raw"), F.sum("t").alias("target")).collect()  # at most `buckets` rows
    raw_n, target_n = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    if not target_n:
        model = {"table": [0.0], "threshold": None, "buckets": 1}
    else:
        table = [math.log(smooth / (target_n + smooth * buckets)) - math.log(smooth / (raw_n + smooth * buckets))] * buckets
        for r in counts:
            table[r["b"]] = (math.log((r["target"] + smooth) / (target_n + smooth * buckets))
                             - math.log((r["raw"] + smooth) / (raw_n + smooth * buckets)))
        model = {"table": [round(x, 5) for x in table], "threshold": None, "buckets": buckets}
        model["threshold"] = _threshold(labelled.select("good", words).select("good", ratio(F.col("w"), model).alias("s")))
    if held is not None:
        release(held)
    return model


def ratio(words: Column, model: dict) -> Column:
    """Mean log ratio of the n-grams; 0 without any."""
    table = F.from_json(F.lit(json.dumps(model["table"])), "array<double>")
    grams = buckets_of(words, model["buckets"])
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def _threshold(told: DataFrame) -> float | None:
    """The step that parts good from bad best, among those that cost at most
    GOOD_LOSS of the good; the lowest of equals.  None without bad ones."""
    bins = (told.groupBy(F.floor(F.col("s") * STEP).alias("bin"))
            .agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
            .orderBy("bin").collect())  # bounded: scores lie within the table's range, so do the steps
    goods, bads = sum(r["g"] for r in bins), sum(r["b"] for r in bins)
    if not goods or not bads:
        return None
    best, at, lost, caught = 0.0, None, 0, 0
    for r in bins:  # threshold at the lower edge of this bin: all bins before are rejected
        if lost <= GOOD_LOSS * goods and caught / bads - lost / goods > best:
            best, at = caught / bads - lost / goods, r["bin"] / STEP
        lost, caught = lost + r["g"], caught + r["b"]
    return at


def judged(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null text: no words, rejected.  Null id: kept as null.  Repeated rows:
    one row each.  Empty table: no rows.  Other columns are not read.
    """
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), split_words(F.col(text_col)).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "id", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), ratio(F.col("w"), model).alias("score"),
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
                    lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"))
    base = ["id", "n_words", "word_chars", "n_symbols", "score"]
    rows = rows.select(*base, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h",
                       # the hash's upper bits and the position in one long: plain longs sort fastest
                       F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(-(1 << _PLACE)).bitwiseOR(i.cast("long")))).alias("p"))
    base.append("n_dup_lines")
    top = lambda x: F.shiftright(x, _PLACE)
    near = F.filter("p", lambda x, i: (F.coalesce(top(x) == top(F.get("p", i - 1)), F.lit(False))
                                       | F.coalesce(top(x) == top(F.get("p", i + 1)), F.lit(False))))
    # the few that are left, by the whole hash
    rows = rows.select(*base, F.sort_array(F.transform(near, lambda x: F.struct(
        F.get("h", x.bitwiseAND((1 << _PLACE) - 1).cast("int")).alias("h"),
        x.bitwiseAND((1 << _PLACE) - 1).cast("int").alias("at")))).alias("c"))
    same = F.filter("c", lambda x, i: (F.coalesce(x["h"] == F.get("c", i - 1)["h"], F.lit(False))
                                       | F.coalesce(x["h"] == F.get("c", i + 1)["h"], F.lit(False))))
    rows = rows.select(*base, F.sort_array(F.transform(same, lambda x: x["at"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))),
                          F.lit(0), lambda acc, x: acc + x)
    rows = rows.select(*base, covered.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.lit(True) if model["threshold"] is None else F.col("score") >= model["threshold"]
    done = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
    # a generator of one row: a filter on the result stays above it.  Pushed
    # below the projections it would repeat their expressions many times over
    return done.select(F.explode(F.array(F.struct(*done.columns))).alias("row")).select("row.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns and names as they were."""
    model = fit(docs, labels, id_col, text_col)
    # the row rides along as the id, so nothing is joined back
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return judged(rows, model, "row", "text").filter("kept").select("id.*")
