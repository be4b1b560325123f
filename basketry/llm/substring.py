"""Removal of passages that repeat an earlier document, by level-wise doubling.

Level 1 looks at windows of half the wanted length.  Of these, each text
offers those with the least hash among any ``window - half + 1`` consecutive
ones: the choice depends on the content alone, so every full window contains
an offered one, at the same place wherever it occurs.  Only half windows
offered by two different texts are extended to twice the length; the
extended windows around them are hashed (96 bits) and those found in a
document with a smaller id are removed.  Doubling further could not cover
any further word, as every longer repeat is a union of windows of the wanted
length; the search ends there.

Exact copies form one class (128 bits of text hash) and are searched once;
all but the smallest id go whole if they hold a window.  Texts are dealt out
by class once and that exchange serves both passes.  Hot passages: minima
and maxima are aggregated before the shuffle, and the join back is a plain
join that Spark splits where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.rolling import minima, mix, windows, word_hashes
from basketry.llm.text import whole
from basketry.session import stage

LAST = 2**63 - 1  # stands for a missing id: larger than any


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the n words that windows at ``starts`` cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + length, n), -1)
    return np.cumsum(mark[:n]) > 0


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def _anchors(rows: DataFrame, half: int, span: int) -> DataFrame:
    """(a, h, pos): offered half windows of each row's text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                keys, found, places = [], [], []
                for a, t in zip(b["a"].values[lo:lo + 500], b["text"].values[lo:lo + 500]):
                    h = windows(word_hashes(t.encode("utf-8", "surrogatepass").split()), half)
                    at = minima(h, span)
                    keys.append(np.full(len(at), a, np.int64))
                    found.append(h[at])
                    places.append(at)
                yield pd.DataFrame({"a": np.concatenate(keys), "h": np.concatenate(found).view(np.int64),
                                    "pos": np.concatenate(places).astype(np.int32)})

    return rows.select("a", "text").mapInPandas(run, "a long, h long, pos int")


def _extended(rows: DataFrame, window: int, half: int) -> DataFrame:
    """(h, g, id, a, start): full windows that hold a candidate half window
    of ``rows(a, id, text, places)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, i, t, places in zip(b["a"], b["id"], b["text"], b["places"]):
                words = word_hashes(t.encode("utf-8", "surrogatepass").split())
                first = windows(words, window)
                at = np.asarray(places, np.int64)
                near = np.zeros(len(first) + 1, np.int64)
                at = at[at < len(words)]
                np.add.at(near, np.clip(at - (window - half), 0, len(first)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(first)), -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                if len(starts):
                    second = windows(words, window, 1)[starts]
                    yield pd.DataFrame({
                        "h": first[starts].view(np.int64), "g": (second >> np.uint64(32)).astype(np.uint32).view(np.int32),
                        "id": i, "a": a, "start": starts.astype(np.int32)})

    return rows.select("a", "id", "text", "places").mapInPandas(run, "h long, g int, id long, a long, start int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, first, t, starts in zip(b["id"], b["first"], b["text"], b["starts"]):
                words = t.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if i > first and n >= window:
                    mask = np.ones(n, bool)
                elif starts is not None and len(starts):
                    mask = _covered(np.asarray(starts, np.int64), window, n)
                else:
                    mask = np.zeros(n, bool)
                kept = words if not mask.any() else [w for w, gone in zip(words, mask) if not gone]
                out.append((None if i == LAST else i, n, int(mask.sum()), _spans(mask),
                            b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "removed", "kept"]).astype({"id": "Int64"})

    return rows.select("id", "first", "text", "starts").mapInPandas(
        run, "id long, n_words long, n_removed long, removed array<struct<start:int,length:int>>, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: id, n_words, n_removed, removed (spans of
    words), kept (the words left, joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it
    also starts in a document with a smaller id; windows are judged on the
    input.  Null text: no words.  Null id: counts as larger than every id,
    and two such rows never remove from each other, like two rows that share
    an id.  Texts shorter than the window keep all words.  Empty table: no
    rows.  Other columns are not read.
    """
    half = -(-window // 2)
    text = whole(F.col(text_col))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))
    classes = rows.groupBy("a", "b").agg(F.min("id").alias("first"))
    offered = stage(_anchors(rows, half, window - half + 1), "offered")
    # written first, so that the join back is between plain exchanges and Spark can split a hot key
    repeated = stage(offered.groupBy("h").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
                     .filter("lo <> hi").select("h"), "repeated")
    places = offered.join(repeated, "h").groupBy("a").agg(F.collect_set("pos").alias("places"))
    places = stage(classes.join(places, "a"), "places")
    dealt = rows.repartition("a", "b")
    candidates = dealt.join(places, (dealt["a"] == places["a"]) & (dealt["b"] == places["b"])
                            & (dealt["id"] == places["first"])).select(dealt["a"], dealt["id"], "text", "places")
    found = stage(_extended(candidates, window, half), "windows")
    earliest = stage(found.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                     .filter("lo < hi").select("h", "g", "lo"), "earliest")
    hits = (found.join(earliest, ["h", "g"]).filter("id > lo")
            .groupBy("a", F.col("id").alias("first")).agg(F.collect_set("start").alias("starts")))
    marks = stage(classes.join(hits, ["a", "first"], "left"), "marks")
    final = dealt.join(marks, ["a", "b"])
    return _cut(final, window)
