"""SimHash near-duplicates with pivot distance tables.

Two fingerprints link when they differ in at most ``max_bits`` bits.  For
every reference fingerprint (pivot) p the distance d(f, p) is tabulated
once; by the triangle inequality |d(f, p) - d(g, p)| <= d(f, g), so a pair
whose largest coordinate difference exceeds ``max_bits`` is discarded and
only survivors are compared bit by bit.

Which pairs meet at all: a single distance to a pivot spreads over a few
values only, so the table alone would pair a constant share of all rows.
Fingerprints are therefore dealt into groups that share ``blocks -
max_bits`` whole blocks of bits (every linked pair shares at least one such
group), and each group takes its most frequent member as its own pivot, the
hub.  Members within ``max_bits`` of the hub link to it and need no pair
among themselves, as they are connected already; every other member meets
only members whose distance to the hub differs by at most ``max_bits``,
through an equality join on that distance.  A group of thousands of near
copies so costs a star, not all its pairs, and no link between components
is lost.

Copies: equal fingerprints are one node, aggregated before any join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.graph import components
from basketry.llm.text import whole
from basketry.session import stage

SEED = 42
CHUNK = 1 << 18


def fingerprint(text: str, shingle_words: int) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats included."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at:at + CHUNK]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """(id, text_hash, fp long) of every row; a null text counts as empty, and
    a text without words has fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "text_hash": b["text_hash"], "fp": fps})

    return rows.mapInPandas(run, "id long, text_hash long, fp long")


def pivots(n: int = 16, seed: int = SEED) -> list[int]:
    """Reference fingerprints: seeded random 64-bit values (signed)."""
    return [int(x) for x in np.random.default_rng(seed).integers(-2**63, 2**63 - 1, n, np.int64)]


def _masks(max_bits: int, blocks: int) -> list[int]:
    """Signed masks of all choices of ``blocks - max_bits`` whole blocks."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    out = []
    for kept in combinations(bits, blocks - max_bits):
        m = sum(kept)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def links(nodes: DataFrame, max_bits: int = 3, blocks: int | None = None,
          reference: list[int] | None = None) -> DataFrame:
    """(u, v): links among the distinct fingerprints ``nodes(fp, n)`` whose
    transitive closure equals that of all pairs within ``max_bits`` bits;
    each returned pair is itself within ``max_bits``."""
    if max_bits <= 0:  # equal fingerprints are one node already
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("false")
    blocks = blocks or max_bits + 2
    reference = pivots() if reference is None else reference
    table = nodes.select(
        "fp", "n", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in reference)).alias("at"))
    groups = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                       for t, m in enumerate(_masks(max_bits, blocks))))
    dealt = nodes.select("fp", "n", F.explode(groups).alias("g")).select("fp", "n", "g.t", "g.k")
    hubs = (dealt.groupBy("t", "k").agg(F.count("*").alias("c"), F.max(F.struct("n", "fp")).alias("h"))
            .filter("c > 1").select("t", "k", F.col("h.fp").alias("hub")))
    member = (dealt.select("fp", "t", "k").join(hubs, ["t", "k"])
              .withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))).filter("d > 0"))
    member = stage(member, "members")
    star = member.filter(F.col("d") <= max_bits).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    ring = F.explode(F.sequence(F.greatest(F.col("d") - max_bits, F.lit(1)), F.col("d") + max_bits)).alias("ring")
    far = (member.filter(F.col("d") > max_bits).select("t", "k", "fp", ring)
           .join(table.select("fp", F.col("at").alias("at_u")), "fp").withColumnRenamed("fp", "u"))
    near = (member.select("t", "k", "fp", F.col("d").alias("ring"), (F.col("d") > max_bits).alias("is_far"))
            .join(table.select("fp", F.col("at").alias("at_v")), "fp").withColumnRenamed("fp", "v"))
    apart = F.array_max(F.zip_with("at_u", "at_v", lambda a, b: F.abs(a - b)))
    met = (far.join(near, ["t", "k", "ring"])
           .filter((F.col("u") < F.col("v")) | (~F.col("is_far") & (F.col("u") != F.col("v"))))
           .filter(apart <= max_bits)
           .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v"))
    return star.unionByName(met).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> DataFrame:
    """(id, fp, rep) of every row; rep: (no_id, id, text_hash) of the row that
    stands for its component."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep")
    nodes = stage(fps.groupBy("fp").agg(rep, F.count("*").alias("n")), "nodes")
    label = components(links(nodes.select("fp", "n"), max_bits)).withColumnRenamed("node", "fp")
    named = nodes.join(label, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    first = named.groupBy("label").agg(F.min("rep").alias("rep"))
    return fps.join(named.select("fp", "label").join(first, "label").select("fp", "rep"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id
    (smallest id reachable over links, itself included).

    Null text: empty, fingerprint zero, linked like any other.  Null id:
    kept; component_id is the smallest non-null id of the component, null if
    there is none.  Repeated rows each get a row.  Empty table: no rows.
    Other columns of ``docs`` are not read.
    """
    return _grouped(docs, id_col, text_col, shingle_words, max_bits).select(
        "id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep.id").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id
    (rows without an id come last), of rows that share it the smallest text
    hash, of equal rows one.  All columns and their names are kept."""
    found = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    reps = found.select(F.col("rep.id").alias("_id"), F.col("rep.text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                       F.col(id_col).cast("long").alias("_id"), F.xxhash64(whole(F.col(text_col))).alias("_hash"))
    kept = rows.alias("a").join(reps.alias("b"), F.expr("a._id <=> b._id AND a._hash = b._hash"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row")))
    return kept.withColumn("_n", nth).filter("_n = 1").select("_row.*")
