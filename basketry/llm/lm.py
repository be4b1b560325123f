"""Language-model scoring of whole documents.

A word's class is its frequency band (the ``groups * size`` most frequent
training words) or, for all other words, a hash of its last two characters;
the end of a text is a class of its own.  A gated recurrent network
(``gru``) predicts the class and, inside a band, the word; inside the other
classes a word has its smoothed share of the class's training count.  The
state runs through the whole document, window after window.

Counts cover all training documents.  The network learns from all training
documents too: in each round every partition trains on its share, starting
from the same weights, and Spark averages the results by tokens; what comes
to the driver per round is one set of weights.

Words: the ``known`` most frequent (bounded) travel to the tasks with their
counts; all others are looked up by a join on the word, so no table that
grows with the corpus is broadcast.  Every text is split into words once for
the counts and once into a table of word numbers, which training and scoring
read.  Splitting, counting and numbering work on Arrow arrays: no word becomes
a Python object in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import gru
from basketry.llm.text import whole
from basketry.session import stage

GROUPS, SIZE = 32, 32        # frequency bands and words in each
TAILS = 31                   # classes of all other words
KNOWN = 262_144              # words sent to the tasks
COUNTED = 400_000            # words a task counts before it hands the counts on
PIECE = 1 << 24              # bytes of text split at a time (one longer text alone)
EMBED = HIDDEN = 12
ROUNDS = 2
LANES, STEPS = 320, 24
CHUNK_TOKENS = 1_200_000     # tokens of documents that run side by side
SEED = 42
END = ""                     # no word is empty
_LAST, _RARE = -1, -2         # word numbers: the end of a text; _RARE - t: a word of class t that is not known
_WORDS = GROUPS * SIZE
_END_CLASS, _CLASSES, _START = GROUPS, GROUPS + 1 + TAILS, _WORDS + TAILS
SIZES = gru.shapes(_WORDS + TAILS + 1, _CLASSES, GROUPS, SIZE, EMBED, HIDDEN)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tail_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, -2, 2)), F.lit(TAILS)).cast("int")


def _tails(words: pa.Array) -> np.ndarray:
    """``tail_of`` of binary ``words``, worked out once per ending."""
    if not len(words):
        return np.empty(0, np.int32)
    two = pc.binary_slice(words, -2)
    plain = pc.string_is_ascii(_as_string(two))
    ends = pc.if_else(plain, two, pc.binary_slice(words, -8)).dictionary_encode()  # 8 bytes hold two characters
    return np.array([_tail_of_end(e) for e in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]


@lru_cache(maxsize=100_000)
def _tail_of_end(end: bytes) -> int:
    import xxhash
    h = xxhash.xxh64_intdigest(end.decode("utf-8", "replace")[-2:].encode("utf-8"), 42)
    return (h - (1 << 64) if h >> 63 else h) % TAILS


def _as_string(a: pa.Array) -> pa.Array:
    """Binary read as text, unchecked: the ASCII functions leave other bytes alone."""
    large = pa.types.is_large_binary(a.type)
    return pa.Array.from_buffers(pa.large_string() if large else pa.string(), len(a), a.buffers(), a.null_count, a.offset)


def _as_binary(a: pa.Array) -> pa.Array:
    return a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``PIECE`` bytes of text."""
    ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of binary ``texts``, one after the other, and
    the number of words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(_as_string(texts)))
    words, edges = split.values, split.offsets.to_numpy()
    kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a space at either end leaves an empty word
    words = words.slice(edges[0], edges[-1] - edges[0])
    kept = kept[edges[0]:edges[-1]]
    before = np.r_[0, np.cumsum(kept)]
    return _as_binary(words if kept.all() else words.filter(pa.array(kept))), np.diff(before[edges - edges[0]])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, c): counts of words and ends in all of ``docs``.  Tasks count what
    they read and hand counts on whenever they hold ``COUNTED`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = None, 0
        for b in batches:
            for piece in _pieces(b):
                counted = pc.value_counts(_split(piece.column("text"))[0])
                new = pa.table({"w": counted.field(0), "c": counted.field(1)})
                if held is not None:
                    new = pa.concat_tables([held, new]).group_by("w", use_threads=False).aggregate([("c", "sum")])
                    new = new.rename_columns({"c_sum": "c"}).select(["w", "c"])
                held = new
                if len(held) >= COUNTED:
                    yield from held.combine_chunks().to_batches(50_000)
                    held = None
            ends += b.num_rows
        if held is not None:
            yield from held.combine_chunks().to_batches(50_000)
        yield pa.RecordBatch.from_arrays([pa.array([END.encode()], pa.binary()), pa.array([ends], pa.int64())], ["w", "c"])

    made = docs.select(whole(F.col(text_col)).cast("binary").alias("text")).mapInArrow(run, "w binary, c long")
    return made.groupBy(F.col("w").cast("string").alias("w")).agg(F.sum("c").alias("c")).filter("c > 0")


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """The words of the highest counts, at most ``most``: a cut between
    steps of the count's logarithm, so no sort of all words is needed and
    only the chosen rows come to the driver."""
    step = F.floor(F.log("c") * 200).cast("int")
    cut, total = None, 0
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():  # under 9,000 steps
        total += r["n"]
        if total > most:
            break
        cut = r["s"]
    top = counts.filter(F.lit(False) if cut is None else step >= cut).select(F.col("w").cast("binary").alias("w"), "c").toArrow()
    return top.sort_by([("c", "descending"), ("w", "ascending")])


class Vocabulary:
    """The bounded part of the counts, and the classes' totals."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        top = _most_frequent(counts.filter(F.col("w") != END), KNOWN)
        ends = counts.filter(F.col("w") == END).first()
        self.ends = int(ends["c"]) if ends else 0
        self.words = top.column("w").combine_chunks()
        self.counts = top.column("c").to_numpy().astype(np.float64)
        tails = np.zeros((TAILS, 2))
        for r in counts.filter(F.col("w") != END).groupBy(tail_of(F.col("w")).alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            tails[r["t"]] = r["c"], r["v"]
        self.tail = _tails(self.words)
        for t, c in zip(self.tail[:_WORDS], self.counts[:_WORDS]):  # words of the bands are in no other class
            tails[t] -= c, 1
        self.tail_totals = tails
        j = np.arange(len(self.words))
        self.symbol = np.where(j < _WORDS, j, _WORDS + self.tail).astype(np.int16)  # sorted faster than wider numbers
        self.cls = np.where(j < _WORDS, j // SIZE, GROUPS + 1 + self.tail).astype(np.int16)
        below = np.log10((self.counts + 0.1) / (tails[self.tail, 0] + 0.1 * (tails[self.tail, 1] + 1)))
        self.within = np.where(j < _WORDS, 0.0, below)
        self.base = np.log10(self.counts + 0.1)
        self.floor = np.log10(self.n + 0.1 * (self.v + 1))

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        band = np.zeros(_WORDS)
        band[:min(_WORDS, len(self.counts))] = self.counts[:_WORDS]
        band = band.reshape(GROUPS, SIZE)
        cls = np.r_[band.sum(axis=1), self.ends, self.tail_totals[:, 0]]
        return np.log((cls + 0.5) / (cls.sum() + 0.5 * _CLASSES)), np.log((band + 0.1) / (band + 0.1).sum(axis=1, keepdims=True))


def coded(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(id, held_out, codes, rare) of ``rows(id, held_out, text)``: the word
    numbers of each text and its words that have none, joined by a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.words
        for b in batches:
            for piece in _pieces(b):
                words, lengths = _split(piece.column("text"))
                numbers = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), _RARE).to_numpy(zero_copy_only=False).astype(np.int32)
                rare = np.flatnonzero(numbers == _RARE)
                others = words.take(pa.array(rare))
                numbers[rare] -= _tails(others)
                edges = np.r_[0, np.cumsum(lengths + 1)]
                codes = np.full(edges[-1], _LAST, np.int32)
                inside = np.ones(len(codes), bool)
                inside[edges[1:] - 1] = False
                codes[inside] = numbers
                left = np.searchsorted(rare, np.r_[0, np.cumsum(lengths)])
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), others), pa.scalar(b" ", words.type))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("held_out"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(codes)),
                     joined], ["id", "held_out", "codes", "rare"])

    made = rows.select("id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "id long, held_out boolean, codes array<int>, rare binary")
    return made.withColumn("rare", F.col("rare").cast("string"))


class _Coded:
    """Documents of a chunk as one flat run of tokens."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, v: Vocabulary):
        self.lengths, self.j = lengths, codes
        ends = np.cumsum(lengths) - 1
        firsts = np.r_[0, ends[:-1] + 1] if len(ends) else np.empty(0, np.int64)
        rare = np.flatnonzero(codes <= _RARE)
        tails = _RARE - codes[rare]
        j = np.maximum(codes, 0)
        if len(v.words):
            symbol, self.cls = v.symbol[j], v.cls[j]
        else:
            symbol, self.cls = np.zeros(len(j), np.int16), np.zeros(len(j), np.int16)
        symbol[rare], self.cls[rare] = _WORDS + tails, GROUPS + 1 + tails
        self.cls[ends] = _END_CLASS
        self.word = j % SIZE
        self.symbol = np.r_[_START, symbol[:-1]].astype(np.int16) if len(symbol) else symbol
        self.symbol[firsts] = _START
        self.first = np.zeros(len(j), bool)
        self.first[firsts] = True
        self.doc, self.firsts = np.repeat(np.arange(len(lengths)), lengths), firsts

    def in_lanes(self):
        docs, start, total = gru.lanes(self.lengths, LANES)
        place = np.concatenate([np.arange(self.firsts[d], self.firsts[d] + self.lengths[d]) for d in docs])
        return place, (self.symbol[place], self.cls[place], self.word[place], self.first[place], start, total)


def _chunks(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[_Coded, pa.Table]]:
    """Rows regrouped to about CHUNK_TOKENS, with their documents."""
    held, size = [], 0
    for b in batches:
        at = 0
        edges = np.asarray(b.column("codes").offsets)
        while at < b.num_rows:
            to = int(np.searchsorted(edges, edges[at] + CHUNK_TOKENS - size))
            to = min(max(to, at + 1), b.num_rows)
            held.append(b.slice(at, to - at))
            size += int(edges[to] - edges[at])
            at = to
            if size >= CHUNK_TOKENS:
                yield _chunk(held, v)
                held, size = [], 0
    if held:
        yield _chunk(held, v)


def _chunk(held: list[pa.RecordBatch], v: Vocabulary) -> tuple[_Coded, pa.Table]:
    table = pa.Table.from_batches(held)
    lists = [c for c in table.column("codes").chunks if len(c)]
    lengths = np.concatenate([np.diff(np.asarray(c.offsets)) for c in lists]).astype(np.int64)
    return _Coded(lengths, np.concatenate([np.asarray(c.flatten()) for c in lists]), v), table


def fit(train: DataFrame, shared: Broadcast, vocabulary: Vocabulary, key_col: str = "id", rounds: int = ROUNDS,
        rate: float = 0.015) -> np.ndarray:
    """Weights after ``rounds`` rounds over ``train`` (``coded``); each
    document is learnt from in one of them, chosen by a hash of its key."""
    weights = gru.pack(gru.initial(SIZES, SEED, *vocabulary.biases()), SIZES)
    for k in range(rounds):
        sent, speed = train.sparkSession.sparkContext.broadcast(weights), rate * 0.5 ** k

        def run(batches: Iterator[pa.RecordBatch], sent=sent, speed=speed) -> Iterator[pa.RecordBatch]:
            v = shared.value
            p, adam, tokens = gru.unpack(sent.value, SIZES), {}, 0
            for c, _ in _chunks(batches, v):
                gru.train(p, *c.in_lanes()[1], adam, speed, STEPS)
                tokens += int(c.lengths.sum())
            flat = gru.pack(p, SIZES)
            if tokens and np.isfinite(flat).all():
                yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([flat.astype(np.float64)])], ["tokens", "weights"])

        share = train.filter(F.pmod(F.xxhash64(F.lit("round"), key_col), F.lit(rounds)) == k).select("codes")
        made = share.mapInArrow(run, "tokens double, weights array<double>")
        rows = (made.select("tokens", F.posexplode("weights").alias("i", "x"))
                .groupBy("i").agg((F.sum(F.col("x") * F.col("tokens")) / F.sum("tokens")).alias("x")).collect())
        sent.destroy()
        if rows:  # one row per weight
            weights = np.empty_like(weights)
            for r in rows:
                weights[r["i"]] = r["x"]
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10).

    Learns from the rows that are not held out.  Null text: empty, one end
    token.  Null id: learnt from, never held out, kept as null.  Repeated
    rows: each counts and gets a row.  Empty table: no rows.  A table with
    held-out rows only: counts of zero.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"),
                       held_out(F.col(id_col)).alias("held_out"))
    counts = stage(word_counts(rows.filter(~F.col("held_out"))), "counts")
    vocabulary = Vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    numbered = stage(coded(rows, shared).withColumn("rid", F.monotonically_increasing_id()), "coded")
    weights = spark.sparkContext.broadcast(fit(numbered.filter(~F.col("held_out")), shared, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        p = gru.unpack(weights.value, SIZES)
        for c, table in _chunks(batches, v):
            place, flat = c.in_lanes()
            lp = np.empty(len(place))
            lp[place] = gru.score(p, *flat, 2 * STEPS)
            n, known = len(c.lengths), c.j >= 0
            base = np.zeros(len(lp))
            base[known] = v.base[c.j[known]]
            base[c.j == _LAST] = np.log10(v.ends + 0.1)
            model = lp / np.log(10.0)
            model[known] += v.within[c.j[known]]
            by = lambda x: np.bincount(c.doc, x, n)
            more = {"n_tokens": pa.array(c.lengths), "n_known": pa.array((by(known) + (v.ends > 0)).astype(np.int64)),
                    "base": pa.array(by(base) - v.floor * c.lengths), "model": pa.array(by(model))}
            table = pa.table({k: table.column(k) for k in ("rid", "id", "held_out")} | more)
            yield from table.combine_chunks().to_batches()

    first = stage(numbered.select("rid", "id", "held_out", "codes").mapInArrow(
        run, "rid long, id long, held_out boolean, n_tokens long, n_known long, base double, model double"), "scored")
    totals = F.array(*(F.lit(float(c + 0.1 * (v + 1))) for c, v in vocabulary.tail_totals))
    rare = numbered.filter("rare <> ''").select("rid", F.explode(F.split("rare", " ")).alias("w"))
    found = rare.join(counts, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = found.groupBy("rid").agg(
        F.count_if(F.col("c") > 0).alias("known2"),
        F.sum(F.log10(F.col("c") + 0.1)).alias("base2"),
        F.sum(F.log10((F.col("c") + 0.1) / F.get(totals, tail_of(F.col("w"))))).alias("model2"))
    out = first.join(more, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("id", "held_out", "n_tokens", add("n_known", "known2").alias("n_known"),
                      F.lit(vocabulary.n).cast("long").alias("train_tokens"),
                      add("base", "base2").alias("base_score"), add("model", "model2").alias("score"))
