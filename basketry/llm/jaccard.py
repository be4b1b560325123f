"""N-gram Jaccard join with signature trees.

A document's set is its distinct word shingles (hashed to 64 bits).  Two
documents link when 100 * |A and B| >= percent * |A or B|.

Signature trees: the documents of a group are the leaves of a tree whose
nodes hold the OR of their token bitmaps and their range of sizes.  Two nodes
are visited together only if the largest possible overlap of a document of
one with a document of the other can reach the threshold: the common bits,
plus the tokens that may share a bit, at most the smaller size.  Pairs of
nodes that survive are opened, pairs of documents that survive are compared
token by token.  Nodes whose documents are connected already are not visited,
so a group of near copies costs a few comparisons a document.

Which documents share a tree: sets of at most s and more tokens that link
differ in at most d = s * (100 - percent) / percent tokens.  Tokens are dealt
by hash into d + 3 segments, so linked sets agree on three segments or more
and a set without three empty segments needs only its others as keys.
Documents that agree on a segment, and what these agree with, are a group: no
link leaves it.  Groups are bounded.  In a larger one the documents are first
held against the first document of each of their segments; segments whose
documents are all connected then are done, the others get trees of their own,
in tiles of bounded size that are traversed pair by pair.

Copies (equal sets) are one leaf.  Sets, and texts, that share their 64-bit
hash are taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordinal import range_ordinal
from basketry.llm.graph import components
from basketry.llm.rolling import mix
from basketry.llm.text import whole
from basketry.session import stage

SPARE = 2                  # segments beyond those that differences can touch and one
GROUP_DOCS, GROUP_TOKENS = 1024, 1 << 22   # the largest group that is one tree
TILE_BITS = 8              # documents of a tile of a larger group: 256
RANGE_PAIRS, HELD_PAIRS = 1 << 22, 1 << 21   # pairs of a range of keys, and of a task before it sends them on
FAN = 4                    # children of a node
BITS_PER_TOKEN = 16        # sparse enough that nodes of unlike leaves are pruned
PAIRS = 2048               # node pairs looked at together
_MIN_BITS, _MAX_BITS = 8, 18   # size of a bitmap, as a power of two


# -- sets and segments ------------------------------------------------------

def token_set(text: str, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle_words:
        shingles = {b" ".join(words)}
    else:
        shingles = set(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def size_steps(percent: int, upto: int) -> list[int]:
    """Lower bounds of the size classes; sets below the first can only link
    with equal ones."""
    steps = [-(-percent // (100 - percent))]
    while steps[-1] <= upto:
        steps.append(max(steps[-1] + 1, steps[-1] * 3 // 2))
    return steps


def segment_keys(tokens: np.ndarray, percent: int, steps: list[int]) -> np.ndarray:
    """Keys of which two linked, different sets share one at least."""
    n = len(tokens)
    own = int(np.searchsorted(steps, n, side="right")) - 1
    if own < 0:  # too small for a partner that differs
        return np.empty(0, np.int64)
    classes = [own]
    if own and -(-percent * n // 100) < steps[own]:  # a smaller partner may be one class below
        classes.append(own - 1)
    keys = []
    with np.errstate(over="ignore"):
        spread = mix(tokens ^ np.uint64(0x9E3779B97F4A7C15))
        for c in classes:
            differ = (steps[c + 1] - 1) * (100 - percent) // percent
            k = differ + 1 + SPARE
            at = (spread % np.uint64(k)).astype(np.int64)
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, at, mix(spread))
            filled = np.bincount(at, minlength=k) > 0
            name = mix(np.arange(k, dtype=np.uint64) + np.uint64((c + 1) << 32))
            key = mix(sums + name)
            keys.append(key if (~filled).sum() > SPARE else key[filled])
    return np.concatenate(keys).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(F.col(f"`{text_col}`")).alias("text"))
    return rows.withColumn("copy", F.xxhash64("text"))


def token_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
               percent: int = 90) -> DataFrame:
    """(id, copy, n, digest, keys) of every row: the text's hash, the set's
    size, digest (null if empty) and segment keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = size_steps(percent, 1 << 40)
        for b in batches:
            sets = [token_set(t, shingle_words) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "copy": b["copy"], "n": [len(s) for s in sets],
                                "digest": pd.array([digest(s) if len(s) else None for s in sets], dtype="Int64"),
                                "keys": [segment_keys(s, percent, steps) for s in sets]})

    return _rows(docs, id_col, text_col).mapInPandas(run, "id long, copy long, n long, digest long, keys array<long>")


def digest(tokens: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)


# -- documents that agree on a segment --------------------------------------

def starred(key: np.ndarray, who: np.ndarray):
    """Per key its least document; and the pairs (other document, least)."""
    order = np.lexsort((who, key.view(np.uint64)))
    key, who = key[order], who[order]
    first = np.r_[True, key[1:] != key[:-1]]
    hub = who[first][np.cumsum(first) - 1]
    star = np.unique(np.stack([who, hub], axis=1)[who != hub], axis=0)
    return key[first], who[first], star


def agreeing(sets: DataFrame) -> DataFrame:
    """(u, v): pairs of documents that agree on a segment, such that all that
    agree on one are connected.

    The pairs (key, document) travel packed, 16 bytes each, in ranges of the
    key.  Before they do, each task makes stars of its own documents and
    sends only their centres on, so a key of very many documents comes with
    one pair per batch."""
    pairs = sets.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    ranges = max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-pairs // RANGE_PAIRS))

    def packed(keys: list[np.ndarray], who: list[np.ndarray]) -> pd.DataFrame:
        key, doc, star = starred(np.concatenate(keys), np.concatenate(who))
        at = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        out = [(int(at[i]), key[i:j].tobytes(), doc[i:j].tobytes(), False) for i, j in zip(cuts, cuts[1:])]
        # known pairs ride along, spread over the ranges
        per = 4096
        out += [(int(at[0] + i) % ranges, star[p:p + per, 0].tobytes(), star[p:p + per, 1].tobytes(), True)
                for i, p in enumerate(range(0, len(star), per))]
        return pd.DataFrame(out, columns=["part", "a", "b", "known"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, who, held = [], [], 0
        for b in batches:
            n = [len(k) for k in b["keys"]]
            if not sum(n):
                continue
            keys.append(np.concatenate(list(b["keys"])).astype(np.int64))
            who.append(np.repeat(b["digest"].to_numpy(np.int64, na_value=0), n))
            held += sum(n)
            if held > HELD_PAIRS:
                yield packed(keys, who)
                keys, who, held = [], [], 0
        if held:
            yield packed(keys, who)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _runs(batches, ["part"]):
            known = g["known"].to_numpy(bool)
            join = lambda c, rows: np.frombuffer(b"".join(g.loc[rows, c]), np.int64)
            u, v = join("a", known), join("b", known)
            key = join("a", ~known)
            if len(key):
                star = starred(key, join("b", ~known))[2]
                u, v = np.r_[u, star[:, 0]], np.r_[v, star[:, 1]]
            yield pd.DataFrame({"u": u, "v": v})

    dealt = sets.filter("size(keys) > 0").select("digest", "keys").mapInPandas(deal, "part long, a binary, b binary, known boolean")
    return dealt.repartition("part").sortWithinPartitions("part").mapInPandas(meet, "u long, v long").distinct()


def tokens_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(digest, ..., tokens) of the texts whose hash is in ``wanted(copy,
    digest, ...)``, each once."""
    keep = wanted.columns
    texts = (_rows(docs, id_col, text_col).select("copy", "text").join(wanted, "copy")
             .groupBy(*keep).agg(F.first("text").alias("text")))
    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text") + ", tokens binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tokens"] = [token_set(t, shingle_words).tobytes() for t in b["text"]]
            yield b.drop(columns="text")

    return texts.mapInPandas(run, schema)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# -- trees ------------------------------------------------------------------

class Forest:
    """Which leaves are connected."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(int(x), i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class SignatureTree:
    """Levels of nodes over leaves ``order``: OR bitmaps, size ranges and the
    most tokens that share a bit with another token of their document."""

    def __init__(self, order: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = order
        bits, n = bitmaps[order], sizes[order]
        crowd = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, crowd)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), FAN)
            low, high, crowd = self.levels[-1][1:]
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            self.levels.append((bits, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(crowd, at)))

    def level(self, h: int):
        """Level h; a tree that ends below repeats its top."""
        return self.levels[min(h, len(self.levels) - 1)]

    def children(self, h: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, on level h - 1, of nodes x."""
        if h >= len(self.levels):
            return x, np.ones_like(x)
        return x * FAN, np.minimum(FAN, len(self.levels[h - 1][1]) - x * FAN)

    def purity(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below each node, level by level."""
        low = high = labels[self.order]
        out = [(low, high)]
        while len(low) > 1:
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append((low, high))
        return out


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    most = max(len(s) for s in sets)
    power = min(max(int(BITS_PER_TOKEN * most - 1).bit_length(), _MIN_BITS), _MAX_BITS)
    out = np.zeros((len(sets), (1 << power) >> 6), np.uint64)
    for i, s in enumerate(sets):
        place = s >> np.uint64(64 - power)
        np.bitwise_or.at(out[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _opened(a: SignatureTree, b: SignatureTree, h: int, x: np.ndarray, y: np.ndarray, same: bool):
    """All pairs of children of the node pairs (x, y)."""
    fx, cx = a.children(h, x)
    fy, cy = b.children(h, y)
    n = cx * cy
    pair = np.repeat(np.arange(len(x)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    i, j = fx[pair] + k // cy[pair], fy[pair] + k % cy[pair]
    if same:
        keep = (x[pair] != y[pair]) | (i <= j)
        i, j = i[keep], j[keep]
    return i, j


def traverse(sets: list[np.ndarray], labels: np.ndarray, right: np.ndarray | None, percent: int, seen: dict | None = None) -> Forest:
    """The leaves' connection after all links between them (with ``right``:
    between the leaves it marks and the others) are known; ``labels`` are
    the connections known before."""
    forest = Forest(labels)
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps = _bitmaps(sets)
    near = np.lexsort((sizes, [s[0] for s in sets]))  # near copies mostly share their least token
    same = right is None
    a = SignatureTree(near if same else near[~right[near]], sizes, bitmaps)
    b = a if same else SignatureTree(near[right[near]], sizes, bitmaps)
    h = max(len(a.levels), len(b.levels)) - 1
    todo = [(h, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        h, x, y = todo.pop()
        if len(x) > PAIRS:
            todo.append((h, x[PAIRS:], y[PAIRS:]))
            x, y = x[:PAIRS], y[:PAIRS]
        now = forest.labels()
        pa = a.purity(now)
        pb = pa if same else b.purity(now)
        pa, pb = pa[min(h, len(pa) - 1)], pb[min(h, len(pb) - 1)]
        apart = (pa[0][x] != pa[1][x]) | (pb[0][y] != pb[1][y]) | (pa[0][x] != pb[0][y])
        x, y = x[apart], y[apart]
        (bx, lx, hx, ex), (by, ly, hy, ey) = a.level(h), b.level(h)
        most = np.bitwise_count(bx[x] & by[y]).sum(axis=1, dtype=np.int64) + np.minimum(ex[x], ey[y])
        most = np.minimum(most, np.minimum(hx[x], hy[y]))
        fits = ((100 + percent) * most >= percent * (lx[x] + ly[y])) & (100 * hx[x] >= percent * ly[y]) & (100 * hy[y] >= percent * lx[x])
        if seen is not None:
            seen["visited"] = seen.get("visited", 0) + len(x)
            seen["pruned"] = seen.get("pruned", 0) + int((~fits).sum())
        x, y = x[fits], y[fits]
        if h:
            if len(x):
                x, y = _opened(a, b, h, x, y, same)
                # pairs within a node last, so that they are taken first
                order = np.argsort(np.where(x == y, 1, 0), kind="stable") if same else np.arange(len(x))
                todo.append((h - 1, x[order][::-1], y[order][::-1]))
            continue
        for i, j in zip(a.order[x], b.order[y]):
            u, v = forest.find(int(i)), forest.find(int(j))
            if u != v:
                if seen is not None:
                    seen["compared"] = seen.get("compared", 0) + 1
                if linked(sets[i], sets[j], percent):
                    forest.up[max(u, v)] = min(u, v)
    return forest


# -- Spark ------------------------------------------------------------------

def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches sorted by it."""
    held, name = [], None
    for b in batches:
        if not len(b):
            continue
        cut = (b[key] != b[key].shift()).any(axis=1).to_numpy()
        edges = [*np.flatnonzero(cut), len(b)]
        if edges[0]:
            edges.insert(0, 0)
        for lo, hi in zip(edges, edges[1:]):
            part = b.iloc[lo:hi]
            now = tuple(part[key].iloc[0])
            if held and now != name:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part.copy() if hi == len(b) else part)
            name = now
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _tree_links(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(u, v): a star for each component found among the rows (node, comp,
    is_right, tokens) of each key."""
    rows = rows.select(*key, "node", "comp", "is_right", "tokens").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _runs(batches, key):
            right = g["is_right"].to_numpy(bool)
            if len(g) < 2:
                continue
            sets = [np.frombuffer(t, np.uint64) for t in g["tokens"]]
            node = g["node"].to_numpy()
            forest = traverse(sets, g["comp"].to_numpy(), right if right.any() else None, percent)
            top = forest.labels()
            new = top != np.arange(len(top))
            if new.any():
                yield pd.DataFrame({"u": node[new], "v": node[top[new]]})

    return rows.mapInPandas(run, "u long, v long")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link."""
    both = (pairs.join(sets.select(F.col("digest").alias("u"), F.col("tokens").alias("a")), "u")
            .join(sets.select(F.col("digest").alias("v"), F.col("tokens").alias("b")), "v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["a"], b["b"])]
            yield b.loc[np.array(ok, bool), ["u", "v"]]

    return both.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def _large_links(large: DataFrame, edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the groups that are more than one tree: ``large(node)``, of
    ``sets(digest, n, keys, tokens)``."""
    sets = stage(sets.join(large.withColumnRenamed("node", "digest"), "digest"), "large")
    star = stage(_checked(edges.join(large.withColumnRenamed("node", "u"), "u", "left_semi"), sets, percent), "star")
    known = components(star).withColumnRenamed("node", "digest").withColumnRenamed("label", "comp")
    leaves = sets.select("digest", "n", "keys").join(known, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    member = stage(leaves.select("digest", "n", "comp", F.explode("keys").alias("key")), "members")
    # keys with several components; of keys with the same documents one
    open_ = (member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"),
                                       F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("s"))
             .filter("lo <> hi").groupBy("c", "s").agg(F.min("key").alias("key")).select("key"))
    placed = stage(range_ordinal(member.join(open_, "key"), ["key", "comp", "n", "digest"], "at"), "tiled")
    placed = placed.withColumn("tile", F.shiftright("at", TILE_BITS))
    tiles = placed.groupBy("key", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                              F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    b = tiles.select("key", *(F.col(c).alias(f"{c}_b") for c in ("tile", "low", "high", "c0", "c1")))
    pairs = (tiles.join(b, "key").filter("tile <= tile_b")
             .filter((100 * F.col("high") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low")))
             .filter("NOT (c0 = c1 AND c0_b = c1_b AND c0 = c0_b)").select("key", "tile", "tile_b"))
    pairs = stage(pairs, "tile-pairs")
    side = placed.select("key", "tile", "digest", "comp")
    tasks = side.join(pairs, ["key", "tile"]).select("key", "tile", "tile_b", "digest", "comp", F.lit(False).alias("is_right")).unionByName(
        side.withColumnRenamed("tile", "tile_b").join(pairs.filter("tile < tile_b"), ["key", "tile_b"])
        .select("key", "tile", "tile_b", "digest", "comp", F.lit(True).alias("is_right")))
    rows = tasks.join(sets.select("digest", "tokens"), "digest").withColumnRenamed("digest", "node")
    return star.unionByName(_tree_links(rows, ["key", "tile", "tile_b"], percent))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
            percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id
    reachable over links, itself included).

    Fewer words than a shingle: the whole sequence is the one shingle.  Null
    text or no words: an empty set, linked with nothing.  Null id: linked
    like any other; component_id is the smallest non-null id, null if there
    is none.  Repeated rows each get a row.  Empty table: no rows.  Other
    columns are not read.  ``percent`` is from 70 to 99.
    """
    if not 70 <= percent <= 99:
        raise ValueError("percent must be from 70 to 99")
    sets = stage(token_sets(docs, id_col, text_col, shingle_words, percent), "token-sets")
    edges = stage(agreeing(sets), "agreeing")
    groups = components(edges).withColumnRenamed("node", "digest").withColumnRenamed("label", "grp")
    known = sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.min("copy").alias("copy"), F.first("n").alias("n"))
    nodes = stage(known.join(groups, "digest", "left"), "nodes")
    member = nodes.filter("grp IS NOT NULL").select("copy", "digest", "n", "grp")
    member = stage(tokens_of(docs, member, id_col, text_col, shingle_words), "members")
    sizes = stage(member.groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
                  .withColumn("is_large", F.expr(f"c > {GROUP_DOCS} OR t > {GROUP_TOKENS}")).select("grp", "is_large"), "group-sizes")
    small = (member.join(sizes.filter("NOT is_large").select("grp"), "grp")
             .select("grp", F.col("digest").alias("node"), F.col("digest").alias("comp"), F.lit(False).alias("is_right"), "tokens"))
    links = _tree_links(small, ["grp"], percent)
    large = sizes.filter("is_large").select("grp")
    if not large.isEmpty():
        inside = stage(member.join(large, "grp").select("digest", "n", "tokens"), "large-sets")
        keys = sets.join(inside.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("keys").alias("keys"))
        links = links.unionByName(_large_links(inside.select(F.col("digest").alias("node")), edges, inside.join(keys, "digest"), percent))
    label = components(links).withColumnRenamed("node", "digest")
    named = nodes.select("digest", "id").join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = named.join(least, "label").select("digest", "component_id")
    out = sets.select("id", "n", "digest").join(found, "digest", "left")
    return out.select("id", F.col("n").alias("n_shingles"),
                      F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
