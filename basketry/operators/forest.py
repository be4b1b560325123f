"""Random forest of deep trees (M2), grown where its rows are.

Deep trees have about as many nodes as rows, so neither a histogram of every
node nor the nodes themselves should pass through one place.  A tree is grown
in two parts.  Nodes of more than ``PART`` rows are cut by histograms that
Spark sums over the whole table, level by level.  The rows of every smaller
node are then shuffled to one task, which grows all below it.  The model is a
table with one row per such part; only the cuts above the parts, about
``2 * rows / PART`` a tree, are held by the driver.  Rows are scored the same
way: they go to their part of each tree, and Spark sums the votes.

Features come in at most ``BINS`` bins, a node looks at ceil(sqrt(features))
of them, splits by Gini impurity until it is pure or no cut helps, and a row
counts Poisson(1) times in each tree.  Both draws are hashes (of the row, of
the tree and the node), so a tree does not depend on where it is grown.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import spread, stage

BINS = 64             # bins per feature
PART = 32_768         # most rows of a node that one task grows on
OPEN = 4_096          # nodes cut in one job
ROWS = 65_536         # rows that a task codes, on average
SCORED = 1_000_000    # rows scored by one part in one task, on average
_VOTE = 1 << 40       # votes are summed as whole numbers, so in any order
_POISSON = np.cumsum([exp(-1.0) / factorial(k) for k in range(18)])
_NO_CUTS = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Forest:
    pipeline: object          # from rows to ``features``
    bins: list[np.ndarray]    # the values that end a bin, of each feature
    cuts: list[tuple]         # per tree: nodes above the parts, their features and cuts
    parts: DataFrame          # tree, part, feature, cut, child, value
    trees: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    u = _mix(h.view(np.uint64) ^ _mix(np.array([seed * 1_000_003 + tree]))) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0 ** -53, side="right").astype(np.uint8)


def _picks(tree: int, node: np.ndarray, d: int, seed: int) -> np.ndarray:
    """The features each node looks at, in order."""
    base = _mix(node ^ _mix(np.array([seed * 1_000_003 + tree]) + (1 << 40)).astype(np.int64))
    return np.argsort(_mix(base[:, None] ^ np.arange(d, dtype=np.uint64)), axis=1, kind="stable")[:, :ceil(d ** 0.5)]


def _route(cuts: tuple, x: np.ndarray) -> np.ndarray:
    """The part of each row: node 1 is the root, 2 n and 2 n + 1 lie below n."""
    ids, feature, cut = cuts
    node, live = np.ones(len(x), np.int64), np.arange(len(x))
    while len(ids) and len(live):
        at = np.minimum(np.searchsorted(ids, node[live]), len(ids) - 1)
        hit = ids[at] == node[live]
        live, at = live[hit], at[hit]
        node[live] = 2 * node[live] + (x[live, feature[at]] > cut[at])
    return node


def _squares(one: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (one * one + (n - one) * (n - one)) / n


def best_cuts(at: np.ndarray, v: np.ndarray, w: np.ndarray, one: np.ndarray, n: np.ndarray, n1: np.ndarray):
    """Per node the gain of the best cut of one feature, and the cut (values
    up to it go left).  A cell has its node ``at``, its value, weight and
    weight of class 1; n and n1 are their sums per node."""
    key = at.astype(np.int64) << 8 | v
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    node = key[last] >> 8
    left = np.cumsum(w[order])[last] - (np.cumsum(n) - n)[node]
    left1 = np.cumsum(one[order])[last] - (np.cumsum(n1) - n1)[node]
    right, right1 = n[node] - left, n1[node] - left1
    inner = right > 0
    gain = np.where(inner, _squares(left1, left) + _squares(right1, np.where(inner, right, 1.0)) - _squares(n1, n)[node], 0.0)
    best = np.maximum.reduceat(gain, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
    places = np.flatnonzero(gain == best[node])
    places = places[np.r_[True, node[places[1:]] != node[places[:-1]]]]
    return best, key[last][places] & 255


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, max_depth: int, seed: int) -> dict[str, np.ndarray]:
    """All below node ``root``, level by level: feature (-1: a leaf), cut,
    place of the left child (the right one follows) and share of class 1."""
    w = w.astype(float)
    one, at, level = w * y, np.zeros(len(x), np.int64), np.array([root], np.int64)
    out: dict[str, list] = {"feature": [], "cut": [], "child": [], "value": []}
    made = 1
    while len(level):
        n, n1 = np.bincount(at, w, len(level)), np.bincount(at, one, len(level))
        feature, cut, child = np.full(len(level), -1), np.zeros(len(level), np.int64), np.full(len(level), -1)
        open_ = np.flatnonzero((n1 > 0) & (n1 < n) & (level < 1 << max_depth))
        place = np.full(len(level), -1)
        place[open_] = np.arange(len(open_))
        keep = place[at] >= 0
        x, w, one, at = x[keep], w[keep], one[keep], place[at[keep]]
        below = np.empty(0, np.int64)
        if len(open_):
            picks, m, m1 = _picks(tree, level[open_], x.shape[1], seed), n[open_], n1[open_]
            gain, f, c = 1e-12 * m, np.full(len(open_), -1), np.zeros(len(open_), np.int64)
            for j in range(picks.shape[1]):
                g, k = best_cuts(at, x[np.arange(len(x)), picks[at, j]], w, one, m, m1)
                better = g > gain
                gain, f, c = np.where(better, g, gain), np.where(better, picks[:, j], f), np.where(better, k, c)
            split = np.flatnonzero(f >= 0)
            feature[open_], cut[open_] = f, c
            child[open_[split]] = made + 2 * np.arange(len(split))
            ids = level[open_[split]]
            below = np.stack([2 * ids, 2 * ids + 1], axis=1).ravel()
            place = np.full(len(open_), -1)
            place[split] = np.arange(len(split))
            keep = place[at] >= 0
            x, w, one, at = x[keep], w[keep], one[keep], at[keep]
            at = 2 * place[at] + (x[np.arange(len(x)), f[at]] > c[at])
            made += len(below)
        for k, a in zip(out, (feature, cut, child, n1 / n)):
            out[k].append(a)
        level = below
    return {k: np.concatenate(a) for k, a in out.items()}


def _codes(batch: pa.RecordBatch, bins: Sequence[np.ndarray]) -> np.ndarray:
    x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, len(bins))
    return np.stack([np.searchsorted(ends, x[:, i], side="left") for i, ends in enumerate(bins)], axis=1).astype(np.uint8)


def _bytes(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x]


def _bins(rows: DataFrame, d: int) -> list[np.ndarray]:
    """The ends of each feature's bins: between its values if there are at
    most ``BINS``, else its quantiles."""
    cells = rows.select(F.posexplode("x").alias("i", "v")).distinct()
    sizes = {r["i"]: r["n"] for r in cells.groupBy("i").agg(F.count("*").alias("n")).collect()}
    few = [i for i in range(d) if sizes.get(i, 0) <= BINS]
    values: dict[int, list] = {i: [] for i in few}
    for r in cells.filter(F.col("i").isin(few)).collect():  # at most BINS a feature
        values[r["i"]].append(r["v"])
    out = {i: np.sort(v) for i, v in values.items()}
    out = {i: (v[1:] + v[:-1]) / 2 for i, v in out.items()}
    many = [i for i in range(d) if i not in out]
    if many:
        wide = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in many])
        for i, q in zip(many, wide.approxQuantile(wide.columns, [k / BINS for k in range(1, BINS)], 0.001)):
            out[i] = np.unique(q)
    return [out[i] for i in range(d)]


def _coded(rows: DataFrame, bins: Sequence[np.ndarray]) -> DataFrame:
    """``rows`` with x as one byte per feature."""
    spark = rows.sparkSession
    shared, others = spark.sparkContext.broadcast(bins), [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(_bytes(_codes(b, shared.value)), pa.binary())],
                                             [*others, "x"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in others) + ", x binary")


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def _cut_open(rows: DataFrame, d: int, cuts: list[tuple], open_: list[tuple[int, int]], seed: int) -> list:
    """One row per open node: its best cut (feature -1: none), rows, weight
    and weight of class 1, in all and left of the cut."""
    spark = rows.sparkSession
    by_tree: dict[int, list[int]] = {}
    for k, (t, _) in enumerate(open_):
        by_tree.setdefault(t, []).append(k)
    nodes = np.array([n for _, n in open_], np.int64)
    sent = spark.sparkContext.broadcast((cuts, by_tree, nodes))
    width = ceil(d ** 0.5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, by_tree, nodes = sent.value
        cells = np.zeros((3, len(nodes) * width * BINS))
        for b in batches:
            x, y, h = _matrix(b.column("x"), d), np.asarray(b.column("y")), np.asarray(b.column("h"))
            for t, places in by_tree.items():
                w = _draws(h, t, seed)
                rows = np.flatnonzero(w)
                node = _route(cuts[t], x[rows])
                mine = np.sort(nodes[places])
                of = np.array(places)[np.argsort(nodes[places])]
                at = np.minimum(np.searchsorted(mine, node), len(mine) - 1)
                hit = mine[at] == node
                rows, at, node = rows[hit], of[at[hit]], node[hit]
                picks = _picks(t, nodes[of], d, seed)
                which = np.searchsorted(mine, node)
                for j in range(width):
                    key = (at * width + j) * BINS + x[rows, picks[which, j]]
                    lo, hi = places[0] * width * BINS, (places[-1] + 1) * width * BINS
                    for c, what in enumerate((None, w[rows], w[rows] * y[rows])):
                        cells[c, lo:hi] += np.bincount(key - lo, what, hi - lo)
        full = np.flatnonzero(cells[0])
        yield pa.RecordBatch.from_arrays([pa.array(full // (width * BINS), pa.int32()), pa.array(full // BINS % width, pa.int32()),
                                          pa.array(full % BINS, pa.int32()), *(pa.array(c[full]) for c in cells)],
                                         ["at", "j", "v", "rows", "w", "one"])

    def choose(key, cells):
        at = int(key[0])
        first = cells[cells["j"] == 0]
        total = [first[c].sum() for c in ("rows", "w", "one")]
        best, cut, at_j = 1e-12 * total[1], 0, -1
        for j in range(width):
            c = cells[cells["j"] == j]
            g, k = best_cuts(np.zeros(len(c), np.int64), c["v"].to_numpy(), c["w"].to_numpy(), c["one"].to_numpy(),
                             np.array([total[1]]), np.array([total[2]]))
            if g[0] > best:
                best, cut, at_j = g[0], int(k[0]), j
        left = cells[(cells["j"] == at_j) & (cells["v"] <= cut)]
        return pd.DataFrame([(at, at_j, cut, *total, *(left[c].sum() for c in ("rows", "w", "one")))],
                            columns=["at", "j", "cut", "rows", "w", "one", "left_rows", "left_w", "left_one"])

    cells = rows.select("h", "y", "x").mapInArrow(count, "at int, j int, v int, rows double, w double, one double")
    summed = cells.groupBy("at", "j", "v").agg(*(F.sum(c).alias(c) for c in ("rows", "w", "one")))
    made = summed.groupBy("at").applyInPandas(choose, "at int, j int, cut int, rows double, w double, one double, "
                                                      "left_rows double, left_w double, left_one double").collect()
    sent.destroy()
    return made


def _top(rows: DataFrame, n: int, d: int, trees: int, max_depth: int, seed: int, part: int):
    """The cuts above the parts, per tree, and the leaves among them."""
    cuts, leaves = [_NO_CUTS] * trees, []
    held: list[dict] = [{} for _ in range(trees)]
    open_ = [(t, 1) for t in range(trees)] if n > part and max_depth > 0 else []
    while open_:
        found = []
        for at in range(0, len(open_), OPEN):
            some = open_[at:at + OPEN]
            for r in _cut_open(rows, d, cuts, some, seed):
                tree, node = some[r["at"]]
                if r["j"] < 0:
                    leaves.append((tree, node, r["one"] / r["w"]))
                    continue
                feature = int(_picks(tree, np.array([node], np.int64), d, seed)[0, r["j"]])
                held[tree][node] = feature, r["cut"]
                for child, *(k, w, one) in ((2 * node, r["left_rows"], r["left_w"], r["left_one"]),
                                            (2 * node + 1, r["rows"] - r["left_rows"], r["w"] - r["left_w"], r["one"] - r["left_one"])):
                    if one in (0, w) or child >= 1 << max_depth:
                        leaves.append((tree, child, one / w))
                    elif k > part:
                        found.append((tree, child))
        for t, h in enumerate(held):
            ids = sorted(h)
            cuts[t] = tuple(np.array(a, np.int64) for a in (ids, [h[i][0] for i in ids], [h[i][1] for i in ids]))
        open_ = sorted(found)
    return cuts, leaves


def _runs(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node with the places that hold it."""
    order = np.argsort(node, kind="stable")
    edges = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1], True]) if len(node) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(node[order[lo]]), order[lo:hi]


def fit(train: DataFrame, pipeline, label: Column, trees: int, max_depth: int, seed: int, part: int = PART) -> Forest:
    """The forest of the rows of ``train``; ``pipeline`` adds ``features``.
    ``label`` is 0 or 1.  Null labels and an empty table are refused."""
    spark = train.sparkSession
    found = pipeline.transform(spread(train, ROWS))
    rows = found.select(F.xxhash64(*train.columns).alias("h"), label.cast("int").alias("y"), vector_to_array("features").alias("x"))
    n, odd, d = rows.agg(F.count("*"), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)), F.max(F.size("x"))).first()
    if not n or odd:
        raise ValueError("a forest needs rows, each with label 0 or 1")
    bins = _bins(rows, d)
    coded = stage(_coded(rows, bins), "forest-rows")
    cuts, leaves = _top(coded, n, d, trees, max_depth, seed, part)
    done: list[list[int]] = [[] for _ in range(trees)]
    for t, node, _ in leaves:
        done[t].append(node)
    sent = spark.sparkContext.broadcast((cuts, done))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, done = sent.value
        for b in batches:
            x, y, h = _matrix(b.column("x"), d), np.asarray(b.column("y")).astype(np.uint8), np.asarray(b.column("h"))
            out: list[tuple] = []
            for t in range(trees):
                w = _draws(h, t, seed)
                held = np.flatnonzero(w)
                block = np.concatenate([x[held], y[held, None], w[held, None]], axis=1)
                for node, at in _runs(_route(cuts[t], x[held])):
                    if node not in done[t]:
                        out.append((t, node, block[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))]
                                             if out else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.binary())],
                                             ["tree", "part", "block"])

    def finish(key, blocks):
        tree, root = key[0].as_py(), key[1].as_py()
        a = _matrix(blocks.column("block"), d + 2)
        made = grow(a[:, :d], a[:, d], a[:, d + 1], tree, root, max_depth, seed)
        return pa.table({"tree": pa.array([tree], pa.int32()), "part": pa.array([root], pa.int64()),
                         **{k: pa.array([v], pa.list_(pa.float64() if k == "value" else pa.int32())) for k, v in made.items()}})

    schema = "tree int, part long, feature array<int>, cut array<int>, child array<int>, value array<double>"
    dealt = coded.mapInArrow(deal, "tree int, part long, block binary").repartition(trees, "tree", "part")
    parts = dealt.groupBy("tree", "part").applyInArrow(finish, schema)
    if leaves:
        parts = parts.unionByName(spark.createDataFrame([(t, node, [-1], [0], [-1], [float(v)]) for t, node, v in leaves], schema))
    return Forest(pipeline, bins, cuts, stage(parts, "forest"), trees)


def predict(forest: Forest, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score): the mean share of class 1 in the leaves of each row.
    Repeated rows and null keys are kept."""
    spark, d = rows.sparkSession, len(forest.bins)
    found = forest.pipeline.transform(spread(rows, ROWS)).select(*keys, vector_to_array("features").alias("x"))
    coded = stage(_coded(found, forest.bins).withColumn("rid", F.monotonically_increasing_id()), "forest-scored")
    salts = max(1, ceil(coded.count() / SCORED))
    sent, trees = spark.sparkContext.broadcast(forest.cuts), forest.trees

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rid = _matrix(b.column("x"), d), np.asarray(b.column("rid"))
            salt = (_mix(rid) % np.uint64(salts)).astype(np.int64)
            out: list[tuple] = []
            for t in range(trees):
                node = _route(sent.value[t], x)
                for s in range(salts):
                    mine = np.flatnonzero(salt == s)
                    out += [(t, part, s, rid[mine[at]].tobytes(), x[mine[at]].tobytes()) for part, at in _runs(node[mine])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
                                             if out else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())],
                                             ["tree", "part", "salt", "rids", "block"])

    def vote(model, blocks):
        rid = np.frombuffer(b"".join(blocks.column("rids").to_pylist()), np.int64)
        if not model.num_rows:  # no row was drawn for this tree
            return pa.table({"rid": pa.array([], pa.int64()), "vote": pa.array([], pa.int64())})
        feature, cut, child, value = (np.asarray(model.column(c).combine_chunks().flatten()) for c in ("feature", "cut", "child", "value"))
        x, at = _matrix(blocks.column("block"), d), np.zeros(len(rid), np.int64)
        live = np.flatnonzero(child[at] >= 0)
        while len(live):
            k = at[live]
            at[live] = child[k] + (x[live, feature[k]] > cut[k])
            live = live[child[at[live]] >= 0]
        return pa.table({"rid": rid, "vote": np.round(value[at] * _VOTE).astype(np.int64)})

    dealt = coded.select("rid", "x").mapInArrow(deal, "tree int, part long, salt int, rids binary, block binary")
    model = forest.parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = ["tree", "part", "salt"]
    votes = (model.repartition(trees, *by).groupBy(*by).cogroup(dealt.repartition(trees, *by).groupBy(*by))
             .applyInArrow(vote, "rid long, vote long"))
    scores = votes.groupBy("rid").agg((F.sum("vote") / F.lit(float(_VOTE)) / F.count("*")).alias("score"))
    return coded.join(scores, "rid").select(*keys, "score")
