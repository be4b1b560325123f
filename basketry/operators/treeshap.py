"""Exact path-dependent attributions of boosted trees (E9, tree part).

The attribution of a feature is its Shapley value in the game whose worth of
a set of features is the trees' expectation when only these are known and
every other split is followed both ways, weighted by the training rows that
went each way.  A leaf's share depends only on the distinct features on its
path: z, the weight that reaches the leaf when a feature is unknown, and o,
whether the row's own value leads there (1 or 0).  With m features on the
path, feature i gets

    value * (o_i - z_i) * integral over t in [0, 1] of
        product over the other features j of (z_j (1 - t) + o_j t)

because the integral of t^k (1 - t)^(m-1-k) is the Shapley weight
k! (m-1-k)! / m!.  The integrand is a polynomial of degree m - 1, so
ceil(m / 2) Gauss-Legendre points give it exactly: polynomial work in the
depth of the trees, no enumeration of subsets.  The o of a leaf form one of
2^m patterns, so for short paths the shares of every pattern are worked out
once and a row only looks them up.

The model travels to the tasks as a broadcast, bounded by the number of trees
and their depth; rows are explained in Arrow batches and never collected.
Base + sum of contributions = margin (log-odds) for every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import scratch_path

ROWS = 4096         # rows explained together
TASK_ROWS = 16_384  # rows of a task, about
SHORT = 8           # features on a path whose patterns are tabulated


@dataclass
class Split:
    feature: int
    threshold: float = 0.0
    left: frozenset = frozenset()   # categories that go left; empty: a threshold

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return np.isin(v, list(self.left)) if self.left else v <= self.threshold


@dataclass
class Leaf:
    value: float                                    # weighted by its tree
    features: list[int] = field(default_factory=list)
    unknown: list[float] = field(default_factory=list)      # z of each feature
    turns: list[list[tuple[int, bool]]] = field(default_factory=list)  # its splits and their sides


@dataclass
class Tree:
    splits: list[Split]
    leaves: list[Leaf]


def paths(nodes: dict[int, dict], weight: float) -> Tree:
    """A tree from its nodes: id -> value, cover, left, right, split."""
    out, numbers = Tree([], []), {}
    todo = [(0, [])]
    while todo:
        at, path = todo.pop()
        n = nodes[at]
        if n["left"] < 0:
            leaf, place = Leaf(weight * n["value"]), {}
            for node, side in path:
                f = nodes[node]["split"].feature
                if f not in place:
                    place[f] = len(leaf.features)
                    leaf.features.append(f)
                    leaf.unknown.append(1.0)
                    leaf.turns.append([])
                child = nodes[nodes[node]["left" if side else "right"]]
                leaf.unknown[place[f]] *= child["cover"] / nodes[node]["cover"]
                leaf.turns[place[f]].append((numbers[node], side))
            out.leaves.append(leaf)
            continue
        numbers[at] = len(out.splits)
        out.splits.append(n["split"])
        todo += [(n["left"], [*path, (at, True)]), (n["right"], [*path, (at, False)])]
    return out


def boosted_trees(spark: SparkSession, model) -> list[Tree]:
    """The trees of a fitted ``GBTClassificationModel``, as saved by Spark;
    at most trees x 2^(depth + 1) nodes.  Leaf values are in log-odds: Spark's
    probability is the logistic of twice the weighted sum."""
    path = scratch_path(spark, "gbt")
    model.write().overwrite().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        s = r["split"]
        by_value = s["numCategories"] < 0
        split = None if r["leftChild"] < 0 else Split(
            s["featureIndex"], s["leftCategoriesOrThreshold"][0] if by_value else 0.0,
            frozenset() if by_value else frozenset(s["leftCategoriesOrThreshold"]))
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "value": r["prediction"], "cover": r["rawCount"], "left": r["leftChild"], "right": r["rightChild"], "split": split}
    return [paths(trees[t], 2.0 * w) for t, w in enumerate(model.treeWeights)]


def base_value(trees: Sequence[Tree]) -> float:
    """The margin's expectation over the training rows."""
    return float(sum(leaf.value * np.prod(leaf.unknown) for t in trees for leaf in t.leaves))


def _points(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on [0, 1], exact to degree m - 1."""
    x, w = np.polynomial.legendre.leggauss((m + 1) // 2)
    return (x + 1) / 2, w / 2


def _shares(known: Sequence, unknown: Sequence, m: int) -> list:
    """Per feature of a path, (o - z) times its integral; arrays o and z."""
    share = [0.0] * m
    for at, weight in zip(*_points(m)):
        term = [z * (1 - at) + o * at for o, z in zip(known, unknown)]
        after = [weight]                               # products of the terms behind, from the last
        for j in range(m - 1, 0, -1):
            after.append(after[-1] * term[j])
        before = 1.0
        for i in range(m):
            share[i] = share[i] + before * after[m - 1 - i]
            before = before * term[i]
    return [(o - z) * s for o, z, s in zip(known, unknown, share)]


def tables(trees: Sequence[Tree]) -> list[list[np.ndarray | None]]:
    """Per tree and leaf: the contribution of each feature of its path for
    every pattern of o (feature i is bit i); none for long paths."""
    out = [[None] * len(t.leaves) for t in trees]
    by_length: dict[int, list[tuple[int, int]]] = {}
    for t, tree in enumerate(trees):
        for k, leaf in enumerate(tree.leaves):
            by_length.setdefault(len(leaf.features), []).append((t, k))
    for m, places in by_length.items():
        if not 0 < m <= SHORT:
            continue
        leaves = [trees[t].leaves[k] for t, k in places]
        value, z = np.array([leaf.value for leaf in leaves]), np.array([leaf.unknown for leaf in leaves])
        bits = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        share = _shares([bits[None, :, i] for i in range(m)], [z[:, i, None] for i in range(m)], m)
        made = np.stack(share, axis=1) * value[:, None, None]   # leaf, feature, pattern
        for (t, k), a in zip(places, made):
            out[t][k] = a
    return out


def attributions(trees: Sequence[Tree], x: np.ndarray, tabled: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(contributions per row and feature, margins) of rows x; ``tabled`` are
    the ``tables`` of the trees, if at hand."""
    tabled = tables(trees) if tabled is None else tabled
    phi, margin = np.zeros(x.shape[::-1]), np.zeros(len(x))
    for t, of_tree in zip(trees, tabled):
        left = [s.goes_left(x) for s in t.splits]
        sides = [(~g, g) for g in left]
        for leaf, table in zip(t.leaves, of_tree):
            m = len(leaf.features)
            if not m:  # a tree without splits
                margin += leaf.value
                continue
            known = []
            for turns in leaf.turns:
                one = sides[turns[0][0]][turns[0][1]]
                for s, side in turns[1:]:
                    one = one & sides[s][side]
                known.append(one)
            if table is None:
                known = [k.astype(float) for k in known]
                margin += leaf.value * np.prod(known, axis=0)
                for f, share in zip(leaf.features, _shares(known, leaf.unknown, m)):
                    phi[f] += leaf.value * share
                continue
            pattern = known[0].astype(np.intp)
            for i in range(1, m):
                pattern += known[i].view(np.uint8) * np.uint8(1 << i)
            for f, row in zip(leaf.features, table):
                phi[f] += row[pattern]
            margin += np.where(pattern == (1 << m) - 1, leaf.value, 0.0)
    return phi.T, margin


def contributions(trees: Sequence[Tree], scored: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long table (keys, feature, value, contribution, base, margin) of
    rows with a ``features`` vector.  Every row of the input is explained;
    null keys are kept, repeated rows each give their features."""
    spark = scored.sparkSession
    shared = spark.sparkContext.broadcast((list(trees), tables(trees)))  # bounded by the model's size
    base, names = base_value(trees), list(names)
    rows = scored.select(*keys, vector_to_array("features").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at:at + ROWS]
                x = np.stack(part["x"].to_numpy()).astype(float)
                phi, margin = attributions(shared.value[0], x, shared.value[1])
                out = part[keys].copy()
                out["value"], out["contribution"] = list(x), list(phi)
                out["margin"] = margin
                yield out

    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k != "x")
    wide = rows.mapInPandas(run, f"{schema}, value array<double>, contribution array<double>, margin double")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), "value", "contribution"))
    return (wide.select(*keys, "margin", each.alias("s"))
            .select(*keys, "s.feature", "s.value", "s.contribution", F.lit(base).alias("base"), "margin"))
