"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import dialogue, jaccard, merkle
from basketry.llm.queries import QUERIES
from basketry.llm.queries_structure import repaired
from basketry.llm.text import ascii_lower
from tests.llm.helpers import SMALL

SPACES = " \t\n\x0b\x0c\r"


def alike(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- 11 Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root of nodes, and per node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            s = p // 16 * 16
            paths[i].append(("".join(nodes[s:p]), "".join(nodes[p + 1:s + 16])))
            at[i] = p // 16
        nodes = [sha(*nodes[s:s + 16]) for s in range(0, len(nodes), 16)]
    return nodes[0], paths


def merkle_rows(rows):
    groups = {}
    for r in rows:
        bad = None
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            low = None if r[4] is None else r[4].translate({c: c + 32 for c in range(65, 91)})
            bad = sha(*map(sized, (*r[:4], low)))
        groups.setdefault(r[1], []).append((r[0], sha(*map(sized, r)), bad))
    built = []
    for g in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built.append((leaves, *tree([x[1] for x in leaves])))
    root, over = tree([b[1] for b in built])
    for (leaves, sub, paths), above in zip(built, over):
        for (i, leaf, bad), path in zip(leaves, paths):
            acc = bad or leaf
            for left, right in path + above:
                acc = sha(left, acc, right)
            yield i, leaf, sub, root, sha(*(x for p in path + above for x in p)), acc, acc == root


def manifest_rows(df):
    m = merkle.manifest(df, merkle.FIELDS, extra={"tampered": merkle.tampered_leaf(ascii_lower(F.col("text")))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    m = m.select("id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), folded.alias("folded"))
    return [tuple(r) for r in m.withColumn("ok", F.col("folded") == F.col("root")).collect()]


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, r long, n long, node string, leaf string, id string"


def test_merkle_awkward_rows(spark, monkeypatch):
    """Null and repeated ids, null groups, equal rows, far apart ids, a group
    of several block levels, clashing column names."""
    monkeypatch.setattr(merkle, "COPIES", 64)
    r = random.Random(3)
    rows = [(r.choice([None, -5, 0, 7, 1 << 62, -(1 << 63), r.randrange(-10**6, 10**6), r.randrange(300)]),
             r.choice([None, "", "a", "ü", "z", *["hot"] * 6]), r.choice([None, "en"]), r.choice([None, 4]),
             r.choice([None, "", "Ab ü", f"T{i % 7}", "L" * 50_000])) for i in range(1500)]
    rows += [(9, "one", None, None, "same X")] * 300
    df = spark.createDataFrame([(*x, "g", 1, 2, "k", "l", "i") for x in rows], DOCS)
    alike(manifest_rows(df), merkle_rows(rows))


def test_merkle_sizes(spark):
    """Around the borders of runs and blocks, with many groups."""
    rows = [(i, f"s{n}", "en", 1, f"Text {i}") for n in (1, 2, 16, 17, 256, 257, 300) for i in range(n)]
    rows += [(i, f"many{i}", None, None, None) for i in range(270)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    alike(manifest_rows(df), merkle_rows(rows))


def test_merkle_empty_and_single(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    alike(manifest_rows(df), merkle_rows([(1, None, None, None, None)]))
    assert manifest_rows(df.limit(0)) == []


# --- 12 conversation repair

def damage(rows):
    convs = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kept = convs.setdefault(c, [])
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            kept += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return convs


def cheapest(rows, faults):
    """(cost, audit, lines) by search over (row, state) in order of (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit, lines
        if (i, s) in done:
            continue
        done.add((i, s))
        to = 3 if s == 2 else 2
        role = "user" if to == 2 else "assistant"
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, lines))
            if faults[i] not in ("blank", "duplicate"):
                cut = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + 1 + cut, audit + "R", i + 1, to, (*lines, f"{role}:{x}")))
                keep = 1 if r[:1] == "s" and s == 0 else to if r[:1] == ("u" if to == 2 else "a") else None
                if keep:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, keep, (*lines, f"{r}:{x}")))


def repair_rows(rows):
    for c, kept in damage(rows).items():
        kept.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, faults = set(), []
        for _, r, x in kept:
            end = x.strip(SPACES)[-1:]
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "" if end in ".!?" else "truncated")
            seen.add((r, x))
        ini = [r[:1] for _, r, _ in kept]
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, lines = cheapest(kept, faults)
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
               *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
               sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, sha("\n".join(lines)))


def repair_query(df):
    return [tuple(r) for r in repaired(df, *dialogue.repair(dialogue.damaged(df))).collect()]


def awkward_turns():
    r, rows = random.Random(5), []
    for c in [None, 1, 2, 3, -4, *range(10, 40)]:
        for k in range(r.choice([1, 3, 8, 40, 90])):
            rows.append((c, r.choice([None, k, k, k, r.randrange(30)]),
                         r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "User"]),
                         r.choice([None, "", "  ", "Yes.", "no", "Fine!\n", "ok? ", f"Long one {r.randrange(20)}.", f"cut {r.randrange(9)}"])))
    return rows + [(7, 1, "user", "Again.")] * 40 + [(8, 0, "user", "x" * 100_000 + "?")]


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_awkward_rows(spark, monkeypatch, bits):
    """Bits 2: blocks of four rows and blocks, so a long conversation climbs
    several levels."""
    monkeypatch.setattr(dialogue, "BLOCK_BITS", bits)
    monkeypatch.setattr(dialogue, "COPIES", 8)
    rows = awkward_turns()
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows],
                               "conv_id long, turn long, role string, text string, kind string, seq long, block long")
    alike(repair_query(df), repair_rows(rows))
    assert repair_query(df.limit(0)) == []


def test_repair_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    alike([tuple(r) for r in QUERIES["op12_conversation_repair"](spark, SMALL).collect()], repair_rows([tuple(r) for r in df.collect()]))


def test_crossings_equal_one_pass():
    """The recursion finds the audit that one pass with whole audits finds."""
    r = random.Random(11)
    for _ in range(300):
        kinds = [r.randrange(16) for _ in range(r.randrange(1, 30))]
        rows = [(0, "sua?"[k % 4], "x") for k in kinds]
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        cost, audit, _ = cheapest(rows, [names[k // 4] for k in kinds])
        tables = [dialogue.row_table(k) for k in kinds]
        q, total = dialogue.last_state(dialogue.block_table(tables))
        states = dialogue.crossings(tables, 0, q)
        found = "".join(dialogue.row_edits(k)[a, b][1] for k, a, b in zip(kinds, states, states[1:])) + dialogue.tail(q)[1]
        assert (total, found) == (cost, audit)


# --- 13 Jaccard join

def jaccard_rows(rows, k=3, percent=90):
    sets, where = [], {}
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w)} if 0 < len(w) <= k else {b" ".join(x) for x in zip(*(w[j:] for j in range(k)))})
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where.get(x, ()):
                common[j] = common.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_rows():
    r = random.Random(7)
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  B"), (None, "a b"), (8, "a b c"),
            (8, "a b c"), (None, "solo one two three"), (None, "solo one two three")]
    n = 10
    for _ in range(60):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([9, 12, 20, 60, 150, 400, 900]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4]) * max(1, len(w) // 200)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            if r.random() < .2 and len(w) > 24:
                w = w[:-r.randrange(1, 1 + len(w) // 12)]
            rows.append((n, " ".join(w).upper() if r.random() < .3 else " ".join(w)))
            n += 1
    return rows + [(n, " ".join(f"z{i}" for i in range(30_000))), (n + 1, " ".join(f"z{i}" for i in range(29_000)))]


@pytest.mark.parametrize("docs,bits", [(1024, 8), (3, 1)])
def test_jaccard_awkward_rows(spark, monkeypatch, docs, bits):
    """Docs 3, bits 1: nearly every group is a large one, in tiles of two."""
    monkeypatch.setattr(jaccard, "GROUP_DOCS", docs)
    monkeypatch.setattr(jaccard, "TILE_BITS", bits)
    rows = near_rows()
    df = spark.createDataFrame([(*x, "n", 1, "t") for x in rows], "doc_id long, text string, n string, digest long, tokens string")
    alike([tuple(x) for x in jaccard.similar(df).collect()], jaccard_rows(rows))
    assert jaccard.similar(df.limit(0)).collect() == []


def test_jaccard_threshold(spark):
    """Exactly at and just below 90 %."""
    words = [f"v{i}" for i in range(212)]
    at = [(1, " ".join(words)), (2, " ".join(words[:191])), (3, " ".join(["y", *words[1:191], "q"]))]
    alike([tuple(x) for x in jaccard.similar(spark.createDataFrame(at, "doc_id long, text string")).collect()], jaccard_rows(at))


def test_signature_tree_prunes():
    """Unlike leaves are pruned as nodes, not compared."""
    import numpy as np
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**64, 40, np.uint64)) for _ in range(64)]
    for i in range(64):
        sets.append(np.unique(np.append(sets[i][:-1], r.integers(0, 2**64, 1, np.uint64))))
    seen = {}
    top = jaccard.traverse(sets, np.arange(128), None, 90, seen).labels()
    assert all(top[i] == top[i + 64] for i in range(64)) and len(set(top)) == 64
    assert seen["compared"] < 80 and seen["visited"] < 128 * 127 / 16
