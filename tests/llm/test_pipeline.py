import re

import corpus_pipeline as pipe
from basketry.llm import packing
from basketry.llm.queries import QUERIES
from basketry.session import stage
from tests.llm.helpers import SMALL


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    held = {}
    for name, step in pipe.STAGES[:-1]:
        docs = stage(step(spark, docs, SMALL), name)
        assert docs.columns == names and docs.count() <= before
        before = docs.count()
        held[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(held[name]) == before
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op3_quality_rules"](spark, SMALL).collect()}
    assert set(held["quality_rules"]) == {i for i, k in verdict.items() if k}

    from tests.llm.test_operators import _simhash
    fps = {i: _simhash(t) for i, t in held["quality_rules"].items()}
    reps = set()
    left = set(fps)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            part.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3}
            left -= near
            todo += near
        reps.add(min(part))
    assert set(held["near_dedup"]) == reps

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode()) if w]
    wins = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        wins |= {tuple(w[s:s + 10]) for s in range(len(w) - 9)}
    clean = {i for i, t in held["near_dedup"].items() if not any(tuple(words(t)[s:s + 10]) in wins for s in range(len(words(t)) - 9))}
    assert set(held["decontaminate"]) == clean
    for i, t in held["secret_scan"].items():
        assert t == re.sub(r'(token = ")[0-9a-f]{40}', r"\1[SECRET]", held["decontaminate"][i], flags=re.I)

    out = pipe.STAGES[-1][1](spark, docs, SMALL).collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert set(total) == set(held["secret_scan"]) and sum(r["length"] for r in out) == sum(total.values())
    (ids,) = packing.encode([held["secret_scan"][min(total)]], packing.tokenizer_path())
    assert len(ids) // 4 + 1 == total[min(total)]
