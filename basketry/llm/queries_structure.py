"""The registered queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.queries import query
from basketry.llm.text import ascii_lower
from basketry.sources.tables import read_table


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit; DuckDB has no function for it."""
    byte = ("list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: "
            "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# --- 11 Merkle manifest

def _tree_sql(name: str, levels: int) -> str:
    """Levels 0 to ``levels`` above a table ``{name}0``(g, r, h, n), and per
    level the siblings left and right of each node."""
    out = []
    for k in range(levels):
        at, run = f"{name}{k}", "PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN"
        out.append(f"""{at}s AS (SELECT g, r, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t FROM {at}),
{name}{k + 1} AS (SELECT g, r // 16 AS r, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h,
          (max(n) + 15) // 16 AS n FROM {at} GROUP BY g, r // 16)""")
    return ",\n".join(out)


def _fold_sql(source: str, name: str, levels: int, g: str, r: str) -> str:
    """``source`` with p (siblings so far) and f (digest so far) taken up."""
    for k in range(levels):
        source = (f"(SELECT x.* EXCLUDE (p, f), p || l || t AS p, CASE WHEN s.n = 1 THEN f ELSE sha256(l || f || t) END AS f "
                  f"FROM {source} x JOIN {name}{k}s s ON s.g = x.{g} AND s.r = x.{r} // {16 ** k})")
    return source


def _op11_sql(in_group: int = 5, over_groups: int = 3) -> str:
    """Unrolled to 16^5 leaves a source and 16^3 sources."""
    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    return f"""
WITH d AS (SELECT doc_id, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(_LOWER.format('text'))} END AS bad,
                  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, r, leaf AS h, n FROM e),
{_tree_sql('a', in_group)},
b0 AS (SELECT 0 AS g, g AS r, h, count(*) OVER () AS n FROM a{in_group}),
{_tree_sql('b', over_groups)},
folded AS (SELECT * FROM {_fold_sql(_fold_sql("(SELECT *, '' AS p, coalesce(bad, leaf) AS f, 0 AS z FROM e)", 'a', in_group, 'g', 'r'), 'b', over_groups, 'z', 'g')})
SELECT doc_id, leaf, b0.h AS subroot, (SELECT h FROM b{over_groups}) AS root, sha256(p) AS proof_sha256, f AS folded_root,
       f = (SELECT h FROM b{over_groups}) AS verified
FROM folded JOIN b0 ON b0.r = folded.g
"""


@query("op11_merkle_manifest", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its
    tampered or original leaf folds to."""
    from basketry.llm import merkle
    docs = read_table(spark, sf_dir, "documents", merkle.FIELDS)
    rows = merkle.manifest(docs, merkle.FIELDS, extra={"tampered": merkle.tampered_leaf(ascii_lower(F.col("text")))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
                       ).withColumn("verified", F.col("folded_root") == F.col("root"))


# --- 12 conversation repair

def _op12_sql() -> str:
    """Forward over the rows with whole audits and transcripts in the state."""
    add = lambda v, c, a, t: f"{{'c': {v}.c + {c}, 'a': {v}.a || '{a}', 't': {v}.t || {t}}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    gone = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    put = lambda v, role: add(v, 5, "I", f"['{role}:']")
    to_user = lambda cost, a, t: least(*(add(f"w{s}", cost, a, t) for s in (0, 1, 3)))
    end = least("v0", "v3", put("v2", "assistant"), *(add(f"v{s}", 10, "II", "['user:', 'assistant:']") for s in (0, 1, 3)))
    return f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
f AS (SELECT *, role[1] AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
             WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN '' ELSE 'truncated' END AS fault,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
           FROM f GROUP BY conv_id),
s AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS v0, {gone} AS v1, {gone} AS v2, {gone} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {add('w0', 2, 'D', '[]')} AS v0,
         {least(add('w1', 2, 'D', '[]'), "CASE WHEN free AND ini = 's' THEN " + add('w0', 'cut', 'K', '[line]') + f" ELSE {gone} END")} AS v1,
         {least(add('w2', 2, 'D', '[]'), "CASE WHEN free THEN " + to_user('1 + cut', 'R', "['user:' || text]") + f" ELSE {gone} END",
                "CASE WHEN free AND ini = 'u' THEN " + to_user('cut', 'K', '[line]') + f" ELSE {gone} END")} AS v2,
         {least(add('w3', 2, 'D', '[]'), "CASE WHEN free THEN " + add('w2', '1 + cut', 'R', "['assistant:' || text]") + f" ELSE {gone} END",
                "CASE WHEN free AND ini = 'a' THEN " + add('w2', 'cut', 'K', '[line]') + f" ELSE {gone} END")} AS v3
  FROM (SELECT conv_id, i, text, line, ini, free, cut, v0 AS w0, v1 AS w1, w2, {least('v3', put('w2', 'assistant'))} AS w3
        FROM (SELECT s.*  REPLACE (f.i AS i), f.text, f.role || ':' || f.text AS line, f.ini, f.fault IN ('', 'truncated') AS free,
                     CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut,
                     {least('v2', put('v0', 'user'), put('v1', 'user'), put('v3', 'user'))} AS w2
              FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))),
best AS (SELECT s.conv_id, {end} AS e FROM s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.last = s.i)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost,
       coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@query("op12_conversation_repair", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired turns of every conversation after
    planted damage."""
    from basketry.llm import dialogue
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return repaired(rows, *dialogue.repair(dialogue.damaged(rows)))


def repaired(rows: DataFrame, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``; zeros where nothing was left."""
    from basketry.llm import dialogue
    told = dialogue.transcripts(turns)
    out = (rows.select("conv_id").distinct().alias("x")
           .join(convs.alias("c"), F.expr("x.conv_id <=> c.conv_id"), "left")
           .join(told.alias("t"), F.expr("x.conv_id <=> t.conv_id"), "left"))
    count = lambda c: F.coalesce(f"c.{c}", F.lit(0).cast("long")).alias(c)
    return out.select("x.conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("t.audit", F.lit("")).alias("audit"),
                      F.sha2(F.coalesce("t.repaired", F.lit("")), 256).alias("repaired_sha256"))


# --- 13 Jaccard join

_OP13_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
                     FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c FROM t a JOIN t b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o WHERE 100 * c >= 90 * (nu + nv - c)),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT doc_id, v FROM r JOIN e ON e.u = r.reached)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m AS component_id FROM s JOIN (SELECT doc_id, min(reached) AS m FROM r GROUP BY doc_id) USING (doc_id)
"""


@query("op13_jaccard_join", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    from basketry.llm.jaccard import similar
    return similar(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                   shingle_words=3, percent=90).withColumnRenamed("id", "doc_id")
