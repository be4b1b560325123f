"""The registered queries of this folder: ``opN_<name>`` and ``pipeline``.

Each applies its operator with production parameters to whole tables and
derives the contract's digest columns from the operator's output.  ``SQL``
holds the DuckDB equivalent where SQL can express one; the others are tested
against brute force (``tests/llm``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f
    return add


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from basketry.llm.simhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                           shingle_words=3, max_bits=3).withColumnRenamed("id", "doc_id")


_OP5_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM h JOIN m USING (h) WHERE doc_id > lo),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
      CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query("op5_substring_dedup", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document, removed."""
    from basketry.llm.substring import remove_repeats
    out = remove_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), window=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b'))
             + length(replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b'), chr(10), '\n'))
             + length('<|start|>') + 1 + length('<|end|>') + 1 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op4_chat_formatting", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1 as a reply tree with one branch,
    formatted, then read back."""
    from basketry.llm import chat
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    out = chat.format_trees(chat.threads(rows.unionByName(extra)))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "lossy", chat.read_loss(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(told, 256).alias("turns_sha256"), F.length("lossy").cast("long").alias("loss_chars"),
                      F.sha2("lossy", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document."""
    from basketry.llm.packing import pack
    return packed_rows(pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))


def packed_rows(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op10_warc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    from basketry.llm import warc
    from basketry.session import scratch_path
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), path)
    found = warc.load_archives(spark, path, payloads=False).filter("kind <> 'gap'")
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                        F.col("kind").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


_ITEM_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
               r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
_OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM b)),
k AS (SELECT DISTINCT m FROM b),
dw AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN k ON len(w) >= m)),
h AS (SELECT doc_id, s, dw.m, item_id FROM dw JOIN bw USING (m, win)),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.l, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op9_benchmark_decontamination", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    from basketry.llm.winnow import contaminated
    out = contaminated(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                       read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, n-gram score and verdict of every document."""
    from basketry.llm import quality
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = quality.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))
    return quality.judged(docs, model).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


def _op6_sql() -> str:
    from basketry.llm import licenses as lic

    def re2(s: str) -> str:
        return s.replace("'", "''")

    def form(col: str) -> str:
        out = f"regexp_replace(lower(regexp_replace(coalesce({col}, ''), '{re2(lic.COPYRIGHT_LINE)}', '', 'g')), '{re2(lic.NOT_WORD)}', ' ', 'g')"
        for a, b in lic.SPELLINGS:
            out = f"regexp_replace({out}, '{re2(a)}', '{b.replace('$', chr(92))}', 'g')"
        return out

    def line(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    known = ", ".join("('{}', '{}')".format(k, re2(t)) for k, t in lic.KNOWN)
    return f"""
WITH known AS (SELECT f, array_to_string(list_sort(list(DISTINCT k)), '|') AS license
               FROM (SELECT k, {line(form('t'))} AS f FROM (VALUES {known}) v(k, t)) WHERE f <> '' GROUP BY f),
d AS (SELECT doc_id, {form('text')} AS form FROM documents),
u AS (SELECT doc_id, 'text' AS unit, {line('form')} AS f FROM d
      UNION ALL SELECT doc_id, 'paragraph', {line('p')} FROM (SELECT doc_id, unnest(regexp_split_to_array(form, '\\n *\\n[ \\n]*')) AS p FROM d)
      UNION ALL SELECT doc_id, 'line', trim(p) FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS p FROM d)),
h AS (SELECT doc_id, unit, license FROM u JOIN known USING (f)),
g AS (SELECT doc_id, max(license) FILTER (unit = 'text') AS text_license, count(*) FILTER (unit = 'line') AS n_lines,
             array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM h GROUP BY doc_id)
SELECT doc_id, text_license, coalesce(n_lines, 0)::BIGINT AS n_license_lines, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op6_license_scan", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts found whole in every document."""
    from basketry.llm.licenses import scan
    out = scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select(F.col("id").alias("doc_id"), "text_license",
                      F.size(F.filter("found", lambda x: x["unit"] == "line")).cast("long").alias("n_license_lines"),
                      F.array_join("licenses", ",").alias("licenses"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its verdict."""
    from basketry.llm.secrets import scan
    out = scan(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))
    return out.select(F.col("id").alias("doc_id"), "word_at", F.col("length").cast("long").alias("length"),
                      F.sha2("value", 256).alias("value_sha256"), "label", "probability", "is_secret")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    from basketry.llm.lm import score
    return score(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).withColumnRenamed("id", "doc_id")


from basketry.llm import queries_structure  # noqa: E402, F401  operators 11 to 13
