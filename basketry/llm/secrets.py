"""Secret scan with a random forest that removes false positives; DataFrame
and Spark ML functions only.

Candidates are keys of a published shape (``KEY``), PEM private key blocks,
``user:password@`` in URLs, values of 6 or more characters assigned to a
credential's name, and all other runs of 12 or more key-like characters with
a digit.  Each is described by its length, its character transitions, how
much of it corpus words cover (dictionary coverage), the path it was found
under and the words around it.  A random forest trained on labelled findings
decides which candidates are secrets; published shapes and short assigned
values that the rules are sure of are secrets whatever the forest says.

Labels come with the findings (a ``label`` column) or from ``rule_labels``,
which marks clear cases only.  Fitting uses a bounded sample of labelled
findings (``TRAIN_ROWS`` of each class, by hash); candidates, dictionary
counts and verdicts cover all documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.text import split_words, whole
from basketry.llm.winnow import item_words
from basketry.session import stage

# What a candidate looks like, and the names secrets go by.
CANDIDATE = r"[A-Za-z0-9_+/.@-]{12,}={0,2}"
KEY = ("(?<![A-Za-z0-9])(?:" + "|".join((
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"xapp-[A-Za-z0-9-]{20,}", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}", r"whsec_[A-Za-z0-9+/]{24,}",
    r"AIza[A-Za-z0-9_-]{35}", r"ya29\.[A-Za-z0-9_-]{20,}", r"GOCSPX-[A-Za-z0-9_-]{28}", r"sk-(?:ant|proj|svcacct|or-v1)-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{32,}", r"npm_[A-Za-z0-9]{36}", r"pypi-[A-Za-z0-9_-]{50,}", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
    r"hf_[A-Za-z0-9]{30,}", r"do[opr]_v1_[0-9a-f]{64}", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", r"sq0[a-z]{3}-[A-Za-z0-9_-]{22,}",
    r"hv[sbr]\.[A-Za-z0-9_-]{24,}", r"dapi[0-9a-f]{32}", r"key-[0-9a-f]{32}", r"SK[0-9a-f]{32}", r"AGE-SECRET-KEY-1[0-9A-Z]{58}",
    r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")) + ")(?![A-Za-z0-9])")
PEM = (r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
       r"(?:[\s\S]{0,20000}?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr]){1,8}[A-Za-z0-9+/]{16,}={0,2}){0,400})")
URL = r"""(?<=://)[^\s:/?#@"'<>]{0,64}:[^\s/@"'<>]{1,128}@(?=[A-Za-z0-9\[])"""
_NAME = (r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api_?-?key|access_?-?key|private_?-?key|secret_?-?key|credential)s?"
         r"""["'`\])]{0,3}""")
_TO = r"(?::=|[=:]{1,2}>?)"
_VALUE = r"""["'`(]{0,2}((?:[^\s"'`,;<>(){}&]|&(?![A-Za-z_]+=)){6,64})"""
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api_?key|access_?key|private_?key|auth|credential|bearer)"
PLACEHOLDER = r"(?i)(example|sample|dummy|change_?me|placeholder|your_|xxxx|1234567890|\$\{|^\$[a-z_]+$|^user(name)?:pass(word|wd)?@$)"
MAIL = r"^[^@\s:/]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}$"
_PART = r"(?:[a-z]+[0-9]{0,4}|[A-Z][a-z]+[0-9]{0,4}|[A-Z]+|[0-9]{1,4})"
_PARTS = rf"{_PART}(?:[._-]{_PART}){{0,12}}"
FILE_PATH = rf"^[.~]{{0,2}}/?{_PARTS}(?:/{_PARTS}){{1,40}}/?$"
IDENTIFIER = r"^(?:[A-Za-z_]\w{0,30}(?:\.[A-Za-z_]\w{0,30}){1,8}|v?[0-9]+(?:\.[0-9A-Za-z-]+){1,6})$"  # a name in code, a version
WORDS_COVER = 0.7    # share of a value that corpus words cover from which it is plain words
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
TRAIN_ROWS = 5_000   # labelled findings of each class, at most
DICTIONARY_MIN = 5   # occurrences that make a run of letters a word
MASK = "[SECRET]"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
_SIDE = len(_ALPHABET) + 1
_NEAR = 512
FEATURES = ["length", "digits", "upper", "changes", "transitions", "coverage", "path_test", "path_depth",
            "path_odds", "assigned", "credential", "quoted", "near_odds"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All candidates: id, text_hash, word_at, value, kind (key, pem, url,
    assigned or null), lead (what stands before it in its word), before2,
    before1, after1, path.  A PEM block is one value, and so is each
    candidate inside it."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = whole(F.col(text_col))
    none = F.array().cast("array<string>")
    blocks = lambda f: F.when(text.contains("PRIVATE KEY"), f).otherwise(none)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), path.alias("path"), text.alias("text"),
                       split_words(text).alias("w"), blocks(F.regexp_extract_all(text, F.lit(PEM), 0)).alias("pem"),
                       blocks(F.split(text, PEM, -1)).alias("between"))
    near = lambda i: F.when(i >= 0, F.coalesce(F.get("w", i), F.lit(""))).otherwise("")
    # assigned to a credential's name that ends before the word
    named = lambda i: F.substring(near(i - 1), -1, 1).isin("=", ":", ">") & F.concat_ws(" ", near(i - 2), near(i - 1)).rlike(f"{_NAME} ?{_TO}$")

    def looked_at(w: Column, i: Column) -> Column:
        run = (F.length(w) >= 12) & w.rlike(CANDIDATE) & (w.rlike("[0-9]") | w.rlike(KEY))
        inside = (w.contains("=") | w.contains(":")) & (w.rlike(_NAME + _TO + _VALUE) | (w.contains("://") & w.rlike(URL)))
        return run | ((F.length(w) >= 6) & (inside | named(i)))

    # no filter on the size of "at": pushed below, it would split the text anew for each word's neighbours; explode drops empty arrays
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda w, i: F.when(looked_at(w, i), i)), lambda i: i.isNotNull()))
    chars = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda t, x: t + F.length(x))
    # the number of the word a block starts in: the words up to its first character
    starts = F.transform("pem", lambda b, k: F.size(split_words(F.substring(
        F.col("text"), F.lit(1), chars("between", k + 1) + chars("pem", k) + 1))) - 1)

    def place(i: Column, word: Column, is_named: Column, is_block: Column, in_block: Column) -> Column:
        return F.struct(i.cast("int").alias("word_at"), word.alias("word"), near(i - 2).alias("before2"), near(i - 1).alias("before1"),
                        near(i + 1).alias("after1"), is_named.alias("named"), is_block.alias("block"), in_block.alias("in_block"))

    no = F.lit(False)
    words = F.transform("at", lambda i: place(i, F.get("w", i), named(i), no, F.exists("pem", lambda b: F.contains(b, F.get("w", i)))))
    whole_blocks = F.transform(F.arrays_zip(F.col("pem").alias("b"), starts.alias("s")), lambda x: place(x["s"], x["b"], no, F.lit(True), F.lit(True)))
    hits = rows.select("id", "text_hash", "path", F.explode(F.concat(words, whole_blocks)).alias("x")).select("id", "text_hash", "path", "x.*")
    # what has a shape of its own is taken out of the word first
    hits = (hits.withColumn("urls", F.regexp_extract_all("word", F.lit(URL), 0)).withColumn("rest", F.regexp_replace("word", URL, " "))
            .withColumn("keys", F.regexp_extract_all("rest", F.lit(KEY), 0)).withColumn("rest", F.regexp_replace("rest", KEY, " "))
            .withColumn("given", F.regexp_extract("rest", _NAME + _TO + _VALUE, 1)))
    given = F.when(F.col("given") != "", F.col("given")).when(F.col("named"), F.regexp_extract("rest", "^" + _VALUE, 1)).otherwise("")
    hits = hits.withColumn("given", F.regexp_replace(given, r"[.:]+$", "")).withColumn("given", F.when(F.length("given") >= 6, F.col("given")))
    runs = F.regexp_extract_all(F.when(F.col("given").isNull(), F.col("rest")).otherwise(F.replace("rest", F.col("given"), F.lit(" "))), F.lit(CANDIDATE), 0)
    runs = F.filter(F.transform(runs, lambda v: F.regexp_replace(v, r"\.+$", "")), lambda v: (F.length(v) >= 12) & v.rlike("[0-9]"))
    of = lambda kind, c: F.transform(c, lambda v: F.struct(v.alias("value"), kind.cast("string").alias("kind")))
    in_pem = F.when(F.col("in_block"), "pem")
    each = F.when(F.col("block"), of(F.lit("pem"), F.array("word"))).otherwise(F.concat(
        of(F.lit("url"), F.col("urls")), of(F.lit("key"), F.col("keys")),
        of(F.coalesce(in_pem, F.lit("assigned")), F.array_compact(F.array("given"))), of(in_pem, runs)))
    return (hits.withColumn("y", F.explode(each)).select("id", "text_hash", "path", "word_at", "word", "before2", "before1", "after1", "y.*")
            .withColumn("lead", F.expr("substring_index(word, value, 1)")).drop("word"))


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds ``label`` to ``described`` findings: 1 for published shapes, for
    mixed values assigned to a credential's name and for quoted passwords; 0
    for mail addresses, dotted or plain numbers, placeholders, file paths and
    plain words; else null, so also for random-looking values that nothing
    names."""
    v, n = F.col("value"), F.length("value")
    kind = lambda *names: F.coalesce(F.col("kind").isin(*names), F.lit(False))
    given = kind("assigned")
    path = (n <= 512) & v.contains("/") & v.rlike(FILE_PATH)
    plain = (v.rlike(MAIL) | v.rlike(PLACEHOLDER) | path
             | (~given & (v.rlike(r"^[0-9.+/_-]+$") | (F.col("coverage") >= WORDS_COVER))))
    code = v.contains("://") | ((n <= 512) & v.rlike(IDENTIFIER))
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~code
    marks = v.rlike(r"[!@#$%^*?~|&+]") & v.rlike("[A-Za-z]") & (n >= 8) & ~code
    quoted = F.col("lead").rlike("[\"'`]$") & F.concat_ws(" ", "before2", "before1", "lead").rlike(r"(?i)passw|passphrase|pwd") & ~code
    label = (F.when(kind("pem"), 1).when(kind("key", "url"), F.when(v.rlike(PLACEHOLDER), 0).otherwise(1)).when(plain, 0)
             .when(given & (mixed | marks | quoted), 1).when(mixed & (n >= 20) & ~v.contains("@") & _assigned() & _credential(), 1))
    return found.withColumn("label", label.cast("int"))


def _sure() -> Column:
    """Labelled 1 by a published shape, or as an assigned value too short for
    the forest to tell from others."""
    return F.coalesce((F.col("label") == 1) & (F.col("kind").isin("key", "pem", "url") | ((F.col("kind") == "assigned") & (F.length("value") < 20))),
                      F.lit(False))


def _assigned() -> Column:
    return F.col("lead").rlike("[=:]") | ((F.col("lead").rlike("^[\"'`(]*$")) & F.col("before1").rlike("[=:]$"))


def _credential() -> Column:
    return F.col("lead").rlike(CREDENTIAL) | F.col("before1").rlike(CREDENTIAL) | F.col("before2").rlike(CREDENTIAL)


def _runs(value: Column) -> Column:
    """Lower-case runs of three letters or more."""
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), 0)


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text", least: int = DICTIONARY_MIN) -> DataFrame:
    """(run): the letter runs of candidates that are words of the corpus,
    occurring ``least`` times or more outside them.  The count covers every
    word of three or more characters, whatever the candidates are, and is
    summed before the shuffle, so its work is linear in the text."""
    runs = found.select(F.explode(_runs(F.col("value"))).alias("run")).distinct()
    words = F.filter(item_words(F.col(text_col)), lambda w: F.length(w) >= 3)
    seen = docs.select(F.explode(words).alias("run")).groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return seen.join(runs, "run", "left_semi").select("run")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the features that need no labels."""
    v = F.col("value")
    n = F.length(v)
    key = ["value"]
    # per distinct value: copies of a value are looked up once
    runs = found.select("value").distinct().select("value", F.explode(_runs(v)).alias("run"))
    covered = runs.join(words, "run").groupBy(*key).agg(F.sum(F.length("run")).alias("covered"))
    found = found.join(covered, key, "left")
    return (found.withColumn("length", n.cast("double"))
            .withColumn("digits", F.length(F.regexp_replace(v, "[^0-9]", "")) / n)
            .withColumn("upper", F.length(F.regexp_replace(v, "[^A-Z]", "")) / n)
            .withColumn("changes", F.size(F.regexp_extract_all(v, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), 0)) / n)
            .withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / n)
            .withColumn("path_test", F.col("path").rlike(TEST_PATH).cast("double"))
            .withColumn("path_depth", F.length(F.regexp_replace("path", "[^/]", "")).cast("double"))
            .withColumn("assigned", _assigned().cast("double")).withColumn("credential", _credential().cast("double"))
            .withColumn("quoted", F.col("lead").rlike("[\"'`]$").cast("double")).drop("covered"))


def _steps(value: Column) -> Column:
    """Numbers of the value's character transitions."""
    code = lambda c: F.instr(F.lit(_ALPHABET), c)
    chars = F.split(F.lower(value), "")
    return F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))),
                       lambda c, i: code(c) * _SIDE + F.instr(F.lit(_ALPHABET), F.get(chars, i + 1)))


def _around() -> Column:
    """Numbers of the words around a candidate."""
    place = lambda tag, c: F.pmod(F.xxhash64(F.lit(tag), F.lower(c)), F.lit(_NEAR)).cast("int")
    return F.array(place("b2", F.col("before2")), place("b1", F.concat("before1", "lead")), place("a1", F.col("after1")))


def _odds(sample: DataFrame, numbers: Column, size: int) -> list[float]:
    """Log odds of class 1 by number; at most ``size`` rows reach the driver."""
    rows = (sample.select("label", F.explode(numbers).alias("k")).groupBy("k")
            .agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect())
    pos, neg = sum(r["p"] for r in rows), sum(r["n"] - r["p"] for r in rows)
    out = [0.0] * size
    for r in rows:
        out[r["k"]] = round(math.log((r["p"] + 0.5) / (pos + 0.5 * size)) - math.log((r["n"] - r["p"] + 0.5) / (neg + 0.5 * size)), 5)
    return out


def _mean(numbers: Column, table: list[float]) -> Column:
    lit = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return F.aggregate(numbers, F.lit(0.0), lambda acc, k: acc + F.get(lit, k)) / F.greatest(F.size(numbers), F.lit(1))


def train_sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` findings of each class, by hash; equal findings count
    once, so groups of copies do not fill the sample."""
    key = ["value", "lead", "before2", "before1", "after1", "path"]
    rest = [c for c in labelled.columns if c not in key and c != "label"]
    one = (labelled.filter("label IS NOT NULL").groupBy(*key, "label").agg(F.min(F.struct(*rest)).alias("rest"))
           .select(*labelled.drop(*rest).columns, "rest.*").select(*labelled.columns))
    order = [F.xxhash64(*key), *key]
    return stage(one.filter("label = 1").orderBy(*order).limit(rows)
                 .unionByName(one.filter("label = 0").orderBy(*order).limit(rows)).coalesce(1), "labelled")


_CONTEXT = ["lead", "before2", "before1", "after1", "path", "path_test", "path_depth", "assigned", "credential", "quoted"]


def _bare(sample: DataFrame) -> DataFrame:
    """The sample, and each value of class 1 once more with the context of a
    row of class 0: label 1 is partly given by the context, and the forest
    must not learn that a value without it is no secret."""
    nth = F.row_number().over(Window.orderBy(F.xxhash64("value", "id", "word_at"), "value", "id", "word_at"))
    pos = sample.filter("label = 1").withColumn("nth", nth).drop(*_CONTEXT)
    neg = sample.filter("label = 0").withColumn("nth", nth).select("nth", *_CONTEXT)
    return stage(sample.unionByName(pos.join(neg, "nth").select(*sample.columns)).coalesce(1), "contexts")


def fit(sample: DataFrame, trees: int = 40, depth: int = 6, seed: int = 42) -> dict:
    """Forest and odds tables from ``described`` findings with a label.
    Without both classes there is no forest: the labels then decide."""
    if sample.select("label").distinct().count() < 2:
        return {"forest": None}
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    sample = _bare(sample)
    model = {"transitions": _odds(sample, _steps(F.col("value")), _SIDE * _SIDE), "near": _odds(sample, _around(), _NEAR)}
    paths = sample.groupBy("path").agg(F.avg("label").alias("p"), F.count("*").alias("n"))
    model["paths"] = stage(paths.select("path", ((F.col("p") * F.col("n") + 1) / (F.col("n") + 2)).alias("path_odds")), "paths")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_learned(sample, model))
    model["forest"] = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(
        rows.select("features", F.col("label").cast("double").alias("label")).coalesce(1))
    return model


def _learned(rows: DataFrame, model: dict) -> DataFrame:
    paths = F.broadcast(model["paths"])  # at most 2 x TRAIN_ROWS rows
    return (rows.join(paths, "path", "left").withColumn("path_odds", F.coalesce("path_odds", F.lit(0.5)))
            .withColumn("transitions", _mean(_steps(F.col("value")), model["transitions"]))
            .withColumn("near_odds", _mean(_around(), model["near"])))


def judge(rows: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Adds probability (1 where the rules are sure) and is_secret."""
    if model["forest"] is None:
        is_one = F.coalesce(F.col("label") == 1, F.lit(False))
        return rows.withColumn("probability", is_one.cast("double")).withColumn("is_secret", is_one)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_learned(rows, model))
    scored = model["forest"].transform(ready).withColumn(
        "probability", F.when(_sure(), 1.0).otherwise(vector_to_array("probability")[1]))
    return scored.withColumn("is_secret", F.col("probability") >= threshold).drop("features", "rawPrediction", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: id, text_hash, word_at, value, the context, the
    features, label (of ``rule_labels``), probability, is_secret.

    Null text: no candidates.  Null id and null path: kept, the path as
    empty.  Repeated rows: each row's candidates are listed.  Empty table: no
    rows; none of one class: label 1 is a secret.  Other columns are not read.
    """
    found = stage(findings(docs, id_col, text_col, path_col), "findings")
    words = stage(dictionary(docs, found, text_col), "dictionary")
    rows = stage(rule_labels(described(found, words)), "described")
    return judge(rows, fit(train_sample(rows)))


LONG = 12  # characters from which a value is masked wherever it stands alone


def _literal(c: Column) -> Column:
    """The column as a regular expression for itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _value() -> Column:
    """A pattern for the value; a letter or digit at its end ends it."""
    return F.concat(_literal(F.col("value")), F.when(F.col("value").rlike("[A-Za-z0-9]$"), "(?![A-Za-z0-9])").otherwise(""))


def _place() -> Column:
    """A pattern for a finding's value at its place: after the word before it
    and what leads it; group 1 is all up to the value."""
    space = r"[\x20\x09-\x0D]"
    before = F.when(F.col("before1") == "", F.lit(rf"^{space}*")).otherwise(F.concat(F.lit(rf"(?:^|{space})"), _literal(F.col("before1")), F.lit(f"{space}+")))
    return F.concat(F.lit("("), before, _literal(F.col("lead")), F.lit(")"), _value())


def _alone() -> Column:
    """A pattern for a value between token bounds."""
    return F.concat(F.lit("()"), F.when(F.col("value").rlike("^[A-Za-z0-9]"), "(?<![A-Za-z0-9])").otherwise(""), _value())


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
                 chars_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mask``; all rows,
    columns and names stay.  A secret is masked where it was found; one of
    ``LONG`` or more characters also wherever else it stands between token
    bounds.  ``chars_col`` is recounted where the text changed."""
    found = scan(docs, id_col, text_col, path_col).filter("is_secret")
    is_long = (F.length("value") >= LONG) | F.coalesce(F.col("kind") == "pem", F.lit(False))
    patterns = F.array_compact(F.array(_place(), F.when(is_long, _alone())))
    lists = (found.select("id", "text_hash", F.length("value").alias("n"), F.explode(patterns).alias("v"))
             .groupBy("id", "text_hash").agg(F.collect_set(F.struct("n", "v")).alias("values"))
             # longest first: a secret may contain another
             .select("id", "text_hash", F.reverse(F.array_sort("values")).alias("values")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"))
    joined = rows.alias("a").join(lists.alias("b"), F.expr("a.id <=> b.id AND a.text_hash = b.text_hash"), "left")
    put = F.lit("$1" + mask.replace("\\", "\\\\").replace("$", "\\$"))
    clean = F.when(F.col("values").isNull(), F.col("text")).otherwise(
        F.aggregate("values", F.col("text"), lambda t, s: F.regexp_replace(t, s["v"], put)))
    out = joined.select("row", "values", clean.alias("clean"))
    kinds = dict(docs.dtypes)

    def column(c: str) -> Column:
        old = F.col("row")[c]
        if c == text_col:
            return F.col("clean").alias(c)
        if c == chars_col:
            return F.when(F.col("values").isNull(), old).otherwise(F.length("clean").cast(kinds[c])).alias(c)
        return old.alias(c)

    return out.select(*(column(c) for c in docs.columns))
