import random

import duckdb

from tests.oracle_harness import canon

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid long, h string, id string, w string"


def table(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, "h", "i", "w") for i, t in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    long = prose(1, 30_000)
    return [(1, prose(2, 120)), (None, prose(3, 80)), (3, None), (4, ""), (5, prose(4, 60)), (5, prose(4, 60)),
            (6, long), (7, " \t\n "), (None, None), (8, "Zürich, été!\r\nno\x0bwhite")]


def same_as_sql(spark, build, sql, sf_dir=SMALL):
    df = build(spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())
