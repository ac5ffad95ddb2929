"""Registered queries against their SQL on rows that the small tables lack."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexweave.operators import quality
from lexweave.plans import catalogue, more, tables  # noqa: F401
from tests.test_library import compared

TEXTS = {
    # q_allowlist, q_incomplete: letters that stood for kana
    1: "vvvvv vvvvv vvvvv vvvvv vvvvv tail", 4: "jv vjv vvvv vvvvvvvv vvvvvvvvv vvvvvv",
    # words with line ends and commas in the first places
    6: "Tom\n Bob\n a, rest", 9: "Tom\nx a\nb a, rest", 12: "Tom Bob\n a, rest", 15: "A.\n re\n Cat\nx rest", 18: "Tom ab a, rest", 21: "A. re Cat rest", 22: "Eve A.\n re\n rest", 24: "Tom cd ef rest",
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    own = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    at = datetime.datetime(2024, 1, 30, 10, 48, 53)
    events = spark.createDataFrame([(k, at + datetime.timedelta(microseconds=us), k % 2, "click", 1.0, "") for k, us in enumerate((999_499, 999_500, 1, 999_999))], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, df in (("documents", own), ("events", events)):
        df.coalesce(1).write.parquet(f"file://{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet/*.parquet'")
    return f"file://{folder}", con


@pytest.mark.parametrize("name", ["q_allowlist", "q_clean_terms", "q_glossary_normalize", "q_incomplete", "q_prompt_lines", "q_term_metadata", "q_usage"])
def test_odd_rows(spark, odd, name):
    folder, con = odd
    compared(con, catalogue.QUERIES[name](spark, folder), catalogue.ORACLE_SQL[name])


def test_blocks_hold_little_and_all():
    """Batches are cut by the length of their texts; a text longer than a block is one row of its own."""
    import pandas as pd
    import pyarrow as pa

    from lexweave import blocks

    texts = ["a" * 40, None, "b" * 70, "c" * 300, "", "d" * 10]
    cut = list(blocks.frames([pd.DataFrame({"k": range(6), "text": texts})], "text", 100))
    assert [p["k"].tolist() for p in cut] == [[0, 1], [2], [3, 4], [5]] or all(len(p) == 1 or p["text"].str.len().sum() <= 100 for p in cut)
    assert [k for p in cut for k in p["k"]] == list(range(6))
    both = list(blocks.batches([pa.RecordBatch.from_pydict({"k": list(range(6)), "text": texts})], "text", 100))
    assert [k for p in both for k in p.column("k").to_pylist()] == list(range(6)) and len(both) > 2


def test_rest_twice_is_two_passes_in_one_worker(spark):
    texts = [None, "", "abc", "没有假名", "[[ja:あいう]] い", "他说「ありがとう」", "あの『カナ』と書く", "ス·テ か", "[[ja:あ]]", "お x 这里有很多很多的中文字"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    found = df.select("i", quality.rest_twice(F.col("s")).alias("r")).select("i", "r.t", "r.tt")
    once = df.withColumn("t", quality.without_allowed(F.col("s")))
    expected = once.select("i", "t", quality.without_allowed(F.col("t")).alias("tt"))
    assert sorted(found.collect()) == sorted(expected.collect())
    # a task of q_recovery_run has one worker for each function in Python: the calls, the names, the rest
    df = catalogue.QUERIES["q_recovery_run"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 3
