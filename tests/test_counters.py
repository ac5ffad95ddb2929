"""Counters of runs and streams, parts that are written once, glossaries in canonical form."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from lexweave.operators import counters, glossary
from lexweave.streaming import flush


def test_counters_of_a_run(spark):
    told = []
    own = counters.Counters(lambda name, values: told.append(name))
    df = own.counted(spark.range(100), "all", even=F.col("id") % 2 == 0, total=F.col("id"))
    left = own.counted(df.where("id >= 90"), "left", none=F.lit(None))
    assert left.count() == 10
    assert own.values() == {"all": {"rows": 100, "even": 50, "total": 4950}, "left": {"rows": 10, "none": 0}} and told == ["all", "left"]
    with pytest.raises(ValueError, match="counted already"):
        own.counted(df, "all")


def test_counters_of_a_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    own = counters.StreamCounters()
    spark.streams.addListener(own)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
        seen = source.observe("seen", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))
        flush.flushed(seen, f"file://{tmp_path}/out", 4).awaitTermination()
        for _ in range(100):
            if own.totals.get("seen", {}).get("rows") == 30:
                break
            import time

            time.sleep(0.1)
        assert own.totals["seen"] == {"rows": 30, "total": 435}
    finally:
        spark.streams.removeListener(own)


def test_parts_are_written_once(spark, tmp_path, monkeypatch):
    arriving, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(10).coalesce(1).write.mode("append").parquet(arriving)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(arriving)
    flush.flushed(stream(), folder, 4).awaitTermination()
    assert len(list((tmp_path / "out/parts/batch=0").glob("*.parquet"))) == 3
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(arriving)

    # the job dies after it has written the part, and before the stream knows of it
    def dying(df, number):
        df.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
        raise RuntimeError("killed")

    q = stream().writeStream.foreachBatch(dying).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination()
    # and another one in the middle of a part
    (tmp_path / "out/parts/batch=1/_SUCCESS").unlink()
    assert sorted(r.id for r in flush.read(spark, folder, "id long").collect()) == list(range(10))
    flush.flushed(stream(), folder, 4).awaitTermination()
    flush.flushed(stream(), folder, 4).awaitTermination()
    got = flush.read(spark, folder, "id long").collect()
    assert sorted(r.id for r in got) == list(range(20)) and {r.batch for r in got} == {0, 1}
    assert flush.read(spark, f"{folder}/nothing", "id long").count() == 0


def test_canonical_glossaries_are_those_of_sorted_json(spark):
    odd = 'q"\\\n\t\b\x01\x1f/é日🙂'
    rows = [("a", "Person", 1, "ローラ", "劳拉", "force", None), ("a", "Person", 0, odd, odd, "", odd), ("a", "Item", 0, "剣", "剑", None, ""), ("b", "Skill", 0, "x", "y", "", "")]
    terms = spark.createDataFrame(rows, "profile string, category string, ord int, original string, translation string, policy string, info string").withColumn("aliases", F.array(F.lit("z")))
    for p in "ab":
        want = {c: [] for c in glossary.CATEGORIES}
        for _, category, _, *values in sorted((r for r in rows if r[0] == p), key=lambda r: r[2]):
            want[category].append({k: v for k, v in zip(("original", "translation", "policy", "info"), values, strict=True) if v})
        compact = json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert glossary.canonical(terms).where(F.col("profile") == p).first().canonical == compact
        assert glossary.fingerprint(terms.repartition(5)).where(F.col("profile") == p).first().fingerprint == hashlib.sha256(compact.encode()).hexdigest()
