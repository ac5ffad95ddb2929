"""The cache table: merges, writers that meet, jobs that are killed, imports that count once; small files."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lexweave.operators import cache
from lexweave.sources import cache_table, files


@pytest.fixture
def store(spark, tmp_path):
    return cache_table.CacheTable(spark, f"file://{tmp_path}/cache", 8)


def entries(spark, rows, now=100):
    """Entries of rows (cache_type, cache_key, translated_text, payload)."""
    raw = [(*r[:3], json.dumps(r[3]) if r[3] is not None else None, k) for k, r in enumerate(rows)]
    return cache.entries(spark.createDataFrame(raw, "cache_type string, cache_key string, translated_text string, payload_json string, seq int"), now)


def texts(store, version=None):
    return {r.cache_key: r.translated_text for r in store.snapshot(version).collect()}


def test_entries_are_read_from_keys_and_payloads(spark):
    d = "0" * 63
    rows = [
        ("model", f"v2:p:m:x:g0123456789abcdef:{d}1", "t1", None), ("model", f"v3ctx:p:m:{d}2:{d}3", "t2", {"source": "not looked at"}), ("model", "plain key", "t3", None),
        ("text", "k1", "t4", {"source": "s", "verified": True, "updated_at": "7"}), ("manual", "k2", "t5", {"updated_at": "soon"}), ("manual", "k3", "t6", None), ("text", "k4", "", None), ("other", "k5", "x", None), ("text", "", "x", None),
    ]
    own = {r.translated_text: r for r in entries(spark, rows).collect()}
    assert set(own) == {f"t{k}" for k in range(1, 7)}
    assert (own["t1"].provider, own["t1"].model, own["t1"].glossary_fingerprint, own["t1"].source_hash) == ("p", "m:x", "0123456789abcdef", d + "1")
    assert (own["t2"].context_hash, own["t2"].source_hash, own["t2"].source_text) == (d + "2", d + "3", None)
    assert own["t3"].source_text == "plain key" and len(own["t3"].source_hash) == 64
    assert (own["t4"].source_text, own["t4"].trusted, own["t4"].verified, own["t4"].updated_at) == ("s", False, True, 7)
    assert (own["t5"].trusted, own["t5"].updated_at, own["t6"].trusted) == (True, 100, False)


def test_merge_get_touch_delete(spark, store):
    assert store.snapshot().count() == 0 and store.get(spark.createDataFrame([("text", "a")], "cache_type string, cache_key string")).first().value is None
    store.upsert(entries(spark, [("text", "a", "1", {"source": "A"}), ("text", "a", "2", {}), ("text", "b", "3", {"translation": "3", "n": 1})]))
    one = store.manifest()["version"]
    store.upsert(entries(spark, [("text", "a", "4", None), ("manual", "a", "5", None)], now=200))
    own = {(r.cache_type, r.cache_key): r for r in store.snapshot().collect()}
    assert (own["text", "a"].translated_text, own["text", "a"].source_text, own["text", "a"].created_at, own["text", "a"].updated_at) == ("4", "A", 100, 200)
    assert texts(store, one) == {"a": "2", "b": "3"}  # an older version is still what it was
    asked = spark.createDataFrame([("text", "a"), ("text", "b"), ("text", "c"), (None, None)], "cache_type string, cache_key string")
    assert {(r.cache_key, r.value) for r in store.get(asked).collect()} == {("a", "4"), ("b", '{"translation": "3", "n": 1}'), ("c", None), (None, None)}
    store.touch(spark.createDataFrame([("text", "a", 5), ("text", "a", 9), ("text", "zz", 9)], "cache_type string, cache_key string, used_at long"))
    assert [(r.hit_count, r.last_used_at) for r in store.snapshot().where("cache_type = 'text' and cache_key = 'a'").collect()] == [(2, 9)]
    before = store.manifest()["version"]
    assert store.delete(asked.limit(0)) == before
    store.delete(asked)
    assert [(r.cache_type, r.cache_key) for r in store.snapshot().collect()] == [("manual", "a")]
    store.expire(1)
    assert store.versions() == [before + 1] and store.snapshot().count() == 1


def test_writers_that_meet_lose_nothing(spark, store):
    store.upsert(entries(spark, [("text", f"k{k}", "old", None) for k in range(40)]))
    failed = []

    def write(n):
        try:
            cache_table.CacheTable(spark, store.folder, 8).upsert(entries(spark, [("text", f"k{k}", f"w{n}", None) for k in range(n, 40, 3)] + [("text", "all", f"w{n}", None)]))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = texts(store)
    assert not failed and store.manifest()["version"] == 4 and found.pop("all") in {"w0", "w1", "w2"}
    assert found == {f"k{k}": f"w{k % 3}" for k in range(40)}


def test_others_buckets_are_taken_over_without_a_second_merge(spark, store, monkeypatch):
    keys = [("text", f"k{k}", "old", None) for k in range(30)]
    store.upsert(entries(spark, keys))
    bucket = {r.cache_key: r.b for r in store.snapshot().select("cache_key", store._bucket(8).alias("b")).collect()}
    mine = next(k for k in bucket if bucket[k] == bucket["k0"])
    theirs = next(k for k in bucket if bucket[k] != bucket["k0"])
    write, reads = files.write_json, []
    monkeypatch.setattr(cache_table.CacheTable, "_read", lambda self, *a, f=cache_table.CacheTable._read: (reads.append(a), f(self, *a))[1])

    def late(spark, path, value, replace=True):
        monkeypatch.setattr(files, "write_json", write)
        cache_table.CacheTable(spark, store.folder, 8).upsert(entries(spark, [("text", theirs, "theirs", None)]))
        return write(spark, path, value, replace)

    monkeypatch.setattr(files, "write_json", late)
    store.upsert(entries(spark, [("text", mine, "mine", None)]))
    assert len(reads) == 2 and store.manifest()["version"] == 3
    assert texts(store) == {k[1]: "old" for k in keys} | {mine: "mine", theirs: "theirs"}


def test_a_killed_job_leaves_the_table_as_it_was(spark, store, monkeypatch):
    store.upsert(entries(spark, [("text", "a", "1", None)]))
    before = store.manifest()
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(files, "write_json", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
        store.upsert(entries(spark, [("text", "a", "2", None)]))
    assert store.manifest() == before and texts(store) == {"a": "1"}
    assert len(files.names(spark, f"{store.folder}/data")) == 2
    store.expire(10)
    assert len(files.names(spark, f"{store.folder}/data")) == 1 and texts(store) == {"a": "1"}
    store.upsert(entries(spark, [("text", "a", "2", None)]))
    assert texts(store) == {"a": "2"}


def test_imports_count_once(spark, store, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"a": "1", "b": {"translation": "2", "verified": True}, "c": "", "d": 5}), "utf-8")
    (folder / "two.json").write_text("{broken", "utf-8")
    (folder / "three.json").write_text("[]", "utf-8")
    (folder / "four.json").write_text("{}", "utf-8")
    report = {r.path.rsplit("/", 1)[1]: (r.imported, r.error is None) for r in store.migrate(f"file://{folder}", "text", 50).collect()}
    assert report == {"one.json": (2, True), "two.json": (0, False), "three.json": (0, False)}
    version = store.manifest()["version"]
    assert texts(store) == {"a": "1", "b": "2"} and store.loads().count() == 2
    again = store.migrate(f"file://{folder}", "text", 60).collect()
    assert {r.path.rsplit("/", 1)[1] for r in again} == {"two.json", "three.json"} and store.manifest()["version"] == version
    (folder / "one.json").write_text(json.dumps({"a": "now longer"}), "utf-8")
    store.migrate(f"file://{folder}/one.json", "text", 70)
    assert texts(store) == {"a": "now longer", "b": "2"} and store.loads().count() == 2
    store.migrate(f"file://{folder}/one.json", "manual", 70)  # of another type it is another import
    assert store.snapshot().where(F.col("cache_type") == "manual").count() == 1


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/sub/settings.json"
    assert files.load_json(spark, path, {"x": 1}) == {"x": 1}
    assert files.write_json(spark, path, {"é": [1, None]}) and files.load_json(spark, path) == {"é": [1, None]}
    assert not files.write_json(spark, path, {}, replace=False) and files.load_json(spark, path) == {"é": [1, None]}
    assert files.write_json(spark, path, {}) and files.load_json(spark, path, 5) == {}
    (tmp_path / "sub/.settings.json.crc").unlink()
    (tmp_path / "sub/settings.json").write_text("{half", "utf-8")
    assert files.load_json(spark, path, 5) == 5
    with pytest.raises(TypeError):
        files.write_json(spark, path, object())
    assert [n for n in files.names(spark, f"file://{tmp_path}/sub") if not n.endswith(".crc")] == ["settings.json"]


def test_lists_of_places_answer_themselves(spark):
    texts = spark.createDataFrame([(1, "熟田津 にぎたづ 愛媛"), (2, "熟田津 愛媛"), (3, "彼女は来た"), (4, " はい "), (5, None)], "id int, text string")
    rules = spark.createDataFrame([("はい", "是")], "phrase string, answer string")
    own = {r.id: r.answer for r in cache.ruled(texts, rules).collect()}
    assert own[1] and "に" not in own[1] and own[1].startswith("熟田津 ") and own[4] == "是" and own[2] is own[3] is own[5] is None
