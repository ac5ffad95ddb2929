"""Rounds of provider calls: every way a reply can fail, ledgers that go on, proofreading and extraction on the same path."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexweave.operators import rounds
from lexweave.operators.rounds import Ask, Reply
from lexweave.plans import stubs

TASK = "batch int, key string, text string, ord int"


def tasks(spark, n=16, each=3):
    return spark.createDataFrame([(b, f"{b}-{k}", "x" * (b + k + 1), k) for b in range(n) for k in range(each)], TASK)


def counting(folder, inner):
    """A provider that notes each request in a folder of files, as it runs in other processes."""
    def call(ask: Ask) -> Reply:
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(json.dumps([ask.name, ask.mode, ask.tries, ask.pieces]) + "\n")
        return inner(ask)

    return call


def noted(folder):
    return [tuple(json.loads(line)) for n in os.listdir(folder) for line in open(f"{folder}/{n}")]


def test_nothing_is_asked_twice_and_a_killed_job_goes_on(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/ledger"
    log.mkdir()
    provider, second = counting(str(log), stubs.faulty), counting(str(log), stubs.second)
    whole = {r.key: tuple(r) for r in rounds.run(tasks(spark), f"file://{tmp_path}/other", stubs.faulty, stubs.second).collect()}
    assert {r[2] for r in whole.values()} == {"ok", "single", "fallback", "moderated", "failed"} and len(whole) == 48

    def dying(ask: Ask) -> Reply:
        if ask.tries:
            raise RuntimeError("killed")
        return provider(ask)

    with pytest.raises(Exception, match="killed"):
        rounds.run(tasks(spark), folder, dying, second)
    done = rounds.read_ledger(spark, folder)
    assert 0 < done.count() and len(rounds._rounds(spark, folder)) == done.agg(F.max("round")).first()[0]
    before = len(noted(log))
    own = {r.key: tuple(r) for r in rounds.run(tasks(spark), folder, provider, second).collect()}
    assert own == whole and len(noted(log)) > before
    # only those of the round that was cut short may have been asked more than once
    asked = noted(log)
    final = rounds.read_ledger(spark, folder).select("ask", "mode", "tries", "pieces").collect()
    assert set(map(tuple, final)) == set(asked) and len(final) == len(set(asked))
    again = len(noted(log))
    more = tasks(spark, 17)
    assert rounds.run(more, folder, provider, second).count() == 51
    assert {a[0].split("/")[0] for a in noted(log)[again:]} <= {"16"} or len(noted(log)) == again + 1


def test_edge_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    assert rounds.run(tasks(spark).limit(0), folder, stubs.faulty).count() == 0
    rows = [(0, "a", "one", 0), (0, "b", None, 1), (0, "c", "  ", 2), (None, "d", "x", 0), (0, None, "x", 3), (4, "e", "even", 0)]
    found = {r.key: r for r in rounds.run(spark.createDataFrame(rows, TASK), folder, stubs.faulty).collect()}
    assert set(found) == {"a", "e"} and (found["a"].answer, found["a"].status, found["a"].asked) == ("T:one", "single", 1)
    assert (found["e"].status, found["e"].asked) == ("moderated", 1)  # no second provider


@pytest.mark.parametrize(("content", "want"), [
    ('{"translations": [{"idx": 1, "zh": "b"}, {"idx": 1, "zh": "later"}, {"idx": 9, "zh": "x"}, {"idx": "0", "zh": " "}]}', [(1, "later")]),
    ('["a", "b", "c"]', [(0, "a"), (1, "b")]), ("no json", []), ('{"items": [{"idx": 0, "zh": "said "so""}, {"idx": 1', [(0, 'said "so"')]),
])
def test_what_a_batch_reply_holds(content, want):
    assert rounds.found_in("batch", content, [0, 1], lambda s: True) == want


def test_proofreading(spark, tmp_path):
    rows = [(1, "a", 0, "原文一二三", "旧译文一", ["style"]), (1, "b", 1, "原文四五六", "旧译文二", ["turn"]), (1, "c", 2, "原文七八九", "旧译文三", []), (2, "d", 0, "原文十", "旧译文四", ["sense"]), (2, "e", 1, "原文", None, ["sense"]), (6, "f", 0, "原文", "旧译文五", ["style"])]

    def provider(ask: Ask) -> Reply:
        if ask.name.startswith("6"):
            return Reply(500)
        said = {"旧译文一": "新译文一（说明：改了）", "旧译文二": "旧译文二", "旧译文四": "哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈"}
        values = [said[json.loads(t)["draft"]] for t in ask.texts]
        return Reply(200, json.dumps(values, ensure_ascii=False) if ask.mode == "batch" else values[0])

    found = spark.createDataFrame(rows, "batch int, key string, ord int, text string, answer string, issues array<string>")
    own = {r.key: (r.proofread, r.revised) for r in rounds.proofread(found, f"file://{tmp_path}/ledger", provider).collect()}
    assert own == {"a": ("accepted", "新译文一"), "b": ("unchanged", "旧译文二"), "c": ("none", "旧译文三"), "d": ("rejected", "旧译文四"), "e": ("none", None), "f": ("none", "旧译文五")}


def test_extraction(spark, tmp_path):
    def provider(ask: Ask) -> Reply:
        if not ask.tries:
            return Reply(200, "I will think about it")
        terms = [{"src": t, "dst": f"译{t}", "category": "角色"} for t in json.loads(ask.texts[0])]
        return Reply(200, "Here:\n```json\n" + json.dumps({"terms": [*terms, "odd", {"src": ""}]}, ensure_ascii=False) + "\n```")

    texts = spark.createDataFrame([("ja", 1, "ローラ"), ("ja", 2, "はるか"), ("ja", 3, "ローラ"), ("ja", 4, "魔王城"), ("ja", 5, None)], "lane string, ord int, text string")
    existing = spark.createDataFrame([("Person", 7, "はるか", "遥香", [])], "category string, ord int, original string, translation string, aliases array<string>")
    own = {r.original: (r.translation, r.outcome) for r in rounds.extract_glossary(texts, existing, f"file://{tmp_path}/ledger", provider, "lane", "ord", "text", items=2).collect()}
    assert own == {"はるか": ("遥香", "kept"), "ローラ": ("译ローラ", "added"), "魔王城": ("译魔王城", "added")}
    ledger = rounds.read_ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.count() == 4 and {r.ask for r in ledger.collect()} == {"ja/000000", "ja/000001"}
