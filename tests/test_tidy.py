"""A glossary made tidy, and groups of linked nodes."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.operators import graph, tidy

RAW = "original string, value string, info string, n long"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=4, max_size=8), st.sampled_from(["s", "t"])), min_size=1, max_size=60, unique_by=lambda x: x[0]))
def test_variants_are_linked_as_by_comparing_all(spark, terms):
    links = {frozenset(r) for r in tidy.variant_links(spark.createDataFrame(terms, "original string, translation string")).collect()}

    def closed(pairs):
        root = {t: t for t, _ in terms}
        for _ in terms:
            for a, b in map(tuple, pairs):
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = {frozenset((a, b)) for a, s in terms for b, t in terms if a < b and s == t and min(len(a), len(b)) >= 5 and one_apart(a, b)}
    assert closed(links) == closed(want) and links <= {frozenset((a, b)) for a, s in terms for b, t in terms if a != b and s == t}


def test_known_variants(spark):
    rows = [
        ("スペース・ドウェルグ", "太空矮人", "", 3), ("スペースドウェルグ", "太空矮人", "", 5), ("スペース・ドヴェルグ", "太空矮人", "", 1), ("すてらおんらいん", "星海在线", "", 0), ("ステラオンライン", "星海在线", "", 0), ("メインジェネレータ", "主发电机", "", 1),
        ("メインジェネレーター", "主发电机", "", 1), ("ジェ○イ", "绝地", "", 0), ("ジェ◯イ", "绝地", "", 1), ("エルマ", "艾尔玛 #女性 #船员", "", 9), ("エルマさん", "艾尔玛小姐", "", 2), ("ミミちゃん", "咪咪", "", 1), ("「", "「", "", 0), ("十二章", "十二章", "", 0),
        ("まちがい", "错误", "错字", 4), ("シスコン", "妹控", "", 1), ("マイコ", "妹控", "", 7), ("グラッカン帝国", "格拉坎帝国", "", 1), ("  ", "x", "", 1), (None, "x", "", 1), ("空手家", None, None, None), ("エルマ", "别的", "", 1), ("戦艦", "战舰", "舰; 大", 1),
    ]
    kept, gone = tidy.tidied(spark.createDataFrame(rows, RAW), spark.createDataFrame([("マイコ", "シスコン"), ("nowhere", "シスコン")], "variant string, canonical string"), spark.createDataFrame([("グラッカン帝国",)], "original string"))
    own = {r.original: r for r in kept.collect()}
    out = {r.original: (r.reason, r.into) for r in gone.collect()}
    assert own["スペースドウェルグ"].aliases == ["スペース・ドウェルグ", "スペース・ドヴェルグ"] and own["スペースドウェルグ"].n == 9
    assert out["ステラオンライン"] == ("variant", "すてらおんらいん")  # of equal counts and lengths the first
    assert own["メインジェネレーター"].aliases == ["メインジェネレータ"] and own["ジェ◯イ"].aliases == ["ジェ○イ"]
    assert own["シスコン"].aliases == ["マイコ"] and out["マイコ"] == ("variant", "シスコン")  # named, though less frequent
    assert out["エルマさん"] == ("address", "エルマ") and "ミミちゃん" in own  # no ミミ of its own
    assert {out[k][0] for k in ("「", "十二章")} == {"no_term"} and out["まちがい"][0] == "typo" and out["グラッカン帝国"][0] == "redundant"
    assert (own["エルマ"].category, own["エルマ"].info, own["エルマ"].n) == ("Person", "", 10) or own["エルマ"].translation == "别的"
    assert own["空手家"].category == "Skill" and own["空手家"].translation == "" and (own["戦艦"].category, own["戦艦"].info) == ("Item", "大")
    assert not set(own) & set(out) and len(own) + len(out) == 20
    nothing = tidy.tidied(spark.createDataFrame([], RAW))
    assert nothing[0].count() == nothing[1].count() == 0


def test_groups_of_chains_stars_and_rings(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1400)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(3000, 3000), (None, 1), (5, None)]
    r.shuffle(links)
    found = {x.node: x.root for x in graph.groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(201)} == {0} and {found[k] for k in range(1000, 1400)} == {1000} and {found[2000 + k] for k in range(50)} == {2000} and found[3000] == 3000
    assert graph.groups(spark.createDataFrame([], "a long, b long")).count() == 0
