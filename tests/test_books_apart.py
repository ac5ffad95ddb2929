"""What is found in one book changes that book only."""

from lexweave.operators import consistency

PAIR, TERM = "book int, seq int, source string, target string", "category string, ord int, original string, translation string, policy string"


def books(spark):
    first = [(1, k, "ローラが来た", t) for k, t in enumerate(("劳拉来了", "劳拉说", "罗拉，来了"))]
    # the second book knows only its own word, the third only the wanted one, and one that is no variant of its own
    second = [(2, k, "ローラが来た", "罗拉，来了") for k in range(3)]
    third = [(3, 0, "ローラが来た", "劳拉和罗拉"), (3, 1, "別の人", "罗拉，来了")]
    return spark.createDataFrame([*first, *second, *third], PAIR), spark.createDataFrame([("Person", 0, "ローラ", "劳拉", "")], TERM)


def test_a_divergence_in_one_book_leaves_the_others_alone(spark):
    pairs, terms = books(spark)
    found = {(r.book, r.verdict) for r in consistency.issues(pairs, terms).collect()}
    assert found == {(1, "divergent"), (2, "missing")}
    own = {(r.book, r.seq): (r.target, r.replaced) for r in consistency.unified_before_save(pairs, terms).collect()}
    assert own[1, 2] == ("劳拉，来了", 1)
    assert all(own[b, s] == (t, 0) for b, s, _, t in map(tuple, pairs.collect()) if (b, s) != (1, 2))
    plan = consistency.plan_terms(consistency.checked(pairs, terms)).collect()
    assert [(r.book, r.terms[0].translation, r.terms[0].aliases) for r in plan] == [(1, "劳拉", ["罗拉"])]


def test_a_winner_counts_in_its_own_book(spark):
    pairs, terms = books(spark)
    variants = spark.createDataFrame([("ローラ", "劳拉", "罗拉")], "original string, winner string, variant string")
    own = {(r.book, r.seq): r.replaced for r in consistency.unified(pairs, variants, terms).collect() if r.replaced}
    assert own == {(1, 2): 1}  # the third book holds the winner once only, the second never


def test_verdicts_and_ranks(spark):
    pairs, terms = books(spark)
    counts = consistency.verdict_counts(consistency.issues(pairs, terms)).first()
    assert tuple(counts) == (1, 0, 1)
    ranks = {(r.book, r.rendering): r["rank"] for r in consistency.ranked(consistency.renderings(pairs, terms)).collect()}
    assert ranks == {(1, "劳拉"): 1, (1, "罗拉"): 2, (2, "罗拉"): 1, (3, "劳拉"): 1}
