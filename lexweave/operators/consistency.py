"""How consistently terms are rendered over ordered (source, target) pairs, and how renderings are unified.

Pairs are rows (book, seq, source, target), with an optional chapter; a glossary as in glossary.py. What is found in a book counts, and is
changed, in that book only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import strip, text
from lexweave.operators.glossary import category_rank, held_terms

# Opening quotes, punctuation that ends a rendering, what a rendering may hold; lengths; sightings of a missing term.
OPENING = "^[「『“‘\"'（(【\\[\\s]+"
ENDING = "(?s)[，。！？、；：,.!?;:\\s].*$"
RENDERING = "^[\\u4e00-\\u9fff\\u3040-\\u30ffA-Za-z0-9・·\\-]+$"
SHORTEST, LONGEST, SIGHTINGS = 2, 8, 3


def expected(translation: Column, original: Column, policy: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    """What a term should read: itself where it is preserved. `trimmed` takes off what surrounds a translation."""
    return F.when(text(policy) == "preserve", original).otherwise(trimmed(text(translation)))


def candidate(target: Column, wanted: Column) -> Column:
    """What a target begins with where the wanted rendering is missing: its head, as long as a rendering may be; null if it can't be one."""
    head = F.regexp_replace(F.regexp_replace(strip(text(target)), OPENING, ""), ENDING, "")
    head = F.substr(head, F.lit(1), F.greatest(F.lit(SHORTEST), F.least(F.length(wanted), F.lit(LONGEST))))
    return F.when((F.length(head) >= SHORTEST) & (head != wanted) & head.rlike(RENDERING), head)


def met_pairs(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """pairs (book, seq, source, target, and chapter where given) with neither side blank, joined to the originals that their sources hold."""
    own = pairs.where((strip(text(F.col("source"))) != "") & (strip(text(F.col("target"))) != ""))
    keyed = own.select(F.struct("book", "seq").alias("at"), "source")
    held = held_terms(keyed, terms, "at", "source").select(F.col("id.book").alias("book"), F.col("id.seq").alias("seq"), "original")
    return own.join(held, ["book", "seq"])


def renderings(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(book, category, ord, original, wanted, policy, rendering, n, first_seq, hit, chapters) of each term in each book; hit: the wanted one; null rendering: none recognised; chapters in order of first sight."""
    t = terms.select("category", "ord", "original", "policy", strip(text(F.col("translation"))).alias("wanted")).where((F.length("original") >= SHORTEST) & (F.col("wanted") != ""))
    met = met_pairs(pairs, t).join(t, "original")
    if "chapter" not in pairs.columns:
        met = met.withColumn("chapter", F.lit(""))
    hit = F.instr(text(F.col("target")), F.col("wanted")) > 0
    own = met.withColumn("hit", hit).withColumn("rendering", F.when(F.col("hit"), F.col("wanted")).when(F.length("original") <= LONGEST, candidate(F.col("target"), F.col("wanted"))))
    key = ["book", "category", "ord", "original", "wanted", "policy", "rendering"]
    by_chapter = own.groupBy(*key, "chapter").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.bool_or("hit").alias("hit"))
    named = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "chapter"))), lambda x: x["chapter"]), lambda c: text(c) != "")
    return by_chapter.groupBy(*key).agg(F.sum("n").alias("n"), named.alias("chapters"), F.min("first_seq").alias("first_seq"), F.bool_or("hit").alias("hit"))


def issues(pairs: DataFrame, terms: DataFrame, most: int = 50, variants: int = 6) -> DataFrame:
    """(book, category, ord, original, wanted, verdict, source_hits, variants array<struct<rendering,n,chapters>>) of terms rendered in several ways (divergent) or never as wanted (missing), at most `most` of a book in glossary order.

    Variants go by count, then the wanted one, then by first sight. Terms with a contextual, reference or ignore policy may be rendered freely.
    """
    r = renderings(pairs, terms)
    one = F.struct((-F.col("n")).alias("m"), (~F.col("hit")).alias("other"), "first_seq", "rendering", "n", "chapters")
    per = r.groupBy("book", "category", "ord", "original", "wanted", "policy").agg(F.sum("n").alias("source_hits"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("wanted_hits"), F.array_sort(F.collect_list(F.when(F.col("rendering").isNotNull(), one))).alias("all"))
    free = text(F.col("policy")).isin("contextual", "reference", "ignore")
    verdict = F.when(~free & (F.size("all") > 1) & (F.col("wanted_hits") > 0), "divergent").when(~free & (F.col("wanted_hits") == 0) & (F.col("source_hits") >= SIGHTINGS), "missing")
    cut = F.transform(F.slice("all", 1, variants), lambda x: F.struct(x["rendering"].alias("rendering"), x["n"].alias("n"), F.slice(x["chapters"], 1, 5).alias("chapters")))
    shown = F.when(F.col("verdict") == "divergent", cut).otherwise(F.array().cast("array<struct<rendering:string,n:bigint,chapters:array<string>>>"))
    found = per.withColumn("verdict", verdict).where("verdict is not null")
    place = F.row_number().over(Window.partitionBy("book").orderBy(category_rank(F.col("category")), "ord", "original"))
    found = found.withColumn("place", place).where(F.col("place") <= most)
    return found.select("book", "category", "ord", "original", "wanted", "verdict", "source_hits", shown.alias("variants"))


def verdict_counts(found: DataFrame) -> DataFrame:
    """(divergent, deviating, missing); nothing is deviating as yet."""
    return found.agg(F.count_if(F.col("verdict") == "divergent").alias("divergent"), F.lit(0).cast("long").alias("deviating"), F.count_if(F.col("verdict") == "missing").alias("missing"))


def write_back(found: DataFrame, least: int = 2) -> DataFrame:
    """(book, category, ord, original, action, translation, n, aliases): a divergent term's most frequent rendering, seen `least` times, is applied with the others as aliases; all else is for review."""
    top = F.get("variants", F.lit(0))
    apply = (F.col("verdict") == "divergent") & (top["n"] >= least)
    rest = F.transform(F.slice("variants", 2, F.greatest(F.size("variants") - 1, F.lit(0))), lambda v: v["rendering"])
    none = F.array().cast("array<string>")
    return found.select("book", "category", "ord", "original", F.when(apply, "apply").otherwise("review").alias("action"), F.when(apply, top["rendering"]).alias("translation"), F.when(apply, top["n"]).otherwise(0).alias("n"), F.when(apply, rest).otherwise(none).alias("aliases"))


def plan_terms(plan: DataFrame) -> DataFrame:
    """(book, category, terms array<struct<original,translation,source,aliases>>): the plan's updates as glossary terms by book and category."""
    own = plan.where("action = 'apply'")
    one = F.struct("ord", "original", "translation", F.lit("consistency_fix").alias("source"), "aliases")
    bare = lambda x: F.struct(x["original"].alias("original"), x["translation"].alias("translation"), x["source"].alias("source"), x["aliases"].alias("aliases"))
    return own.groupBy("book", F.coalesce(F.nullif("category", F.lit("")), F.lit("Item")).alias("category")).agg(F.transform(F.array_sort(F.collect_list(one)), bare).alias("terms"))


def merged_plan(existing: DataFrame, plan: DataFrame, overwrite: bool = False) -> DataFrame:
    """(category, original, translation, source): a glossary (with these columns) after a plan's updates; an entry that exists wins, unless overwritten."""
    new = plan.where("action = 'apply'").select("category", "original", F.col("translation").alias("new"))
    met = existing.join(new, ["category", "original"], "full_outer")
    takes = F.col("translation").isNull() | (F.lit(overwrite) & F.col("new").isNotNull())
    return met.select("category", "original", F.when(takes, F.col("new")).otherwise(F.col("translation")).alias("translation"), F.when(takes, "consistency_fix").otherwise(F.col("source")).alias("source"))


def checked(pairs: DataFrame, terms: DataFrame, most: int = 50) -> DataFrame:
    """The write-back plan of books after they are saved: only terms that a book's own sources hold are checked in it, as renderings() meets them there."""
    return write_back(issues(pairs, terms, most))


def unified_before_save(pairs: DataFrame, terms: DataFrame, most: int = 50) -> DataFrame:
    """(book, seq, target, replaced): the divergent terms' other renderings, as the check finds them, replaced by the wanted ones."""
    found = issues(pairs, terms, most).where("verdict = 'divergent'")
    other = found.select("original", F.col("wanted").alias("winner"), F.explode("variants").alias("v"), "book").select("book", "original", "winner", F.col("v.rendering").alias("variant")).where("variant <> winner")
    return unified(pairs, other, terms)


def safe_variants(variants: DataFrame, terms: DataFrame) -> DataFrame:
    """From (original, winner, variant, and book where given): reason why a variant can't be replaced, or ok: too short, part of the winner, or part of another term's translation."""
    other = terms.select(F.col("original").alias("other"), F.col("translation").alias("t")).where("t <> ''")
    keyed = other.select("other", "t", F.explode(F.array_distinct(F.split("t", ""))).alias("c"))
    taken = variants.withColumn("c", F.substring("variant", 1, 1)).join(keyed, "c").where((F.col("other") != F.col("original")) & (F.instr("t", F.col("variant")) > 0)).select("original", "variant").distinct().withColumn("taken", F.lit(True))
    reason = F.when(F.instr("winner", F.col("variant")) > 0, "part_of_winner").when(F.length("variant") < 2, "short").when(F.col("taken"), "other_term").otherwise("ok")
    return variants.join(taken, ["original", "variant"], "left").select(*[c for c in ("book", "original", "winner", "variant") if c in variants.columns], reason.alias("reason"))


def unified(pairs: DataFrame, variants: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """(book, seq, target, replaced): safe variants replaced by the winner in targets whose source holds the term, where the winner stands in `least` such targets of the book.

    Variants (original, winner, variant) are those of all books, or with book of that one. Terms go in glossary order, each over the outcome of
    those before.
    """
    safe = safe_variants(variants, terms).where("reason = 'ok'").drop("reason")
    held = held_terms(pairs.select(F.struct("book", "seq").alias("at"), "source"), safe.select("original").distinct(), "at", "source").select(F.col("id.book").alias("book"), F.col("id.seq").alias("seq"), "original")
    met = pairs.join(held, ["book", "seq"]).join(safe, [c for c in ("book", "original") if c in safe.columns])
    per_term = met.select("book", "seq", "target", "original", "winner").distinct().groupBy("book", "original", "winner").agg(F.count_if(F.instr("target", F.col("winner")) > 0).alias("held"))
    strong = per_term.where(F.col("held") >= least).select("book", "original", "winner")
    order = terms.select("original", category_rank(F.col("category")).alias("k"), "ord")
    steps = met.join(strong, ["book", "original", "winner"]).join(order, "original").groupBy("book", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "ord", (-F.length("variant")).alias("l"), "variant", "winner"))).alias("steps"))
    start = F.struct(F.col("target").alias("t"), F.lit(0).cast("long").alias("n"))
    count = lambda t, v: ((F.length(t) - F.length(F.replace(t, v, F.lit("")))) / F.length(v)).cast("long")
    done = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<k:bigint,ord:int,l:int,variant:string,winner:string>>")), start, lambda a, s: F.struct(F.replace(a["t"], s["variant"], s["winner"]).alias("t"), (a["n"] + count(a["t"], s["variant"])).alias("n")))
    out = pairs.join(steps, ["book", "seq"], "left").withColumn("done", done)
    return out.select("book", "seq", F.col("done.t").alias("target"), F.col("done.n").alias("replaced"))


def ranked(r: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent renderings of each term, ties by the wanted one, then first sight."""
    w = Window.partitionBy("book", "original").orderBy(F.desc("n"), ~F.col("hit"), "first_seq", "rendering")
    return r.where("rendering is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
