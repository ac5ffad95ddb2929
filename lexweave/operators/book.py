"""Translations put back into a book: results aligned with blocks, titles of contents made one with headings, clean titles; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import titles
from lexweave.functions.text import strip, text
from lexweave.storage import stored

#: Tags whose text is a title.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def title_key(c: Column) -> Column:
    """A title with its white space made one."""
    return strip(F.regexp_replace(text(c), "(?U)\\s+", " "))


def aligned(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """blocks (id, seq, text, ...) with translation from results (id, seq, text, translation): that of the same place unless empty, else that of the same text."""
    placed = results.where("seq is not null").groupBy("id", "seq").agg(F.max("translation").alias("_by_place"))
    spoken = results.where(text(F.col("translation")) != "").groupBy("id", "text").agg(F.min_by("translation", F.coalesce("seq", F.lit(2**31 - 1))).alias("_by_text"))
    met = blocks.join(placed, ["id", "seq"], "left").join(spoken, ["id", "text"], "left")
    return met.withColumn("translation", F.coalesce(F.nullif("_by_place", F.lit("")), F.col("_by_text"))).drop("_by_place", "_by_text")


def cleaned_nodes(found: DataFrame) -> DataFrame:
    """found (id, seq, mode, tag, text, translation) with translations of titles cleaned: those of anchors, headings and texts that are titles of contents; a refusal gives the original back."""
    known = found.where("mode = 'toc'").select("id", "text").distinct().withColumn("_title", F.lit(True))
    met = found.join(known, ["id", "text"], "left")
    title = F.col("mode").isin("single_anchor", "multi_anchor") | F.coalesce("_title", F.lit(False)) | F.lower(F.coalesce("tag", F.lit(""))).isin(*HEADINGS)
    t = F.col("translation")
    clean = F.nullif(titles.clean_title(F.when(title, t)), F.lit(""))
    out = F.when(~title | (text(t) == ""), t).otherwise(F.coalesce(clean, F.when(titles.refusal(t), F.col("text")).otherwise(t)))
    return met.withColumn("translation", out).drop("_title")


def written_back(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """blocks (id, seq, mode, tag, text) with the translation that goes into the book; null where the text stays.

    A heading that is also a title of contents says how the title is translated everywhere, the first one of the book.
    """
    # read three times
    own = stored(cleaned_nodes(aligned(blocks, results)).withColumn("_key", title_key(F.col("text"))), "aligned")
    listed = own.where("mode = 'toc' and _key <> ''").select("id", "_key").distinct()
    heads = own.where(F.lower(F.coalesce("tag", F.lit(""))).isin(*HEADINGS) & (text(F.col("translation")) != "")).join(listed, ["id", "_key"], "left_semi")
    canonical = heads.groupBy("id", "_key").agg(F.min_by("translation", "seq").alias("_canonical"))
    met = own.join(canonical, ["id", "_key"], "left")
    return cleaned_nodes(met.withColumn("translation", F.coalesce("_canonical", "translation")).drop("_canonical", "_key"))


def title_map(done: DataFrame) -> DataFrame:
    """(id, title, translation) of the titles of contents of written_back()'s rows, the first of each title."""
    own = done.where("mode = 'toc'").where(text(F.col("translation")) != "")
    return own.groupBy("id", F.col("text").alias("title")).agg(F.min_by("translation", "seq").alias("translation"))


def renamed(toc: DataFrame, names: DataFrame) -> DataFrame:
    """toc (id, ord, uid, title) with titles that the map (id, title, translation) names replaced, and entries without a uid numbered in order."""
    from pyspark.sql import Window

    met = toc.join(names.select("id", "title", "translation"), ["id", "title"], "left")
    place = F.sum(F.col("uid").isNull().cast("int")).over(Window.partitionBy("id").orderBy("ord"))
    return met.select("id", "ord", F.coalesce("uid", F.concat(F.lit("navpoint-"), place.cast("string"))).alias("uid"), F.coalesce("translation", "title").alias("title"))


#: What each save policy means, in a report's legend.
LEGEND = {"strict": "all residue that blocks", "balanced": "high and medium risk", "lenient": "nothing"}


def residue_report(counts: DataFrame, policy: str) -> DataFrame:
    """(report): one JSON text of counts by risk (risk, n, blocking, samples), with the policy's legend."""
    one = F.struct("risk", "n", "blocking", "samples")
    return counts.agg(F.to_json(F.struct(F.lit(policy).alias("policy"), F.lit(LEGEND[policy]).alias("legend"), F.array_sort(F.collect_list(one)).alias("risks"))).alias("report"))


def self_check(numbers: DataFrame) -> DataFrame:
    """numbers (task_id, total, failed, residue, divergent) with warnings array<string>: what of a run a person should look at."""
    share = F.try_divide(F.col("failed"), F.col("total"))
    found = F.array(F.when(F.col("failed") > 0, F.when(share >= 0.05, "many_failed").otherwise("some_failed")), F.when(F.col("residue") > 0, "residue"), F.when(F.col("divergent") > 0, "divergent_terms"), F.when(F.col("total") == 0, "nothing_translated"))
    return numbers.withColumn("warnings", F.array_compact(found))
