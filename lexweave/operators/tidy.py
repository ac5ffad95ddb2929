"""Tidying a glossary: notes split off, typing errors and entries of no use out, spelling variants made one, categories found.

Terms of equal translation are variants if their folded forms are one letter apart: hiragana as katakana, without dots, hyphens and spaces
between words, long vowels at the end, and with one kind of circle. Letters left out are join keys, so no term is compared with all
others: what leaves the same rest at the same place is linked to the first of its kind, and a rest to the longer terms it is the rest of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import strip, text
from lexweave.operators.graph import groups

# The note of a typing error; endings of address; hints at categories, first those that notes hold, then those that any part
# holds, in the order they are tried; notes that a category makes needless.
TYPO = "错字"
ADDRESS = ("さん", "様", "君", "くん", "嬢", "ちゃん", "ちゃーん", "氏", "卿", "殿")
NOTED = (
    ("Person", ("皇女", "皇太子妃", "伯爵", "侯爵", "子爵", "男爵", "准男爵", "女性", "母亲", "父亲", "叔父", "祖母", "姐姐")),
    ("Location", ("星系", "行星", "殖民卫星", "度假行星")),
    ("Org", ("氏族", "連邦", "帝国", "管理局", "軍", "帮派")),
)
HELD = (
    ("Location", ("星系", "行星", "殖民卫星", "都市", "街", "区", "村", "店", "施設", "館", "院", "ドック", "船坞")),
    ("Org", ("クラン", "シンジケート", "社", "公司", "工業", "科技", "管理局", "軍")),
    ("Skill", ("ジツ", "の術", "カラテ", "空手", "柔术", "居合", "道場", "ドージョー")),
    ("Creature", ("ニンジャ", "エルフ", "ボット", "ロボット", "アンドロイド")),
    ("Item", ("艦", "舰", "銃", "枪", "炮", "装甲", "导弹", "パック", "ポッド")),
)
NEEDLESS = ("舰", "星系", "氏族", "連邦", "帝国", "男", "女性", "男性", "错字")
NO_TERM = "^[「」『』ⅠⅡⅢⅣⅤ]$|^[一二三四五六七八九十]+章$"
NAME = "^[ァ-ヶー・]{2,8}$"

_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
SHORTEST = 5


def entries(raw: DataFrame) -> DataFrame:
    """(original, translation, info, n) of rows (original, value, info, n): notes that follow a value as #note are split off where info is empty.

    Blank originals are left out; of repeated ones the first by translation stays, with all their occurrences n.
    """
    value = strip(text(F.col("value")))
    noted = F.regexp_extract(value, r"^(.+?)\s*((?:\s#[^\s#]+)+)$", 2)
    bare = F.when(noted != "", F.regexp_extract(value, r"^(.+?)\s*((?:\s#[^\s#]+)+)$", 1)).otherwise(value)
    notes = F.array_join(F.filter(F.transform(F.split(noted, "#"), lambda x: strip(x)), lambda x: x != ""), "; ")
    own = raw.select(strip(text(F.col("original"))).alias("original"), strip(bare).alias("translation"), F.coalesce(F.nullif(strip(text(F.col("info"))), F.lit("")), notes).alias("info"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    one = own.where("original <> ''").groupBy("original").agg(F.min(F.struct("translation", "info")).alias("e"), F.sum("n").alias("n"))
    return one.select("original", "e.translation", "e.info", "n")


def folded(c: Column) -> Column:
    """A term as its spelling variants have it too."""
    plain = F.translate(F.regexp_replace(c, "[・･\\s　=＝\\-‐－]", ""), _HIRAGANA + "○", _KATAKANA + "◯")
    return F.lower(F.regexp_replace(plain, "ー+$", ""))


def variant_links(terms: DataFrame) -> DataFrame:
    """(a, b) between terms (original, translation) of one translation whose folded forms are equal, or one letter apart and SHORTEST letters long at least."""
    own = terms.where("translation <> ''").select("original", "translation", folded(F.col("original")).alias("f")).where("f <> ''")
    whole = own.select("original", "translation", "f", F.lit(-1).alias("place"), F.col("f").alias("rest"))
    long = own.where(F.length("f") >= SHORTEST)
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.concat(F.substring("f", F.lit(1), i - 1), F.substring("f", i + 1, F.length("f")))))
    rests = long.select("original", "translation", "f", cut.alias("place", "rest"))
    # within a kind the smallest stands for all: equal forms, and equal rests at one place
    same = whole.unionByName(rests).groupBy("translation", "rest", "place").agg(F.min("original").alias("a"), F.collect_set("original").alias("all"))
    alike = same.select("a", F.explode("all").alias("b")).where("a <> b")
    shorter = whole.where(F.length("f") >= SHORTEST).groupBy("translation", "rest").agg(F.min("original").alias("a"))
    longer = rests.select("translation", "rest", F.col("original").alias("b")).join(shorter, ["translation", "rest"])
    return alike.select("a", "b").union(longer.select("a", "b").where("a <> b")).distinct()


def category(original: Column, translation: Column, info: Column) -> Column:
    """What a term is, by hints in its notes, then in any part of it; short katakana is a name; else an item."""
    holds = lambda c, words: F.greatest(*[F.contains(c, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(c, F.lit(words[0]))
    every = F.concat_ws(" ", original, translation, info)
    out = F.when(F.lit(False), "")
    for name, words in NOTED:
        out = out.when(holds(info, words), name)
    for name, words in HELD:
        out = out.when(holds(every, words), name)
    return out.when(original.rlike(NAME), "Person").otherwise("Item")


def tidied(raw: DataFrame, merges: DataFrame | None = None, redundant: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A glossary (category, ord, original, translation, info, aliases, n) out of rows (original, value, info, n), and what went: (original, reason, into).

    Out go typing errors, marks and numbers of chapters, what `redundant` (original) names, forms of address of a term that is there too, and
    variants, be they alike or named in `merges` (variant, canonical). Of a group of variants the most frequent stays, then the longest, then the first; it
    takes the others as aliases, and their occurrences.
    """
    own = entries(raw)
    listed = redundant.select("original").distinct().withColumn("listed", F.lit(True)) if redundant is not None else own.select("original").limit(0).withColumn("listed", F.lit(True))
    found = own.join(listed, "original", "left")
    bases = own.select(F.col("original").alias("base"))
    # endings may end alike, so each is tried
    tried = own.select("original", F.explode(F.array_compact(F.array(*[F.when(F.col("original").endswith(a), F.substring("original", F.lit(1), F.length("original") - len(a))) for a in ADDRESS]))).alias("base"))
    addressed = tried.join(bases, "base").groupBy("original").agg(F.min("base").alias("base"))
    judged = found.join(addressed, "original", "left").withColumn(
        "reason", F.when(F.contains("info", F.lit(TYPO)), "typo").when(F.col("listed"), "redundant").when(F.col("original").rlike(NO_TERM), "no_term").when(F.col("base").isNotNull(), "address")
    )
    left = judged.where("reason is null").select("original", "translation", "info", "n")
    links = variant_links(left)
    if merges is not None:
        named = merges.select(F.col("canonical").alias("a"), F.col("variant").alias("b"))
        links = links.union(named.join(left.select(F.col("original").alias("a")), "a", "left_semi").join(left.select(F.col("original").alias("b")), "b", "left_semi").select("a", "b"))
        first = merges.select(F.col("canonical").alias("original")).distinct().withColumn("chosen", F.lit(0))
    else:
        first = left.select("original").limit(0).withColumn("chosen", F.lit(0))
    grouped = left.join(groups(links).withColumnRenamed("node", "original"), "original", "left").join(first, "original", "left").withColumn("root", F.coalesce("root", "original"))
    best = F.struct(F.coalesce("chosen", F.lit(1)), (-F.col("n")).alias("m"), (-F.length("original")).alias("l"), "original")
    heads = grouped.groupBy("root").agg(F.min(best).alias("h"), F.sort_array(F.collect_set("original")).alias("all"), F.sum("n").alias("n"))
    kept = heads.select(F.col("h.original").alias("original"), F.array_except("all", F.array("h.original")).alias("aliases"), "n").join(left.drop("n"), "original")
    info = F.array_join(F.filter(F.transform(F.split("info", ";"), lambda x: strip(x)), lambda x: (x != "") & ~x.isin(*NEEDLESS)), "; ")
    kind = category(F.col("original"), F.col("translation"), F.col("info"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("original")) - 1
    out = kept.select(kind.alias("category"), "original", "translation", info.alias("info"), "aliases", "n").withColumn("ord", place)
    merged = heads.select(F.col("h.original").alias("into"), F.explode(F.array_except("all", F.array("h.original"))).alias("original")).select("original", F.lit("variant").alias("reason"), "into")
    gone = judged.where("reason is not null").select("original", "reason", F.when(F.col("reason") == "address", F.col("base")).alias("into")).unionByName(merged)
    return out.select("category", "ord", "original", "translation", "info", "aliases", "n"), gone
