"""Glossaries: normalising, merging, matching with boundaries, selection and replacement.

A glossary is rows (category, ord, original, translation, policy, aliases array<string>), in the order of the categories.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lexweave.blocks import frames as small
from lexweave.functions.text import meaningful_term, slug, strip, text

#: Categories in order, scopes by priority, spellings of policies, prefixes of alias lists.
CATEGORIES = ["Person", "Location", "Org", "Item", "Skill", "Creature"]
SCOPES = ["global", "genre", "series", "book"]
POLICIES = {
    "force": ["force", "forced", "confirm", "confirmed", "strict", "强制", "强制使用", "固定", "已确认"],
    "reference": ["reference", "ref", "weak", "suggestion", "参考", "仅供参考", "弱", "不强制"],
    "contextual": ["context", "contextual", "context-only", "上下文", "上下文命中", "按上下文", "语境命中"],
    "preserve": ["preserve", "keep", "keep-source", "keep_original", "保留", "保留原文", "不翻译"],
    "ignore": ["ignore", "ignored", "off", "skip", "忽略", "忽略校对", "禁用"],
}
ALIAS_PREFIX = "^(?i)(?:中文别名|别名|aliases|alias)[:：]"
KATAKANA = "\\u30a0-\\u30ff\\u31f0-\\u31ff\\uff66-\\uff9f"


def policy(c: Column) -> Column:
    raw = F.lower(strip(text(c)))
    out = F.lit("")
    for name, spellings in POLICIES.items():
        out = F.when(raw.isin(*spellings), name).otherwise(out)
    return out


def alias_list(c: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    """Different aliases of two characters or more, in order."""
    parts = F.split(trimmed(F.regexp_replace(trimmed(text(c)), ALIAS_PREFIX, "")), "[\\n,，;；、|]+")
    return distinct_aliases(parts, trimmed)


def distinct_aliases(parts: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    return F.array_distinct(F.filter(F.transform(parts, lambda a: trimmed(a)), lambda a: F.length(a) >= 2))


def category_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), c)


def normalised(raw: DataFrame, trimmed: Callable[[Column], Column] = strip) -> DataFrame:
    """From rows (category, ord, original, src, translation, dst, policy, aliases string): the first row of each original, unknown categories as Item; conflict where a later row translates otherwise. `trimmed` takes off what surrounds a name."""
    own = raw.select(
        F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("Item").alias("category"), "ord", trimmed(text(F.coalesce("original", "src"))).alias("original"),
        trimmed(text(F.coalesce("translation", "dst"))).alias("translation"), policy(F.col("policy")).alias("policy"), alias_list(F.col("aliases"), trimmed).alias("aliases"),
    ).where("original <> '' and translation <> ''")
    w = Window.partitionBy("original").orderBy(category_rank(F.col("category")), "ord")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return own.withColumn("r", F.row_number().over(w)).withColumn("conflict", F.size(F.collect_set("translation").over(every)) > 1).where("r = 1").drop("r")


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by original; existing rows win and take the aliases of incoming rows of equal translation. outcome: kept, added."""
    old = existing.select("original", F.col("translation").alias("t0"))
    new = incoming.join(old, "original", "left").withColumn("outcome", F.when(F.col("t0").isNull(), "added").when(F.col("t0") == F.col("translation"), "same").otherwise("conflict"))
    more = new.where("outcome = 'same'").select("original", F.explode("aliases").alias("a"), "ord").groupBy("original").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a"))), lambda x: x["a"]).alias("more"))
    kept = existing.join(more, "original", "left").withColumn("aliases", F.array_except(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))), F.array("original", "translation")))
    first = Window.partitionBy("original").orderBy(category_rank(F.col("category")), "ord")
    added = new.where("outcome = 'added'").withColumn("r", F.row_number().over(first)).where("r = 1")
    columns = ["category", "ord", "original", "translation", "aliases"]
    return kept.select(*columns, F.lit("kept").alias("outcome")).unionByName(added.select(*columns, F.lit("added").alias("outcome")))


def merge_statistics(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(added, skipped, conflicts)."""
    old = existing.select("original", F.col("translation").alias("t0")).unionByName(incoming.groupBy("original").agg(F.min_by("translation", F.struct(category_rank(F.col("category")), "ord")).alias("t0")).join(existing, "original", "left_anti"))
    first = F.row_number().over(Window.partitionBy("original").orderBy(category_rank(F.col("category")), "ord"))
    new = incoming.withColumn("r", first).join(old, "original").join(existing.select("original", F.lit(True).alias("known")), "original", "left")
    fresh = F.col("known").isNull() & (F.col("r") == 1)
    return new.agg(F.count_if(fresh).alias("added"), F.count_if(~fresh).alias("skipped"), F.count_if(~fresh & (F.col("t0") != F.col("translation"))).alias("conflicts"))


def by_scope(terms: DataFrame) -> DataFrame:
    """From rows with scope and ord, the winner of each original: book before series, genre and global."""
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    return terms.withColumn("r", F.row_number().over(Window.partitionBy("original").orderBy(F.desc(rank), "ord"))).where("r = 1").drop("r")


def occurrences(value: Column, term: Column) -> Column:
    """Starts (from 0) of all occurrences, overlapping ones too, that don't cut a run of katakana which the term's edge belongs to."""
    kata = f"[{KATAKANA}]"
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(term.rlike(f"^{kata}"), f"(?<!{kata})").otherwise("")
    after = F.when(term.rlike(f"{kata}$"), f"(?!{kata})").otherwise("")
    pattern = F.concat(before, F.lit("(?="), quoted, after, F.lit(")"))
    # cut before each occurrence: all pieces but perhaps the first begin with one
    pieces = F.transform(F.split(value, pattern), F.length)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    starts = F.slice(ends, 1, F.size(ends) - 1)
    inner = F.filter(starts, lambda i: i > 0)
    return F.when((term == "") | (value == ""), F.array().cast("array<int>")).when(F.rlike(value, F.concat(F.lit("^"), pattern)), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


#: Terms whose characters sum up to this go to every worker as one automaton; more are met by an equality join.
AUTOMATON_CHARS = 8_000_000


def _bounded(terms: DataFrame) -> list[str] | None:
    """Different originals, if they are few enough to send."""
    own = terms.select("original").where("original <> ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.length("original")), F.lit(0))).first()[0]
    return [r[0] for r in own.orderBy("original").collect()] if size <= AUTOMATON_CHARS else None


def held_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, automaton_chars: int | None = None) -> DataFrame:
    """(id, original, starts) of terms in texts, all occurrences, overlapping ones too, without regard to boundaries.

    Texts are read once, where they are: all terms are looked for in one pass by an automaton that every worker builds from
    the terms, whose size is checked before. A larger glossary meets the texts by an equality join of their character groups
    with the terms' first characters, on rows that hold no text; what meets is verified with the text after.
    """
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    kind = own.schema["id"].dataType.simpleString()
    known = _bounded(terms) if automaton_chars is None else None
    if known is None:
        return _held_by_groups(own, terms)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, term in enumerate(known):
            machine.add_word(term, k)
        machine.make_automaton()
        for part in small(parts, "text", 1 << 18):
            ids, originals, starts = [], [], []
            for i, value in part.itertuples(index=False):
                places: dict[int, list[int]] = {}
                for end, k in machine.iter(value):
                    places.setdefault(k, []).append(end + 1 - len(known[k]))
                ids += [i] * len(places)
                originals += [known[k] for k in places]
                starts += places.values()
            yield pd.DataFrame({"id": pd.Series(ids, dtype=part["id"].dtype), "original": pd.Series(originals, dtype=object), "starts": pd.Series(starts, dtype=object)})

    schema = f"id {kind}, original string, starts array<int>"
    return own.mapInPandas(run, schema) if known else own.select("id", F.lit("").alias("original"), F.array().cast("array<int>").alias("starts")).limit(0)


def _held_by_groups(own: DataFrame, terms: DataFrame) -> DataFrame:
    """The same by a join: each text offers its different groups of 1, 2 and 4 characters, each term its longest first group of these."""
    t = terms.select("original").where("original <> ''").distinct()
    t = t.withColumn("group", F.when(F.length("original") >= 4, F.substring("original", 1, 4)).when(F.length("original") >= 2, F.substring("original", 1, 2)).otherwise(F.col("original")))
    c = F.col("text")
    sizes = [r[0] for r in t.select(F.length("group")).distinct().collect()]

    def pieces(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    every = [pieces(n) for n in sizes]
    groups = F.array_distinct(F.concat(*every)) if every else F.array().cast("array<string>")
    met = own.select("id", F.explode(groups).alias("group")).join(t, "group").groupBy("id").agg(F.collect_set("original").alias("all"))
    back = own.join(met, "id").select("id", "text", F.explode("all").alias("original")).where(F.instr(c, F.col("original")) > 0)
    # a term occurs at i where the text's piece from i begins with it
    places = F.filter(F.sequence(F.lit(0), F.length(c) - F.length("original")), lambda i: F.substr(c, i + 1, F.length("original")) == F.col("original"))
    return back.select("id", "original", places.alias("starts"))


def matches(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, automaton_chars: int | None = None) -> DataFrame:
    """(id, original, translation, starts) of terms in texts; occurrences that cut a run of katakana, which the term's edge belongs to, don't count."""
    found = held_terms(texts, terms, id_col, text_col, automaton_chars)
    kata = f"[{KATAKANA}]"
    edged = F.col("original").rlike(f"^{kata}|{kata}$")
    plain = found.where(~edged)
    # only the few terms with a katakana edge need the text again
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(kata))
    bounded = found.where(edged).select("id", "original").join(own, "id").select("id", "original", occurrences(F.col("text"), F.col("original")).alias("starts")).where(F.size("starts") > 0)
    return plain.unionByName(bounded).join(terms.select("original", "translation"), "original").select("id", "original", "translation", "starts")


def matches_nested(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same as matches() by comparing every text with every term; for tests on small data."""
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = own.join(terms.select("original", "translation").where("original <> ''"), F.instr(F.col("text"), F.col("original")) > 0)
    return met.select("id", "original", "translation", occurrences(F.col("text"), F.col("original")).alias("starts")).where(F.size("starts") > 0)


def apart(starts: Column, length: Column) -> Column:
    """How many of the occurrences, taken from the left, don't overlap."""
    step = lambda a, s: F.when(s >= a["end"], F.struct((s + length).cast("int").alias("end"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def counts(found: DataFrame) -> DataFrame:
    """(original, translation, texts, times) of matches."""
    n = apart(F.col("starts"), F.length("original"))
    return found.groupBy("original", "translation").agg(F.count("*").alias("texts"), F.sum(n).cast("long").alias("times"))


def selected(found: DataFrame, most: int = 120) -> DataFrame:
    """(id, place, original, start): of each text's matches, the longest first, the first place of each that no longer one takes."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("original")).alias("m"), F.col("starts")[0].alias("f"), F.col("original").alias("o"), F.col("starts").alias("s"))))
    spans = "array<struct<o:string,a:int,b:int>>"

    def take(held: Column, x: Column) -> Column:
        free = F.filter(x["s"], lambda a: ~F.exists(held, lambda h: (a < h["b"]) & (h["a"] < a + F.length(x["o"]))))
        fits = (F.size(held) < most) & (F.size(free) > 0)
        one = F.array(F.struct(x["o"].alias("o"), F.get(free, F.lit(0)).alias("a"), (F.get(free, F.lit(0)) + F.length(x["o"])).alias("b")))
        return F.when(fits, F.concat(held, one)).otherwise(held)

    grouped = found.groupBy("id").agg(order.alias("all"))
    chosen = F.aggregate("all", F.array().cast(spans), take)
    return grouped.select("id", F.posexplode(chosen).alias("place", "x")).select("id", "place", F.col("x.o").alias("original"), F.col("x.a").alias("start"))


def replacement_terms(terms: DataFrame) -> DataFrame:
    """(match, translation) of originals and aliases; ignored and preserved terms, short matches and those equal to the translation are left out."""
    own = terms.where(~F.col("policy").isin("ignore", "preserve") & (F.col("translation") != ""))
    flat = own.select(F.explode(F.concat(F.array("original"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("match"), "translation", category_rank(F.col("category")).alias("c"), "ord")
    flat = flat.where((F.length("match") >= 2) & (F.col("match") != F.col("translation")))
    return flat.groupBy("match").agg(F.min_by("translation", F.struct("c", "ord")).alias("translation"))


def term_list(terms: DataFrame, most: int = 100_000) -> list[tuple[str, str]]:
    """The terms to replace, longest first, for workers that need all of them in order; more than `most` are refused."""
    found = terms.orderBy(F.desc(F.length("match")), "match", "translation").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms to replace in turn")
    return [(r["match"], r["translation"]) for r in found]


def replace_terms(texts: DataFrame, terms: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """(id, text, changes array<struct<match,translation,n>>): the terms in turn, each over the outcome of those before; leftmost occurrences that don't overlap, under the boundary rule."""
    import re

    kata = "゠-ヿㇰ-ㇿｦ-ﾟ"
    edge = lambda ch, look: f"(?{look}[{kata}])" if re.match(f"[{kata}]", ch) else ""
    compiled = [(re.compile(edge(m[0], "<!") + re.escape(m) + edge(m[-1], "!")), m, t) for m, t in terms]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in small(parts, "text"):
            texts, logs = [], []
            for value in part["text"].fillna(""):
                log = []
                for pattern, match, translation in compiled:
                    if match in value:
                        value, n = pattern.subn(lambda _, t=translation: t, value)
                        if n:
                            log.append({"match": match, "translation": translation, "n": n})
                texts.append(value)
                logs.append(log)
            yield pd.DataFrame({"id": part["id"], "text": texts, "changes": logs})

    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {own.schema['id'].dataType.simpleString()}, text string, changes array<struct<match:string,translation:string,n:int>>")


def replacement_totals(replaced: DataFrame) -> DataFrame:
    """(match, translation, n, texts)."""
    return replaced.select(F.explode("changes").alias("c")).groupBy(F.col("c.match").alias("match"), F.col("c.translation").alias("translation")).agg(F.sum("c.n").alias("n"), F.count("*").alias("texts"))


# --- enforcement, prompts, candidates, profiles -----------------------------------------------------------------------------

# Words of notes and sources that force a term or leave it free; words that are no terms; names of categories.
FORCES = ("force", "forced", "confirmed", "强制", "固定", "已确认")
FREE_SOURCES = ("auto", "自动提取", "reference", "ref", "weak", "suggestion")
FREES = ("参考", "弱", "多义", "普通名词", "不强制", "reference-only")
COMMON_WORDS = (
    "我们", "你们", "他们", "这个", "那个", "这里", "那里", "然后", "但是", "因为", "所以", "可以", "不会", "已经", "正在", "没有", "非常", "真的", "老师", "学校", "城市", "国家",
    "魔法", "剑", "勇者", "魔王", "世界", "时间", "地方", "事情", "东西", "样子", "之后", "之前", "起来", "下去", "出来", "进去", "回来", "过来",
)
CATEGORY_NAMES = {
    "Person": ("person", "角色", "人物"), "Location": ("location", "地点", "场所"), "Org": ("org", "organization", "组织", "团体"),
    "Item": ("item", "物品", "装备", "道具"), "Skill": ("skill", "技能", "招式", "魔法"), "Creature": ("creature", "生物", "怪物", "宠物"),
}
POLICY_NOTES = {"force": "强制使用", "reference": "仅供参考", "contextual": "仅在上下文符合时使用", "preserve": "保留原文不翻译"}
PARTICLE = "^(?:は|が|を|に|へ|と|も|の|や|で)\\s*[、,、:：]?\\s*(?=[\\u3400-\\u4dbf\\u4e00-\\u9fff\\u30a0-\\u30ff])"
NO_TERMS = "无术语表。"


def enforcement(original: Column, translation: Column, category: Column, source: Column, info: Column, said: Column) -> Column:
    """How binding a term is: its policy, else what its source and note say, else its category; short katakana items stay free."""
    own = policy(said)
    source, info = text(source), text(info)
    marks = F.lower(F.concat(source, F.lit(" "), info))
    has = lambda words: F.lit(False) if not words else _any_of(marks, words)
    free = F.lower(strip(source)).isin(*FREE_SOURCES) | has(FREES)
    short = original.rlike(f"[{KATAKANA}]") & (F.length(original) <= 4)
    level = F.when(own != "", own).when(has(FORCES), "force").when(free, "reference").when(category.isin("Person", "Location", "Org", "Skill", "Creature"), "force").when(short, "reference").otherwise("force")
    return F.when(meaningful_term(original, translation), level).otherwise("ignore")


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def prompt_line(original: Column, translation: Column, said: Column, info: Column) -> Column:
    """A term as a prompt shows it, with its policy and note; preserved terms read as they are."""
    own = policy(said)
    note = F.lit(None).cast("string")
    for name, words in POLICY_NOTES.items():
        note = F.when(own == name, words).otherwise(note)
    notes = F.concat_ws("；", note, F.nullif(strip(text(info)), F.lit("")))
    return F.concat(original, F.lit("->"), F.when(own == "preserve", original).otherwise(translation), F.when(notes != "", F.concat(F.lit(" #"), notes)).otherwise(""))


def prompts(chosen: DataFrame, terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, prompt) of every text (id): the lines of its selected terms in their order, or the words for none."""
    lines = chosen.join(terms.select("original", prompt_line(F.col("original"), F.col("translation"), F.col("policy"), F.col("info")).alias("line")), "original")
    joined = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
    return texts.select("id").join(joined, "id", "left").select("id", F.coalesce("prompt", F.lit(NO_TERMS)).alias("prompt"))


def cleaned(raw: DataFrame) -> DataFrame:
    """Candidates (ord, src, dst, category, info, source, policy, aliases string or array<string>) as terms (ord, original, translation, category, info, source, policy, aliases): particles before names cut, short and common words out, repeated sources merged.

    The first of a source counts; the others' translations and aliases become its aliases. It becomes a creature if any of
    them is, else leaves Item for the first other category.
    """
    src = strip(F.regexp_replace(strip(text(F.col("src"))), PARTICLE, ""))
    dst, said = strip(text(F.col("dst"))), F.lower(strip(text(F.col("category"))))
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("Item")
    for name, words in CATEGORY_NAMES.items():
        category = F.when(said.isin(*words), name).otherwise(category)
    # a list is taken as it is, so that its names may hold commas
    aliases = distinct_aliases(F.coalesce("aliases", F.array().cast("array<string>"))) if isinstance(raw.schema["aliases"].dataType, ArrayType) else alias_list(F.col("aliases"))
    own = raw.select("ord", src.alias("original"), dst.alias("translation"), category.alias("category"), strip(text(F.col("info"))).alias("info"), F.coalesce(F.nullif(strip(text(F.col("source"))), F.lit("")), F.lit("auto")).alias("source"), policy(F.col("policy")).alias("policy"), aliases.alias("aliases"))
    own = own.where((F.length("original") >= 2) & (F.length("translation") >= 2) & ~F.col("original").isin(*COMMON_WORDS) & ~F.col("translation").isin(*COMMON_WORDS))
    every = F.array_sort(F.collect_list(F.struct("ord", "translation", "category", "info", "source", "policy", "aliases")))
    grouped = own.groupBy("original").agg(every.alias("all")).withColumn("f", F.get("all", F.lit(0)))
    names = F.flatten(F.transform("all", lambda x: F.when(x["ord"] == F.col("f.ord"), x["aliases"]).otherwise(F.concat(F.array(x["translation"]), x["aliases"]))))
    other = F.get(F.filter(F.transform("all", lambda x: x["category"]), lambda c: c != "Item"), F.lit(0))
    best = F.when(F.exists("all", lambda x: x["category"] == "Creature"), "Creature").when((F.col("f.category") == "Item") & other.isNotNull(), other).otherwise(F.col("f.category"))
    return grouped.select("f.ord", "original", "f.translation", best.alias("category"), "f.info", "f.source", "f.policy", F.array_except(F.array_distinct(names), F.array("original", "f.translation")).alias("aliases"))


def extracted(found: DataFrame, existing: DataFrame, lite: bool = False) -> DataFrame:
    """A glossary (category, ord, original, translation, aliases, outcome) after candidates as of cleaned(); lite keeps persons, places and creatures only. What exists wins."""
    new = cleaned(found).where(F.col("category").isin("Person", "Location", "Creature") if lite else F.lit(True))
    return merged(existing, new)


def source_statistics(terms: DataFrame) -> DataFrame:
    """(auto, manual, unknown) of terms by where they come from."""
    s = F.lower(strip(text(F.col("source"))))
    automatic = s.isin("auto", "自动提取")
    return terms.agg(F.count_if(automatic).alias("auto"), F.count_if(~automatic & (s != "")).alias("manual"), F.count_if(s == "").alias("unknown"))


def invalid_injections(pairs: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """(id, invalid array<string>) of revisions (id, source, draft, revised) that newly hold a term's translation although the source holds the term only inside a longer word."""
    own = pairs.where((text(F.col("source")) != "") & (text(F.col("revised")) != "") & ~F.col("revised").eqNullSafe(F.col("draft")))
    met = held_terms(own.select("id", "source"), terms, "id", "source").select("id", "original").join(own, "id").join(terms.select("category", "ord", "original", "translation", "policy"), "original")
    level = enforcement(F.col("original"), F.col("translation"), F.col("category"), F.lit(""), F.lit(""), F.col("policy"))
    bad = met.where((F.length("translation") >= 2) & (level != "ignore") & F.contains("revised", F.col("translation")) & ~F.contains(text(F.col("draft")), F.col("translation")) & (F.size(occurrences(F.col("source"), F.col("original"))) == 0))
    one = F.struct(category_rank(F.col("category")).alias("k"), "ord", F.concat("original", F.lit("->"), F.col("translation")).alias("t"))
    return bad.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), 1, most).alias("invalid"))


def proofread_issues(pairs: DataFrame, terms: DataFrame, most: int = 30) -> DataFrame:
    """(id, original, wanted, issue) of pairs (id, source, target): binding terms of the source that the target doesn't hold, as `missing` or, where they should stay, `not_preserved`."""
    own = pairs.where((strip(text(F.col("source"))) != "") & (strip(text(F.col("target"))) != ""))
    level = enforcement(F.col("original"), F.col("translation"), F.col("category"), F.lit(""), F.lit(""), F.col("policy"))
    bound = terms.withColumn("level", level).where(F.col("level").isin("force", "preserve"))
    chosen = selected(matches(own, terms, "id", "source"), most)
    wanted = F.when(F.col("level") == "preserve", F.col("original")).otherwise(F.col("translation"))
    met = chosen.join(bound, "original").join(own, "id").withColumn("wanted", wanted).where(~F.contains("target", F.col("wanted")))
    return met.select("id", "original", "wanted", F.when(F.col("level") == "preserve", "not_preserved").otherwise("missing").alias("issue"))


def applied_to_book(nodes: DataFrame, titles: DataFrame, terms: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(changed, summary): text nodes (file, pos, text) and titles of contents (pos, text) after the replacement of terms, and one row (ok, n, texts); ok is false without a replacement."""
    every = nodes.select(F.struct("file", "pos").alias("at"), "text").unionByName(titles.select(F.struct(F.lit("").alias("file"), "pos").alias("at"), "text"))
    done = replace_terms(every, term_list(replacement_terms(terms), most), "at", "text")
    changed = done.where(F.size("changes") > 0).select(F.col("id.file").alias("file"), F.col("id.pos").alias("pos"), "text", "changes")
    n = F.aggregate("changes", F.lit(0), lambda a, x: a + x["n"])
    summary = changed.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count("*").alias("texts"))
    return changed, summary.select((F.col("n") > 0).alias("ok"), "n", "texts")


def metadata(asked: DataFrame, terms: DataFrame, trimmed: Callable[[Column], Column] = strip) -> DataFrame:
    """asked (original) with category, source, info and policy of the term of that name: of several the first by category, then by order; null where there is none, or the name is blank. `trimmed` takes off what surrounds a name or a field."""
    fields = ["category", "source", "info", "policy"]
    one = F.struct(category_rank(F.col("category")).alias("k"), "ord", *[trimmed(text(F.col(f))).alias(f) for f in fields])
    first = terms.where(category_rank(F.col("category")) > 0).groupBy(trimmed(text(F.col("original"))).alias("_name")).agg(F.min(one).alias("_m")).where("_name <> ''")
    met = asked.withColumn("_name", trimmed(text(F.col("original")))).join(first, "_name", "left")
    return met.select(*asked.columns, *[F.col(f"_m.{f}").alias(f) for f in fields])


def json_text(c: Column) -> Column:
    """A string as JSON writes it, with all characters beyond ASCII as they are."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(0x20):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        c = F.replace(c, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), c, F.lit('"'))


def canonical(terms: DataFrame, by: str = "profile") -> DataFrame:
    """(by, canonical): each glossary as compact JSON with sorted keys: by category, in order, the terms' fields that have a value; aliases don't count.

    A glossary becomes one text, as it does in a prompt; categories without terms are empty lists.
    """
    fields = sorted(c for c in ("original", "translation", "info", "policy", "source") if c in terms.columns)
    given = [F.when(text(F.col(c)) != "", F.concat(F.lit(f'"{c}":'), json_text(F.col(c)))) for c in fields]
    one = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*given)), ","), F.lit("}"))
    lists = terms.groupBy(by, "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("j")))), lambda x: x["j"]), ",").alias("j"))
    held = lists.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("category", "j"))).alias("m"))
    parts = [F.concat(F.lit(f'"{c}":['), F.coalesce(F.try_element_at("m", F.lit(c)), F.lit("")), F.lit("]")) for c in sorted(CATEGORIES)]
    return held.select(by, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("canonical"))


def fingerprint(terms: DataFrame, by: str = "profile") -> DataFrame:
    """(by, fingerprint): SHA-256 of each glossary's canonical form."""
    return canonical(terms, by).select(by, F.sha2("canonical", 256).alias("fingerprint"))


def profiles_by_name(profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (scope, name) with the profile (scope, name, updated_at, created_at, id) of equal scope and slug of name, the latest."""
    order = Window.partitionBy("scope", "slug").orderBy(F.desc_nulls_last(F.coalesce("updated_at", "created_at")), "id")
    latest = profiles.withColumn("slug", slug(F.col("name"))).withColumn("r", F.row_number().over(order)).where("r = 1").select("scope", "slug", "id")
    return asked.withColumn("slug", slug(F.col("name"))).join(latest, ["scope", "slug"], "left").select("scope", "name", "id")


def listed_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles by scope, the widest first, then by name, whatever its case."""
    return profiles.orderBy(F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")), F.lower("name"))


def csv_rows(terms: DataFrame) -> DataFrame:
    """A glossary as the seven columns of its CSV, in the order of categories."""
    own = terms.orderBy(category_rank(F.col("category")), "ord")
    return own.select("category", F.col("original").alias("src"), F.col("translation").alias("dst"), text(F.col("info")).alias("info"), text(F.col("source")).alias("source"), text(F.col("policy")).alias("policy"), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "、").alias("aliases"))
