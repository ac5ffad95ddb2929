"""Further registered queries: quality cases, glossary work, control, history, titles and styles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import titles
from lexweave.operators import book, cache, consistency, control, counters, enrich, glossary, quality, rounds, runs, tidy
from lexweave.plans import fixtures as X
from lexweave.plans import stubs
from lexweave.plans.catalogue import _TERMS, _in, _terms, case, query, table
from lexweave.plans.fixtures import Fixture
from lexweave.sources import cache_table, epub
from lexweave.sources import html as H
from lexweave.storage import fresh_path, stored
from lexweave.streaming import control as stream_control
from lexweave.streaming import flush

# --- quality ------------------------------------------------------------------------------------------------------------

CASES = Fixture(
    "k int, text string, risk string, blocking boolean",
    (1, "彼女は笑った。そして走った。", "high", True), (2, "她还是说でも要去。", "medium", True), (3, "今年的《生きて明日なく》非常出色，她拥有很多粉丝。", "low", True), (4, "这句话里有一处小さ假名。", "weak", False), (5, "她笑了。", "none", False),
    (6, "这首和歌采用二句切，第四句的‘ふる’是‘世に経る’与‘长雨が降る’的双关，结句的‘ながめ’不仅是‘眺め’与‘长雨’，还兼有‘詠め’之意。", "none", False), (7, "第二句的‘こそ’和‘なけれ’，以及结句的‘ぞ’和‘なる’这两处运用了系结。", "none", False),
    (8, "原歌：奥山に 紅葉踏みわけ 鳴く鹿の 声きく時ぞ 秋は悲しき\n译意：深山踏红叶，鹿鸣声凄切，闻之秋悲凉。", "none", False), (9, "小、日、死，可若是只取每个字的首音连起来，便是コ、ニ、シ、ノ、ソ、ノ、シ、ニ。", "none", False), (10, "数理信息工程学权威、久珠场俊隆博士去世", "none", False),
)


@case(f"SELECT k, risk, blocking FROM {CASES.sql}")
def q_residue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2, Q4 to Q7, Q17 on texts whose neighbourhood allows kana, by their known classes."""
    return quality.classified(CASES.df(spark).select("k", "text"), "text").select("k", "residue.risk", "residue.blocking")


REPAIRS = Fixture(
    "k int, source string, text string, repaired string",
    (1, "source", "回来的妻子，手里拿着一个叫作\"チロリ\"的烫酒壶。", "回来的妻子，手里拿着一个烫酒壶。"), (2, "source", "チロリ的酒也喝光了。", "烫酒壶里的酒也喝光了。"), (3, "", "“去哪里呢？”【前文上下文（仅供参考，帮助理解当前文本的语境，无需翻译）】女子对旅人说了话。", "“去哪里呢？”"),
    (4, "", "为什么把凶手的名字告诉了阿景さん，说是弁藏呢？阿鶴さん也离开了。", "为什么把凶手的名字告诉了阿景，说是弁藏呢？阿鹤也离开了。"), (5, "", "点野 しめの 大阪", "点野 大阪"), (6, "", "熟田津 にぎたづ 愛媛", "熟田津 爱媛"), (7, "", "九十九 つくも 群馬・和歌山", "九十九 群马、和歌山"), (8, "", "大豆戸 まめと 東京", "大豆户 东京"),
    (9, "", "为了阿清，我でも想回到江户。", "为了阿清，我也想回到江户。"), (10, "", "就算有手癖不好控制，でも我还是喜欢阿清啊。", "就算有手癖不好控制，我还是喜欢阿清啊。"), (11, "", "今年的《生きて明日なく》非常出色。", "今年的《活着却无明日》非常出色。"), (12, "", "关于柚木ミドリ的事情则保持沉默。", "关于柚木绿的事情则保持沉默。"),
    (13, "お仲という女が来た。", "お仲来了。", "阿仲来了。"), (14, "", "「她」说『好』[[ja:「はい」]]", "“她”说“好”[[ja:「はい」]]"), (15, "", None, ""), (16, "", " plain ", "plain"),
)


@case(f"SELECT k, repaired FROM {REPAIRS.sql}")
def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20 to Q30: repairs in their order, by their known results (rows 13 to 16 by the rule)."""
    return REPAIRS.df(spark).select("k", quality.repaired(F.col("source"), F.col("text")).alias("repaired"))


@case("""SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, true), (6, true), (7, false)) AS v(k, incomplete)""")
def q_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "彼女", " "), (2, "source", "她は笑った。"), (3, "彼女は笑った。", "她笑了。"), (4, "「漢字」", "「漢字」"), (5, "彼女は笑った。そして走った。", "彼女は笑った。そして走った。"), (6, "s", "没有设置时钟的，是や行的'い'和'え'，それからわ行的'う'。"), (7, "source", "可若是只取每个字的首音连起来，便是コ、ニ、シ、ノ、ソ、ノ、シ、ニ。")]
    return quality.incomplete(spark.createDataFrame(rows, "k int, s string, d string"), "s", "d").select("k", "incomplete")


@case("SELECT * FROM (VALUES (1, false), (2, false), (3, false), (4, true)) AS v(k, blocking)")
def q_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality.allowlist('{"quoted": ["べん", "べんぞう", "〈ちゆりつぷ〉", "おじご"], "exact": [], "quoted_regex": ["("], "regex": []}')
    rows = [(1, "弥一郎写的“べん”和阿里说的“弁蔵”是同一个字。べんぞう是个人的名字，应该写作弁藏。"), (2, "国定忠治称呼年长十七岁的荣五郎为“おじご”，一眼就能看出关系不一般。"), (3, "纸上歪歪扭扭地排列着“ちゆりつぷ”、〈ちゆりつぷ〉之类的文字。"), (4, "她说‘明日は学校へ行きます’，然后离开。")]
    return quality.classified(spark.createDataFrame(rows, "k int, text string"), "text", user=own).select("k", "residue.blocking")


@case("SELECT CAST(3 AS BIGINT) AS n, '「一」|すべて' AS before, '“一”|全部' AS after")
def q_save_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31: text nodes that repairs change, with the first of them."""
    rows = [(0, "p", "「一」"), (1, "script", "「二」"), (2, "p", "すべて"), (3, "p", "三"), (4, "p", "「四」")]
    found = quality.repair_nodes(spark.createDataFrame(rows, "seq int, tag string, text string"), "seq", first=2)
    said = lambda side: F.array_join(F.transform("samples", lambda x: x[side]), "|").alias(side)
    return found.select("n", said("before"), said("after"))


@query(f"""
WITH p AS (SELECT conv_id * 1000 + turn AS k, text AS src, 'ZH:' || text AS dst FROM conversations UNION ALL SELECT * FROM (VALUES (-1, '声が遠い', '远处有个声音说着什么话语啊'), (-2, '行くのに。', '他的书的家的门开着没有人在那里'), (-3, 'x', '12%'), (-4, 'abcdef', '「」')) v)
SELECT k, trim(dst) = '' OR length(src) <= 5 AND length(trim(dst)) <= 5 OR regexp_matches(trim(dst), '^[、。！？…\\s]*$') OR regexp_matches(trim(dst), '^\\d+[%％]?$') OR regexp_matches(trim(dst), '^[A-Za-z0-9\\s]+$') OR regexp_matches(trim(dst), '^[「」『』\\s]*$') AS skip,
       CASE k WHEN -1 THEN 'style,sense' WHEN -2 THEN 'style,turn' ELSE '' END AS stiff FROM p
""")
def q_proofread_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that need no second look, and what sounds translated."""
    own = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("text").alias("src"), F.concat(F.lit("ZH:"), F.col("text")).alias("dst"))
    more = spark.createDataFrame([(-1, "声が遠い", "远处有个声音说着什么话语啊"), (-2, "行くのに。", "他的书的家的门开着没有人在那里"), (-3, "x", "12%"), (-4, "abcdef", "「」")], "k long, src string, dst string")
    both = own.unionByName(more)
    return both.select("k", T.skips_proofreading(F.col("src"), F.col("dst")).alias("skip"), F.array_join(T.stiff_style(F.col("src"), F.col("dst")), ",").alias("stiff"))


# --- glossary -----------------------------------------------------------------------------------------------------------

MORE_TERMS = Fixture(
    "category string, ord int, original string, translation string, source string, info string, policy string, aliases array<string>",
    ("Person", 0, "ローラ", "劳拉", "", "主角", "", ["萝拉"]), ("Person", 1, "！", "？", "", "", "force", []), ("Location", 0, "日の下町", "日之下町", "auto", "", "", []), ("Item", 0, "グラス", "玻璃杯", "", "", "", []), ("Item", 1, "アシビ", "马醉木", "manual", "已确认", "", ["x", "马醉"]),
    ("Item", 2, "剣道具", "剑具", "", "参考用", "", None), ("Skill", 0, "ABC", "甲乙", "", "", "保留", []), ("Item", 3, "サングラスケース", "墨镜盒", "user", "", "", []), ("Creature", 0, "竜", "龙", "自动提取", "", "忽略", ["大龙"]), ("Org", 0, "鉄道会社", "铁路公司", "", "x", "上下文", []),
)
_LEVEL = f"""CASE WHEN NOT regexp_matches(original, '[A-Za-z0-9\\x{{3040}}-\\x{{30ff}}\\x{{31f0}}-\\x{{31ff}}\\x{{3400}}-\\x{{9fff}}]') OR NOT regexp_matches(translation, '[A-Za-z0-9\\x{{3040}}-\\x{{30ff}}\\x{{31f0}}-\\x{{31ff}}\\x{{3400}}-\\x{{9fff}}]') THEN 'ignore'
WHEN policy IN ({_in(glossary.POLICIES['force'])}) THEN 'force' WHEN policy IN ({_in(glossary.POLICIES['reference'])}) THEN 'reference' WHEN policy IN ({_in(glossary.POLICIES['contextual'])}) THEN 'contextual' WHEN policy IN ({_in(glossary.POLICIES['preserve'])}) THEN 'preserve' WHEN policy IN ({_in(glossary.POLICIES['ignore'])}) THEN 'ignore'
WHEN regexp_matches(lower(source || ' ' || info), 'force|confirmed|强制|固定|已确认') THEN 'force' WHEN lower(trim(source)) IN ('auto', '自动提取', 'reference', 'ref', 'weak', 'suggestion') OR regexp_matches(lower(source || ' ' || info), '参考|弱|多义|普通名词|不强制|reference-only') THEN 'reference'
WHEN category <> 'Item' THEN 'force' WHEN length(original) <= 4 AND regexp_matches(original, '[\\x{{30a0}}-\\x{{30ff}}]') THEN 'reference' ELSE 'force' END"""


@case(f"""SELECT ord, category, original, {_LEVEL} AS level, CASE WHEN {_LEVEL} = 'preserve' THEN original ELSE translation END AS wanted,
original || '->' || CASE policy WHEN '保留' THEN original ELSE translation END || CASE WHEN policy = '' AND info = '' OR policy = '忽略' AND info = '' THEN '' ELSE ' #' || concat_ws('；', CASE policy WHEN 'force' THEN '强制使用' WHEN '保留' THEN '保留原文不翻译' WHEN '上下文' THEN '仅在上下文符合时使用' END, nullif(info, '')) END AS line FROM {MORE_TERMS.sql}""")
def q_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How binding terms are, what they should read, and their lines in a prompt."""
    c = F.col
    level = glossary.enforcement(c("original"), c("translation"), c("category"), c("source"), c("info"), c("policy"))
    return MORE_TERMS.df(spark).select("ord", "category", "original", level.alias("level"), consistency.expected(c("translation"), c("original"), level).alias("wanted"), glossary.prompt_line(c("original"), c("translation"), c("policy"), c("info")).alias("line"))


@case(f"""SELECT match, arg_min(translation, list_position([{_in(glossary.CATEGORIES)}], category) * 100 + ord) AS translation FROM (SELECT unnest(list_concat([original], coalesce(aliases, []))) AS match, translation, category, ord FROM {MORE_TERMS.sql} WHERE policy NOT IN ('保留', '忽略')) WHERE length(match) >= 2 AND match <> translation GROUP BY match""")
def q_post_apply_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is replaced after the fact, with aliases."""
    return glossary.replacement_terms(MORE_TERMS.df(spark).withColumn("policy", glossary.policy(F.col("policy"))))


@case(f"SELECT count(*) FILTER (lower(trim(source)) IN ('auto', '自动提取')) AS auto, count(*) FILTER (trim(source) NOT IN ('', 'auto', '自动提取')) AS manual, count(*) FILTER (trim(source) = '') AS unknown FROM {MORE_TERMS.sql}")
def q_glossary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by where they come from."""
    return glossary.source_statistics(MORE_TERMS.df(spark))


@case(f"SELECT category, count(*) AS n FROM {MORE_TERMS.sql} GROUP BY category")
def q_glossary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by category."""
    return MORE_TERMS.df(spark).groupBy("category").agg(F.count("*").alias("n"))


CANDIDATES = Fixture(
    "ord int, src string, dst string, category string, info string, source string, policy string, aliases string",
    (0, "は、ローラ", "劳拉", "角色", "", None, "", None), (1, "ローラ", "萝拉", "Person", "", "", "", "罗拉、劳拉"), (2, "はるか", "遥香", "人物", "", "", "", None), (3, "剣", "剑客", "", "", "", "", None), (4, "魔王", "大魔王", "", "", "", "", None), (5, "鬼人", "鬼", "怪物", "", "", "", None),
    (6, "鬼人", "鬼人族", "Item", "", "user", "强制", "鬼族"), (7, "鬼人", "恶鬼", "生物", "", "", "", None), (8, None, "x", "", "", "", "", None), (9, "道具箱", "工具箱", "odd", "i", "", "ref", None), (10, "道具箱", "工具盒", "技能", "", "", "", None),
)


@case("""SELECT * FROM (VALUES (0, 'ローラ', '劳拉', 'Person', 'auto', '', '萝拉|罗拉'), (2, 'はるか', '遥香', 'Person', 'auto', '', ''), (6, '鬼人', '鬼人族', 'Creature', 'user', 'force', '鬼族|恶鬼'), (9, '道具箱', '工具箱', 'Skill', 'auto', 'reference', '工具盒')) AS v(ord, original, translation, category, source, policy, aliases)""")
def q_clean_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.cleaned(CANDIDATES.df(spark)).select("ord", "original", "translation", "category", "source", "policy", F.array_join("aliases", "|").alias("aliases"))


@case(f"""
WITH old AS (SELECT original, translation FROM {X.TERMS.sql}), new AS (SELECT * FROM (VALUES ('ローラ', '劳拉'), ('はるか', '遥香'), ('鬼人', '鬼人族')) v(original, translation))
SELECT original, translation, 'kept' AS outcome FROM old UNION ALL SELECT original, translation, 'added' FROM new ANTI JOIN old USING (original)
""")
def q_glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted candidates merged into a glossary; persons, places and creatures only."""
    old = X.TERMS.df(spark).withColumn("aliases", F.array().cast("array<string>"))
    return glossary.extracted(CANDIDATES.df(spark), old, lite=True).select("original", "translation", "outcome")


@case("SELECT * FROM (VALUES (1, 'グラス->玻璃杯')) AS v(id, invalid)")
def q_invalid_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q34: translations that a revision brings in for a term inside a longer word."""
    rows = [(1, "サングラスをかけた", "戴上墨镜", "戴上玻璃杯"), (2, "グラスを置いた", "放下杯子", "放下玻璃杯"), (3, "サングラス", "玻璃杯", "玻璃杯 x"), (4, "サングラス", "x", "y")]
    found = glossary.invalid_injections(spark.createDataFrame(rows, "id int, source string, draft string, revised string"), MORE_TERMS.df(spark))
    return found.select("id", F.array_join("invalid", "|").alias("invalid"))


@case("SELECT * FROM (VALUES (1, 'ローラ', '劳拉', 'missing'), (2, 'ABC', 'ABC', 'not_preserved'), (4, 'サングラスケース', '墨镜盒', 'missing')) AS v(id, original, wanted, issue)")
def q_proofread_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q33: binding terms that a translation lacks."""
    rows = [(1, "ローラが来た", "萝拉来了"), (2, "ABCです", "是甲乙"), (3, "ローラ", "劳拉"), (4, "サングラスケース", "眼镜盒"), (5, "グラス", "杯"), (6, "ローランド", "x"), (7, "竜", "y")]
    return glossary.proofread_issues(spark.createDataFrame(rows, "id int, source string, target string"), MORE_TERMS.df(spark).drop("source", "info"))


@case("SELECT true AS ok, CAST(5 AS BIGINT) AS n, CAST(3 AS BIGINT) AS texts")
def q_book_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary applied to the text nodes and titles of a finished book; each term works on the outcome of longer ones, so that an alias inside a translation counts again."""
    nodes = spark.createDataFrame([("a", 0, "萝拉和萝拉"), ("a", 1, "没有"), ("b", 0, "アシビ开了")], "file string, pos int, text string")
    own = MORE_TERMS.df(spark).withColumn("policy", glossary.policy(F.col("policy")))
    return glossary.applied_to_book(nodes, spark.createDataFrame([(0, "ローラ")], "pos int, text string"), own)[1]


@case("SELECT * FROM (VALUES ('a', true), ('b', true), ('c', false)) AS v(profile, same)")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal glossaries in another order, or with other aliases, have one fingerprint; another translation has another."""
    base = MORE_TERMS.df(spark).select("category", "ord", "original", "translation", "policy")
    other = base.withColumn("translation", F.when(F.col("original") == "竜", "蛟").otherwise(F.col("translation")))
    every = base.withColumn("profile", F.lit("a")).unionByName(base.orderBy(F.rand(4)).withColumn("profile", F.lit("b"))).unionByName(other.withColumn("profile", F.lit("c")))
    prints = glossary.fingerprint(every)
    first = prints.where("profile = 'a'").select(F.col("fingerprint").alias("f"))
    return prints.crossJoin(F.broadcast(first)).select("profile", (F.col("fingerprint") == F.col("f")).alias("same"))


@case("SELECT * FROM (VALUES ('book', 'My  Book!', 2), ('genre', 'sci fi', 4), ('book', 'none', NULL)) AS v(scope, name, id)")
def q_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by scope and name, the latest of each."""
    own = spark.createDataFrame([("book", "my book", 5, 1, 1), ("book", "My-Book", 9, 1, 2), ("series", "my book", 99, 1, 3), ("genre", "Sci-Fi", None, 7, 4)], "scope string, name string, updated_at int, created_at int, id int")
    return glossary.profiles_by_name(glossary.listed_profiles(own), spark.createDataFrame([("book", "My  Book!"), ("genre", "sci fi"), ("book", "none")], "scope string, name string"))


@query(f"SELECT doc_id AS id, coalesce(string_agg(original || '->' || translation, chr(10) ORDER BY original) FILTER (original IS NOT NULL), '无术语表。') AS prompt FROM (SELECT doc_id, original, translation FROM documents LEFT JOIN (SELECT * FROM {_TERMS} WHERE contains(original, ' ')) ON contains(text, original) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(original) DESC, instr(text, original), original) = 1) GROUP BY doc_id")
def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt line of the longest phrase that a document holds."""
    docs = table(spark, sf_dir, "documents")
    terms = _terms(spark, sf_dir).where(F.contains("original", F.lit(" ")))
    chosen = glossary.selected(glossary.matches(docs, terms, "doc_id", "text"), 1)
    return glossary.prompts(chosen, terms.withColumn("policy", F.lit("")).withColumn("info", F.lit("")), docs.select(F.col("doc_id").alias("id")))


@case("SELECT category, original, CASE WHEN takes THEN new ELSE translation END AS translation, CASE WHEN takes THEN 'consistency_fix' ELSE source END AS source FROM (SELECT *, translation IS NULL AS takes FROM (VALUES ('Person', 'ローラ', '罗拉', 'manual')) e(category, original, translation, source) FULL JOIN (VALUES ('Person', 'ローラ', '劳拉'), ('Person', 'まっちょ', '小真')) p(category, original, new) USING (category, original))")
def q_plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan merged into a glossary, whose own entries win."""
    plan = spark.createDataFrame([("Person", "ローラ", "apply", "劳拉"), ("Person", "まっちょ", "apply", "小真"), ("Item", "x", "review", None)], "category string, original string, action string, translation string")
    return consistency.merged_plan(spark.createDataFrame([("Person", "ローラ", "罗拉", "manual")], "category string, original string, translation string, source string"), plan)


@case("SELECT * FROM (VALUES ('Person', 'ローラ=劳拉(萝拉);まっちょ=小真(阿肌)')) AS v(category, terms)")
def q_plan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the updates of book 1 and of a book with two clear renderings as glossary terms."""
    pairs = X.PAIRS.df(spark).where("book in (1, 4)").unionByName(X.PAIRS.df(spark).where("book = 4 and seq = 1").withColumn("seq", F.lit(9)))
    found = consistency.plan_terms(consistency.checked(pairs.withColumn("book", F.lit(1)).withColumn("seq", F.monotonically_increasing_id()), X.TERMS.df(spark)))
    one = F.transform("terms", lambda t: F.concat(t["original"], F.lit("="), t["translation"], F.lit("("), F.array_join(t["aliases"], ","), F.lit(")")))
    return found.select("category", F.array_join(one, ";").alias("terms"))  # of one book


@case("SELECT * FROM (VALUES (6, 0, '劳拉，哭了。', 0), (6, 1, '「劳拉」等等。', 1), (6, 2, '劳拉和劳拉和劳拉。', 2), (6, 5, '劳拉ain-A·b', 1), (6, 6, '好', 0), (1, 0, '劳拉笑了。', 1)) AS v(book, seq, target, replaced)")
def q_presave_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergent renderings found and made one before a save."""
    own = X.PAIRS.df(spark).where("book = 6 and source like '%ローラ%' or book = 1 and seq = 0")
    return consistency.unified_before_save(own.withColumn("seq", F.col("seq") + 100 * F.col("book")).withColumn("b", F.col("book")).withColumn("book", F.lit(1)), X.TERMS.df(spark)).select(F.floor(F.col("seq") / 100).cast("int").alias("book"), (F.col("seq") % 100).alias("seq"), "target", "replaced")


#: Answers that begin with one of three words, and three terms that questions hold, in books that are conversations.
_RENDERED = [("the", "ALPHA"), ("der", "BETA"), ("que", "GAMMA")]
_HEADS = """
pairs AS (SELECT a.conv_id AS book, a.turn AS seq, a.text AS source, CASE (a.conv_id + a.turn) % 5 WHEN 0 THEN 'ALFA' WHEN 1 THEN 'BETAX' WHEN 2 THEN 'GAMMA' ELSE 'ALPHA' END AS head, b.text AS said
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE trim(a.text) <> ''),
answers AS (SELECT *, head || '。' || said AS target FROM pairs),
terms AS (SELECT * FROM (VALUES (0, 'the', 'ALPHA'), (1, 'der', 'BETA'), (2, 'que', 'GAMMA')) v(ord, original, wanted)),
met AS (SELECT *, contains(target, wanted) AS hit, CASE WHEN contains(target, wanted) THEN wanted ELSE left(head, least(length(wanted), 8)) END AS rendering FROM answers JOIN terms ON contains(source, original)),
counted AS (SELECT book, ord, original, wanted, rendering, hit, count(*) AS n, min(seq) AS first FROM met GROUP BY ALL),
terms_of AS (SELECT book, ord, original, wanted, list(rendering ORDER BY n DESC, NOT hit, first, rendering) AS all_of, max(n) AS top FROM counted GROUP BY ALL HAVING bool_or(hit) AND count(*) > 1)
"""


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    k = (F.col("book") + F.col("seq")) % 5
    head = F.when(k == 0, "ALFA").when(k == 1, "BETAX").when(k == 2, "GAMMA").otherwise("ALPHA")
    asked = c.where("trim(text) <> ''").select(F.col("conv_id").alias("book"), F.col("turn").alias("seq"), F.col("text").alias("source"))
    pairs = asked.join(c.select(F.col("conv_id").alias("book"), (F.col("turn") - 1).alias("seq"), F.col("text").alias("said")), ["book", "seq"])
    terms = spark.createDataFrame([("Item", n, o, w, "") for n, (o, w) in enumerate(_RENDERED)], "category string, ord int, original string, translation string, policy string")
    return pairs.withColumn("target", F.concat(head, F.lit("。"), "said")).drop("said"), terms


@query(f"WITH {_HEADS} SELECT book, string_agg(original || '=' || all_of[1] || '(' || array_to_string(all_of[2:], ',') || ')', ';' ORDER BY ord) AS terms FROM terms_of WHERE top >= 2 GROUP BY book")
def q_books_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's divergent terms, and what its own glossary would say."""
    found = consistency.plan_terms(consistency.checked(*_books(spark, sf_dir)))
    one = F.transform("terms", lambda t: F.concat(t["original"], F.lit("="), t["translation"], F.lit("("), F.array_join(t["aliases"], ","), F.lit(")")))
    return found.select("book", F.array_join(one, ";").alias("terms"))


@query(f"""
WITH {_HEADS},
variants AS (SELECT book, ord, original, wanted, unnest(all_of) AS variant FROM terms_of),
safe AS (SELECT * FROM variants v WHERE variant <> wanted AND NOT contains(wanted, variant) AND length(variant) >= 2 AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.original <> v.original AND contains(t.wanted, v.variant))),
strong AS (SELECT book, original, count(*) FILTER (hit) AS held FROM met GROUP BY ALL HAVING held >= 2),
steps AS (SELECT book, seq, list(variant || '|' || safe.wanted ORDER BY safe.ord, length(variant) DESC, variant) AS steps FROM met JOIN safe USING (book, original) JOIN strong USING (book, original) GROUP BY book, seq)
SELECT book, seq, list_reduce(coalesce(steps, []), lambda a, s: replace(a, split_part(s, '|', 1), split_part(s, '|', 2)), target) AS target FROM answers LEFT JOIN steps USING (book, seq)
""")
def q_books_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's divergent renderings made one before a save, and no other conversation's."""
    return consistency.unified_before_save(*_books(spark, sf_dir)).select("book", "seq", "target")


# --- control ------------------------------------------------------------------------------------------------------------

_KINDS = "CASE WHEN user_id % 3 = 0 THEN 'rate' WHEN user_id % 3 = 1 THEN 'timeout' ELSE 'format' END"


@query(f"""
WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS ord, {_KINDS} AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events WHERE value > 40),
s AS (
  SELECT key, ord, kind, place, 16 AS w, 24 AS b, 0 AS n, 0 AS f, CAST(0 AS DOUBLE) AS pause, true AS start FROM (SELECT key, CAST(0 AS BIGINT) AS ord, '' AS kind, 0 AS place FROM e GROUP BY key)
  UNION ALL
  SELECT e.key, e.ord, e.kind, e.place, greatest(1, CAST(floor(s.w * CASE e.kind WHEN 'rate' THEN 0.6 WHEN 'timeout' THEN 0.75 ELSE 0.85 END + 0.999) AS INTEGER)),
         CASE WHEN e.kind = 'format' AND (s.f >= 2 OR s.b <= 3) THEN 1 ELSE greatest(1, CAST(floor(s.b * CASE e.kind WHEN 'rate' THEN 0.7 WHEN 'timeout' THEN 0.75 ELSE 0.5 END + 0.999) AS INTEGER)) END,
         s.n + 1, s.f + CASE e.kind WHEN 'format' THEN 1 ELSE 0 END,
         CAST(CASE e.kind WHEN 'format' THEN least(20.0, 1.5 * (s.f + 1)) WHEN 'timeout' THEN least(45.0, pow(2.0, least(s.n + 1, 5))) ELSE least(60.0, pow(2.0, least(s.n + 1, 5))) END AS DOUBLE), false
  FROM s JOIN e ON e.key = s.key AND e.place = s.place + 1
)
SELECT key, ord, kind, w AS workers, b AS batch, CAST(pause AS DOUBLE) AS pause FROM s WHERE NOT start
""")
def q_limiter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: what failures leave of workers and batches, over events as failures."""
    kind = F.when(F.col("user_id") % 3 == 0, "rate").when(F.col("user_id") % 3 == 1, "timeout").otherwise("format")
    own = table(spark, sf_dir, "events").where("value > 40").withColumn("kind", kind)
    return runs.failure_limits(own, "event_type", "event_id", "kind", 16, 24)


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS s, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN event_id % 700 ELSE 0 END AS pause FROM events)
SELECT event_id, round(greatest(0.0, coalesce(max(CASE WHEN pause > 0 THEN s + pause END) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - s, 0.0)), 3) AS held FROM e
""")
def q_global_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: how long pauses that earlier requests asked for hold each back."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    pause = F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), F.col("event_id") % 700).otherwise(0)
    return runs.global_pause(e, "event_type", "event_id", F.col("s"), pause).select("event_id", F.round("held", 3).alias("held"))


# --- cache --------------------------------------------------------------------------------------------------------------

@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL) OR text IS NULL")
def q_clear_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after those of every tenth document's text went, in whatever form the key is."""
    docs = table(spark, sf_dir, "documents")
    form = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).otherwise(F.md5("text"))
    entries = docs.select("doc_id", F.lit(None).cast("string").alias("source_hash"), form.alias("cache_key"))
    return cache.without_texts(entries, docs.where("doc_id % 10 = 0"), "text").select("doc_id")


# --- history ------------------------------------------------------------------------------------------------------------

_PARTS = "(SELECT conv_id AS task_id, turn AS index, text AS source, CASE turn % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CASE turn % 4 WHEN 0 THEN 'done' ELSE '' END AS translation, CASE turn % 4 WHEN 1 THEN 'timeout' ELSE '' END AS reason FROM conversations)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("turn") % 4
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("index"), F.col("text").alias("source"), F.when(four == 0, "success").when(four == 1, "failed").otherwise("pending").alias("status"),
        F.when(four == 0, "done").otherwise("").alias("translation"), F.when(four == 1, "timeout").otherwise("").alias("reason"),
    )


@query(f"""
WITH p AS {_PARTS}, a AS (SELECT DISTINCT task_id, source FROM p WHERE index % 2 = 0 OR task_id % 3 = 0), m AS (SELECT p.*, a.source IS NOT NULL AND status <> 'success' AS changed FROM p LEFT JOIN a USING (task_id, source))
SELECT task_id, index, CASE WHEN changed THEN 'success' ELSE status END AS status, CASE WHEN changed THEN 'ZH' ELSE translation END AS translation, CASE WHEN changed THEN '' ELSE reason END AS reason, changed FROM m
""")
def q_mark_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tasks after answers came for some sources."""
    parts = _parts(spark, sf_dir)
    answers = parts.where("index % 2 = 0 or task_id % 3 = 0").select("task_id", "source", F.lit("ZH").alias("translation"))
    return runs.marked_success(parts, answers).drop("source")


@query(f"""
WITH p AS {_PARTS}, b AS (SELECT DISTINCT task_id, source FROM p WHERE index % 3 = 0), m AS (SELECT p.*, b.source IS NOT NULL AS changed FROM p LEFT JOIN b USING (task_id, source))
SELECT task_id, index, CASE WHEN changed THEN 'residue' ELSE status END AS status, translation, CASE WHEN changed THEN 'kana left' ELSE reason END AS reason, changed FROM m
""")
def q_mark_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tasks after some were found wrong."""
    parts = _parts(spark, sf_dir)
    blocks = parts.where("index % 3 = 0").select("task_id", F.col("source").alias("text"), F.lit("residue").alias("kind"), F.lit(" kana  left ").alias("reason"), F.lit("").alias("translation"), F.col("index").alias("ord"))
    return runs.marked_problem(parts, blocks).drop("source")


@query(f"SELECT task_id, CASE WHEN task_id % 2 = 0 THEN NULL ELSE count(*) END AS subtask_count FROM {_PARTS} GROUP BY task_id")
def q_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of finished tasks are only counted."""
    parts = _parts(spark, sf_dir)
    tasks = parts.select("task_id").distinct().withColumn("status", F.when(F.col("task_id") % 2 == 0, " Running").otherwise("finished"))
    return runs.compacted(tasks, parts).select("task_id", "subtask_count")


@case("""SELECT * FROM (VALUES (1, 0, 'failed', 'a b', '未返回安全译文', '', ''), (1, 1, 'residue', 'src', 'r', 'dst', 'あ|い'), (1, 2, 'save_residue', 'body text', '保存前检查发现高风险日文残留', 'body text', 'x|y z'), (2, 0, 'save_residue', 'bare', '保存前检查发现高风险日文残留', 'bare', '')) AS v(task_id, ord, kind, text, reason, translation, fragments)""")
def q_block_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed blocks from three inputs."""
    schema = "task_id int, ord int, text string, reason string, translation string, fragments array<string>"
    failed = spark.createDataFrame([(1, 0, " a  b ", "", None, None), (1, 1, "a b", "again", "", []), (1, 2, " ", "x", "", [])], schema)
    residue = spark.createDataFrame([(1, 0, "src", "r", "dst", ["あ", " い ", "あ", ""])], schema)
    samples = spark.createDataFrame([(1, 0, "fragment: x / y  z | text: body text"), (2, 0, "bare")], "task_id int, ord int, sample string")
    return runs.normalised_blocks(failed, residue, samples).withColumn("fragments", F.array_join("fragments", "|"))


@case("SELECT CAST(4 AS BIGINT) AS attempted, CAST(1 AS BIGINT) AS success, CAST(2 AS BIGINT) AS needs_review, CAST(1 AS BIGINT) AS failed")
def q_recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return runs.recovery_summary(spark.createDataFrame([("a", "success"), ("b", "needs_review"), ("c", ""), ("d", "boom"), (" ", "success")], "source string, status string"))


@case("SELECT * FROM (VALUES (1, 'success', 'ZH:abc'), (2, 'needs_review', NULL), (3, 'needs_review', NULL), (4, 'success', 'お x 这里有很多很多的中文字'), (5, 'success', '全部'), (6, 'success', 'second'), (7, 'needs_review', NULL)) AS v(key, status, answer)")
def q_recovery_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoveries carried out with a stub provider and a second one."""
    rows = [(1, "abc", "", "timeout", "retry", 0), (2, "abc", "", "timeout", "retry", 2), (3, " ", "", "timeout", "retry", 0), (4, "s", "お x 这里有很多很多的中文字", "residue_low", "accept_review", 0), (5, "s", "すべて", "residue_high", "repair", 0), (6, "abc", "", "provider_error", "switch_provider", 1), (7, "abc", "", "moderation", "manual_review", 0)]
    df = spark.createDataFrame(rows, "key int, source string, translation string, issue string, action string, attempts int")
    return enrich.executed(df, enrich.stub, lambda texts: ["second"] * len(texts)).select("key", "status", "answer")


@query("SELECT lang AS batch, count(*) AS books, count(*) FILTER (doc_id % 4 > 0) AS ok, count(*) FILTER (doc_id % 4 = 0) AS failed, CAST(sum(n_chars) AS BIGINT) AS texts, CAST(sum(doc_id % 7) AS BIGINT) AS terms, count(DISTINCT source) AS paths FROM documents GROUP BY lang")
def q_multi_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of many books rolled up, sources as paths."""
    own = table(spark, sf_dir, "documents").select(F.col("lang").alias("batch"), F.col("doc_id").alias("ord"), F.col("source").alias("path"), (F.col("doc_id") % 4 > 0).alias("ok"), F.col("n_chars").alias("texts"), (F.col("doc_id") % 7).alias("terms"))
    return runs.multi_book(own).withColumn("paths", F.size("paths").cast("long"))


@case("SELECT * FROM (VALUES ('a', CAST(3 AS BIGINT), CAST(1 AS BIGINT), 'failed: t one — timeout'), ('b', 1, 0, 'failed: t one — empty')) AS v(task_id, failed, residue, line)")
def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a task's first block says."""
    return runs.diagnostics(X.BLOCKS.df(spark)).select("task_id", "failed", "residue", F.get("lines", F.lit(0)).alias("line"))


# --- titles, replies, styles --------------------------------------------------------------------------------------------

NAMES = Fixture(
    "k int, candidate string, name string, title string",
    (1, "恐怖 角川恐怖文库精选集(恒川光太郎、坂东真砂子、宇佐美诚（颇 _ 或依意译处理为其它合适名，但没更多信息，这里保留“诚”的翻译 ）、小林泰三、竹本健治、小松左京等)", "恐怖 角川恐怖文库精选集(恒川光太郎、坂东真砂子、宇佐美诚、小林泰三、竹本健治、小松左京等)", None),
    (2, "究極の純爱小説を、君に", "", None), (3, "献给你的终极纯爱小说", "献给你的终极纯爱小说", "献给你的终极纯爱小说"),
    (4, "尼俄泊（尼俄柏之穴的简写（译者注），尼俄柏是希腊神话中坦塔罗斯之女，因炫耀自己的子女，悲叹七子七女被阿波罗和阿尔忒弥斯射杀，悲痛永无止息，身体化作泉水，永远流动。） 恒川光太郎\n\n【前文（无需翻译）】\n《正月女》 坂东真砂子\n\n【后文（无需翻译）】\n《某个堕落者的死亡》 平山梦明", None, "尼俄泊"),
    (5, "抱歉，无法翻译。", "", ""), (6, None, "", ""), (7, "a/b: 书.epub", "a_b_ 书", None), (8, "CON.x", "CON.x_", None), (9, "标题：新书等内容", None, "新书"),
)


@case(f"SELECT k, name, title FROM {NAMES.sql}")
def q_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and titles made safe; columns that a row leaves open are null on both sides."""
    own = NAMES.df(spark)
    return own.select("k", F.when(F.col("name").isNotNull(), titles.safe_name(F.col("candidate"))).alias("name"), F.when(F.col("title").isNotNull(), titles.clean_title(F.col("candidate"))).alias("title"))


@case("SELECT * FROM (VALUES (1, 'book', 'good', true, false, '浅仓学'), (2, 'a', '', false, true, 'x')) AS v(k, stem, safe, japanese, chinese, simple)")
def q_title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of files, the first safe of two proposals, scripts, simplified names."""
    own = spark.createDataFrame([(1, "book+(site) x", "抱歉，无法翻译", "good", "かな", "淺倉學"), (2, " a＋(b)", "かな", None, "书 A", "x")], "k int, stem string, one string, two string, title string, name string")
    c = F.col
    return own.select("k", titles.source_title(c("stem")).alias("stem"), titles.first_safe([c("one"), c("two")]).alias("safe"), titles.japanese_title(c("title")).alias("japanese"), titles.chinese_title(c("title")).alias("chinese"), titles.simplified(c("name")).alias("simple"))


@case("""SELECT * FROM (VALUES (1, 'stop', CAST(12 AS BIGINT), 'https://a/v1/chat/completions', '译文', false), (2, NULL, NULL, 'https://b/chat/completions', '好', true), (3, 'length', NULL, 'https://c/v1/chat/completions', 'fallback', false), (4, NULL, NULL, '', 'x', false)) AS v(k, finish, tokens, url, answer, newer)""")
def q_reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of replies, addresses, answers without notes, versions."""
    rows = [
        (1, '{"choices": [{"finish_reason": "stop"}], "usage": {"total_tokens": 12}}', " https://a/v1/ ", "```text\n译文：译文\n```", "1.2", "1.10"), (2, "[]", "https://b/chat/completions", "好（说明：改了）", "2.0.1", "2.0"),
        (3, '{"choices": [{"finish_reason": "length"}], "usage": {"total_tokens": -1}}', "https://c/v1/chat", "说明：全是", "1", "1.0.0"), (4, "broken", "", "x\n修改说明：y", "v3", "3"),
    ]
    own = spark.createDataFrame(rows, "k int, reply string, url string, said string, version string, current string")
    c = F.col
    return own.select("k", T.finish_reason(c("reply")).alias("finish"), T.usage_tokens(c("reply")).alias("tokens"), T.endpoint(c("url")).alias("url"), T.proofread_answer(c("said"), F.lit("fallback")).alias("answer"), T.newer(c("version"), c("current")).alias("newer"))


@query("""
WITH d AS (SELECT doc_id AS id, text || repeat('「啊！」', CAST(doc_id % 9 AS INTEGER)) AS t, doc_id % 40 AS light0, doc_id % 23 AS literary, doc_id % 6 AS gs, CAST(30 * (doc_id % 4) AS INTEGER) AS conf FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, CAST(least(20, floor(2 * (id % 9) * 1800 / greatest(1, length(regexp_replace(t, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g'))))) + least(10, id % 9 + (length(text0) - length(replace(text0, '!?', ''))) / 2) AS INTEGER) AS dialogue FROM d JOIN (SELECT doc_id AS id, text AS text0 FROM documents) USING (id)),
p AS (SELECT *, light0 + dialogue AS light, gs > 0 AND conf >= 60 AS sure FROM s),
q AS (SELECT *, CASE WHEN sure THEN 'mystery' ELSE 'general' END AS genre, CASE WHEN light >= greatest(8, literary + 3) THEN 'light' WHEN literary >= 10 THEN 'literary' ELSE 'neutral' END AS tone FROM p),
r AS (SELECT *, CAST(round_even((CASE WHEN sure THEN conf WHEN gs > 0 THEN 40 ELSE 0 END) * CAST(0.65 AS DOUBLE) + (CASE tone WHEN 'light' THEN least(100, light * 6) WHEN 'literary' THEN least(100, literary * 7) ELSE 50 END) * CAST(0.35 AS DOUBLE), 0) AS INTEGER) AS mixed FROM q)
SELECT id, dialogue, CASE WHEN id % 5 = 0 THEN 'scifi' ELSE genre END AS genre, tone, CASE WHEN id % 5 = 0 THEN 100 WHEN genre = 'general' AND tone = 'neutral' THEN least(mixed, 50) ELSE mixed END AS confidence FROM r
""")
def q_style_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much documents talk, the tone and confidence that scores give, and a user's choice."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    i = F.col("doc_id")
    talk = runs.dialogue_score(F.concat("text", F.repeat(F.lit("「啊！」"), (i % 9).cast("int"))))
    genre, tone, confidence = runs.detected(F.lit("mystery"), i % 6, (30 * (i % 4)).cast("int"), i % 40 + talk, i % 23)
    own = docs.select(i.alias("id"), talk.alias("dialogue"), genre.alias("g"), tone.alias("t"), confidence.alias("c"))
    g, t, c = runs.chosen(F.when(F.col("id") % 5 == 0, "scifi").otherwise("auto"), F.lit("auto"), F.col("g"), F.col("t"), F.col("c"))
    return own.select("id", "dialogue", g.alias("genre"), t.alias("tone"), c.cast("int").alias("confidence"))


@case("SELECT * FROM (VALUES (1, 'T' || chr(10) || 'one' || chr(10) || 'abcdefghij' || chr(10) || 'klm'), (2, 'abcdefghijklmnopqrst'), (3, 'T')) AS v(k, context)")
def q_style_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, contents and samples up to a number of characters."""
    own = spark.createDataFrame([(1, "T", ["one", " "], ["abcdefghij", "klm", "never"]), (2, "", [], ["abcdefghijklmnopqrstuvwxyz"]), (3, "T", None, None)], "k int, title string, titles array<string>, samples array<string>")
    return own.select("k", runs.joined_context(F.col("title"), F.col("titles"), F.col("samples"), 20).alias("context"))


#: Pages with letters of other scripts, their navigation made one block of many links, quotation marks written out.
_NAV = "replace(replace(translate(html, 'AILNSU', 'あいるんすう'), '&quot;', '“'), '</a></li><li>', '</a>/ ')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_NAV).alias("html"))


#: Blocks of these pages: an open paragraph ends where the next begins.
_BLOCKS = f"""
made AS (SELECT page_id, replace(replace({_NAV}, '<br><p>', '<br></p><p>'), '<br></article>', '<br></p></article>') AS html FROM pages),
found AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:li|h1|p)>.*?</(?:li|h1|p)>')) AS block, generate_subscripts(regexp_extract_all(html, '<(?:li|h1|p)>.*?</(?:li|h1|p)>'), 1) AS k FROM made),
tagged AS (SELECT page_id, k, regexp_extract(block, '<(\\w+)>', 1) AS tag, regexp_extract(block, '<\\w+>(.*)</\\w+>', 1) AS inside, len(regexp_extract_all(block, '<a ')) AS links FROM found),
texts AS (
  SELECT page_id, k, 0 AS j, tag, CASE links WHEN 1 THEN 'single_anchor' ELSE 'plain' END AS mode, replace(regexp_replace(inside, '<[^>]*>', '', 'g'), '&amp;', '&') AS text FROM tagged WHERE links < 2
  UNION ALL
  SELECT page_id, k, generate_subscripts(string_split_regex(inside, '<[^>]*>'), 1), tag, 'multi_anchor', replace(unnest(string_split_regex(inside, '<[^>]*>')), '&amp;', '&') FROM tagged WHERE links >= 2),
seen AS (SELECT page_id, k, j, tag, mode, trim(text) AS text FROM texts WHERE trim(text) <> '')
"""


@query(f"""
WITH {_BLOCKS},
body AS (SELECT *, 0 AS part FROM seen WHERE regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}]') OR regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_matches(text, '[A-Za-z]')),
whole AS (SELECT page_id, k, j, tag, mode, text, part FROM body UNION ALL SELECT page_id, 0, 0, '', 'toc', url, 1 FROM pages)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, k, j) - 1 AS INTEGER) AS seq, mode, tag, text FROM whole
""")
def q_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page offers for translation, text by text where a block has several links, then its address as a title of contents."""
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(0).alias("ord"), F.col("url").alias("title"))
    return H.text_plan(H.plan(_pages(spark, sf_dir)), titles).select(F.col("id").alias("page_id"), "seq", "mode", "tag", "text")


@query(f"WITH {_BLOCKS}, own AS (SELECT text FROM seen UNION ALL SELECT url FROM pages) SELECT count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM own")
def q_page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and characters of all visible blocks and titles, translatable or not."""
    return H.estimate(H.plan(_pages(spark, sf_dir)), table(spark, sf_dir, "pages").select(F.col("url").alias("title")))


@query(f"""
WITH made AS (SELECT page_id, {_NAV} AS html FROM pages),
-- the first block's element is cut off by the next paragraph; links keep their tags; what is between links is a text too
blocks AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<p><b>\\s*([^<]*?)\\s*<br>(<p>|</article>)', '<p>&lt;\\1&gt;\\2', 'g'), '<(h1|p)>\\s*([^<]*?)\\s*</(h1|p)>', '<\\1>&lt;\\2&gt;</\\3>', 'g') AS done FROM made)
SELECT page_id, replace(regexp_replace(done, '(<a href="[^"]*">)([^<]*)</a>', '\\1&lt;\\2&gt;</a>', 'g'), '</a>/ <a', '</a>&lt;/&gt;<a') AS html FROM blocks
""")
def q_page_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every page put in angle brackets, and nothing else of the page changed."""
    pages = _pages(spark, sf_dir)
    done = H.plan(pages).withColumn("seq", F.col("pos")).withColumn("translation", F.concat(F.lit("<"), "text", F.lit(">")))
    return H.written(pages, done).withColumnRenamed("id", "page_id")


# --- books --------------------------------------------------------------------------------------------------------------

BOOK = Fixture(
    "id int, seq int, mode string, tag string, text string",
    (1, 0, "plain", "h1", "第一章  夜"), (1, 1, "plain", "p", "本文"), (1, 2, "plain", "p", "本文"), (1, 3, "single_anchor", "p", "注"), (1, 4, "plain", "h4", "著者"), (1, 5, "plain", "p", "なし"), (1, 6, "toc", "", "第一章 夜"), (1, 7, "toc", "", "著者"), (2, 0, "plain", "p", "本文"),
)
RESULTS = Fixture(
    "id int, seq int, text string, translation string",
    (1, 0, "第一章  夜", "标题：第一章 夜晚"), (1, 1, "本文", "正文一"), (1, 2, "本文", ""), (1, 3, "注", "抱歉，无法翻译该内容。"), (1, 4, "著者", "作者等内容"), (1, 6, "第一章 夜", "第一章 夜里"), (1, 7, "著者", None),
)


@case("""SELECT * FROM (VALUES (1, 0, '第一章 夜晚'), (1, 1, '正文一'), (1, 2, '正文一'), (1, 3, '注'), (1, 4, '作者'), (1, 5, NULL), (1, 6, '第一章 夜晚'), (1, 7, '作者'), (2, 0, NULL)) AS v(id, seq, translation)""")
def q_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations as they go into a book."""
    return book.written_back(BOOK.df(spark), RESULTS.df(spark)).select("id", "seq", "translation")


@case("SELECT * FROM (VALUES (1, 0, 'navpoint-1', '第一章 夜晚'), (1, 1, 'x', '作者'), (1, 2, 'navpoint-2', 'other')) AS v(id, ord, uid, title)")
def q_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with their titles translated and missing ids numbered."""
    toc = spark.createDataFrame([(1, 0, None, "第一章 夜"), (1, 1, "x", "著者"), (1, 2, None, "other")], "id int, ord int, uid string, title string")
    return book.renamed(toc, book.title_map(book.written_back(BOOK.df(spark), RESULTS.df(spark))))


@query("WITH b AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL), p AS (SELECT id, seq, CASE WHEN seq % 3 = 0 THEN '' ELSE 'P' || seq END AS t FROM b WHERE seq % 2 = 0), w AS (SELECT id, text, arg_min('T' || seq, seq) AS t FROM b WHERE seq % 5 = 0 GROUP BY id, text) SELECT id, CAST(seq AS INTEGER) AS seq, coalesce(nullif(p.t, ''), w.t) AS translation FROM b LEFT JOIN p USING (id, seq) LEFT JOIN w USING (id, text)")
def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 over all lines of all documents: by place, else by text."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    s = F.col("seq")
    placed = lines.where("seq % 2 = 0").select("id", "seq", F.lit(None).cast("string").alias("text"), F.when(s % 3 == 0, "").otherwise(F.concat(F.lit("P"), s.cast("string"))).alias("translation"))
    spoken = lines.where("seq % 5 = 0").groupBy("id", "text").agg(F.min("seq").alias("m")).select("id", F.lit(None).cast("int").alias("seq"), "text", F.concat(F.lit("T"), F.col("m").cast("string")).alias("translation"))
    return book.aligned(lines, placed.unionByName(spoken)).select("id", "seq", "translation")


@case("SELECT * FROM (VALUES ('a', 'many_failed,divergent_terms'), ('b', 'some_failed,residue'), ('c', ''), ('d', 'nothing_translated')) AS v(task_id, warnings)")
def q_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of runs (their names are this library's own)."""
    own = spark.createDataFrame([("a", 100, 5, 0, 1), ("b", 100, 1, 3, 0), ("c", 10, 0, 0, 0), ("d", 0, 0, 0, 0)], "task_id string, total int, failed int, residue int, divergent int")
    return book.self_check(own).select("task_id", F.array_join("warnings", ",").alias("warnings"))


@case("SELECT 'balanced' AS policy, CAST(1 AS BIGINT) AS high, CAST(3 AS BIGINT) AS risks")
def q_residue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the known cases as JSON, read back."""
    found = quality.scan(quality.classified(CASES.df(spark).where("k in (1, 2, 3)").select("k", "text"), "text"), "k", "text")
    report = book.residue_report(found, "balanced").select(F.from_json("report", "policy string, legend string, risks array<struct<risk:string,n:long>>").alias("r"))
    return report.select("r.policy", F.get(F.filter("r.risks", lambda x: x["risk"] == "high"), F.lit(0))["n"].alias("high"), F.size("r.risks").cast("long").alias("risks"))


# --- cache store --------------------------------------------------------------------------------------------------------

_ENTRIES = "(SELECT CASE doc_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'text' ELSE 'model' END AS cache_type, 'k' || doc_id AS cache_key, sha256(text) AS source_hash, lang AS translated_text, doc_id AS updated_at FROM documents WHERE text IS NOT NULL)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "manual").when(i % 3 == 1, "text").otherwise("model")
    return table(spark, sf_dir, "documents").where("text is not null").select(kind.alias("cache_type"), F.concat(F.lit("k"), i.cast("string")).alias("cache_key"), F.sha2("text", 256).alias("source_hash"), F.col("lang").alias("translated_text"), i.alias("updated_at"))


@query(f"SELECT cache_type, cache_key, source_hash, translated_text, updated_at FROM {_ENTRIES} WHERE cache_type <> 'text' AND updated_at % 7 <> 0 AND source_hash NOT IN (SELECT source_hash FROM {_ENTRIES} WHERE updated_at % 50 = 1)")
def q_cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after a type, some keys and some sources went."""
    own = _entries(spark, sf_dir)
    none = F.lit(None).cast("string")
    keys = own.where("updated_at % 7 = 0").select("cache_type", "cache_key", none.alias("source_hash")).unionByName(own.where("updated_at % 50 = 1").select("cache_type", none.alias("cache_key"), "source_hash"))
    return cache.without_keys(cache.cleared(own, "text"), keys)


@query(f"SELECT cache_type, cache_key, CASE WHEN updated_at % 4 = 0 THEN 'new' ELSE translated_text END AS translated_text FROM {_ENTRIES} WHERE updated_at % 4 <> 1")
def q_cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read while writes and deletions wait."""
    own = _entries(spark, sf_dir)
    n = F.col("updated_at") % 4
    first = own.where(n < 2).select("cache_type", "cache_key", F.lit("old").alias("translated_text"), F.lit(False).alias("deleted"), F.lit(0).alias("o"))
    then = own.where(n < 2).select("cache_type", "cache_key", F.when(n == 0, "new").alias("translated_text"), (n == 1).alias("deleted"), F.lit(1).alias("o"))
    seen = cache.with_pending(own, first.unionByName(then), "o")
    return cache.got(seen, seen.select("cache_type", "cache_key"))


@query(f"SELECT source_hash, cache_type, translated_text FROM {_ENTRIES} QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY CASE cache_type WHEN 'manual' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, updated_at DESC, cache_key) = 1")
def q_cache_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees of each source."""
    own = _entries(spark, sf_dir)
    return cache.shown(own.select("source_hash").distinct(), own)


@case("SELECT * FROM (VALUES (1, 'A'), (2, 'A'), (3, NULL), (4, 'whole'), (5, NULL)) AS v(id, answer)")
def q_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed phrases, also inside corner quotes."""
    texts = spark.createDataFrame([(1, " はい "), (2, "「はい」"), (3, "はい。"), (4, "「いいえ」"), (5, None)], "id int, text string")
    return cache.ruled(texts, spark.createDataFrame([("はい", "A"), ("「いいえ」", "whole"), ("いいえ", "inner")], "phrase string, answer string")).select("id", "answer")


@query("SELECT conv_id * 1000 + turn AS k, length(text) <= 30 AND regexp_matches(text, '[\\x{3040}-\\x{30ff}]') AND turn % 2 = 0 AS cached FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'え？' ELSE text END AS text FROM conversations)")
def q_context_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: texts that are cached within their neighbours only."""
    own = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, "え？").otherwise(F.col("text")))
    return own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), T.caches_in_context(F.col("text"), F.col("turn") % 2 == 0, F.lit(False)).alias("cached"))


@query("WITH f AS (SELECT doc_id AS k, doc_id AS o, unnest(list_distinct([lang, source])) AS frag FROM documents), m AS (SELECT frag, min(o) AS first FROM f GROUP BY frag) SELECT k, bool_or(o > first) AS repeated FROM f JOIN m USING (frag) GROUP BY k")
def q_repeated_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that an earlier answer had too; languages and sources of documents stand for fragments."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("o"), F.array_distinct(F.array("lang", "source")).alias("fragments"))
    return enrich.repeated_residue(own, "o").select(F.col("key").alias("k"), "repeated")


@case(f"SELECT category, src, dst, info, source, policy, aliases FROM (SELECT category, original AS src, translation AS dst, info, source, policy, coalesce(array_to_string(aliases, '、'), '') AS aliases FROM {MORE_TERMS.sql})")
def q_glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary as its CSV's columns."""
    return glossary.csv_rows(MORE_TERMS.df(spark))


@query("SELECT event_type AS key, count(*) AS n, CAST(floor(avg(greatest(0.001, abs(value))) * 1000) AS INTEGER) AS mean_ms, CAST(round_even(avg(event_id % 9), 0) AS INTEGER) AS mean_batch FROM events GROUP BY event_type")
def q_latency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, over events, their values as seconds."""
    own = table(spark, sf_dir, "events").select("event_type", F.abs("value").alias("elapsed_s"), (F.col("event_id") % 9).alias("batch"))
    return runs.latency_snapshot(own, "event_type")


@query("SELECT greatest(count(*), 1) AS texts, CAST(greatest(coalesce(sum(length(text)), 0), 1) AS BIGINT) AS chars FROM documents")
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return runs.totals(table(spark, sf_dir, "documents"), "text")


@case("SELECT * FROM (VALUES (1, 'a b', 'a b'), (1, 'ab', 'ab'), (1, 'c d', 'cd'), (1, 'x', NULL), (2, 'a b', NULL)) AS v(task_id, text, source)")
def q_block_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of failed blocks, equal ones first, then only ones."""
    blocks = spark.createDataFrame([(1, "a b"), (1, "ab"), (1, "c d"), (1, "x"), (2, "a b")], "task_id int, text string")
    return runs.originals_of(blocks, spark.createDataFrame([(1, "a b"), (1, "ab"), (1, "cd"), (1, "cd")], "task_id int, source string")).select("task_id", "text", "source")


@case("SELECT CAST(3 AS BIGINT) AS accepted, CAST(3 AS BIGINT) AS skipped")
def q_csv_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a glossary CSV, under one of its headers, that are taken and left out."""
    rows = [("Person", "a", "1"), ("", "b", "2"), ("x", "a", "3"), ("x", "", "4"), ("x", "c", " "), ("Item", " d ", "5")]
    return enrich.csv_statistics(enrich.csv_glossary(spark.createDataFrame(rows, "`\ufeffCategory` string, SRC string, Target string")))


# --- the cache as a table ---------------------------------------------------------------------------------------------


@query("""
WITH docs AS (SELECT doc_id, text, sha256(text) AS k FROM documents WHERE text IS NOT NULL),
one AS (SELECT k, 'a' || max(doc_id) AS said, arg_max(left(text, 20), doc_id) FILTER (doc_id % 2 = 0) AS source, min(doc_id) AS made, max(doc_id) AS late FROM docs GROUP BY k),
two AS (SELECT k, 'b' || max(doc_id) AS said, min(doc_id) + 1000000 AS made, max(doc_id) + 1000000 AS late FROM docs WHERE doc_id % 3 = 0 GROUP BY k),
gone AS (SELECT k FROM docs WHERE doc_id % 7 = 0),
used AS (SELECT k, count(*) AS hits, max(doc_id) + 2000000 AS last FROM docs WHERE doc_id % 5 = 0 GROUP BY k),
kept AS (SELECT k, coalesce(two.said, one.said) AS said, source, one.made, coalesce(two.late, one.late) AS late FROM one LEFT JOIN two USING (k) WHERE k NOT IN (SELECT k FROM gone))
SELECT DISTINCT k AS cache_key, said AS value, source AS source_text, made AS created_at, late AS updated_at, CASE WHEN said IS NOT NULL THEN last END AS last_used_at, CASE WHEN said IS NOT NULL THEN coalesce(hits, 0) END AS hit_count
FROM docs LEFT JOIN kept USING (k) LEFT JOIN used USING (k)
""")
def q_cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all documents merged into a table twice, some deleted, uses counted, and all keys asked for."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.sha2("text", 256).alias("k"))
    store = cache_table.CacheTable(spark, fresh_path(spark, "cache"), 16)

    def made(df: DataFrame, mark: str, later: int, source) -> DataFrame:
        payload = F.to_json(F.struct(source.alias("source"), (F.col("doc_id") + later).alias("updated_at")))
        raw = df.select(F.lit("text").alias("cache_type"), F.col("k").alias("cache_key"), F.concat(F.lit(mark), "doc_id").alias("translated_text"), payload.alias("payload_json"), F.col("doc_id").alias("seq"))
        return cache.entries(raw, 0).withColumn("payload_json", F.lit(None).cast("string"))

    key = [F.lit("text").alias("cache_type"), F.col("k").alias("cache_key")]
    # a time of nought counts as none, so the first document's is now, which is nought too
    store.upsert(made(docs, "a", 0, F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(20)))))
    store.upsert(made(docs.where("doc_id % 3 = 0"), "b", 1_000_000, F.lit(None).cast("string")))
    store.touch(docs.where("doc_id % 5 = 0").select(*key, (F.col("doc_id") + 2_000_000).alias("used_at")))
    store.delete(docs.where("doc_id % 7 = 0").select(*key))
    found = store.get(docs.select(*key).distinct())
    said = store.snapshot().select("cache_key", "source_text", "created_at", "updated_at", "last_used_at", "hit_count")
    return found.join(said, "cache_key", "left").select("cache_key", "value", "source_text", "created_at", "updated_at", "last_used_at", "hit_count")


# --- control as a stream ----------------------------------------------------------------------------------------------

_CONTROL = f"""
WITH RECURSIVE e AS (
  SELECT event_id AS id, event_type AS key, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS s, CAST(1 + event_id % 50 AS INTEGER) AS tokens, abs(value) AS elapsed, CASE WHEN value > 40 THEN {_KINDS} END AS kind,
         CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN event_id % 700 ELSE 0 END AS pause, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events),
w AS (SELECT *, count(*) OVER x AS requests, CAST(sum(tokens) OVER x AS BIGINT) AS window_tokens, min(s) OVER x AS first FROM e WINDOW x AS (PARTITION BY key ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)),
leaves AS (SELECT a.id, min(b.s) AS enough FROM w a JOIN w b ON a.key = b.key AND b.s BETWEEN a.s - 3600 AND a.s WHERE a.window_tokens > 200 AND (SELECT coalesce(sum(c.tokens), 0) FROM w c WHERE c.key = a.key AND c.s > b.s AND c.s <= a.s) <= 200 GROUP BY a.id),
sent AS (SELECT id, max(s - (place - 1) * 450.0) OVER o + (place - 1) * 450.0 - s AS gap, greatest(0.0, coalesce(max(CASE WHEN pause > 0 THEN s + pause END) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - s, 0.0)) AS held FROM w WINDOW o AS (PARTITION BY key ORDER BY place)),
l AS (
  SELECT key, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[]) AS held, 4 AS w, 6 AS b, '' AS action FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT key, place, CASE WHEN action = 'none' THEN ring ELSE [] END, w + CASE action WHEN 'down' THEN CASE WHEN b <= 1 THEN -1 ELSE 0 END WHEN 'up' THEN CASE WHEN b >= 6 THEN 1 ELSE 0 END ELSE 0 END,
         b + CASE action WHEN 'down' THEN CASE WHEN b > 1 THEN -1 ELSE 0 END WHEN 'up' THEN CASE WHEN b < 6 THEN 1 ELSE 0 END ELSE 0 END, action
  FROM (SELECT *, CASE WHEN n >= 8 AND (floor(total / n * 1000) >= 50000 OR slow >= 0.5 * n) AND (b > 1 OR w > 1) THEN 'down' WHEN n >= 16 AND floor(total / n * 1000) <= 30000 AND slow = 0 AND (b < 6 OR w < 4) THEN 'up' ELSE 'none' END AS action
        FROM (SELECT *, len(ring) AS n, list_sum(ring) AS total, len(list_filter(ring, lambda y: y >= 50)) AS slow
              FROM (SELECT l.key, e.place, l.w, l.b, list_slice(list_append(l.held, greatest(0.001, e.elapsed)), -24, -1) AS ring FROM l JOIN e ON e.key = l.key AND e.place = l.place + 1)))),
g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS nth FROM e WHERE kind IS NOT NULL),
f AS (
  SELECT key, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS nth, 4 AS w, 6 AS b, 0 AS n, 0 AS formats, CAST(0 AS DOUBLE) AS pause FROM g GROUP BY key
  UNION ALL
  SELECT g.key, g.id, g.nth, greatest(1, CAST(floor(f.w * CASE g.kind WHEN 'rate' THEN 0.6 WHEN 'timeout' THEN 0.75 ELSE 0.85 END + 0.999) AS INTEGER)),
         CASE WHEN g.kind = 'format' AND (f.formats >= 2 OR f.b <= 3) THEN 1 ELSE greatest(1, CAST(floor(f.b * CASE g.kind WHEN 'rate' THEN 0.7 WHEN 'timeout' THEN 0.75 ELSE 0.5 END + 0.999) AS INTEGER)) END,
         f.n + 1, f.formats + CASE g.kind WHEN 'format' THEN 1 ELSE 0 END,
         CAST(CASE g.kind WHEN 'format' THEN least(20.0, 1.5 * (f.formats + 1)) WHEN 'timeout' THEN least(45.0, pow(2.0, least(f.n + 1, 5))) ELSE least(60.0, pow(2.0, least(f.n + 1, 5))) END AS DOUBLE)
  FROM f JOIN g ON g.key = f.key AND g.nth = f.nth + 1)
SELECT w.key, w.id, w.us, w.requests, w.window_tokens, round(greatest(CASE WHEN requests > 8 THEN first + 3600 - s ELSE 0.0 END, CASE WHEN window_tokens > 200 THEN enough + 3600 - s ELSE 0.0 END), 3) AS wait, round(gap, 3) AS gap, round(sent.held, 3) AS held,
       l.action, l.w AS workers, l.b AS batch, f.w AS failure_workers, f.b AS failure_batch, f.pause AS failure_pause
FROM w LEFT JOIN leaves USING (id) JOIN sent USING (id) JOIN l ON l.key = w.key AND l.place = w.place LEFT JOIN f ON f.id = w.id
"""
_LIMITS = control.Limits(8, 200, 3600, 4, 6, 50.0)


def _control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    c = F.col
    kind = F.when(c("value") > 40, F.when(c("user_id") % 3 == 0, "rate").when(c("user_id") % 3 == 1, "timeout").otherwise("format"))
    pause = F.when((c("event_type") == "error") | (c("event_id") % 5 == 0), c("event_id") % 700).otherwise(0)
    return control.events(e, c("event_type"), c("at"), c("event_id"), 1 + c("event_id") % 50, F.abs("value"), kind, pause)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 3).alias(c) if c in ("wait", "gap", "held") else F.col(c) for c in df.columns])


@query(_CONTROL)
def q_control_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 to ST4, A14: all decisions of control on a log of events."""
    return _rounded(control.replayed(_control_events(spark, sf_dir), _LIMITS))


@query(_CONTROL)
def q_control_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 to ST4 over a stream: events arrive in six files, out of order by up to six hours, and the decisions are those of the replay."""
    found = _control_events(spark, sf_dir)
    late = 6 * 3600 * 1_000_000
    # the same shift for an event wherever it is read, less than what the watermark waits
    arrival = F.col("us") + F.pmod(F.xxhash64("id"), F.lit(late))
    marked = stored(found.withColumn("arrival", arrival), "arrivals")
    cuts = [float("-inf"), *marked.approxQuantile("arrival", [k / 6 for k in range(1, 6)], 0.01), float("inf")]
    folder, result = fresh_path(spark, "stream"), fresh_path(spark, "decisions")
    for low, high in zip(cuts, cuts[1:], strict=False):
        marked.where((F.col("arrival") > low) & (F.col("arrival") <= high)).drop("arrival").coalesce(1).write.mode("append").parquet(folder)
    # a beat of no key's own, so that the watermark passes the last events
    last = found.agg(F.max("us").alias("us")).where("us is not null")
    beat = last.select(F.lit("").alias("key"), F.timestamp_micros(F.col("us") + 2 * late).alias("ts"), (F.col("us") + 2 * late).alias("us"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("tokens"))
    beat = beat.select("*", F.lit(None).cast("double").alias("elapsed"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("pause"))
    beat.coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    decided = stream_control.controlled(arriving, _LIMITS, "6 hours")
    with stream_control.rocksdb(spark):
        stream = decided.writeStream.format("parquet").option("checkpointLocation", f"{result}-state").trigger(availableNow=True).start(result)
    stream.awaitTermination()
    return _rounded(spark.read.schema(decided.schema).parquet(result).where("key <> ''"))


# --- rounds of provider calls -----------------------------------------------------------------------------------------

_TASKS = """
first AS (SELECT conv_id, text, min(turn) AS ord FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY ALL),
t AS (SELECT *, conv_id % 8 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n, conv_id || '-' || ord AS key FROM first)
"""


@query(f"""
WITH {_TASKS},
-- what the batch came to, and how many requests it took; a batch of one is a single text at once
b AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN kind IN (0, 3, 4) THEN 1 WHEN kind IN (1, 7) THEN 3 WHEN kind = 2 THEN 2 ELSE 4 END AS went,
             n > 1 AND (kind IN (0, 1, 2) OR kind = 3 AND idx % 2 = 0 OR kind = 7 AND idx = 0) AS ok FROM t),
s AS (SELECT *, CASE WHEN ok THEN 'ok'
                     WHEN kind = 6 OR kind = 5 AND length(text) % 5 = 0 THEN 'failed'
                     WHEN kind = 4 AND length(text) % 6 = 0 THEN 'moderated'
                     WHEN kind = 4 AND length(text) % 2 = 0 THEN 'fallback' ELSE 'single' END AS status FROM b)
SELECT key, CASE status WHEN 'failed' THEN NULL WHEN 'moderated' THEN NULL WHEN 'fallback' THEN 'S:' || text ELSE 'T:' || text END AS answer, status,
       went + CASE WHEN ok THEN 0 WHEN status = 'failed' THEN 4 WHEN status IN ('fallback', 'moderated') THEN 2 WHEN kind = 1 THEN 3 WHEN kind = 2 THEN 2 ELSE 1 END AS asked FROM s
""")
def q_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of all conversations through a provider that is busy, stops, forgets, refuses and fails, and a second one."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''").groupBy("conv_id", "text").agg(F.min("turn").alias("ord"))
    tasks = asked.select(F.col("conv_id").alias("batch"), F.concat_ws("-", "conv_id", "ord").alias("key"), "text", "ord")
    return rounds.run(tasks, fresh_path(spark, "ledger"), stubs.faulty, stubs.second)


# --- a glossary made tidy ---------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE words AS (SELECT word AS original, 'T' || left(word, 3) AS translation, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark) GROUP BY word),
own AS (SELECT * FROM words UNION ALL SELECT original || '様', translation, n FROM words WHERE n % 2 = 1),
left_over AS (SELECT * FROM words),
links AS (SELECT a.original AS a, b.original AS b FROM left_over a JOIN left_over b ON a.translation = b.translation AND a.original <> b.original AND length(a.original) >= 5 AND length(b.original) >= 5 AND levenshtein(a.original, b.original) = 1),
reach AS (SELECT original AS node, original AS other FROM left_over UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
heads AS (SELECT root, first(original ORDER BY n DESC, length(original) DESC, original) AS head, sum(n) AS n, string_agg(original, ',' ORDER BY original) AS members FROM roots JOIN left_over ON original = node GROUP BY root)
SELECT original, 'kept' AS outcome, NULL AS into, members, CAST(h.n AS BIGINT) AS n FROM heads h JOIN left_over ON original = head
UNION ALL SELECT node, 'variant', head, NULL, NULL FROM roots JOIN heads USING (root) WHERE node <> head
UNION ALL SELECT original || '様', 'address', original, NULL, NULL FROM words WHERE n % 2 = 1
""")
def q_tidy_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark as terms, translated by their first letters: variants one letter apart made one, forms of address out."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("original")).groupBy("original").agg(F.count("*").alias("n"))
    own = words.select("original", F.concat(F.lit("T"), F.left("original", F.lit(3))).alias("value"), F.lit(None).cast("string").alias("info"), "n")
    kept, gone = tidy.tidied(own.unionByName(own.where("n % 2 = 1").withColumn("original", F.concat("original", F.lit("様")))))
    members = F.array_join(F.array_sort(F.array_append("aliases", F.col("original"))), ",")
    none = F.lit(None)
    return kept.select("original", F.lit("kept").alias("outcome"), none.cast("string").alias("into"), members.alias("members"), "n").unionByName(gone.select("original", F.col("reason").alias("outcome"), "into", none.cast("string").alias("members"), none.cast("long").alias("n")))


# --- books as files ---------------------------------------------------------------------------------------------------


@query("""
WITH docs AS (SELECT page_id // 20 AS book, 'p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.xhtml' AS file_name, 'ZH ' || trim(regexp_replace(url, '\\s+', ' ', 'g')) AS title, sha256(html) AS digest FROM pages WHERE html IS NOT NULL AND url IS NOT NULL)
SELECT CAST(book AS BIGINT) AS book, CAST(row_number() OVER (PARTITION BY book ORDER BY file_name) AS INTEGER) AS doc_idx, file_name, title, digest FROM docs
UNION ALL SELECT DISTINCT CAST(book AS BIGINT), 0, 'translation-notice.xhtml', NULL, NULL FROM docs
UNION ALL SELECT CAST(book AS BIGINT), CAST(count(*) + 1 AS INTEGER), 'nav.xhtml', NULL, NULL FROM docs GROUP BY book
""")
def q_epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pages a book written as archives, their titles of contents translated and a notice put in, and all read back."""
    pages = table(spark, sf_dir, "pages").where("html is not null and url is not null")
    own = pages.select(F.floor(F.col("page_id") / 20).cast("long").alias("book"), F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".xhtml")).alias("file_name"), F.trim(F.regexp_replace("url", "\\s+", " ")).alias("title"), "html")
    bound = own.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("file_name", "title", "html"))).alias("docs"))

    @F.udf("binary")
    def made(book, docs):
        return epub.new_book(f"Book {book}", "ja", [tuple(d) for d in docs])

    files = stored(bound.select(F.format_string("%012d", "book").alias("path"), made("book", "docs").alias("content")), "books")
    folder = fresh_path(spark, "epub")
    names = own.select(F.format_string("%012d", "book").alias("path"), "title", F.concat(F.lit("ZH "), "title").alias("translation"))
    books = files.select("path", F.concat("path", F.lit(".epub")).alias("name"), F.lit("书").alias("title"), F.lit("ltr").alias("direction"), F.lit("zh").alias("language"), F.lit("A notice.").alias("notice"))
    none = spark.createDataFrame([], "path string, file_name string, html string")
    # writing is an action of its own; what it reports is small
    stored(epub.write(files, none, names, books, folder), "written")
    number = lambda: F.regexp_extract("path", "(\\d+)\\.epub$", 1).cast("long").alias("book")
    docs = epub.read(spark, folder).select(number(), "doc_idx", "file_name", F.when(F.col("file_name").startswith("p"), F.sha2("html", 256)).alias("digest"))
    titles = epub.contents(spark, folder).select(number(), F.col("href").alias("file_name"), "title")
    return docs.join(titles, ["book", "file_name"], "left").select("book", "doc_idx", "file_name", "title", "digest")


# --- counters and flushes ---------------------------------------------------------------------------------------------


@query(f"""
WITH {_TASKS}, every AS (SELECT * FROM conversations WHERE role = 'user'),
done AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]') THEN NULL ELSE 'ZH:' || text END AS answer FROM t)
SELECT 'asked' AS stage, 'rows' AS counter, count(*) AS n FROM every
UNION ALL SELECT 'asked', 'chars', CAST(sum(length(text)) AS BIGINT) FROM every
UNION ALL SELECT 'tasks', 'rows', count(*) FROM done
UNION ALL SELECT 'answers', 'rows', count(*) FROM done
UNION ALL SELECT 'answers', 'failed', count(*) FILTER (answer IS NULL) FROM done
UNION ALL SELECT 'answers', 'tokens', CAST(sum(CASE WHEN answer IS NULL OR length(answer) % 7 = 0 THEN 0 ELSE length(answer) END) AS BIGINT) FROM done
""")
def q_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flows through the stages of a run, counted as it flows; replies tell the tokens they used, some of them none."""
    own = counters.Counters()
    asked = own.counted(table(spark, sf_dir, "conversations").where("role = 'user'"), "asked", chars=F.length("text"))
    tasks = own.counted(cache.distinct_tasks(asked, "turn", "text", "conv_id"), "tasks")
    done = enrich.enriched(tasks, enrich.stub, "task_key", "text", "conv_id")
    n = F.length("answer")
    reply = F.to_json(F.struct(F.struct(F.when(n % 7 == 0, -1).otherwise(n).alias("total_tokens")).alias("usage")))
    counted = own.counted(done, "answers", failed=F.col("answer").isNull(), tokens=counters.usage(reply))
    stored(counted.select("key", "answer", "status"), "answers")
    return own.rows(spark)


@query("SELECT event_id, event_type, value FROM events")
def q_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: all events written by a stream in parts of 500 rows, the stream stopped and started again between two halves of them."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    arriving, folder = fresh_path(spark, "arriving"), fresh_path(spark, "flushed")
    for half in (0, 1):
        e.where(F.pmod("event_id", F.lit(2)) == half).write.mode("append").parquet(arriving)
        flush.flushed(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 3).parquet(arriving), folder, 500).awaitTermination()
    return flush.read(spark, folder, "event_id long, event_type string, value double").drop("batch")
