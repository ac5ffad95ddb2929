"""The registered queries of the library and the same in DuckDB's SQL, written from the semantics, not from the plans; and small known cases."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import titles
from lexweave.operators import batching, cache, consistency, enrich, glossary, quality, runs
from lexweave.plans import fixtures as X
from lexweave.sources import html as H
from lexweave.streaming import logs as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Small known cases, each with its answer: tests run them, nothing registers them.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def case(sql: str | None = None):
    """Keep a query over fixed rows as a case for tests, under its function's name."""
    def add(f):
        CASES[f.__name__] = f
        if sql:
            CASE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# --- blocks, filters, keys -------------------------------------------------------------------------------------------

#: Greedy packing by recursion over places; needs ranked(lane, class, place, n_chars) and the limits as SQL by class.
def _packing(items: str, chars: str) -> str:
    return f"""
steps AS (
  SELECT lane, class, place, n_chars, 0 AS batch, 1 AS n, n_chars AS total FROM ranked WHERE place = 0
  UNION ALL
  SELECT r.lane, r.class, r.place, r.n_chars,
         CASE WHEN s.n >= {items} OR s.total + r.n_chars >= {chars} THEN s.batch + 1 ELSE s.batch END,
         CASE WHEN s.n >= {items} OR s.total + r.n_chars >= {chars} THEN 1 ELSE s.n + 1 END,
         CASE WHEN s.n >= {items} OR s.total + r.n_chars >= {chars} THEN r.n_chars ELSE s.total + r.n_chars END
  FROM steps s JOIN ranked r ON r.lane = s.lane AND r.class = s.class AND r.place = s.place + 1
)"""


_CLASS = "CASE WHEN n_chars <= {0} THEN 0 WHEN n_chars <= {1} THEN 1 ELSE 2 END"


@query(f"""
WITH RECURSIVE blocks AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
stripped AS (SELECT doc_id, lang, pos, {_strip('block')} AS block FROM blocks),
tasks AS (SELECT lang AS lane, block, count(*) AS times, min(doc_id * 100000 + pos - 1) AS ord FROM stripped WHERE block <> '' GROUP BY lang, block),
known AS (SELECT DISTINCT block FROM stripped JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 2 = 0),
pending AS (SELECT lane, ord, times, CAST(length(block) AS INTEGER) AS n_chars FROM tasks ANTI JOIN known USING (block)),
classed AS (SELECT *, {_CLASS.format(30, 200)} AS class FROM pending),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lane, class ORDER BY ord) - 1 AS place FROM classed WHERE class < 2),
{_packing('CASE s.class WHEN 0 THEN 8 ELSE 4 END', 'CASE s.class WHEN 0 THEN 1600 ELSE 800 END')},
counted AS (SELECT lane, class, count(DISTINCT batch) AS batches FROM steps GROUP BY ALL UNION ALL SELECT lane, class, count(*) FROM classed WHERE class = 2 GROUP BY ALL)
SELECT lane, class, count(*) AS texts, any_value(batches) AS batches, CAST(sum(n_chars) AS BIGINT) AS chars FROM classed JOIN counted USING (lane, class) GROUP BY lane, class
""")
def q_block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different blocks per language that no cached document holds, and the batches they form."""
    docs = table(spark, sf_dir, "documents")
    blocks = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "lang", (F.col("doc_id") * 100_000 + F.col("pos")).alias("ord"), T.strip(F.col("raw")).alias("block")).where("block <> ''")
    tasks = cache.distinct_tasks(blocks, "ord", "block", "lang").select(F.col("lang").alias("lane"), "task_key", "text", F.col("first_ord").alias("ord"))
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id % 2 = 0").select("doc_id").distinct()
    known = blocks.join(good, "doc_id", "left_semi").select(F.sha2("block", 256).alias("task_key")).distinct()
    pending = tasks.join(known, "task_key", "left_anti")
    return batching.batch_statistics(batching.packed(pending, "lane", "ord", "text", 4, 800))


@query(f"""
SELECT seq, regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}]') OR (regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_matches(t, '[A-Za-z]')) AS translatable,
       regexp_matches(coalesce(text, ''), '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AS japanese, CAST(length(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS INTEGER) AS compact
FROM (SELECT *, replace(coalesce(text, ''), chr(65532), '') AS t FROM (SELECT seq, text FROM {X.TEXTS.sql} UNION ALL SELECT CAST(doc_id + 1000 AS INTEGER), text FROM documents))
""")
def q_translatable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P3 over the fixture and all documents."""
    own = X.TEXTS.df(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("int").alias("seq"), "text"))
    c = F.col("text")
    return own.select("seq", T.is_translatable(c).alias("translatable"), T.has_japanese(c).alias("japanese"), T.compact_length(T.text(c)).alias("compact"))


@query(f"""
WITH near AS (SELECT *, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, substr(before, 1, 80) AS prev_text, substr(after, 1, 80) AS next_text, sha256(text) AS text_key, sha256({_strip('text')}) AS stripped_key,
       'v2:p:m:' || sha256(text) AS model_key,
       'v3ctx:p:m:g0123456789abcdef:' || sha256(substr(before, 1, 80) || chr(10) || '<<<TEXT>>>' || chr(10) || {_strip('text')} || chr(10) || '<<<NEXT>>>' || chr(10) || substr(after, 1, 80)) || ':' || sha256({_strip('text')}) AS context_key
FROM near
""")
def q_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of turns, alone and within their neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("text").over(w), F.lit("")))
    c, none = F.col("text"), F.lit("")
    return own.select(
        "conv_id", "turn", F.substring("before", 1, 80).alias("prev_text"), F.substring("after", 1, 80).alias("next_text"), T.text_key(c).alias("text_key"), T.stripped_key(c).alias("stripped_key"),
        T.model_key(F.lit("P"), F.lit("M"), c, none).alias("model_key"), T.context_key(F.lit("P"), F.lit("M"), c, F.col("before"), F.col("after"), 80, F.lit("0123456789abcdef")).alias("context_key"),
    )


@query("SELECT doc_id % 7 AS grp, sha256(text) AS task_key, count(*) AS n, min(doc_id) AS first_ord, list(doc_id ORDER BY doc_id) AS places FROM documents WHERE trim(text) <> '' GROUP BY doc_id % 7, text")
def q_pending_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts with their multiplicity and places."""
    own = table(spark, sf_dir, "documents").withColumn("grp", F.col("doc_id") % 7)
    return cache.distinct_tasks(own, "doc_id", "text", "grp").drop("text")


@query("""
WITH d AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY text), l AS (SELECT * FROM labels),
manual AS (SELECT d.text, min(CASE WHEN d2.doc_id % 3 = 0 THEN '' ELSE 'manual ' || d2.doc_id END) AS answer FROM d JOIN documents d2 USING (text) WHERE d2.doc_id % 11 = 0 GROUP BY d.text),
model AS (SELECT d2.text, min(CASE WHEN d2.doc_id % 5 = 0 THEN ' ' ELSE 'model ' || d2.doc_id END) AS answer FROM documents d2 JOIN l USING (doc_id) WHERE quality = 1 GROUP BY d2.text),
plain AS (SELECT d2.text, min('text ' || d2.doc_id) AS answer FROM documents d2 JOIN l USING (doc_id) GROUP BY d2.text)
SELECT d.doc_id AS first_ord,
       CASE WHEN manual.text IS NOT NULL THEN 'manual' WHEN trim(coalesce(model.answer, '')) <> '' THEN 'model' WHEN trim(coalesce(plain.answer, '')) <> '' THEN 'text' ELSE 'pending' END AS layer,
       CASE WHEN manual.text IS NOT NULL THEN manual.answer WHEN trim(coalesce(model.answer, '')) <> '' THEN model.answer ELSE plain.answer END AS answer
FROM d LEFT JOIN manual USING (text) LEFT JOIN model USING (text) LEFT JOIN plain USING (text)
""")
def q_layered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted manual entries whatever they say, then valid model entries, then texts; the rest is pending."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tasks = cache.distinct_tasks(docs, "doc_id", "text").select("task_key", "first_ord")
    keyed = docs.withColumn("task_key", F.sha2("text", 256))
    one = lambda df, answer, trusted: df.groupBy("task_key").agg(F.min(answer).alias("answer")).withColumn("trusted", F.lit(trusted))
    name = lambda kind: F.concat(F.lit(f"{kind} "), F.col("doc_id").cast("string"))
    manual = one(keyed.where("doc_id % 11 = 0"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(name("manual")), True)
    model = one(keyed.join(labels.where("quality = 1"), "doc_id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(name("model")), False)
    plain = one(keyed.join(labels, "doc_id"), name("text"), False)
    return cache.layered(tasks, [("manual", manual, True), ("model", model, False), ("text", plain, False)]).drop("task_key")


_MODEL_ROWS = f"""(SELECT *, string_split(cache_key, ':') AS p FROM {X.CACHE.sql} WHERE cache_type IN ('model', 'text', 'manual'))"""


@case(f"""
SELECT cache_type, cache_key, CASE WHEN cache_type = 'model' THEN p[-1] ELSE cache_key END AS source_hash, CASE WHEN cache_key LIKE 'v3ctx:%' THEN p[-2] END AS context_hash,
       CASE WHEN cache_type = 'model' THEN p[2] END AS provider,
       CASE cache_key[1:7] WHEN 'v2:a:m:' THEN 'm' WHEN 'v2:b:gl' THEN 'glm-4-flash' WHEN 'v2:b:m:' THEN 'm' WHEN 'v3ctx:a' THEN 'm' WHEN 'v2:c:x:' THEN 'x:y' END AS model,
       CASE WHEN cache_key LIKE '%:g0123456789abcdef:%' THEN '0123456789abcdef' END AS glossary_fingerprint,
       CASE WHEN cache_key LIKE 'v3ctx:%' THEN 'context' WHEN cache_key LIKE 'v2:%' THEN 'text' END AS kind, translated_text
FROM {_MODEL_ROWS}
""")
def q_key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that cache keys tell."""
    return cache.normalised(X.CACHE.df(spark))


@case(f"""
WITH e AS (SELECT cache_key, translated_text, updated_at, string_split(cache_key, ':')[-1] AS s, CASE WHEN cache_key LIKE 'v3ctx:%' THEN string_split(cache_key, ':')[-2] END AS c, cache_key LIKE '%:g0123456789abcdef:%' AS g FROM {X.CACHE.sql} WHERE cache_type = 'model')
SELECT a.cache_key, b.cache_key AS found_key, b.translated_text FROM e a LEFT JOIN e b ON a.s = b.s AND a.c IS NOT DISTINCT FROM b.c AND a.cache_key <> b.cache_key AND NOT b.g
QUALIFY row_number() OVER (PARTITION BY a.cache_key ORDER BY b.updated_at DESC NULLS LAST, b.cache_key) = 1
""")
def q_cross_model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest other entry of the same source and context."""
    fields = cache.normalised(X.CACHE.df(spark)).drop("translated_text")
    rows = X.CACHE.df(spark).select("cache_type", "cache_key", "translated_text", "updated_at").join(fields, ["cache_type", "cache_key"])
    return cache.across_models(rows.where("cache_type = 'model'").select("cache_key", "source_hash", "context_hash"), rows)


@case(f"""
SELECT cache_type, cache_key, coalesce(n.source_text, b.source_text) AS source_text, CASE WHEN n.cache_key IS NULL THEN b.translated_text ELSE n.translated_text END AS translated_text,
       CASE WHEN n.cache_key IS NULL THEN b.trusted ELSE n.trusted END AS trusted, CASE WHEN n.cache_key IS NULL THEN b.verified ELSE n.verified END AS verified, coalesce(b.created_at, n.created_at) AS created_at,
       CASE WHEN n.cache_key IS NULL THEN b.updated_at ELSE n.updated_at END AS updated_at, coalesce(b.last_used_at, n.last_used_at) AS last_used_at, coalesce(b.hit_count, n.hit_count, 0) AS hit_count
FROM {X.CACHE.sql} b FULL JOIN {X.NEW_CACHE.sql} n USING (cache_type, cache_key)
""")
def q_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of new entries."""
    return cache.upserted(X.CACHE.df(spark), X.NEW_CACHE.df(spark))


@case(f"SELECT n.cache_key, n.translated_text FROM {X.NEW_CACHE.sql} n LEFT JOIN {X.CACHE.sql} b ON b.cache_type = 'text' AND b.cache_key = n.cache_key WHERE n.cache_type = 'text' AND NOT coalesce(b.verified, false) AND b.translated_text IS DISTINCT FROM n.translated_text")
def q_guarded_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: text entries that may be written."""
    return cache.guarded_text_saves(X.CACHE.df(spark), X.NEW_CACHE.df(spark).where("cache_type = 'text'")).select("cache_key", "translated_text")


@case(f"SELECT cache_key FROM {X.CACHE.sql} WHERE NOT (coalesce(last_used_at, updated_at) < 80000000 - 30 * 86400 AND (cache_type = 'model' OR cache_type = 'text' AND NOT verified))")
def q_cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after 30 days without use."""
    return cache.unexpired(X.CACHE.df(spark), 80_000_000, 10).select("cache_key")


@case(f"SELECT cache_key FROM {X.CACHE.sql} WHERE NOT (cache_type = 'model' AND string_split(cache_key, ':')[2] = 'b' AND cache_key LIKE 'v2:b:glm-4-flash:%' AND updated_at < 50)")
def q_scoped_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after one model's old entries went."""
    fields = cache.normalised(X.CACHE.df(spark)).select("cache_type", "cache_key", "provider", "model")
    return cache.outside_scope(X.CACHE.df(spark).join(fields, ["cache_type", "cache_key"], "left"), "B", "GLM-4-Flash", 50).select("cache_key")


@query("SELECT event_type AS cache_type, user_id AS cache_key, CAST(count(*) + 1 AS BIGINT) AS hit_count, max(CAST(epoch_ms(ts) // 1000 AS BIGINT)) AS last_used_at FROM events GROUP BY ALL")
def q_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and last use, here of event types by users."""
    used = table(spark, sf_dir, "events").select(F.col("event_type").alias("cache_type"), F.col("user_id").alias("cache_key"), F.floor(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000).alias("used_at"))
    base = used.select("cache_type", "cache_key").distinct().withColumn("hit_count", F.lit(1).cast("long")).withColumn("last_used_at", F.lit(0).cast("long"))
    return cache.with_usage(base, used).select("cache_type", "cache_key", "hit_count", "last_used_at")


@case(f"SELECT cache_type, count(*) AS n FROM {X.CACHE.sql} GROUP BY cache_type")
def q_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return X.CACHE.df(spark).groupBy("cache_type").agg(F.count("*").alias("n"))


# --- batches -----------------------------------------------------------------------------------------------------------

def _batches_sql(items: str, chars: str, short: int, long: int) -> str:
    return f"""
WITH RECURSIVE classed AS (SELECT role AS lane, conv_id * 1000 + turn AS ord, CAST(length(text) AS INTEGER) AS n_chars FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lane, class ORDER BY ord) - 1 AS place FROM (SELECT *, {_CLASS.format(short, long)} AS class FROM classed)),
{_packing(items, chars)}
SELECT lane, class, count(*) AS texts, count(DISTINCT batch) AS batches, CAST(sum(n_chars) AS BIGINT) AS chars FROM steps GROUP BY lane, class"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("lane"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")


@query(_batches_sql("CASE s.class WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 1 END", "CASE s.class WHEN 0 THEN 1600 WHEN 1 THEN 800 ELSE 0 END", 120, 400))
def q_smart_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2, A10: turns packed by role and length class."""
    return batching.batch_statistics(batching.packed(_turns(spark, sf_dir), "lane", "ord", "text", 4, 800, 120, 400))


@query(_batches_sql("CASE s.class WHEN 0 THEN 24 WHEN 1 THEN 12 ELSE 1 END", "CASE s.class WHEN 0 THEN 5200 WHEN 1 THEN 2600 ELSE 0 END", 120, 700))
def q_fast_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the limits of large inputs."""
    return batching.batch_statistics(batching.packed(_turns(spark, sf_dir), "lane", "ord", "text", 12, 800, 120, 700, fast=(16, 2600)))


@case("SELECT texts, items, most, CASE WHEN texts >= 2000 AND eligible THEN least(most, greatest(items, least(most, greatest(8, 2 * items)))) ELSE items END AS effective FROM (SELECT CAST(t AS INTEGER) AS texts, CAST(i AS INTEGER) AS items, CAST(m AS INTEGER) AS most, i % 2 = 0 AS eligible FROM (VALUES (10), (1999), (2000), (9000)) a(t), (VALUES (1), (2), (3), (4), (6), (20)) b(i), (VALUES (4), (16)) c(m))")
def q_effective_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 over a grid."""
    grid = spark.createDataFrame([(t, i, m) for t in (10, 1999, 2000, 9000) for i in (1, 2, 3, 4, 6, 20) for m in (4, 16)], "texts int, items int, most int")
    return grid.select("texts", "items", "most", batching.effective_items(F.col("texts"), F.col("items"), F.col("items") % 2 == 0, F.col("most")).alias("effective"))


@query(f"""
WITH f AS (SELECT lang AS lane, text, min(doc_id) AS ord FROM documents WHERE {_strip('text')} <> '' GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS n, CAST(sum(length(text)) OVER w AS BIGINT) AS total FROM f WINDOW w AS (PARTITION BY lane ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT lane, ord, n, total FROM s WHERE n = 1 OR (n <= 120 AND total <= 30000)
""")
def q_extraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts of each language up to 120 and 30000 characters."""
    return batching.sample_in_order(table(spark, sf_dir, "documents"), "lang", "doc_id", "text").drop("text").select("lane", "ord", F.col("n").cast("long").alias("n"), "total")


@query()
def q_chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 500 characters (tested against its properties)."""
    return batching.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 500)


# --- glossary -----------------------------------------------------------------------------------------------------------

_POLICY = "CASE " + " ".join(f"WHEN lower(trim(policy)) IN ({_in(v)}) THEN '{k}'" for k, v in glossary.POLICIES.items()) + " ELSE '' END"
_RANK = "list_position([" + _in(glossary.CATEGORIES) + "], category)"
_ALIASES = "list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(trim(coalesce(aliases, '')), '^(?i)(?:中文别名|别名|aliases|alias)[:：]', '')), '[\\n,，;；、|]+'), lambda a: trim(a)), lambda a: length(a) >= 2)"
_NORMAL = f"""(SELECT *, row_number() OVER (PARTITION BY original ORDER BY {_RANK}, ord) AS r, min(translation) OVER p <> max(translation) OVER p AS conflict FROM (
SELECT CASE WHEN category IN ({_in(glossary.CATEGORIES)}) THEN category ELSE 'Item' END AS category, ord, trim(coalesce(original, src)) AS original, trim(coalesce(translation, dst)) AS translation, coalesce({_POLICY}, '') AS policy, {_ALIASES} AS raw FROM {X.GLOSSARY.sql})
WHERE original <> '' AND translation <> '' WINDOW p AS (PARTITION BY original))"""


@case(f"SELECT category, ord, original, translation, policy, conflict, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS aliases FROM {_NORMAL} WHERE r = 1")
def q_glossary_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw glossary made uniform."""
    return glossary.normalised(X.GLOSSARY.df(spark))


@case(f"SELECT scope, ord, original, translation FROM {X.PROFILES.sql} QUALIFY row_number() OVER (PARTITION BY original ORDER BY list_position(['global', 'genre', 'series', 'book'], scope) DESC, ord) = 1")
def q_profile_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book before series, genre and global."""
    return glossary.by_scope(X.PROFILES.df(spark))


#: The first word, the first two and the first three of every benchmark item.
_TERMS = "(SELECT original, 'T' || min(item_id) AS translation FROM (SELECT item_id, unnest([s[1], s[1] || ' ' || s[2], s[1] || ' ' || s[2] || ' ' || s[3]]) AS original FROM (SELECT item_id, string_split(text, ' ') AS s FROM benchmark)) WHERE length(original) >= 2 GROUP BY original)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    words = [F.get(w, F.lit(k)) for k in range(3)]
    phrases = F.array(words[0], F.concat(words[0], F.lit(" "), words[1]), F.concat(words[0], F.lit(" "), words[1], F.lit(" "), words[2]))
    own = table(spark, sf_dir, "benchmark").select(F.explode(phrases).alias("original"), "item_id").where(F.length("original") >= 2)
    return own.groupBy("original").agg(F.concat(F.lit("T"), F.min("item_id").cast("string")).alias("translation"))


@query(f"SELECT doc_id AS id, original, translation, CAST(instr(text, original) - 1 AS INTEGER) AS first FROM documents JOIN {_TERMS} ON contains(text, original)")
def q_glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in all documents with their first place."""
    found = glossary.matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), "doc_id", "text")
    return found.select("id", "original", "translation", F.col("starts")[0].alias("first"))


@query(f"SELECT original, translation, count(*) AS texts, CAST(sum(cast((length(text) - length(replace(text, original, ''))) / length(original) AS BIGINT)) AS BIGINT) AS times FROM documents JOIN {_TERMS} ON contains(text, original) GROUP BY ALL")
def q_glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and occurrences of each term in all documents."""
    return glossary.counts(glossary.matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), "doc_id", "text"))


@query()
def q_glossary_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that a text's prompt gets."""
    found = glossary.matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), "doc_id", "text")
    return glossary.selected(found, 30)


@query(f"""
WITH RECURSIVE t AS (SELECT *, row_number() OVER (ORDER BY length(original) DESC, original) AS k FROM {_TERMS} WHERE original <> translation),
s AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, replace(s.text, t.original, t.translation), t.k, CAST((length(s.text) - length(replace(s.text, t.original, ''))) / length(t.original) AS BIGINT) FROM s JOIN t ON t.k = s.k + 1)
SELECT t.original AS match, t.translation, CAST(sum(n) AS BIGINT) AS n, count(*) AS texts FROM s JOIN t USING (k) WHERE n > 0 GROUP BY ALL
""")
def q_term_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms replaced in all documents, and how often."""
    own = _terms(spark, sf_dir).select(F.lit("Item").alias("category"), F.lit(0).alias("ord"), "original", "translation", F.lit("").alias("policy"), F.array().cast("array<string>").alias("aliases"))
    terms = glossary.term_list(glossary.replacement_terms(own))
    return glossary.replacement_totals(glossary.replace_terms(table(spark, sf_dir, "documents"), terms, "doc_id", "text"))


# --- consistency --------------------------------------------------------------------------------------------------------

def _pairs_glossary(spark: SparkSession) -> DataFrame:
    return glossary.normalised(X.GLOSSARY.df(spark))


_HEAD = f"regexp_extract(regexp_replace({_strip('target')}, '^[「『“‘\"''（(【\\[\\s]+', ''), '^[^，。！？、；：,.!?;:\\s]*')"
_ISSUES = f"""
met AS (SELECT p.book, p.seq, p.chapter, p.target, t.* FROM {X.PAIRS.sql} p JOIN {X.TERMS.sql} t ON contains(p.source, t.original) WHERE length(t.original) >= 2 AND {_strip('p.source')} <> '' AND {_strip('p.target')} <> ''),
heads AS (SELECT *, contains(target, translation) AS hit, substr({_HEAD}, 1, CAST(greatest(2, least(length(translation), 8)) AS INTEGER)) AS head FROM met),
seen AS (SELECT *, CASE WHEN hit THEN translation WHEN length(original) <= 8 AND length(head) >= 2 AND head <> translation AND regexp_matches(head, '^[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}A-Za-z0-9・·\\-]+$') THEN head END AS rendering FROM heads),
per AS (SELECT book, category, ord, original, translation AS wanted, coalesce(policy, '') IN ('contextual', 'reference', 'ignore') AS free, count(*) AS source_hits, count(*) FILTER (hit) AS wanted_hits, count(DISTINCT rendering) AS kinds FROM seen GROUP BY ALL),
verdicts AS (SELECT *, CASE WHEN free THEN NULL WHEN wanted_hits > 0 AND kinds > 1 THEN 'divergent' WHEN wanted_hits = 0 AND source_hits >= 3 THEN 'missing' END AS verdict FROM per),
ranked AS (SELECT book, original, rendering, count(*) AS n, row_number() OVER (PARTITION BY book, original ORDER BY count(*) DESC, bool_or(hit) DESC, min(seq)) AS place FROM seen WHERE rendering IS NOT NULL GROUP BY book, original, rendering)"""


@case(f"""WITH {_ISSUES}
SELECT v.book, v.original, v.wanted, v.verdict, v.source_hits, coalesce((SELECT string_agg(rendering || ' ' || n, '; ' ORDER BY place) FROM ranked r WHERE v.verdict = 'divergent' AND r.book = v.book AND r.original = v.original), '') AS variants
FROM verdicts v WHERE verdict IS NOT NULL""")
def q_consistency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.issues(X.PAIRS.df(spark), X.TERMS.df(spark))
    one = F.transform("variants", lambda v: F.concat(v["rendering"], F.lit(" "), v["n"].cast("string")))
    return found.select("book", "original", "wanted", "verdict", "source_hits", F.array_join(one, "; ").alias("variants"))


@case(f"""WITH {_ISSUES}
SELECT v.book, v.category, v.original, CASE WHEN v.verdict = 'divergent' AND r.n >= 2 THEN 'apply' ELSE 'review' END AS action, CASE WHEN v.verdict = 'divergent' AND r.n >= 2 THEN r.rendering END AS translation, CASE WHEN v.verdict = 'divergent' AND r.n >= 2 THEN r.n ELSE 0 END AS n
FROM verdicts v LEFT JOIN ranked r ON r.book = v.book AND r.original = v.original AND r.place = 1 WHERE verdict IS NOT NULL""")
def q_writeback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the issues of a book write back to the glossary."""
    return consistency.checked(X.PAIRS.df(spark), X.TERMS.df(spark)).select("book", "category", "original", "action", "translation", "n")


_TURNS = "(SELECT a.conv_id AS book, a.turn AS seq, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


@query(f"SELECT original, original AS wanted, count(*) AS source_hits, count(*) FILTER (contains(target, original)) AS wanted_hits, min(seq) FILTER (contains(target, original)) AS first_seq FROM {_TURNS} JOIN {_TERMS} ON contains(source, original) GROUP BY original")
def q_consistency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often what a question holds stands in its answer."""
    c = table(spark, sf_dir, "conversations")
    pairs = c.where("role = 'user'").select(F.col("conv_id").alias("book"), F.col("turn").alias("seq"), F.col("text").alias("source")).join(c.select(F.col("conv_id").alias("book"), (F.col("turn") - 1).alias("seq"), F.col("text").alias("target")), ["book", "seq"])
    terms = _terms(spark, sf_dir).select(F.lit("Item").alias("category"), F.lit(0).alias("ord"), "original", F.lit("").alias("policy"), F.col("original").alias("translation"))
    r = consistency.renderings(pairs, terms)
    return r.groupBy("original", "wanted").agg(F.sum("n").alias("source_hits"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("wanted_hits"), F.min(F.when(F.col("hit"), F.col("first_seq"))).alias("first_seq"))


@case("SELECT * FROM (VALUES ('ローラ', '劳拉', '萝拉', 'ok'), ('ローラ', '劳拉', '罗拉', 'ok'), ('日の下町', '日之下町', '日下町', 'ok'), ('日の下町', '日之下町', '日下', 'ok'), ('アシビ', '马醉木', 'bb', 'ok'), ('the', 'THE', '二二', 'ok'), ('x', '很好的', '很好', 'part_of_winner'), ('x', '很好的', '好', 'part_of_winner'), ('x', '很好的', '坏', 'short'), ('x', '很好的', '马醉', 'other_term')) AS v(original, winner, variant, reason)")
def q_safe_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variants may be replaced."""
    g = _pairs_glossary(spark)
    own = g.select("original", F.col("translation").alias("winner"), F.explode("aliases").alias("variant"))
    more = spark.createDataFrame([("x", "很好的", "很好"), ("x", "很好的", "好"), ("x", "很好的", "坏"), ("x", "很好的", "马醉")], "original string, winner string, variant string")
    return consistency.safe_variants(own.unionByName(more), g)


_UNIFY_TERMS = [("Person", 0, "ローラ", "劳拉", ["萝拉", "罗拉"]), ("Person", 1, "ユタカ", "丰", ["小丰"]), ("Item", 0, "アシビ", "马醉木", ["马醉", "夹竹"])]


@case(f"""
WITH own AS (SELECT * FROM {X.UNIFY.sql}), met AS (SELECT *, CASE WHEN contains(source, 'ローラ') THEN '劳拉' WHEN contains(source, 'ユタカ') THEN '丰' WHEN contains(source, 'アシビ') THEN '马醉木' END AS winner FROM own),
held AS (SELECT book, winner, count(*) FILTER (contains(target, winner)) AS n FROM met GROUP BY book, winner)
SELECT book, seq, CASE WHEN n < 2 OR n IS NULL THEN target WHEN winner = '劳拉' THEN replace(replace(target, '萝拉', winner), '罗拉', winner) WHEN winner = '丰' THEN replace(target, '小丰', winner) ELSE replace(target, '夹竹', winner) END AS target,
       CAST(CASE WHEN n < 2 OR n IS NULL THEN 0 WHEN winner = '劳拉' THEN (length(target) - length(replace(replace(target, '萝拉', ''), '罗拉', ''))) / 2 WHEN winner = '丰' THEN (length(target) - length(replace(target, '小丰', ''))) / 2 ELSE (length(target) - length(replace(target, '夹竹', ''))) / 2 END AS BIGINT) AS replaced
FROM met LEFT JOIN held USING (book, winner)
""")
def q_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([t[:4] for t in _UNIFY_TERMS], "category string, ord int, original string, translation string")
    variants = spark.createDataFrame([(o, w, v) for _, _, o, w, vs in _UNIFY_TERMS for v in vs], "original string, winner string, variant string")
    return consistency.unified(X.UNIFY.df(spark), variants, g)


# --- quality ------------------------------------------------------------------------------------------------------------

#: Documents in other scripts, so that kana is left over in them: vowels as kana, or most letters as Han and few as kana, at three lengths.
_LATIN, _VOWELS, _MOSTLY = "abcdefghijklmnopqrstuvwxyz", "あbcdえfghいjklmnおpqrstうvwxyz", "的人他她们说话来去お山水火木金土ク日月天地すのべん"
_TEXTS = f"""(SELECT seq, text FROM {X.TEXTS.sql} UNION ALL SELECT CAST(doc_id + 1000 AS INTEGER), CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN left(translate(text, '{_LATIN}', '{_VOWELS}'), 12) WHEN 2 THEN left(translate(text, '{_LATIN}', '{_MOSTLY}'), 24)
WHEN 3 THEN left(translate(text, '{_LATIN}', '{_MOSTLY}'), 90) ELSE translate(text, '{_LATIN}', '{_MOSTLY}') END FROM documents)"""
_K, _ALONE = "[\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}\\x{ff66}-\\x{ff9f}]", "[\\x{30a0}-\\x{30ff}\\x{ff66}-\\x{ff9f}]"
_HAN, _HAN4 = "\\x{3400}-\\x{9fff}", "\\x{4e00}-\\x{9fff}"
_sql = lambda pattern: pattern.replace("'", "''")
_U = lambda pattern: re.sub("\\\\u([0-9a-f]{4})", "\\\\x{\\1}", pattern).replace("'", "''")
#: Classes of texts without neighbourhoods that allow them; the patterns are data, the rules are written anew.
_CLASSES = f"""
raw AS (SELECT seq, {_strip("coalesce(text, '')")} AS raw FROM {_TEXTS}),
cut AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\\[\\[ja:.*?\\]\\]', '', 'g'), '([A-Za-z0-9])・([A-Za-z0-9])', '\\1\\2', 'g'), '{_U(quality.SHAPE)}', '', 'g'), '[「『“‘"''（(【\\[〈《]\\s*{_ALONE}\\s*[」』”’"''）)】\\]〉》]', '', 'g') AS t FROM raw),
runs AS (SELECT *, regexp_extract_all(t, '{_K}+') AS rs, regexp_extract_all(raw, '{_K}+') AS own, length(regexp_replace(t, '[^{_HAN4}]', '', 'g')) AS han4, length(regexp_replace(t, '[^{_HAN}]', '', 'g')) AS han, length(regexp_replace(raw, '[^{_HAN4}]', '', 'g')) AS raw_han FROM cut),
sums AS (SELECT *, length(array_to_string(rs, '')) AS total, len(rs) AS n, length(array_to_string(own, '')) AS own_total, len(own) AS own_n FROM runs),
signs AS (SELECT *, n > 0 AS kana, regexp_matches(t, 'お[{_HAN}々]{{1,3}}([^{_HAN}々]|$)') OR len(list_filter(regexp_extract_all(t, 'お([{_HAN}々])', 1), lambda x: NOT list_contains([{_in(quality.STEMS)}], x))) > 0 AS named, regexp_matches(t, '[{quality.JAPANESE_KANJI}]') AND regexp_matches(t, '{_U(quality.BETWEEN)}') AS grammar,
          regexp_matches(regexp_extract(raw, '{_U(quality.SHORT_QUOTE)}', 1), '{_K}') AS quoted, han4 >= 8 AND n <= 3 AND total <= greatest(3, han4 * 0.05) AS noise, raw_han >= 8 AND own_n BETWEEN 1 AND 4 AND own_total <= 24 AND (regexp_matches(raw, '{_U(quality.TITLE)}') OR own_total <= 16 AND regexp_matches(raw, '{_U(quality.NAME)}')) AS titled FROM sums),
classes AS (SELECT seq, CASE WHEN NOT kana THEN 'none' WHEN quoted THEN 'low' WHEN NOT named AND NOT grammar AND total = n AND n <= 3 THEN 'weak' WHEN noise OR titled THEN 'low' WHEN total >= 12 OR total >= 0.35 * length(t) OR total >= 5 AND han <= 2 THEN 'high' ELSE 'medium' END AS risk,
            kana AND NOT quoted AND NOT (NOT named AND NOT grammar AND total = n AND n <= 3) AS blocking FROM signs)"""


def _classified(spark: SparkSession, sf_dir: str, all_rows: bool = True) -> DataFrame:
    k = F.col("doc_id") % 5
    other = F.translate("text", _LATIN, _MOSTLY)
    text = F.when(k == 0, F.col("text")).when(k == 1, F.left(F.translate("text", _LATIN, _VOWELS), F.lit(12))).when(k == 2, F.left(other, F.lit(24))).when(k == 3, F.left(other, F.lit(90))).otherwise(other)
    own = X.TEXTS.df(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("int").alias("seq"), text.alias("text")))
    return quality.classified(own if all_rows else quality.with_kana(own, "text"), "text")


@query(f"WITH {_CLASSES} SELECT seq, risk, blocking FROM classes")
def q_residue_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q10 to Q18 over all texts of the fixture and all documents."""
    return _classified(spark, sf_dir).select("seq", "residue.risk", "residue.blocking")


@query(f"WITH {_CLASSES} SELECT risk, count(*) AS n, count(*) FILTER (blocking) AS blocking, min(seq) AS first FROM classes WHERE risk <> 'none' GROUP BY risk")
def q_residue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, Q17: counts by risk, and the first sample of each."""
    found = _classified(spark, sf_dir, all_rows=False)
    return quality.scan(found, "seq", "text").select("risk", "n", "blocking", "first")


@query(f"WITH {_CLASSES} SELECT policy, count(*) FILTER (CASE policy WHEN 'strict' THEN blocking WHEN 'balanced' THEN risk IN ('high', 'medium') ELSE false END) AS blocked FROM classes, (VALUES ('strict'), ('balanced'), ('lenient')) p(policy) GROUP BY policy")
def q_save_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q32: texts that stop a save under each policy."""
    found = _classified(spark, sf_dir, all_rows=False)
    return quality.gates(found)


@case(f"""
SELECT k, {_strip("coalesce(dst, '')")} = '' OR (length(src) >= 20 AND length(trim(dst)) <= 1) OR (length(trim(dst)) >= 8 AND list_max(list_transform(string_split(trim(dst), ''), lambda c: length(trim(dst)) - length(replace(trim(dst), c, '')))) / length(trim(dst)) >= 0.65) OR k = 4 AS suspicious
FROM {X.MISC.sql}
""")
def q_suspicious_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    return X.MISC.df(spark).select("k", T.suspicious_pair(F.col("src"), F.col("dst")).alias("suspicious"))


# --- logs, control, history ---------------------------------------------------------------------------------------------

_RAW = "lower(concat_ws(' ', coalesce(outcome, ''), coalesce(CAST(status_code AS VARCHAR), ''), coalesce(error, '')))"


@case(f"""
SELECT id, CASE WHEN coalesce(category, '') <> '' THEN lower(trim(category)) WHEN regexp_matches({_RAW}, 'residue|日文残留') THEN 'residue' WHEN regexp_matches({_RAW}, '{runs.MODERATION}') THEN 'security' WHEN regexp_matches({_RAW}, 'timeout|超时') THEN 'timeout'
       WHEN regexp_matches({_RAW}, 'json|format|格式|parse') THEN 'format' WHEN status_code = 429 OR regexp_matches({_RAW}, 'rate|限流') THEN 'rate_limit' WHEN lower(coalesce(outcome, '')) = 'ok' AND (status_code IS NULL OR status_code BETWEEN 200 AND 299) THEN 'ok' ELSE 'failed' END AS class,
       coalesce(status_code IN (408, 429, 500, 502, 503, 504), false) AS retryable,
       CASE id WHEN '1' THEN 'Authorization: Bearer *** and more' WHEN '2' THEN 'api_key=*** x' WHEN '3' THEN 'key *** rest' WHEN '5' THEN 'many spaces' WHEN '6' THEN substr(summary, 1, 240) || '...' ELSE coalesce(summary, '') END AS snippet,
       CAST(CASE WHEN coalesce(summary, '') = '' THEN 0 ELSE greatest(1, length(summary) // 2) END AS INTEGER) AS tokens,
       CASE id WHEN '2' THEN 7.0 WHEN '4' THEN 900.0 WHEN '5' THEN 0.0 WHEN '6' THEN 0.0 WHEN '7' THEN 100.0 WHEN '9' THEN 2.5 ELSE 0.0 END AS after,
       greatest(least(16.0, 2.0 * pow(2.0, greatest(0, coalesce(attempt, 0)))) + 0.5, 0.0) AS delay
FROM {X.LOG.sql}
""")
def q_log_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 to F11, F13, F34, F35, P12, P13, F44."""
    now = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    return X.LOG.df(spark).select(
        "id", runs.log_class(F.col("category"), F.col("outcome"), F.col("status_code"), F.col("error")).alias("class"), T.retryable(F.col("status_code")).alias("retryable"), T.snippet(F.col("summary")).alias("snippet"), T.log_tokens(F.col("summary")).alias("tokens"),
        T.retry_after(F.col("retry_after"), now).alias("after"), T.retry_delay(F.col("attempt"), F.lit(None).cast("double"), F.lit(0.5)).alias("delay"),
    )


@query("SELECT event_id, event_type, ts, value FROM events WHERE event_type = 'click' AND contains(lower(concat_ws(' ', event_type, props)), '1') ORDER BY ts DESC, event_type, props LIMIT 200")
def q_log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events that hold a query."""
    return runs.search(table(spark, sf_dir, "events"), "1", "click", ["event_type", "props"], "ts", 200, "event_type").select("event_id", "event_type", "ts", "value")


@query("SELECT event_id, CAST(day AS VARCHAR) AS day, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)) JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 14) USING (day) WHERE place <= 200")
def q_log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of the last 14 days."""
    return runs.retained(table(spark, sf_dir, "events"), "ts", "event_id", 200, 14).select("event_id", F.col("day").cast("string").alias("day"), F.col("place").cast("long").alias("place"))


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS s, CAST(1 + event_id % 50 AS INTEGER) AS tokens FROM events),
w AS (SELECT *, count(*) OVER x AS requests, CAST(sum(tokens) OVER x AS BIGINT) AS window_tokens, min(s) OVER x AS first, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS place FROM e WINDOW x AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)),
leaves AS (SELECT a.event_id, min(b.s) AS enough FROM w a JOIN w b ON a.event_type = b.event_type AND b.s BETWEEN a.s - 3600 AND a.s WHERE a.window_tokens > 200 AND (SELECT coalesce(sum(c.tokens), 0) FROM w c WHERE c.event_type = a.event_type AND c.s > b.s AND c.s <= a.s) <= 200 GROUP BY a.event_id),
sent AS (SELECT event_id, max(s - (place - 1) * 450.0) OVER (PARTITION BY event_type ORDER BY place) + (place - 1) * 450.0 - s AS gap FROM w)
SELECT event_id, requests, window_tokens, round(greatest(CASE WHEN requests > 8 THEN first + 3600 - s ELSE 0.0 END, CASE WHEN window_tokens > 200 THEN enough + 3600 - s ELSE 0.0 END), 3) AS wait, round(gap, 3) AS gap FROM w LEFT JOIN leaves USING (event_id) JOIN sent USING (event_id)
""")
def q_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, A13: requests and tokens of the last hour, the wait for room, and what even spacing holds back."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = runs.rate_windows(e, "event_type", "ts", "event_id", (1 + F.col("event_id") % 50).cast("int"), 8, 200, 3600)
    return out.select("event_id", "requests", "window_tokens", F.round("wait", 3).alias("wait"), F.round("gap", 3).alias("gap"))


@query("""
WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS ord, greatest(0.001, abs(value)) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events),
s AS (
  SELECT key, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[]) AS held, 4 AS w, 6 AS b, '' AS action FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT key, ord, place, CASE WHEN action = 'none' THEN ring ELSE [] END, w + CASE action WHEN 'down' THEN CASE WHEN b <= 1 THEN -1 ELSE 0 END WHEN 'up' THEN CASE WHEN b >= 6 THEN 1 ELSE 0 END ELSE 0 END,
         b + CASE action WHEN 'down' THEN CASE WHEN b > 1 THEN -1 ELSE 0 END WHEN 'up' THEN CASE WHEN b < 6 THEN 1 ELSE 0 END ELSE 0 END, action
  FROM (SELECT *, CASE WHEN n >= 8 AND (floor(total / n * 1000) >= 50000 OR slow >= 0.5 * n) AND (b > 1 OR w > 1) THEN 'down' WHEN n >= 16 AND floor(total / n * 1000) <= 30000 AND slow = 0 AND (b < 6 OR w < 4) THEN 'up' ELSE 'none' END AS action
        FROM (SELECT *, len(ring) AS n, list_sum(ring) AS total, len(list_filter(ring, lambda y: y >= 50)) AS slow
              FROM (SELECT s.key, e.ord, e.place, s.w, s.b, list_slice(list_append(s.held, e.x), -24, -1) AS ring FROM s JOIN e ON e.key = s.key AND e.place = s.place + 1)))
)
SELECT key, ord, action, w AS workers, b AS batch FROM s WHERE place > 0
""")
def q_latency_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, A14: what the controller does over events, their values as seconds."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.abs("value").alias("elapsed_s"))
    return runs.latency_control(e, "event_type", "event_id", 4, 6, 50.0)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def q_outcome_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts of tumbling hours."""
    return S.outcome_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", width="1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@case(f"SELECT task_id, count(*) AS total, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status IN ('failed', 'residue', 'save_residue')) AS failed, CAST(sum(chars) AS BIGINT) AS chars, round_even(count(*) FILTER (status = 'success') / count(*), 4) AS progress FROM {X.SUBTASKS.sql} GROUP BY task_id")
def q_task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return runs.task_summary(X.SUBTASKS.df(spark))


@case(f"SELECT p.task_id, p.index, p.source, sha1(p.source) AS source_hash, coalesce(s.status, 'pending') AS status, coalesce(s.translation, '') AS translation, CAST(length(p.source) AS INTEGER) AS chars FROM {X.PLAN.sql} p LEFT JOIN {X.SUBTASKS.sql} s ON p.task_id = s.task_id AND p.index = s.index AND p.source = s.source AND s.status IN ({_in(runs.DONE)})")
def q_subtask_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, F7, F18, ST7."""
    return runs.resumed(X.PLAN.df(spark), X.SUBTASKS.df(spark).withColumn("source_hash", F.sha1("source")))


@case(f"""
SELECT task_id, kind, text, translation, CAST(min(ord) AS INTEGER) AS ord, arg_min(reason, ord) AS reason, row_number() OVER (PARTITION BY task_id ORDER BY min(ord)) AS place FROM {X.BLOCKS.sql} b
WHERE NOT EXISTS (SELECT 1 FROM {X.FIXED.sql} f WHERE f.task_id = b.task_id AND replace(f.text, ' ', '') = replace(b.text, ' ', '')) GROUP BY task_id, kind, text, translation
""")
def q_failed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, W4."""
    return runs.failed_blocks(X.BLOCKS.df(spark), X.FIXED.df(spark)).withColumn("place", F.col("place").cast("long"))


@case(f"SELECT task_id, ord, CASE WHEN reason = 'timeout' THEN 'timeout' WHEN reason = 'json' THEN 'json_format' WHEN trim(translation) = '' THEN 'empty_output' WHEN kind = 'residue' THEN 'residue_high' ELSE 'provider_error' END AS issue, CASE WHEN reason = 'timeout' THEN 'retry' WHEN reason = 'json' THEN 'single_retry' WHEN trim(translation) = '' THEN 'retry' WHEN kind = 'residue' THEN 'retranslate' ELSE 'switch_provider' END AS action FROM {X.BLOCKS.sql}")
def q_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2, R4."""
    issue = runs.issue_class(F.col("reason"), F.col("translation"), F.when(F.col("kind") == "residue", "high"))
    return X.BLOCKS.df(spark).select("task_id", "ord", issue.alias("issue"), runs.recommended(issue).alias("action"))


@case(f"""
SELECT k, list_slice(list_concat(list_transform(regexp_extract_all(coalesce(version, ''), '\\d+'), lambda x: CAST(x AS INTEGER)), [0, 0, 0, 0]), 1, 4) AS version,
       CASE WHEN coalesce(secret, '') = '' THEN '' WHEN length(secret) <= 8 THEN '***' ELSE substr(secret, 1, 4) || '***' || right(secret, 4) END AS masked,
       CASE k WHEN 1 THEN 'a-b-c-txt' WHEN 2 THEN 'con' WHEN 3 THEN 'x-y-z' WHEN 4 THEN '正常-名' WHEN 5 THEN 'hello-world' ELSE 'profile' END AS slug,
       CASE k WHEN 1 THEN 'a_b_c_.txt' WHEN 2 THEN 'CON_' WHEN 3 THEN 'x y__z' WHEN 4 THEN '正常 名' WHEN 5 THEN 'Hello, World!' ELSE '' END AS file_name,
       round_even(100 * (texts - failed) / nullif(texts, 0), 1) AS success, round_even(texts / nullif(seconds, 0), 2) AS texts_s,
       CASE k WHEN 1 THEN '1 min' WHEN 2 THEN '1 min' WHEN 3 THEN '1 h 7 min' WHEN 4 THEN '1 h 1 min' WHEN 5 THEN '1 min' ELSE '2 h' END AS duration,
       greatest(ceil(texts / 4) * 3.0 / 2.95, chars / (90 * 2.95)) + greatest(10.0, 0.02 * texts) AS estimate, CAST(floor(chars / 4) + 12 * greatest(1, texts) AS BIGINT) AS budget
FROM {X.MISC.sql}
""")
def q_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, F20 to F22, F37, F38, F43, A18, P15, S31."""
    c = F.col
    rate, texts_s, _ = runs.run_statistics(c("texts"), c("failed"), c("chars"), c("seconds"))
    return X.MISC.df(spark).select(
        "k", T.version(c("version")).alias("version"), T.mask(c("secret")).alias("masked"), T.slug(c("name")).alias("slug"), titles.file_name(c("name")).alias("file_name"), rate.alias("success"), texts_s.alias("texts_s"), T.duration_text(c("seconds")).alias("duration"),
        runs.duration_estimate(c("texts"), c("chars"), F.lit(90), F.lit(3.0), F.lit(4), F.lit(4)).alias("estimate"), T.budget_tokens(c("chars"), c("texts")).alias("budget"),
    )


@query(f"""
WITH s AS (SELECT doc_id AS id, genre, genre_ord, CAST(sum(least(CAST((length(lower(text)) - length(replace(lower(text), keyword, ''))) / length(keyword) AS INTEGER), 4) * weight) AS BIGINT) AS score FROM documents JOIN {X.KEYWORDS.sql} ON contains(lower(text), keyword) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, genre_ord))
SELECT id, genre, score, CAST(least(100, 8 * score + 4 * (score - second)) AS INTEGER) AS confidence FROM r WHERE r = 1
""")
def q_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre that a document's words speak for."""
    found = runs.keyword_scores(table(spark, sf_dir, "documents"), X.KEYWORDS.df(spark), "doc_id", "text")
    ords = X.KEYWORDS.df(spark).select("genre", "genre_ord").distinct()
    return runs.style(found.join(F.broadcast(ords), "genre"))


@case("SELECT * FROM (VALUES (1, 0, 'a'), (1, 1, 'B'), (1, 2, NULL), (2, 0, 'x'), (2, 1, NULL)) AS v(batch_id, idx, value)")
def q_reply_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by place."""
    return runs.aligned(X.REPLIES.df(spark))


@query()
def q_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of all pages (tested against pages with known blocks)."""
    return H.blocks(table(spark, sf_dir, "pages"))


@query("""
WITH t AS (SELECT DISTINCT conv_id AS batch, text FROM conversations WHERE role = 'user'), a AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]') THEN NULL ELSE 'ZH:' || text END AS answer FROM t),
b AS (SELECT *, count(DISTINCT text) OVER (PARTITION BY batch) AS kinds, count(*) OVER (PARTITION BY batch, answer) AS times FROM a)
SELECT batch, sha256(text) AS key, answer, CASE WHEN answer IS NULL THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN answer IS NULL OR times >= 3 AND kinds >= 3 OR len(list_filter(range(1, CAST(length(answer) AS BIGINT)), lambda i: len(list_filter(range(2, 11), lambda n: length(answer) >= i - 1 + 4 * n AND substr(answer, i, 4 * n) = repeat(substr(answer, i, n), 4))) > 0)) > 0 THEN 'retranslate' ELSE 'keep' END AS route FROM b
""")
def q_stage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different questions of each conversation through the stub provider, and their routes, as stages of which one is switched off."""
    stages = enrich.Stages(
        enrich.Stage("tasks", lambda df: cache.distinct_tasks(df, "turn", "text", "conv_id")),
        enrich.Stage("provider", lambda df: enrich.enriched(df, enrich.stub, "task_key", "text", "conv_id")),
        enrich.Stage("nothing", lambda df: df.limit(0)),
    ).add(enrich.Stage("routes", enrich.routed)).switch("nothing", False)
    return stages.run(table(spark, sf_dir, "conversations").where("role = 'user'")).select("batch", "key", "answer", "status", "route")


@case("SELECT * FROM (VALUES (1, 0, 1, 'b'), (1, 1, 0, 'a'), (2, 0, NULL, 'x'), (2, 1, NULL, 'y'), (3, 0, 4, 'said \"so\" here'), (4, 0, 0, 'fenced')) AS v(batch_id, pos, idx, value)")
def q_reply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items of well-formed, fenced and broken replies."""
    raw = ['{"translations": [{"idx": 1, "zh": "b"}, {"index": "0", "text": " a "}]}', 'Here: ["x", "y"] done', '{"items": [{"idx": 4, "zh": "said "so" here"}]', '```json\n[{"id": 0, "translation": "fenced"}]\n```', "nothing", None]
    return enrich.parsed_replies(spark.createDataFrame(list(enumerate(raw, 1)), "batch_id int, raw string"))


@case("SELECT * FROM (VALUES (1, 'apply'), (2, 'invalid'), (3, 'provider_pinned'), (4, 'locked'), (5, 'manual_review'), (6, 'invalid')) AS v(k, verdict)")
def q_recovery_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of proposed recoveries."""
    rows = [(1, "timeout", "retry", 0.9, "a", "a"), (2, "timeout", "dance", 0.9, "", ""), (3, "timeout", "retry", 0.9, "a", "b"), (4, "moderation", "retry", 0.99, "", ""), (5, "timeout", "retry", 0.5, "", ""), (6, "timeout", "retry", 1.5, "", "")]
    df = spark.createDataFrame(rows, "k int, issue string, action string, confidence double, provider string, pinned string")
    return df.select("k", enrich.decision(*[F.col(c) for c in ("issue", "action", "confidence", "provider", "pinned")]).alias("verdict"))
