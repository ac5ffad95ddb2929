"""Cache tables: layered lookup, lookup across models, merges, expiry and usage. Time is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import key_scope, parse_key, strip, text
from lexweave.operators import quality


def distinct_tasks(df: DataFrame, order: str, text_col: str, *scope: str) -> DataFrame:
    """One row per different text (in its scope) with its multiplicity, places and first place."""
    own = df.where(strip(text(F.col(text_col))) != "")
    return own.groupBy(*scope, F.sha2(F.col(text_col), 256).alias("task_key")).agg(F.count("*").alias("n"), F.min(order).alias("first_ord"), F.sort_array(F.collect_list(order)).alias("places"), F.min(text_col).alias("text"))


def layered(tasks: DataFrame, layers: list[tuple[str, DataFrame, bool]], key: str = "task_key", valid: Column | None = None) -> DataFrame:
    """The first layer that holds a valid answer for each task: its columns, layer (or pending) and answer.

    layers: (name, (key, answer, trusted), whether trusted answers skip the validity check), best first. An invalid answer
    falls through to the next layer. valid tells of a column named answer.
    """
    good = valid if valid is not None else strip(text(F.col("answer"))) != ""
    offered = []
    for rank, (name, layer, trusts) in enumerate(layers):
        passes = good | F.col("trusted") if trusts else good
        offered.append(layer.where(passes).select(F.col(key), F.lit(rank).alias("rank"), F.lit(name).alias("layer"), "answer"))
    best = reduce(DataFrame.unionByName, offered).groupBy(key).agg(F.min(F.struct("rank", "answer", "layer")).alias("b"))
    return tasks.join(best, key, "left").select(*[F.col(c) for c in tasks.columns], F.coalesce("b.layer", F.lit("pending")).alias("layer"), F.col("b.answer").alias("answer"))


def across_models(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """For each asked (cache_key, source_hash, context_hash): the latest other entry of the source in the same context, without a glossary."""
    e = entries.where((F.col("cache_type") == "model") & (text(F.col("glossary_fingerprint")) == "")).select(F.col("cache_key").alias("found_key"), F.col("source_hash").alias("s"), F.col("context_hash").alias("c"), "translated_text", "updated_at")
    met = asked.join(e, (F.col("source_hash") == F.col("s")) & F.col("context_hash").eqNullSafe(F.col("c")) & (F.col("cache_key") != F.col("found_key")), "left")
    best = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc_nulls_last("updated_at"), "found_key"))
    return met.withColumn("r", best).where("r = 1").select("cache_key", "found_key", "translated_text")


def normalised(entries: DataFrame) -> DataFrame:
    """Entries with the fields that their keys tell; rows of unknown type or without key or text are left out."""
    kind, source, context = parse_key(F.col("cache_key"))
    provider, model, fingerprint = key_scope(F.col("cache_key"))
    is_model = F.col("cache_type") == "model"
    own = entries.where(F.col("cache_type").isin("model", "text", "manual") & (text(F.col("cache_key")) != "") & (strip(text(F.col("translated_text"))) != ""))
    return own.select(
        "cache_type", "cache_key", F.when(is_model, source).otherwise(F.col("cache_key")).alias("source_hash"), F.when(is_model, context).alias("context_hash"),
        F.when(is_model, provider).alias("provider"), F.when(is_model, model).alias("model"), F.when(is_model, fingerprint).alias("glossary_fingerprint"), F.when(is_model, kind).alias("kind"), "translated_text",
    )


def upserted(base: DataFrame, new: DataFrame) -> DataFrame:
    """Both keyed by (cache_type, cache_key): new rows win, but keep the old source text where theirs is null, and created_at, hit_count and last_used_at of old rows."""
    b, n = base.alias("b"), new.alias("n")
    met = b.join(n, ["cache_type", "cache_key"], "full_outer")
    fresh = F.col("n.translated_text").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return met.select(
        "cache_type", "cache_key", F.coalesce("n.source_text", "b.source_text").alias("source_text"), pick("translated_text"), pick("trusted"), pick("verified"),
        F.coalesce("b.created_at", "n.created_at").alias("created_at"), pick("updated_at"), F.coalesce("b.last_used_at", "n.last_used_at").alias("last_used_at"), F.coalesce("b.hit_count", "n.hit_count", F.lit(0)).cast("long").alias("hit_count"),
    )


#: The columns of a cache.
ENTRY = (
    "cache_type string, cache_key string, source_hash string, context_hash string, source_text string, translated_text string, provider string, model string, glossary_fingerprint string, "
    "trusted boolean, verified boolean, payload_json string, created_at long, updated_at long, last_used_at long, hit_count long"
)


def entries(raw: DataFrame, now: int) -> DataFrame:
    """Entries, in the columns of ENTRY and seq, from rows (cache_type, cache_key, translated_text, payload_json, seq).

    What a model's key tells of provider, model, glossary, source and context is split off; a key that tells nothing is the source text. Other
    keys are the hash of the source, whose text, trust, verification and time the payload may tell; without a payload nothing is trusted.
    Rows of unknown type, or without key or text, are left out. In a payload null counts as absent.
    """
    _, source, context = parse_key(F.col("cache_key"))
    provider, model, fingerprint = key_scope(F.col("cache_key"))
    is_model = F.col("cache_type") == "model"
    said = F.from_json("payload_json", "source string, trusted string, verified string, updated_at string")
    given = F.col("payload_json").isNotNull() & ~is_model
    true = lambda c, default: F.coalesce(~F.lower(c).isin("", "0", "0.0", "false", "[]", "{}"), default)
    own = raw.where(F.col("cache_type").isin("model", "text", "manual") & (text(F.col("cache_key")) != "") & (F.col("translated_text") != "")).withColumn("p", said)
    bare = is_model & (text(source) == "")
    at = F.when(given, F.nullif(F.expr("try_cast(p.updated_at AS long)"), F.lit(0)))
    own_hash = F.when(bare, F.sha2("cache_key", 256)).when(is_model, source).otherwise(F.col("cache_key"))
    return own.select(
        "cache_type", "cache_key", own_hash.alias("source_hash"), F.when(is_model, context).alias("context_hash"),
        F.when(bare, F.col("cache_key")).when(given, F.nullif(F.col("p.source"), F.lit(""))).alias("source_text"), "translated_text",
        F.when(is_model, provider).alias("provider"), F.when(is_model, model).alias("model"), F.when(is_model, fingerprint).alias("glossary_fingerprint"),
        F.when(given, true(F.col("p.trusted"), F.col("cache_type") == "manual")).otherwise(F.lit(False)).alias("trusted"), F.when(given, true(F.col("p.verified"), F.lit(False))).otherwise(F.lit(False)).alias("verified"),
        "payload_json", F.coalesce(at, F.lit(now)).cast("long").alias("created_at"), F.coalesce(at, F.lit(now)).cast("long").alias("updated_at"), F.lit(None).cast("long").alias("last_used_at"), F.lit(0).cast("long").alias("hit_count"), "seq",
    )


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of entries of one key the last by seq, with the last source text that isn't null."""
    own = [f.split()[0] for f in ENTRY.split(", ")]
    last = rows.groupBy("cache_type", "cache_key").agg(F.max_by(F.struct(*own[2:]), "seq").alias("l"), F.max_by("source_text", F.when(F.col("source_text").isNotNull(), F.col("seq"))).alias("t"), F.min_by("created_at", "seq").alias("c"))
    return last.select("cache_type", "cache_key", *[(F.col("t") if c == "source_text" else F.col("c") if c == "created_at" else F.col(f"l.{c}")).alias(c) for c in own[2:]])


def merged(base: DataFrame, new: DataFrame) -> DataFrame:
    """Both in the columns of ENTRY, one row a key: new rows win, but what they don't have of a source text, when the entry was made, and its uses stay the old row's."""
    met = base.alias("b").join(new.alias("n"), ["cache_type", "cache_key"], "full_outer")
    fresh = F.col("n.translated_text").isNotNull()
    stays = {"source_text": ("n", "b"), "created_at": ("b", "n"), "last_used_at": ("b", "n"), "hit_count": ("b", "n")}
    pick = lambda c: F.coalesce(*[F.col(f"{x}.{c}") for x in stays[c]]) if c in stays else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}"))
    return met.select("cache_type", "cache_key", *[pick(c).alias(c) for c in (f.split()[0] for f in ENTRY.split(", ")[2:])])


def guarded_text_saves(base: DataFrame, new: DataFrame, fingerprint: str = "") -> DataFrame:
    """The new text entries that may be written: none under a glossary, none over a verified entry, none that change nothing."""
    if fingerprint:
        return new.limit(0)
    kept = base.where("cache_type = 'text'").select("cache_key", F.col("translated_text").alias("old"), F.col("verified").alias("was_verified"))
    return new.join(kept, "cache_key", "left").where(~F.coalesce("was_verified", F.lit(False)) & ~F.col("translated_text").eqNullSafe(F.col("old"))).drop("old", "was_verified")


def unexpired(entries: DataFrame, now: int, days: int) -> DataFrame:
    """Without model entries, and texts not verified, that nobody used for max(30, days) days."""
    old = F.coalesce("last_used_at", "updated_at") < now - max(30, days) * 86_400
    return entries.where(~(old & ((F.col("cache_type") == "model") | (F.col("cache_type") == "text") & ~F.coalesce("verified", F.lit(False)))))


def outside_scope(entries: DataFrame, provider: str, model: str = "", before: int | None = None) -> DataFrame:
    """Without the model entries of a provider, and of a model and updated before a time where these are given."""
    gone = (F.col("cache_type") == "model") & (F.lower(text(F.col("provider"))) == provider.lower())
    if model:
        gone &= F.lower(text(F.col("model"))) == model.lower()
    if before is not None:
        gone &= F.col("updated_at") < before
    return entries.where(~gone)


def with_usage(entries: DataFrame, usage: DataFrame) -> DataFrame:
    """hit_count and last_used_at after usage rows (cache_type, cache_key, used_at)."""
    u = usage.groupBy("cache_type", "cache_key").agg(F.count("*").alias("hits"), F.max("used_at").alias("used"))
    met = entries.join(u, ["cache_type", "cache_key"], "left")
    return met.withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).withColumn("last_used_at", F.greatest("last_used_at", "used")).drop("hits", "used")


def without_texts(entries: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Without the entries of given texts in any layer, whether keyed by plain text, SHA-256 or MD5."""
    c = F.col(text_col)
    keys = texts.select(F.explode(F.array(c, F.sha2(c, 256), F.sha2(strip(c), 256), F.md5(c))).alias("gone")).distinct()
    own = entries.withColumn("_source", F.coalesce("source_hash", "cache_key"))
    return own.join(keys, F.col("_source") == F.col("gone"), "left_anti").drop("_source")


def got(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (cache_type, cache_key) with translated_text where the cache holds it; the keys found are what with_usage() counts."""
    return asked.join(entries.select("cache_type", "cache_key", "translated_text"), ["cache_type", "cache_key"], "left")


def without_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the entries of the keys (cache_type, cache_key), and of those that have one of the source hashes (source_hash) where that column is given."""
    out = entries.join(keys.where("cache_key is not null").select("cache_type", "cache_key").distinct(), ["cache_type", "cache_key"], "left_anti")
    if "source_hash" in keys.columns:
        out = out.join(keys.where("source_hash is not null").select("source_hash").distinct(), "source_hash", "left_anti").select(*entries.columns)
    return out


def cleared(entries: DataFrame, kind: str = "") -> DataFrame:
    """Without all entries, or all of a type."""
    return entries.where(F.col("cache_type") != kind) if kind else entries.limit(0)


def with_pending(base: DataFrame, pending: DataFrame, order: str) -> DataFrame:
    """Entries as a reader sees them while writes wait: the last pending write of a key, which may be a deletion (deleted), else the stored one."""
    last = pending.groupBy("cache_type", "cache_key").agg(F.max_by(F.struct("translated_text", "deleted"), order).alias("p"))
    met = base.select("cache_type", "cache_key", "translated_text").join(last, ["cache_type", "cache_key"], "full_outer")
    return met.where(~F.coalesce("p.deleted", F.lit(False))).select("cache_type", "cache_key", F.when(F.col("p").isNotNull(), F.col("p.translated_text")).otherwise(F.col("translated_text")).alias("translated_text"))


def shown(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (source_hash) with what a user sees: the manual entry, else the text's, else the model's latest."""
    rank = F.when(F.col("cache_type") == "manual", 0).when(F.col("cache_type") == "text", 1).otherwise(2)
    best = entries.groupBy("source_hash").agg(F.min_by(F.struct("cache_type", "translated_text"), F.struct(rank.alias("r"), (-F.coalesce("updated_at", F.lit(0))).alias("u"), "cache_key")).alias("b"))
    return asked.join(best, "source_hash", "left").select("source_hash", F.col("b.cache_type").alias("cache_type"), F.col("b.translated_text").alias("translated_text"))


def unseen_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, length, modificationTime), as Spark's binary files have them, that no earlier migration (path, fingerprint) took in this state, with their fingerprints."""
    own = files.withColumn("fingerprint", F.concat_ws(":", F.col("length").cast("string"), F.unix_micros(F.col("modificationTime")).cast("string")))
    return own.join(known.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def ruled(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (id, text) with the answer of a fixed phrase: of the stripped text, else of the text without corner quotes around it; the answer stands without quotes then. A short list of places with readings is its own answer without them, if nothing blocks in what is left. Null without an answer."""
    own = texts.withColumn("_s", strip(text(F.col("text")))).withColumn("_bare", F.regexp_replace("_s", "^[「『]+|[」』]+$", ""))
    r = rules.select(F.col("phrase"), F.col("answer"))
    one = r.select(F.col("phrase").alias("_s"), F.col("answer").alias("_whole"))
    two = r.select(F.col("phrase").alias("_bare"), F.col("answer").alias("_inner"))
    met = own.join(one, "_s", "left").join(two, "_bare", "left")
    read = quality.once(met, "_read", quality.without_listed_readings(F.col("_s")))
    listed = F.when((F.col("_read") != F.col("_s")) & ~F.col("residue.blocking"), F.col("_read"))
    return quality.classified(read, "_read").select("id", "text", F.coalesce("_whole", "_inner", listed).alias("answer"))
