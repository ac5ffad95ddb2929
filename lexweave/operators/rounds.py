"""Rounds of provider calls over a ledger: partial replies, continuations, retries, single texts, a second provider; nothing is asked twice.

Every round sends all requests that are open, and writes what came back to the ledger, a folder of tables in shared storage. From
a round's rows follows what is open next: a reply that was cut off is continued, a failure that may pass is repeated, what a batch leaves
without an answer goes alone, what is refused as moderated goes to a second provider. Each of these is bounded, so the rounds end. A job
that is killed goes on after the last round that was written whole; only requests of an unfinished round can be sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import batching, glossary, runs
from lexweave.operators.enrich import json_value, reply_items
from lexweave.sources import files


class Ask(NamedTuple):
    """A request: its name, batch, single or fallback, how often it was tried before, pieces of the reply so far with their text, and the texts."""

    name: str
    mode: str
    tries: int
    pieces: int
    held: str
    texts: list[str]


class Reply(NamedTuple):
    """An HTTP status (0 where no answer came in time), the content, why the provider stopped, and the tokens used."""

    status: int
    content: str = ""
    finish: str = "stop"
    tokens: int | None = None


#: A provider answers one request; it may raise OSError or TimeoutError where no answer comes.
Caller = Callable[[Ask], Reply]

#: Most tries of a request, most continuations of a reply.
TRIES, CONTINUED = 4, 2
_ITEMS = "array<struct<idx:int,key:string,text:string>>"
LEDGER = f"ask string, mode string, tries int, pieces int, held string, items {_ITEMS}, status int, content string, finish string, tokens long, found array<struct<idx:int,value:string>>"


def found_in(mode: str, content: str, places: list[int], accepts: Callable[[str], bool]) -> list[tuple[int, str]]:
    """(place, answer) of what a reply's content holds for a request's places; of several answers for one place the last."""
    if mode != "batch":
        own = content.strip()
        return [(places[0], own)] if own and accepts(own) else []
    own = [(k if place is None else place, value.strip()) for k, (place, value) in enumerate(reply_items(content))]
    return list({place: value for place, value in own if 0 <= place < len(places) and value}.items())


def first_asks(tasks: DataFrame, batch: str, key: str, text_col: str, order: str) -> DataFrame:
    """Requests for tasks: a batch each, or a single text where a batch has but one."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))))
    own = tasks.where(F.col(batch).isNotNull() & F.col(key).isNotNull() & (T.strip(T.text(F.col(text_col))) != "")).groupBy(F.col(batch).cast("string").alias("ask")).agg(rows.alias("rows"))
    items = F.transform("rows", lambda x, k: F.struct(k.alias("idx"), x["key"].alias("key"), x["text"].alias("text")))
    mode = F.when(F.size("rows") == 1, "single").otherwise("batch")
    return own.select("ask", mode.alias("mode"), F.lit(0).alias("tries"), F.lit(0).alias("pieces"), F.lit("").alias("held"), items.cast(_ITEMS).alias("items"))


def sent(asks: DataFrame, provider: Caller, fallback: Caller | None, accepts: Callable[[str], bool]) -> DataFrame:
    """The requests with what came back."""
    def call(ask: Ask) -> Reply:
        try:
            return (fallback if ask.mode == "fallback" else provider)(ask)
        except (OSError, TimeoutError):
            return Reply(0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, mode, tries, pieces, held, items in part.itertuples(index=False):
                reply = call(Ask(name, mode, tries, pieces, held, [x["text"] for x in items]))
                found = found_in(mode, held + reply.content, [x["idx"] for x in items], accepts) if reply.status == 200 else []
                # places of a single text that came from a batch are still the batch's
                rows.append((*reply, [{"idx": i, "value": v} for i, v in found]))
            yield part.assign(**{n: list(c) for n, c in zip(("status", "content", "finish", "tokens", "found"), zip(*rows, strict=True) if rows else [()] * 5, strict=True)}).astype({"tokens": "Int64"})

    return asks.mapInPandas(run, LEDGER)


def states(ledger: DataFrame, again: bool, tries: int = TRIES, continued: int = CONTINUED) -> DataFrame:
    """Rows of the ledger with what follows: continue, retry, alone, fallback or end; again tells whether there is a second provider."""
    good = F.col("status") == 200
    cut = good & (F.col("finish") == "length") & (F.col("pieces") < continued)
    passing = (F.col("status") == 0) | T.retryable(F.col("status").cast("string")) | (good & (F.size("found") == 0))
    missing = F.size("found") < F.size("items")
    then = F.when(cut, "continue").when(passing & (F.col("tries") + 1 < tries), "retry").when(~missing, "end").when(F.col("mode") == "batch", "alone")
    return ledger.withColumn("then", then.when((F.col("mode") == "single") & refused() & F.lit(again), "fallback").otherwise("end"))


def refused() -> Column:
    """A request that its content forbids: it passes with no retry."""
    return F.col("status").between(400, 499) & ~T.retryable(F.col("status").cast("string")) & F.lower("content").rlike(runs.MODERATION)


def next_asks(done: DataFrame) -> DataFrame:
    """The requests that states()'s rows lead to."""
    columns = [c.split()[0] for c in LEDGER.split(", ")[:6]]
    then = F.col("then")
    same = done.where(then.isin("continue", "retry", "fallback"))
    on = then == "continue"
    same = same.select(
        "ask", F.when(then == "fallback", "fallback").otherwise(F.col("mode")).alias("mode"), F.when(on, F.col("tries")).when(then == "retry", F.col("tries") + 1).otherwise(0).alias("tries"),
        F.when(on, F.col("pieces") + 1).otherwise(0).alias("pieces"), F.when(on, F.concat("held", "content")).otherwise("").alias("held"), "items",
    )
    answered = F.transform("found", lambda x: x["idx"])
    left = done.where(then == "alone").select("ask", F.explode(F.filter("items", lambda x: ~F.array_contains(answered, x["idx"]))).alias("x"))
    own = F.array(F.struct(F.lit(0).alias("idx"), F.col("x.key").alias("key"), F.col("x.text").alias("text"))).cast(_ITEMS)
    alone = left.select(F.concat_ws("/", "ask", F.col("x.idx").cast("string")).alias("ask"), F.lit("single").alias("mode"), F.lit(0).alias("tries"), F.lit(0).alias("pieces"), F.lit("").alias("held"), own.alias("items"))
    return same.select(*columns).unionByName(alone.select(*columns))


def _rounds(spark: SparkSession, folder: str) -> list[str]:
    """Rounds in a ledger that were written whole."""
    return [n for n in files.names(spark, folder) if n.startswith("round=") and "_SUCCESS" in files.names(spark, f"{folder}/{n}")]


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All rounds of a ledger, with round int."""
    known = _rounds(spark, folder)
    return spark.read.schema(LEDGER + ", round int").option("basePath", folder).parquet(*[f"{folder}/{n}" for n in known]) if known else spark.createDataFrame([], LEDGER + ", round int")


def run(tasks: DataFrame, folder: str, provider: Caller, fallback: Caller | None = None, batch: str = "batch", key: str = "key", text_col: str = "text", order: str = "ord", accepts: Callable[[str], bool] = lambda s: True, tries: int = TRIES, continued: int = CONTINUED) -> DataFrame:
    """Ask for all tasks that the ledger in `folder` doesn't know yet, go on with those it does, and return outcomes().

    Rows without batch, key or text are left out; of equal keys in a batch each is asked. A provider is called once a request and round, by
    the task that holds it; how many at once is the number of partitions.
    """
    spark = tasks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ledger = read_ledger(spark, folder)
    # what is open after the last round leads on; tasks that no round has seen begin
    seen = ledger.select(F.explode("items.key").alias(key)).distinct()
    fresh = tasks.withColumn(key, F.col(key).cast("string")).join(seen, key, "left_anti")
    known = _rounds(spark, folder)
    at = len(known)
    asks = first_asks(fresh, batch, key, text_col, order)
    if known:
        asks = asks.unionByName(next_asks(states(ledger.where(F.col("round") == at), fallback is not None, tries, continued)))
    for _ in range(3 * tries * (continued + 1) + 1):
        if asks.isEmpty():
            return outcomes(read_ledger(spark, folder))
        at += 1
        where = f"{folder}/round={at}"
        # not overwritten by halves: an unfinished round of a killed job is written anew
        sent(asks.repartition(parts, "ask"), provider, fallback, accepts).write.mode("overwrite").parquet(where)
        asks = next_asks(states(spark.read.schema(LEDGER).parquet(where), fallback is not None, tries, continued))
    raise RuntimeError("requests are still open")


def outcomes(ledger: DataFrame) -> DataFrame:
    """(key, answer, status, asked) of each task: ok with its batch, single, fallback, moderated or failed; asked is how many requests held it."""
    value = F.get(F.transform(F.filter("found", lambda f: f["idx"] == F.col("x.idx")), lambda f: f["value"]), F.lit(0))
    each = ledger.select("round", "mode", F.explode("items").alias("x"), "found", refused().alias("refused")).select(F.col("x.key").alias("key"), "round", "mode", value.alias("value"), "refused")
    last = each.groupBy("key").agg(F.max_by(F.struct("mode", "value", "refused"), "round").alias("l"), F.count("*").alias("asked"))
    status = F.when(F.col("l.value").isNull(), F.when(F.col("l.refused"), "moderated").otherwise("failed")).when(F.col("l.mode") == "batch", "ok").otherwise(F.col("l.mode"))
    return last.select("key", F.col("l.value").alias("answer"), status.alias("status"), "asked")


# --- what goes through the rounds besides translation ------------------------------------------------------------------


def proofread(found: DataFrame, folder: str, provider: Caller, fallback: Caller | None = None) -> DataFrame:
    """found (batch, key, ord, text, answer, issues array<string>) with revised, and proofread: accepted, unchanged, rejected or none.

    Rows with text, answer and issues are asked about. A revision without notes counts unless it repeats itself or is nothing like its source; else the
    draft stays.
    """
    asked = found.where((T.strip(T.text(F.col("text"))) != "") & (T.strip(T.text(F.col("answer"))) != "") & (F.size("issues") > 0))
    item = F.to_json(F.struct(F.col("text").alias("src"), F.col("answer").alias("draft"), "issues"))
    done = run(asked.select("batch", F.col("key").cast("string").alias("key"), "ord", item.alias("text")), folder, provider, fallback)
    met = found.join(done.select(F.col("key").alias("_key"), F.col("answer").alias("_said")), F.col("key").cast("string") == F.col("_key"), "left")
    said = T.proofread_answer(F.col("_said"), F.col("answer"))
    state = F.when(F.col("_said").isNull(), "none").when(said == F.col("answer"), "unchanged").when(T.suspicious_pair(F.col("text"), said), "rejected").otherwise("accepted")
    return met.withColumn("proofread", state).withColumn("revised", F.when(F.col("proofread") == "accepted", said).otherwise(F.col("answer"))).drop("_key", "_said")


def terms_of(answers: DataFrame) -> DataFrame:
    """(ord long, src, dst, category, info, source, policy, aliases) candidates of raw replies (g, answer), in the order of groups and places."""
    @F.pandas_udf("array<struct<src:string,dst:string,category:string,info:string>>")
    def parsed(column: pd.Series) -> pd.Series:
        return column.map(lambda raw: [{n: str(x.get(n) or "") for n in ("src", "dst", "category", "info")} for x in _term_list(raw)])

    own = answers.select("g", F.posexplode(parsed("answer")).alias("pos", "t"))
    none = F.lit(None).cast("string")
    return own.select((F.col("g") * 1_000_000 + F.col("pos")).alias("ord"), "t.src", "t.dst", "t.category", "t.info", none.alias("source"), none.alias("policy"), none.alias("aliases"))


def _term_list(raw: str | None) -> list[dict]:
    value = json_value(raw or "")
    if isinstance(value, dict):
        value = next((value[k] for k in ("terms", "new_terms", "items") if isinstance(value.get(k), list)), [])
    return [x for x in value or [] if isinstance(x, dict)]


def extract_glossary(texts: DataFrame, existing: DataFrame, folder: str, provider: Caller, lane: str, order: str, text_col: str, items: int = 20, most: int = 120, chars: int = 30_000, lite: bool = False) -> DataFrame:
    """A glossary after candidates that a model finds in a sample of each lane's texts: sampled in order, asked for in groups, cleaned, merged; what exists wins.

    A reply counts if it holds JSON; else it is asked for again.
    """
    sample = batching.sample_in_order(texts, lane, order, text_col, most, chars)
    group = F.floor((F.col("n") - 1) / items).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("n", "text")))
    groups = sample.groupBy("lane", group.alias("g")).agg(F.to_json(F.transform(rows, lambda x: x["text"])).alias("text"))
    named = groups.select(F.format_string("%s/%06d", F.col("lane").cast("string"), "g").alias("key"), "text").withColumn("batch", F.col("key")).withColumn("ord", F.lit(0))
    done = run(named, folder, provider, accepts=lambda s: json_value(s) is not None)
    replies = done.where("answer is not null").withColumn("g", F.element_at(F.split("key", "/"), -1).cast("long"))
    return glossary.extracted(terms_of(replies), existing.withColumn("ord", F.col("ord").cast("long")), lite)
