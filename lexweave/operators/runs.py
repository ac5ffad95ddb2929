"""Request logs, rate windows, latency control, task history, recovery and run reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.text import clean_fragments, residue_sample, snippet, strip, text
from lexweave.operators.control import Limits, failed, sampled
from lexweave.operators.glossary import apart, held_terms

#: Signs of moderation; states of finished parts; scopes of records.
MODERATION = "security_audit_fail|security_error|内容审核拦截|内容审核未通过|违规信息|contentfilter|content filter|code\":\"1301|不安全或敏感内容|敏感内容|content_moderation|content moderation|moderation|contentmoderation"
DONE = ["success", "failed", "residue", "save_residue"]


def log_class(category: Column, outcome: Column, status: Column, error: Column) -> Column:
    """What an event was: its own category, else the first sign found in outcome, status and error."""
    raw = F.lower(F.concat_ws(" ", text(outcome), F.coalesce(status.cast("string"), F.lit("")), text(error)))
    good = (F.lower(text(outcome)) == "ok") & (status.isNull() | status.between(200, 299))
    return (
        F.when(text(category) != "", F.lower(strip(category)))
        .when(raw.rlike("residue|日文残留"), "residue")
        .when(raw.rlike(MODERATION), "security")
        .when(raw.rlike("timeout|超时"), "timeout")
        .when(raw.rlike("json|format|格式|parse"), "format")
        .when((status == 429) | raw.rlike("rate|限流"), "rate_limit")
        .when(good, "ok")
        .otherwise("failed")
    )


def search(log: DataFrame, query: str, category: str, fields: list[str], newest: str, limit: int, category_col: str = "category") -> DataFrame:
    """Newest events of a category whose fields hold the query, 20 to 2000 of them."""
    found = log.where((F.col(category_col) == category) if category else F.lit(True))
    if query:
        found = found.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.lower())))
    return found.orderBy(F.desc(newest), *fields).limit(min(2000, max(20, limit)))


def retained(log: DataFrame, ts: str, tie: str, a_day: int = 2000, days: int = 14) -> DataFrame:
    """The newest events of each of the last days."""
    own = log.withColumn("day", F.to_date(ts))
    last = own.select("day").distinct().orderBy(F.desc("day")).limit(days)
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(ts), F.desc(tie)))
    return own.join(F.broadcast(last), "day").withColumn("place", place).where(F.col("place") <= a_day)


def rate_windows(events: DataFrame, key: str, ts: str, tie: str, tokens: Column, rpm: int, tpm: int, seconds: int = 60) -> DataFrame:
    """events with requests and tokens of the window up to each, wait: seconds until both have room again, and gap: how long even spacing holds it back.

    Requests wait for the first of the window to leave it. Tokens wait for as many of the first as must leave to make room.
    Spacing sends one request every seconds / rpm. A key's events are replayed in order by one task, batch by batch with the
    last window of those before; keys are providers or accounts. Events without key or time are left out.
    """
    timed = events.withColumn("tokens", tokens).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    whole = T.LongType() if isinstance(timed.schema["tokens"].dataType, T.IntegralType) else T.DoubleType()
    schema = T.StructType(list(timed.schema.fields))
    for name, kind in (("requests", T.LongType()), ("window_tokens", whole), ("wait", T.DoubleType()), ("gap", T.DoubleType())):
        schema = schema.add(name, kind)
    own = timed.withColumn("_s", F.unix_micros(ts) / 1e6).withColumn("_n", F.coalesce(F.col("tokens").cast(whole), F.lit(0).cast(whole)))
    # a number of partitions is kept as it is: adaptive execution would put several keys into one task
    own = own.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, "_s", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, now = None, None, None
        for batch in _with_end(batches):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            keys, s = rows[key].to_numpy(), rows["_s"].to_numpy()
            other = np.flatnonzero((keys[1:] != keys[:-1]) | (s[1:] != s[:-1])) + 1
            # events of one moment are in each other's windows, so the last moment waits for the next batch
            upto = rows.num_rows if batch is None else int(other[-1]) if len(other) else 0
            held = rows.slice(upto)
            starts = [0, *(int(k) for k in other if k < upto and keys[k] != keys[k - 1]), upto]
            found = []
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if state is None or keys[a] != now:
                    now, state = keys[a], _Window(rpm, tpm, seconds)
                found.append(state.passed(s[a:b], rows["_n"].slice(a, b - a).to_numpy()))
            if found:
                done = rows.slice(0, upto).drop_columns(["_s", "_n"])
                for name, values in zip(("requests", "window_tokens", "wait", "gap"), zip(*found, strict=True), strict=True):
                    done = done.append_column(name, pa.array(np.concatenate(values)))
                yield from done.combine_chunks().to_batches()

    return own.mapInArrow(run, schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


class _Window:
    """What a key's next events need of those before: the events of the last window, their tokens, and the latest due time."""

    def __init__(self, rpm: int, tpm: int, seconds: int):
        self.rpm, self.tpm, self.seconds = rpm, tpm, seconds
        self.s, self.n = np.empty(0), np.empty(0, dtype=np.int64)
        self.place, self.due = 0, -np.inf

    def passed(self, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(requests, tokens, wait, gap) of events in order, whole moments."""
        every, sums = np.concatenate([self.s, s]), np.concatenate([[0], np.cumsum(np.concatenate([self.n, n]))])
        ends = np.searchsorted(every, every, "right")
        end, start = ends[len(self.s) :], np.searchsorted(every, s - self.seconds, "left")
        requests, tokens, first = end - start, sums[end] - sums[start], every[start]
        # as many of the first moments must leave as hold the tokens that are too many
        enough = every[np.searchsorted(sums[ends], sums[end] - self.tpm, "left")]
        wait = np.where(requests > self.rpm, first + self.seconds - s, 0.0)
        wait = np.maximum(wait, np.where(tokens > self.tpm, np.maximum(enough, first) + self.seconds - s, 0.0))
        ahead = (self.place + np.arange(len(s))) * (self.seconds / self.rpm)
        due = np.maximum.accumulate(np.maximum(s - ahead, self.due))
        self.place, self.due = self.place + len(s), due[-1]
        self.s, self.n = every[start[-1] :], np.concatenate([self.n, n])[start[-1] :]
        return requests, tokens, wait, due + ahead - s


def failure_limits(failures: DataFrame, key: str, order: str, kind: str, workers: int, batch: int) -> DataFrame:
    """(key, ord, kind, workers, batch, pause) after each failure: rate and timeout pause for doubling seconds, formats for 1.5 a failure; three format failures, or one at batches of 3, end batches.

    State runs over a key's failures in order, one Arrow batch at a time. Jitter is for the caller to add.
    """
    kinds = {c: failures.schema[c].dataType.simpleString() for c in (key, order)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (workers, batch, 0, 0)
        for part in parts:
            out = []
            for k, o, what in part.itertuples(index=False):
                if k != now:
                    now, state = k, (workers, batch, 0, 0)
                state, pause = failed(state, what)
                out.append((k, o, what, *state[:2], pause))
            yield pd.DataFrame(out, columns=["key", "ord", "kind", "workers", "batch", "pause"])

    own = failures.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(kind).alias("kind")).repartition("key").sortWithinPartitions("key", "ord")
    return own.mapInPandas(run, f"key {kinds[key]}, ord {kinds[order]}, kind string, workers int, batch int, pause double")


def global_pause(requests: DataFrame, key: str, order: str, at: Column, pause: Column) -> DataFrame:
    """requests with held: seconds that pauses asked for by earlier ones still hold each back; the latest end of any counts."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(pause > 0, at + pause)).over(before)
    return requests.withColumn("held", F.greatest(F.lit(0.0), F.coalesce(until - at, F.lit(0.0))))


def latency_control(samples: DataFrame, key: str, order: str, workers: int, batch: int, slow: float, down_at: int = 8, up_at: int = 16, ring: int = 24) -> DataFrame:
    """(key, ord, action, workers, batch) after each sample (elapsed seconds): batches shrink before workers while a window is slow, and grow first once it is fast; the window starts anew with each change.

    State runs over a key's samples in order, one Arrow batch at a time, so that a long history is never in memory.
    """
    limits = Limits(1, 1, workers=workers, batch=batch, slow=slow, down_at=down_at, up_at=up_at, ring=ring)
    kind, ord_kind = samples.schema[key].dataType.simpleString(), samples.schema[order].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, w, b = None, [], workers, batch
        for part in parts:
            out = []
            for k, o, elapsed in part.itertuples(index=False):
                if k != now:
                    now, held, w, b = k, [], workers, batch
                action, held, w, b = sampled(held, w, b, elapsed, limits)
                out.append((k, o, action, w, b))
            yield pd.DataFrame(out, columns=["key", "ord", "action", "workers", "batch"])

    own = samples.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col("elapsed_s")).repartition("key").sortWithinPartitions("key", "ord")
    return own.mapInPandas(run, f"key {kind}, ord {ord_kind}, action string, workers int, batch int")


def task_summary(subtasks: DataFrame) -> DataFrame:
    """(task_id, total, completed, failed, chars, progress) of subtasks (task_id, status, chars)."""
    done = F.count_if(F.col("status") == "success")
    return subtasks.groupBy("task_id").agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("status").isin("failed", "residue", "save_residue")).alias("failed"), F.sum("chars").alias("chars"), F.bround(done / F.count("*"), 4).alias("progress"))


def resumed(plan: DataFrame, old: DataFrame) -> DataFrame:
    """plan (task_id, index, source) with what is known of finished parts of equal place and source."""
    own = plan.withColumn("source_hash", F.sha1("source"))
    known = old.where(F.col("status").isin(*DONE)).select("task_id", "index", "source_hash", F.col("status").alias("s"), F.col("translation").alias("t"))
    met = own.join(known, ["task_id", "index", "source_hash"], "left")
    return met.select("task_id", "index", "source", "source_hash", F.coalesce("s", F.lit("pending")).alias("status"), F.coalesce("t", F.lit("")).alias("translation"), F.length("source").alias("chars"))


def failed_blocks(blocks: DataFrame, fixed: DataFrame, most: int = 200) -> DataFrame:
    """Different failed blocks (kind, text, translation) in order of first sight, without those fixed since, `most` a task."""
    first = blocks.groupBy("task_id", "kind", "text", "translation").agg(F.min("ord").alias("ord"), F.min_by("reason", "ord").alias("reason"))
    key = F.regexp_replace(F.col("text"), r"(?U)\s+", "")
    gone = fixed.select("task_id", F.regexp_replace("text", r"(?U)\s+", "").alias("k")).distinct()
    left = first.withColumn("k", key).join(gone, ["task_id", "k"], "left_anti").drop("k")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("ord", "kind", "text", "translation"))).where(F.col("place") <= most)


def latest_unfinished(tasks: DataFrame) -> DataFrame:
    """The last task by update that isn't finished."""
    return tasks.where(~F.col("status").isin("success", "finished", "cancelled")).orderBy(F.desc("updated_at"), "task_id").limit(1)


#: Signs of issues, the gravest first, and the action that each calls for.
SIGNS = {"timeout": "timeout|timed out|超时|连接失败", "glossary": "glossary conflict|术语冲突|术语不一致|术语不匹配", "json_format": "json|解析失败|格式错误|missing index|invalid response"}
ACTIONS = {"moderation": "manual_review", "timeout": "retry", "glossary": "retry_with_glossary", "json_format": "single_retry", "empty_output": "retry", "residue_high": "retranslate", "residue_medium": "retranslate", "residue_low": "accept_review"}


def issue_class(reason: Column, translation: Column, risk: Column) -> Column:
    """What went wrong with a block, the gravest sign first: the reason's, an empty translation, the residue's risk."""
    r = F.lower(strip(text(reason)))
    out = F.when(r.rlike(MODERATION), "moderation")
    for issue, signs in SIGNS.items():
        out = out.when(r.rlike(signs), issue)
    return out.when(strip(text(translation)) == "", "empty_output").when(text(risk).isin("high", "medium", "low"), F.concat(F.lit("residue_"), risk)).otherwise("provider_error")


def recommended(issue: Column) -> Column:
    """The default action for an issue."""
    out = F.lit("switch_provider")
    for k, v in ACTIONS.items():
        out = F.when(issue == k, v).otherwise(out)
    return out


def recovery_summary(results: DataFrame) -> DataFrame:
    """(attempted, success, needs_review, failed) of results with a source and a status."""
    own = results.where(strip(text(F.col("source"))) != "").select(F.coalesce(F.nullif("status", F.lit("")), F.lit("needs_review")).alias("s"))
    return own.agg(F.count("*").alias("attempted"), F.count_if(F.col("s") == "success").alias("success"), F.count_if(F.col("s") == "needs_review").alias("needs_review"), F.count_if(~F.col("s").isin("success", "needs_review")).alias("failed"))


# --- history ------------------------------------------------------------------------------------------------------------

#: States whose parts stay in full; lengths of stored texts and reasons.
DETAILED = ["running", "pausing", "paused", "cancelling", "stopping", "failed", "partial"]
STORED, REASON = 2000, 300


def normalised_blocks(failed: DataFrame, residue: DataFrame, samples: DataFrame, most: int = 200) -> DataFrame:
    """(task_id, ord, kind, text, reason, translation, fragments): failed details, then residue details, then sample lines of a save, different ones of each task in this order, at most `most`.

    failed and residue: task_id, ord, text, reason, translation, fragments array<string>; samples: task_id, ord, sample.
    """
    c = F.col
    told = lambda df, k, kind, reason: df.select("task_id", F.lit(k).alias("k"), "ord", F.lit(kind).alias("kind"), snippet(c("text"), STORED, hide=False).alias("text"), snippet(F.coalesce(F.nullif("reason", F.lit("")), F.lit(reason)), REASON, hide=False).alias("reason"), snippet(c("translation"), STORED, hide=False).alias("translation"), clean_fragments(c("fragments")).alias("fragments"))
    body, parts = residue_sample(c("sample"))
    lines = samples.select("task_id", "ord", body.alias("text"), F.lit("").alias("reason"), body.alias("translation"), parts.alias("fragments"))
    every = told(failed, 0, "failed", "未返回安全译文").unionByName(told(residue, 1, "residue", "译文疑似仍有日文残留")).unionByName(told(lines, 2, "save_residue", "保存前检查发现高风险日文残留"))
    first = every.where("text <> '' or translation <> ''").groupBy("task_id", "kind", "text", "translation").agg(F.min_by(F.struct("k", "ord", "reason", "fragments"), F.struct("k", "ord")).alias("f"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("f.k", "f.ord"))
    return first.withColumn("place", place).where(c("place") <= most).select("task_id", (c("place") - 1).alias("ord"), "kind", "text", "f.reason", "translation", "f.fragments")


def compacted(tasks: DataFrame, subtasks: DataFrame) -> DataFrame:
    """(tasks' columns, subtask_count): parts of finished tasks are only counted; null where a task keeps them."""
    n = subtasks.groupBy("task_id").agg(F.count("*").alias("n"))
    return tasks.join(n, "task_id", "left").withColumn("subtask_count", F.when(~F.lower(strip(text(F.col("status")))).isin(*DETAILED), F.col("n"))).drop("n")


def kept_subtasks(tasks: DataFrame, subtasks: DataFrame) -> DataFrame:
    """Parts of tasks that aren't finished."""
    return subtasks.join(tasks.where(F.lower(strip(text(F.col("status")))).isin(*DETAILED)).select("task_id").distinct(), "task_id", "left_semi")


def marked_success(subtasks: DataFrame, answers: DataFrame) -> DataFrame:
    """subtasks (task_id, index, source, status, translation, reason) after answers (task_id, source, translation): pending or failed parts of equal source are done; changed tells which."""
    a = answers.where((strip(text(F.col("source"))) != "") & (strip(text(F.col("translation"))) != "")).groupBy("task_id", F.sha1("source").alias("h")).agg(F.max("translation").alias("new"))
    met = subtasks.withColumn("h", F.sha1("source")).join(a, ["task_id", "h"], "left")
    done = F.col("new").isNotNull() & ~((F.col("status") == "success") & (text(F.col("translation")) != ""))
    return met.select("task_id", "index", "source", F.when(done, "success").otherwise(F.col("status")).alias("status"), F.when(done, snippet(F.col("new"), STORED, hide=False)).otherwise(F.col("translation")).alias("translation"), F.when(done, "").otherwise(F.col("reason")).alias("reason"), done.alias("changed"))


def marked_problem(subtasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same after problem blocks (task_id, text, kind, reason, translation): their kind is the status."""
    b = blocks.where(text(F.col("text")) != "").groupBy("task_id", F.sha1("text").alias("h")).agg(F.max_by(F.struct("kind", "reason", "translation"), "ord").alias("b"))
    met = subtasks.withColumn("h", F.sha1("source")).join(b, ["task_id", "h"], "left")
    hit = F.col("b").isNotNull()
    return met.select("task_id", "index", "source", F.when(hit, F.coalesce(F.nullif("b.kind", F.lit("")), F.lit("failed"))).otherwise(F.col("status")).alias("status"), F.when(hit & (text(F.col("b.translation")) != ""), snippet(F.col("b.translation"), STORED, hide=False)).otherwise(F.col("translation")).alias("translation"), F.when(hit, snippet(F.col("b.reason"), REASON, hide=False)).otherwise(F.col("reason")).alias("reason"), hit.alias("changed"))


def recorded_recovery(items: DataFrame, results: DataFrame, source_col: str) -> DataFrame:
    """items with recovery_attempts, recovery_action and recovery_status of results (task_id, source, attempts, action, status) of equal source."""
    r = results.where(strip(text(F.col("source"))) != "").groupBy("task_id", F.sha1("source").alias("h")).agg(F.max_by(F.struct("attempts", "action", "status"), "attempts").alias("r"))
    met = items.withColumn("h", F.sha1(source_col)).join(r, ["task_id", "h"], "left").drop("h")
    return met.select(*items.columns, F.greatest(F.lit(0), F.coalesce("r.attempts", F.lit(0))).alias("recovery_attempts"), text(F.col("r.action")).alias("recovery_action"), text(F.col("r.status")).alias("recovery_status"))


def diagnostics(blocks: DataFrame, first: int = 5) -> DataFrame:
    """(task_id, failed, residue, lines array<string>): counts and the first blocks of a task that need attention, as text."""
    one = F.struct("ord", F.concat(F.col("kind"), F.lit(": "), snippet(F.col("text"), 80, hide=False), F.lit(" — "), snippet(F.col("reason"), 120, hide=False)).alias("line"))
    r = F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))
    counts = blocks.groupBy("task_id").agg(F.count_if(F.col("kind") == "failed").alias("failed"), F.count_if(F.col("kind") != "failed").alias("residue"))
    top = blocks.withColumn("r", r).where(F.col("r") <= first).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"]).alias("lines"))
    return counts.join(top, "task_id", "left")


def multi_book(results: DataFrame) -> DataFrame:
    """(batch, books, ok, failed, texts, terms, paths): rollup of results (batch, ord, path, ok, texts, terms); paths different, in order of first sight."""
    per = results.groupBy("batch", "path").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("texts").alias("texts"), F.sum("terms").alias("terms"))
    return per.groupBy("batch").agg(F.sum("n").alias("books"), F.sum("ok").alias("ok"), (F.sum("n") - F.sum("ok")).alias("failed"), F.sum("texts").alias("texts"), F.sum("terms").alias("terms"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))


def run_statistics(texts: Column, failed: Column, chars: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """(success rate in per cent, texts a second, characters a second)."""
    return F.bround(100 * F.try_divide(texts - failed, texts), 1), F.bround(F.try_divide(texts, seconds), 2), F.bround(F.try_divide(chars, seconds), 1)


def duration_estimate(texts: Column, chars: Column, per_second: Column, per_batch: Column, batch: Column, active: Column) -> Column:
    """Seconds a run may take: the slower of requests and characters at 0.65 a further worker, and what every run costs besides."""
    w = 1 + 0.65 * (F.greatest(active, F.lit(1)) - 1)
    return F.greatest(F.ceil(texts / batch) * per_batch / w, chars / (per_second * w)) + F.greatest(F.lit(10.0), 0.02 * texts)


def keyword_scores(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, genre, score, hits): weights of a genre's keywords, whatever their case, each at most four times, and the first eight found."""
    own = texts.select(F.col(id_col).alias("id"), F.lower(text(F.col(text_col))).alias("t"))
    words = keywords.withColumn("original", F.lower("keyword"))
    met = held_terms(own, words, "id", "t").join(words, "original")
    n = F.least(apart(F.col("starts"), F.length("original")), F.lit(4))
    hits = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: x["keyword"]), 1, 8)
    return met.withColumn("n", n).groupBy("id", "genre").agg(F.sum(F.col("n") * F.col("weight")).alias("score"), hits.alias("hits"))


def style(scores: DataFrame) -> DataFrame:
    """(id, genre, score, confidence): the best genre, ties by declaration (genre_ord), and how far it leads."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "genre_ord")
    own = scores.withColumn("r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0)))
    return own.where("r = 1").select("id", "genre", "score", F.least(F.lit(100), 8 * F.col("score") + 4 * (F.col("score") - F.col("second"))).cast("int").alias("confidence"))


def joined_context(title: Column, titles: Column, samples: Column, most: int = 12_000) -> Column:
    """Title, titles of contents and samples in lines, samples only until the characters are reached, cut there."""
    full = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: strip(text(x)) != "")
    head = F.concat(F.when(text(title) != "", F.array(title)).otherwise(F.array().cast("array<string>")), full(titles))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    # the first sample is always taken: the sum is looked at after each
    take = lambda a, x: F.when((F.size(a) == F.size(head)) | (length(a) < most), F.concat(a, F.array(x))).otherwise(a)
    return F.substring(F.array_join(F.aggregate(full(samples), head, take), "\n"), 1, most)


def dialogue_score(c: Column) -> Column:
    """How much a text talks: density of corner quotes, up to 20, and exclamations, up to 10."""
    t = text(c)
    count = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
    quotes = count("「") + count("」") + count("『") + count("』")
    excited = count("！") + count("!?") + count("？！")
    compact = F.greatest(F.lit(1), F.length(F.regexp_replace(t, "(?U)\\s+", "")))
    return (F.least(F.lit(20), F.floor(quotes * 1800 / compact)) + F.least(excited, F.lit(10))).cast("int")


def detected(genre: Column, genre_score: Column, confidence: Column, light: Column, literary: Column, least: int = 60) -> tuple[Column, Column, Column]:
    """(genre, tone, confidence) from the best genre's score and confidence and the scores of both tones; weak genres count as general."""
    sure = (F.coalesce(genre_score, F.lit(0)) > 0) & (F.coalesce(confidence, F.lit(0)) >= least)
    g = F.when(sure, genre).otherwise("general")
    own = F.when(sure, confidence).when(F.coalesce(genre_score, F.lit(0)) > 0, 40).otherwise(0)
    is_light = light >= F.greatest(F.lit(8), literary + 3)
    tone = F.when(is_light, "light").when(literary >= 10, "literary").otherwise("neutral")
    sure_tone = F.when(is_light, F.least(F.lit(100), light * 6)).when(literary >= 10, F.least(F.lit(100), literary * 7)).otherwise(50)
    both = F.bround(own * 0.65 + sure_tone * 0.35).cast("int")
    return g, tone, F.when((g == "general") & (tone == "neutral"), F.least(both, F.lit(50))).otherwise(both)


#: Genres and tones that can be chosen.
GENRES, TONES = ["general", "mystery", "historical_mystery", "scifi", "fantasy"], ["neutral", "light", "literary"]


def chosen(genre: Column, tone: Column, found_genre: Column, found_tone: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """(genre, tone, confidence) after a user's choice, `auto` for what was detected; unknown choices are general and neutral."""
    g = F.when(genre == "auto", found_genre).otherwise(F.coalesce(F.nullif(genre, F.lit("")), F.lit("general")))
    t = F.when(tone == "auto", found_tone).otherwise(F.coalesce(F.nullif(tone, F.lit("")), F.lit("neutral")))
    manual = (genre != "auto") | (tone != "auto")
    return F.when(g.isin(*GENRES), g).otherwise("general"), F.when(t.isin(*TONES), t).otherwise("neutral"), F.when(manual, 100).otherwise(confidence)


def aligned(replies: DataFrame) -> DataFrame:
    """From (batch_id, pos, idx, value, n): (batch_id, idx, value) of expected places 0 to n - 1; the last reply for a place counts, null where none came."""
    own = replies.withColumn("i", F.coalesce("idx", "pos")).where("i >= 0 and i < n and value <> ''")
    last = own.groupBy("batch_id", "i").agg(F.max_by("value", "pos").alias("value"))
    places = replies.groupBy("batch_id").agg(F.max("n").alias("n")).where("n > 0").select("batch_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return places.join(last, ["batch_id", "i"], "left").select("batch_id", F.col("i").alias("idx"), "value")


def latency_snapshot(samples: DataFrame, key: str) -> DataFrame:
    """(key, n, mean_ms, mean_batch) of samples (elapsed_s, batch): milliseconds cut off, batches rounded half to even."""
    seconds = F.avg(F.greatest(F.lit(0.001), F.col("elapsed_s")))
    return samples.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.floor(seconds * 1000).cast("int").alias("mean_ms"), F.bround(F.avg("batch")).cast("int").alias("mean_batch"))


def totals(texts: DataFrame, text_col: str) -> DataFrame:
    """(texts, chars), both 1 at least, so that shares of them are defined."""
    return texts.agg(F.greatest(F.count("*"), F.lit(1)).alias("texts"), F.greatest(F.coalesce(F.sum(F.length(text_col)), F.lit(0)), F.lit(1)).alias("chars"))


def originals_of(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """blocks (task_id, text) with source: the source text of the task that is equal, else the only one that is equal without white space; null if there are several or none."""
    bare = lambda c: F.regexp_replace(text(F.col(c)), r"(?U)\s+", "")
    own = sources.select("task_id", "source").distinct()
    exact = own.select("task_id", F.col("source").alias("text"), F.lit(True).alias("_same"))
    only = own.groupBy("task_id", bare("source").alias("_bare")).agg(F.count("*").alias("_n"), F.min("source").alias("_one")).where("_n = 1 and _bare <> ''")
    met = blocks.withColumn("_bare", bare("text")).join(exact, ["task_id", "text"], "left").join(only, ["task_id", "_bare"], "left")
    return met.withColumn("source", F.when(F.col("_same"), F.col("text")).otherwise(F.col("_one"))).drop("_bare", "_same", "_n", "_one")


def appended(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events as JSON lines in a folder a day; readers keep the newest by retained()."""
    log.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)
