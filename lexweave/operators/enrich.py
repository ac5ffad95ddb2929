"""Enriching pending texts through an injected provider, tolerant reading of replies, and routing of outcomes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import strip, suspicious_pair, text
from lexweave.operators import quality

#: A provider takes the texts of one batch and returns as many answers, null where it has none. It must give equal answers
#: to equal texts, since Spark may ask again; results are keyed by task, so a repeated call changes nothing.
Provider = Callable[[list[str]], list[str | None]]

#: Keys under which replies hold their lists, their places and their texts.
LISTS, PLACES, VALUES = ("translations", "items", "results", "data"), ("idx", "index", "id"), ("zh", "translation", "text", "dst", "target", "output", "result")


def stub(texts: list[str]) -> list[str | None]:
    """A provider for tests: a mark before each text, nothing for texts that begin with a digit."""
    return [None if t[:1].isdigit() else f"ZH:{t}" for t in texts]


def enriched(tasks: DataFrame, provider: Provider, key: str, text_col: str, batch: str, fallback: Provider | None = None, moderated: Callable[[Exception], bool] = lambda e: False) -> DataFrame:
    """(batch, key, text, answer, status) of tasks in batches: a batch goes out whole, what it leaves open goes alone.

    status: ok, single (alone, after the batch failed or left it out), fallback (by the second provider, where the first one
    refuses a text as moderated), failed. Providers raise ValueError, OSError or TimeoutError where they fail.
    """
    kinds = {c: tasks.schema[c].dataType.simpleString() for c in (batch, key)}
    wrong = (ValueError, OSError, TimeoutError)

    def alone(one: str) -> tuple[str | None, str]:
        try:
            answer = provider([one])[0]
            return (answer, "single") if answer else (None, "failed")
        except wrong as e:
            if not fallback or not moderated(e):
                return None, "failed"
        try:
            answer = fallback([one])[0]
            return (answer, "fallback") if answer else (None, "failed")
        except wrong:
            return None, "failed"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = group["text"].tolist()
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError("a reply of another length")
        except wrong:
            got = [None] * len(texts)
        found = [(a, "ok") if a else alone(t) for t, a in zip(texts, got, strict=True)]
        return group.assign(answer=[a for a, _ in found], status=[s for _, s in found])

    own = tasks.select(F.col(batch).alias("batch"), F.col(key).alias("key"), F.col(text_col).alias("text"))
    return own.groupBy("batch").applyInPandas(run, f"batch {kinds[batch]}, key {kinds[key]}, text string, answer string, status string")


def routed(found: DataFrame, issues: Column | None = None, skips: Column | None = None) -> DataFrame:
    """found (batch, text, answer) with route: retranslate what is missing, suspicious, or one answer three times in a batch of three different texts or more; proofread what has issues, unless it may be skipped; keep the rest."""
    batch = Window.partitionBy("batch")
    kinds = F.size(F.collect_set("text").over(batch))
    times = F.count("*").over(Window.partitionBy("batch", "answer"))
    wrong = (text(F.col("answer")) == "") | suspicious_pair(F.col("text"), F.col("answer"))
    many = (times >= 3) & (kinds >= 3) & (text(F.col("answer")) != "")
    check = (issues if issues is not None else F.lit(False)) & ~(skips if skips is not None else F.lit(False))
    return found.withColumn("route", F.when(wrong | many, "retranslate").when(check, "proofread").otherwise("keep"))


def repeated_residue(found: DataFrame, order: str, fragments: str = "fragments") -> DataFrame:
    """found (key, fragments) with repeated: one of its fragments stood in an earlier answer, so that proofreading it again is of no use."""
    each = found.select("key", F.col(order).alias("o"), F.explode(fragments).alias("fragment")).distinct()
    first = each.groupBy("fragment").agg(F.min("o").alias("first"))
    again = each.join(first, "fragment").where(F.col("o") > F.col("first")).select("key").distinct().withColumn("_again", F.lit(True))
    return found.join(again, "key", "left").withColumn("repeated", F.coalesce("_again", F.lit(False))).drop("_again")


@dataclass(frozen=True)
class Stage:
    """A named step over a DataFrame that can be switched off."""

    name: str
    step: Callable[[DataFrame], DataFrame]
    enabled: bool = True


class Stages:
    """An ordered list of stages, to which users add their own."""

    def __init__(self, *stages: Stage):
        self.all = list(stages)

    def add(self, stage: Stage, before: str | None = None) -> Stages:
        """Put a stage last, or before a named one; one of its name goes."""
        rest = [s for s in self.all if s.name != stage.name]
        at = next((k for k, s in enumerate(rest) if s.name == before), len(rest))
        return Stages(*rest[:at], stage, *rest[at:])

    def remove(self, name: str) -> Stages:
        return Stages(*[s for s in self.all if s.name != name])

    def switch(self, name: str, enabled: bool) -> Stages:
        return Stages(*[replace(s, enabled=enabled) if s.name == name else s for s in self.all])

    def run(self, df: DataFrame) -> DataFrame:
        for s in self.all:
            df = df.transform(s.step) if s.enabled else df
        return df


def executed(issues: DataFrame, provider: Provider, fallback: Provider | None = None, most: int = 2) -> DataFrame:
    """issues (key, source, translation, issue, action, attempts) with answer and status: success or needs_review.

    Retries ask the provider once more, switch_provider the fallback; accept_review takes low residue as it is, repair mends the
    translation. What has no source, was tried `most` times or gives nothing that is complete is for a person.
    """
    mended = quality.repaired(F.col("source"), F.col("translation"))
    @F.pandas_udf("string")
    def asked(sources: pd.Series, second: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(sources)
        for use, chosen in ((provider, ~second), (fallback, second)):
            rows = np.flatnonzero((chosen & sources.notna()).to_numpy())
            for k in rows if use else []:
                try:
                    out[k] = use([sources.iloc[k]])[0]
                except (ValueError, OSError, TimeoutError):
                    out[k] = None
        return pd.Series(out, dtype=object)

    retried = F.col("action").isin("retry", "single_retry", "retranslate", "retry_with_glossary")
    switched = F.col("action") == "switch_provider"
    open_ = (F.coalesce("attempts", F.lit(0)) < most) & (strip(text(F.col("source"))) != "")
    call = asked(F.when(open_ & (retried | switched), F.col("source")), switched)
    answer = F.when(open_ & (retried | switched), call).when(open_ & (F.col("action") == "repair"), mended).when(open_ & (F.col("action") == "accept_review") & (F.col("issue") == "residue_low"), F.col("translation"))
    own = quality.incomplete(quality.once(issues, "answer", answer), "source", "answer")
    good = (strip(text(F.col("answer"))) != "") & ((F.col("action") == "accept_review") | ~F.col("incomplete"))
    return own.withColumn("status", F.when(good, "success").otherwise("needs_review")).withColumn("answer", F.when(good, F.col("answer"))).drop("incomplete")


def json_value(raw: str):
    """The first JSON object or list in a reply: whole, in code fences, or after other words; None if there is none."""
    raw = (raw or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    decoder = json.JSONDecoder()
    for candidate in filter(None, (raw, fenced and fenced[1].strip())):
        for at in [0, *(m.start() for m in re.finditer(r"[{\[]", candidate))]:
            try:
                value, _ = decoder.raw_decode(candidate, at)
            except ValueError:
                continue
            if isinstance(value, (dict, list)):
                return value
    return None


def reply_items(raw: str) -> list[tuple[int | None, str]]:
    """(place, text) of a reply's items; where the JSON is broken, items of the form idx and text are still found."""
    value = json_value(raw)
    if isinstance(value, dict):
        value = next((value[k] for k in LISTS if isinstance(value.get(k), list)), [value])
    out: list[tuple[int | None, str]] = []
    for item in value or []:
        if isinstance(item, str):
            out.append((None, item))
        elif isinstance(item, dict):
            place = next((item[k] for k in PLACES if str(item.get(k, "")).strip().isdigit()), None)
            said = next((str(item[k]).strip() for k in VALUES if item.get(k) and str(item[k]).strip()), "")
            if said:
                out.append((None if place is None else int(place), said))
    if out:
        return out
    loose = re.finditer(r'"(?:idx|index|id)"\s*:\s*"?(\d+)"?\s*,\s*"(?:zh|translation|text)"\s*:\s*"(.*?)"\s*(?=\}|,\s*"(?:idx|index|id)"|$)', raw or "", re.S)
    return [(int(m[1]), m[2].replace('\\"', '"')) for m in loose]


def parsed_replies(replies: DataFrame, id_col: str = "batch_id", raw_col: str = "raw") -> DataFrame:
    """(batch_id, pos, idx, value) of the items in raw replies."""
    @F.pandas_udf("array<struct<idx:int,value:string>>")
    def parse(column: pd.Series) -> pd.Series:
        return column.map(lambda r: [{"idx": i, "value": v} for i, v in reply_items(r)])

    own = replies.select(F.col(id_col).alias("batch_id"), F.posexplode(parse(F.col(raw_col))).alias("pos", "x"))
    return own.select("batch_id", "pos", F.col("x.idx").alias("idx"), F.col("x.value").alias("value"))


def decision(issue: Column, action: Column, confidence: Column, provider: Column, pinned: Column) -> Column:
    """verdict on a proposed recovery: unknown actions and confidences outside 0 to 1 are invalid, a pinned provider and moderated texts stay, the rest needs 0.85."""
    known = action.isin("retry", "single_retry", "retranslate", "retry_with_glossary", "switch_provider", "manual_review", "accept_review", "keep_original")
    return (
        F.when(~F.coalesce(known, F.lit(False)) | confidence.isNull() | ~confidence.between(0, 1), "invalid")
        .when((text(pinned) != "") & (text(provider) != "") & (provider != pinned), "provider_pinned")
        .when((issue == "moderation") & (action != "manual_review"), "locked")
        .when(confidence < 0.85, "manual_review")
        .otherwise("apply")
    )


def csv_glossary(rows: DataFrame) -> DataFrame:
    """A glossary read from CSV by header, under any of its usual names, into the raw form of glossary.normalised(), with its notes (info) and source."""
    names = {c.strip().lower().lstrip("﻿"): c for c in rows.columns}
    pick = lambda *options: F.coalesce(*[F.col(f"`{names[o]}`") for o in options if o in names], F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    return rows.select(
        strip(text(pick("category", "type"))).alias("category"), F.monotonically_increasing_id().alias("ord"), pick("original", "src", "source_text").alias("original"), none.alias("src"),
        pick("translation", "dst", "target").alias("translation"), none.alias("dst"), pick("policy", "enforcement").alias("policy"), pick("aliases", "alias", "variants").alias("aliases"),
        strip(text(pick("info", "note", "notes", "comment"))).alias("info"), strip(text(pick("source", "origin"))).alias("source"),
    )


def csv_statistics(raw: DataFrame) -> DataFrame:
    """(accepted, skipped) of csv_glossary()'s rows: the first of each source with a translation is taken."""
    own = raw.withColumn("o", strip(text(F.col("original")))).withColumn("good", (F.col("o") != "") & (strip(text(F.col("translation"))) != ""))
    taken = own.where("good").agg(F.count_distinct("o").alias("accepted"))
    return own.agg(F.count("*").alias("every")).join(taken).select("accepted", (F.col("every") - F.col("accepted")).alias("skipped"))
