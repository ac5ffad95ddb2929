"""Providers that fail, for tests and queries: what they do follows from a request's name and texts alone."""

from __future__ import annotations

import json

from lexweave.operators.rounds import Ask, Reply


def faulty(ask: Ask) -> Reply:
    """By the number a request's name begins with, modulo 8: 0 answers; 1 is busy twice; 2 stops half way; 3 leaves out every other text; 4 refuses
    batches, and texts of even length alone; 5 answers batches with no JSON, and texts whose length is a multiple of 5 with nothing; 6 is down; 7 never comes to an end.
    """
    kind = int(ask.name.split("/")[0]) % 8
    batch = ask.mode == "batch"
    items = [{"idx": k, "zh": f"T:{t}"} for k, t in enumerate(ask.texts)]
    whole = json.dumps({"translations": items}, ensure_ascii=False) if batch else f"T:{ask.texts[0]}"
    if kind == 1 and ask.tries < 2:
        return Reply(429)
    if kind == 2:
        cut = len(whole) // 2
        return Reply(200, whole[cut:]) if ask.pieces else Reply(200, whole[:cut], "length")
    if kind == 3 and batch:
        return Reply(200, json.dumps({"items": items[::2]}, ensure_ascii=False))
    if kind == 4 and (batch or len(ask.texts[0]) % 2 == 0):
        return Reply(400, "content moderation")
    if kind == 5:
        return Reply(200, "sorry, no" if batch else "" if len(ask.texts[0]) % 5 == 0 else whole)
    if kind == 6:
        raise TimeoutError
    if kind == 7 and batch:
        return Reply(200, json.dumps(items[0], ensure_ascii=False) if not ask.pieces else " and", "length")
    return Reply(200, whole)


def second(ask: Ask) -> Reply:
    """A second provider, which refuses texts whose length is a multiple of 6 as well."""
    return Reply(403, "sensitive: moderation") if len(ask.texts[0]) % 6 == 0 else Reply(200, f"S:{ask.texts[0]}")
