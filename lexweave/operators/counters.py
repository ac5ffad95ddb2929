"""Counters of a run that cost no pass of their own: what flows through a stage is counted as it flows.

Counts are known once the action that computes the stage has ended; a table that is computed twice is counted by the first action. Streams tell them
with each batch, to a listener that adds them up.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lexweave.functions.text import usage_tokens


class Counters:
    """Named counters of one run. `changed` is called with name and values whenever some are known."""

    def __init__(self, changed: Callable[[str, dict[str, int]], None] | None = None):
        self.observed: dict[str, Observation] = {}
        self.changed = changed or (lambda name, values: None)

    def counted(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        """df, of which rows and the given conditions or numbers are counted as `name`."""
        if name in self.observed:
            raise ValueError(f"{name} is counted already")
        self.observed[name] = Observation(name)
        totals = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in sums.items()]
        return df.observe(self.observed[name], F.count(F.lit(1)).alias("rows"), *totals)

    def values(self) -> dict[str, dict[str, int]]:
        """All counters; waits for those of stages that no action has computed yet."""
        out = {name: dict(o.get) for name, o in self.observed.items()}
        for name, found in out.items():
            self.changed(name, found)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, counter, n) of all counters."""
        found = [(stage, counter, int(n)) for stage, values in self.values().items() for counter, n in values.items()]
        return spark.createDataFrame(found, "stage string, counter string, n long")


def usage(reply: Column) -> Column:
    """Tokens of a reply as a number to be added up."""
    return F.coalesce(usage_tokens(reply), F.lit(0))


class StreamCounters(StreamingQueryListener):
    """Counters of streams whose frames were observed by name: sums over all batches of all queries, each batch once."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.seen: set[tuple[str, int]] = set()
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  (names of the interface)
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.lock:
            progress = event.progress
            # a query that restarts repeats its last batch under the same number
            if (str(progress.id), progress.batchId) in self.seen:
                return
            self.seen.add((str(progress.id), progress.batchId))
            for name, row in progress.observedMetrics.items():
                own = self.totals.setdefault(name, {})
                for counter, n in row.asDict().items():
                    own[counter] = own.get(counter, 0) + int(n or 0)
