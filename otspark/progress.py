"""What a run has done so far: figures that come with the jobs which run anyway (DataFrame.observe), and how long each step took."""

from __future__ import annotations

import logging
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation

from otspark.operators import graph

VERSION = "0.3"
log = logging.getLogger("otspark")


class Progress:
    """Steps of a run, in their order. An observed figure costs no job of its own."""

    def __init__(self) -> None:
        self.began, self.clock, self.steps = datetime.now(timezone.utc), time.monotonic(), []

    def cut(self, df: DataFrame, step: str, **figures: Column) -> DataFrame:
        """The rows behind a checkpoint, with the figures (aggregates) of them noted under the step's name."""
        seen, start = Observation(), time.monotonic()
        out = graph.cut(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
        self.steps.append({"step": step, "seconds": round(time.monotonic() - start, 3), **seen.get})
        log.info("%s: %s", step, {k: v for k, v in self.steps[-1].items() if k != "step"})
        return out

    def of(self, step: str, name: str, otherwise=None):
        """A figure of a step that has run."""
        return next((s[name] for s in self.steps if s["step"] == step and name in s), otherwise)

    def metadata(self) -> dict:
        return {"version": VERSION, "started": self.began.isoformat(), "duration_seconds": round(time.monotonic() - self.clock, 3), "steps": list(self.steps)}
