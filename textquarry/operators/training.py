"""Training with history, callbacks and early stopping; counters of the steps of a run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from textquarry.functions.shared import checkpoint
from textquarry.operators import tokenizers as K


@dataclass
class Step:
    number: int
    parameters: dict
    seconds: float
    chars_per_token: float
    vocabulary: int
    improved: bool


@dataclass
class History:
    steps: list[Step] = field(default_factory=list)
    stopped_early: bool = False
    best: int = -1

    def as_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


def train(df: DataFrame, held_out: DataFrame, kind: str, steps: Iterable[dict], patience: int = 2, min_gain: float = 0.0, callbacks: Sequence[Callable[[Step, object], bool | None]] = (), text_col: str = "text") -> tuple[object, History]:
    """One model for each set of parameters (say of growing size), judged by characters per token on ``held_out``; (the best one, its history).

    Training ends after ``patience`` steps without a gain of more than ``min_gain``, or when a callback returns True. The corpus is written
    once and read by every step.
    """
    df, held_out = checkpoint(df.select(text_col)), checkpoint(held_out.select(text_col))
    history, best, waited = History(), None, 0
    for k, parameters in enumerate(steps):
        began = time.perf_counter()
        model = K.build(kind, df, **parameters)
        took = time.perf_counter() - began
        r = held_out.agg(F.sum(F.length(text_col)).alias("c"), F.sum(F.size(model.encode(F.col(text_col)))).alias("n")).first()
        rate = (r.c or 0) / r.n if r.n else 0.0
        gain = rate - (history.steps[history.best].chars_per_token if best is not None else -min_gain - 1)
        step = Step(k, dict(parameters), took, rate, model.vocabulary(df.sparkSession).count(), gain > min_gain)
        history.steps.append(step)
        waited = 0 if step.improved else waited + 1
        if step.improved:
            best, history.best = model, k
        if any([c(step, model) for c in callbacks]) or waited >= patience:
            history.stopped_early = True
            break
    return best, history


@dataclass
class Counts:
    rows: int
    chars: int
    empty: int


class Collector:
    """Counts what goes through each step of a run, by the run's own action: nothing is computed twice."""

    def __init__(self, text_col: str = "text"):
        self.text_col, self.observations, self.started = text_col, {}, time.perf_counter()

    def watch(self, name: str) -> Callable[[DataFrame], DataFrame]:
        """For DataFrame.transform, before or after a step."""
        t: Column = F.col(self.text_col)
        o = self.observations[name] = Observation()

        def run(df: DataFrame) -> DataFrame:
            return df.observe(o, F.count("*").alias("rows"), F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("chars"), F.count_if(t.isNull() | (t == "")).alias("empty"))

        return run

    def counts(self) -> dict[str, Counts]:
        """After the action."""
        return {n: Counts(**o.get) for n, o in self.observations.items()}

    def report(self) -> list[dict]:
        """Of each step after the first: rows dropped, mean length, and by how much the characters changed."""
        out, before = [], None
        for name, c in self.counts().items():
            row = {"step": name, **asdict(c), "mean_chars": c.chars / c.rows if c.rows else 0.0}
            if before is not None:
                row |= {"rows_dropped": before.rows - c.rows, "char_change_percent": 100 * (c.chars - before.chars) / before.chars if before.chars else 0.0}
            out.append(row)
            before = c
        return out

    def chars_per_second(self) -> float:
        c = self.counts()
        return next(iter(c.values())).chars / (time.perf_counter() - self.started) if c else 0.0
