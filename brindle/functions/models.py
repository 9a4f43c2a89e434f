"""Calls to a model from inside tasks: batches, bounded concurrency, retries, and failures that stay with their rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a called row gives.
RESULT = "vector array<double>, error string, tries int"


class Caller:
    """Calls ``model(texts) -> vectors`` with batches, ``concurrency`` of them at a time in one task.

    A batch that fails is tried again after a growing pause with some chance in
    it; one that still fails is taken apart, so that a text that cannot be
    embedded fails alone. A failed row gets a zero vector and the error's words.
    At most ``rate`` calls a second leave one task; the rate of a job is that
    times the tasks that run at once.
    """

    def __init__(self, model: Callable[[list[str]], list], size: int, batch: int = 32, concurrency: int = 10, retries: int = 3, pause: float = 0.5, rate: float | None = None):
        if min(size, batch, concurrency) < 1 or retries < 0:
            raise ValueError("size, batch and concurrency must be positive and retries not negative")
        self.model, self.size, self.batch, self.concurrency, self.retries, self.pause, self.rate = model, size, batch, concurrency, retries, pause, rate

    def _tried(self, texts: list[str]) -> tuple[list | None, str | None, int]:
        error = None
        for attempt in range(self.retries + 1):
            try:
                out = [list(map(float, v)) for v in self.model(texts)]
                if len(out) != len(texts) or any(len(v) != self.size for v in out):
                    raise ValueError("the model gave vectors of another number or length")
                return out, None, attempt + 1
            except Exception as e:  # whatever a model raises stays with its rows
                error = f"{type(e).__name__}: {e}"
                if attempt < self.retries and self.pause:
                    time.sleep(self.pause * 2**attempt * (0.5 + random.random() / 2))
        return None, error, self.retries + 1

    def _called(self, texts: list[str]) -> list[tuple[list, str | None, int]]:
        out, error, tries = self._tried(texts)
        if out is not None:
            return [(v, None, tries) for v in out]
        if len(texts) == 1:
            return [([0.0] * self.size, error, tries)]
        half = len(texts) // 2
        return self._called(texts[:half]) + self._called(texts[half:])

    def calls(self, texts: list[str]) -> list[tuple[list, str | None, int]]:
        """Results in the order of the texts; each distinct text is called once."""
        known = list(dict.fromkeys(texts))
        parts, due = [known[i : i + self.batch] for i in range(0, len(known), self.batch)], time.monotonic()
        with ThreadPoolExecutor(self.concurrency) as pool:
            running = []
            for part in parts:
                if self.rate:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + 1 / self.rate
                running.append(pool.submit(self._called, part))
            found = dict(zip(known, (r for x in running for r in x.result()), strict=True))
        return [found[t] for t in texts]


class Rotation:
    """Several models as one: a call goes to the first healthy one and on to the next if it fails.

    A model that fails is unhealthy for ``recover`` seconds, twice as long with
    each failure in a row, and is then tried again; a call that succeeds makes it
    healthy. If none is healthy, the one that recovers first is tried. Every task
    keeps its own record of health.
    """

    def __init__(self, models: dict[str, Callable[[list[str]], list]], recover: float = 30.0, clock: Callable[[], float] = time.monotonic):
        if not models:
            raise ValueError("at least one model is needed")
        self.models, self.recover, self.clock = models, recover, clock
        self.failures, self.until = dict.fromkeys(models, 0), dict.fromkeys(models, 0.0)

    def healthy(self) -> list[str]:
        """The names of the models that would be asked, in their order."""
        now = self.clock()
        return [n for n in self.models if self.until[n] <= now] or [min(self.models, key=lambda n: self.until[n])]

    def __call__(self, texts: list[str]) -> list:
        error: Exception | None = None
        for name in self.healthy():
            try:
                out = self.models[name](texts)
            except Exception as e:  # the next model is asked instead
                error, self.failures[name] = e, self.failures[name] + 1
                self.until[name] = self.clock() + self.recover * 2 ** min(self.failures[name] - 1, 10)
            else:
                self.failures[name], self.until[name] = 0, 0.0
                return out
        raise error


def embedded(text: Column, caller: Caller) -> Column:
    """``vector, error, tries`` of each text, by Arrow batches. Null and blank texts are not called: a zero vector without an error."""

    @F.pandas_udf(RESULT)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            asked = [t for t in texts if t and t.strip()]
            found = iter(caller.calls(asked))
            rows = [next(found) if t and t.strip() else ([0.0] * caller.size, None, 0) for t in texts]
            yield pd.DataFrame({"vector": [r[0] for r in rows], "error": [r[1] for r in rows], "tries": [r[2] for r in rows]})

    return embed(text)
