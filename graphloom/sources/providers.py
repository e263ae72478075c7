"""Language-model and embedding providers: anything with the right method can take a place here; none needs a network to be tested."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.operators.errors import ProviderError


class Retryable(Exception):
    """A failure that may pass: time-outs, rate limits, a server's own errors."""


@dataclass
class Failover:
    """Calls models in order until one answers; each is tried ``tries`` times with doubled pauses, within ``deadline`` seconds for all. ``served`` counts who answered."""

    models: Sequence[tuple[str, Callable[[str], str]]]
    tries: int = 3
    pause: float = 0.5
    deadline: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    served: dict[str, int] = field(default_factory=dict)

    def complete(self, prompt: str) -> str:
        return self.attempt(prompt)[1]

    def attempt(self, prompt: str) -> tuple[str, str]:
        """(model, reply)."""
        end, last = self.clock() + self.deadline, None
        for name, call in self.models:
            for k in range(self.tries):
                if self.clock() > end:
                    raise ProviderError(f"no reply within {self.deadline} s") from last
                try:
                    reply = call(prompt)
                except Retryable as e:
                    last = e
                    if k + 1 < self.tries:
                        self.sleep(min(self.pause * 2**k, max(0.0, end - self.clock())))
                except Exception as e:
                    last = e
                    break  # another try would fail alike: go to the next model
                else:
                    self.served[name] = self.served.get(name, 0) + 1
                    return name, reply
        raise ProviderError("no model answered") from last

    def stream(self, prompt: str, piece: int = 16) -> Iterator[str]:
        """The reply in pieces, for callers on the driver."""
        reply = self.complete(prompt)
        for at in range(0, len(reply), piece):
            yield reply[at : at + piece]


class Replay:
    """Replies recorded in advance, by prompt; ``default`` for others."""

    def __init__(self, replies: dict[str, str], default: str | None = None) -> None:
        self.replies, self.default = replies, default

    def __call__(self, prompt: str) -> str:
        reply = self.replies.get(prompt, self.default)
        if reply is None:
            raise KeyError(f"no reply recorded for {prompt[:60]!r}")
        return reply


def completed(provider: Callable[[], Failover], prompt: Column) -> Column:
    """A struct (model, reply, error) for each prompt. ``provider`` makes the client, once for each task; a failure is a row with ``error``, not a failed job."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = provider()
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    rows.append((*client.attempt("" if p is None else p), None))
                except ProviderError as e:
                    rows.append((None, None, str(e)))
            yield pd.DataFrame(rows, columns=["model", "reply", "error"], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "model string, reply string, error string")(prompt)


def served(completions: Column) -> list[Column]:
    """Aggregates of a column of completions: by whom answered, and how many failed."""
    return [F.count_if(completions["error"].isNull()).alias("answered"), F.count_if(completions["error"].isNotNull()).alias("failed"), F.array_sort(F.collect_set(completions["model"])).alias("models")]
