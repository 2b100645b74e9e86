"""Embeddings from any provider: a callable that takes texts and gives vectors, None for those it can't do."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float] | None]]


@dataclass(frozen=True)
class Provider:
    """batch: texts of one call; retries: how often a failed call is made again, waiting twice as long each time; name: of the model, which vectors carry."""

    embed: Embed
    batch: int = 64
    retries: int = 2
    wait: float = 1.0
    name: str = ""

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for at in range(0, len(texts), self.batch):
            out += self._tried(texts[at : at + self.batch])
        return out

    def _tried(self, texts: list[str]) -> list[list[float] | None]:
        """A batch that fails for good is tried text by text."""
        for attempt in range(self.retries + 1):
            try:
                return list(self.embed(texts))
            except Exception:  # providers fail in their own ways
                if attempt < self.retries:
                    time.sleep(self.wait * 2**attempt)
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in Provider(self.embed, 1, 0, self.wait)([t])]


def hashed(texts: list[str], size: int = 16) -> list[list[float]]:
    """Vectors of a digest: equal texts have equal ones. For tests, and where there is no model."""
    out = []
    for t in texts:
        digest = hashlib.shake_128(t.encode("utf-8", "replace")).digest(size)
        norm = sum((b - 127.5) ** 2 for b in digest) ** 0.5
        out.append([(b - 127.5) / norm for b in digest])
    return out


def with_fallback(first: Embed, second: Embed) -> Embed:
    """The second where the first raises."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        try:
            return first(texts)
        except Exception:  # whatever it is, the second may do
            return second(texts)

    return embed


REGISTRY: dict[str, Callable[..., Embed]] = {"hashed": lambda size=16: lambda texts: hashed(texts, size)}


def register(name: str, factory: Callable[..., Embed]) -> None:
    """Remote models are registered by their users: factory(**options) gives the callable."""
    REGISTRY[name] = factory


def provider(name: str, batch: int = 64, **options) -> Provider:
    if name not in REGISTRY:
        raise ValueError(f"no provider {name!r}; there are {sorted(REGISTRY)}")
    return Provider(REGISTRY[name](**options), batch, name=":".join([name, *(f"{k}={options[k]}" for k in sorted(options))]))


def embedded(rows: DataFrame, column: str, model: Provider) -> DataFrame:
    """The rows with `embedding`, null where the provider failed."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model(part.tolist()), index=part.index)

    # not deterministic, or a filter on the result would run it again, and below joins that spare it most rows
    return rows.withColumn("embedding", run.asNondeterministic()(column))


def query_vector(model: Provider, text: str) -> list[float]:
    found = model([text])[0]
    if found is None:
        raise ValueError("the query can't be embedded")
    return list(found)
