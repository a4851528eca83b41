"""Model-backed steps behind clients that callers inject; offline stand-ins are the defaults."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Classifier(Protocol):
    def classify(self, title: str, body: str) -> dict:
        """``relevant`` (bool), ``kind`` and ``field`` (strings or None)."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Transient(Exception):
    """A failure that may pass: no status, 429 or a server's fault."""


def with_retry(call: Callable, tries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """``call()`` again after 1, 2, 4 ... times ``base`` seconds while it fails transiently."""
    for n in range(tries + 1):
        try:
            return call()
        except Transient:
            if n == tries:
                raise
            sleep(base * 2**n)


class RateGate:
    """A least gap between starts, and a pause after a host's refusal; clock and sleep are injectable."""

    def __init__(self, gap: float, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.pause, self.clock, self.sleep, self.next = gap, pause, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap

    def refused(self) -> None:
        self.next = max(self.next, self.clock() + self.pause)


class RuleClassifier:
    """A deterministic stand-in: relevant if a title names an early career."""

    early = re.compile(r"\b(intern|co-op|apprentice|new grad)\b", re.I)

    def classify(self, title: str, body: str) -> dict:
        m = self.early.search(title or "")
        return {"relevant": bool(m), "kind": m.group(1).lower() if m else None, "field": None}


class RuleSigner:
    """A deterministic stand-in: the title's words are the skills, the title is the focus."""

    def distill(self, title: str, body: str) -> dict:
        return {"skills": re.findall(r"[a-z]{3,}", title.lower())[:20] or ["none"], "focus": title[:300] or "none"}


class HashEmbedder:
    """A deterministic stand-in: a unit vector from the text's hash."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = hashlib.shake_128(t.encode()).digest(self.dimensions * 2)
            v = [int.from_bytes(raw[i : i + 2], "big") / 65535 - 0.5 for i in range(0, len(raw), 2)]
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


KINDS = ("intern", "co-op", "apprentice", "new grad")


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def classify(df: DataFrame, client: Classifier, keys: list[str], title: str, body: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``keys, relevant, kind, field, error`` of each row.

    A failing row has an error and no verdict, to be tried again, and never fails its batch. A kind
    that isn't known is null; the field is null unless the row is relevant. Null texts are empty ones.
    """

    def one(t, b) -> tuple:
        try:
            r = with_retry(lambda: client.classify(t or "", b or ""))
            relevant = r.get("relevant") is True
            kind = r.get("kind") if r.get("kind") in kinds else None
            return relevant, kind, r.get("field") if relevant else None, None
        except Exception as e:  # noqa: BLE001 - isolated by row
            return None, None, None, str(e)[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(t, b) for t, b in zip(pdf[title], pdf[body])], columns=["relevant", "kind", "field", "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[keys], got], axis=1)

    return df.select(*dict.fromkeys([*keys, title, body])).mapInPandas(run, f"{_types(df, keys)}, relevant boolean, kind string, field string, error string")


# What an extraction may find, and its types.
EXTRACTED = {
    "grad_date_min": "date", "grad_date_max": "date", "grad_year_min": "int", "grad_year_max": "int",
    "citizenship_status": "string", "degree_status": "string", "application_deadline": "timestamp",
}


def extract(df: DataFrame, client, keys: list[str], title: str, body: str) -> DataFrame:
    """``keys``, the fields of ``EXTRACTED`` that ``client.extract(title, body)`` finds, and ``error``.

    A failing row has an error and null fields; a value that isn't of its field's type is null.
    """

    def one(t, b) -> tuple:
        try:
            r = with_retry(lambda: client.extract(t or "", b or ""))
            return (*[None if r.get(f) is None else str(r[f]) for f in EXTRACTED], None)
        except Exception as e:  # noqa: BLE001 - isolated by row
            return (*[None] * len(EXTRACTED), str(e)[:500])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(t, b) for t, b in zip(pdf[title], pdf[body])], columns=[*EXTRACTED, "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[keys], got], axis=1)

    told = df.select(*dict.fromkeys([*keys, title, body])).mapInPandas(run, f"{_types(df, keys)}, {', '.join(f'{f} string' for f in EXTRACTED)}, error string")
    return told.select(*keys, *[F.col(f).try_cast(t).alias(f) for f, t in EXTRACTED.items()], "error")


def embed(df: DataFrame, client: Embedder, keys: list[str], text: str, size: int = 16) -> DataFrame:
    """``keys, vector, error``: texts go to the client in groups of ``size``.

    A group whose answer has another length, or an empty vector, gives errors for its rows only. Null and empty texts
    have no vector and the error "empty".
    """

    def group(texts: list[str]) -> list[tuple]:
        try:
            vectors = with_retry(lambda: client.embed(texts))
            if len(vectors) != len(texts) or not all(vectors):
                raise ValueError("wrong number of vectors")
            return [(v, None) for v in vectors]
        except Exception as e:  # noqa: BLE001
            return [(None, str(e)[:500])] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = [(None, "empty")] * len(pdf)
            told = [i for i, t in enumerate(pdf[text]) if isinstance(t, str) and t]
            for lo in range(0, len(told), size):
                part = told[lo : lo + size]
                for i, r in zip(part, group([pdf[text].iloc[i] for i in part])):
                    out[i] = r
            yield pd.concat([pdf[keys], pd.DataFrame(out, columns=["vector", "error"], index=pdf.index)], axis=1)

    return df.select(*dict.fromkeys([*keys, text])).mapInPandas(run, f"{_types(df, keys)}, vector array<double>, error string")
