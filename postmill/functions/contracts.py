"""Typed contracts of model calls: answers bound to a shape, and guards on what an answer may say."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.models import _types, with_retry
from postmill.functions.text import canonical_terms, plausible_years, strict_date
from postmill.schema import clean, one_of, valid_signature


class Chat(Protocol):
    def answer(self, system: str, user: str, schema: dict, temperature: float) -> str:
        """The text of an answer, which should be a JSON object of ``schema``."""


_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def conforms(value, schema: dict) -> bool:
    """Whether a JSON value has the shape of a schema: types (or alternatives), required properties, items, enumerations."""
    kinds = schema.get("type", "object")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if value is None:
        return "null" in kinds
    fits = any(k != "null" and isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
    if not fits or ("enum" in schema and value not in schema["enum"]):
        return False
    if isinstance(value, dict):
        parts = schema.get("properties", {})
        return all(k in value for k in schema.get("required", [])) and all(conforms(value[k], s) for k, s in parts.items() if k in value)
    return all(conforms(v, schema["items"]) for v in value) if isinstance(value, list) and "items" in schema else True


def chat_json(client: Chat, system: str, user: str, schema: dict, sleep: Callable[[float], None] | None = None) -> dict:
    """An answer bound to a schema, asked at temperature 0; transient failures are tried again, another shape is an error."""
    ask = lambda: client.answer(system, user, schema, 0.0)
    text = with_retry(ask, sleep=sleep) if sleep else with_retry(ask)
    value = json.loads(text)
    if not conforms(value, schema):
        raise ValueError("the answer has not the shape asked for")
    return value


def model_for(step: str, settings: dict[str, str], default: str) -> str:
    """The model of a step: its own setting, else the common one, else the default."""
    return settings.get(f"model.{step}") or settings.get("model") or default


def prompt_text(body: Column, *fields: tuple[str, Column], most: int = 6000) -> Column:
    """What a model is asked about a row: labelled fields, then the first characters of the description."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in fields]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("Description:"), F.substring(F.coalesce(body, F.lit("")), 1, most))


def guarded_extract(df: DataFrame, now: Column, citizenship: list[str], degrees: list[str]) -> DataFrame:
    """``df`` of raw extracted strings with each field as far as it can be believed, else null.

    Graduation dates must be a year or year and month whose class year is plausible by ``now``; date and year
    are kept or dropped together. A deadline must be an exact date; statuses must be known values.
    """
    low, low_year = plausible_years(F.col("grad_date_min"), now)
    high, high_year = plausible_years(F.col("grad_date_max"), now)
    return df.withColumns(
        {
            "grad_date_min": low, "grad_year_min": low_year, "grad_date_max": high, "grad_year_max": high_year,
            "citizenship_status": one_of(F.col("citizenship_status"), citizenship), "degree_status": one_of(F.col("degree_status"), degrees),
            "application_deadline": strict_date(F.col("application_deadline")).cast("timestamp"),
        }
    )


def distill(df: DataFrame, client, keys: list[str], title: str, body: str, kind: str, field: str, aliases: dict[str, str]) -> DataFrame:
    """``keys, signature, error``: skills and focus by ``client.distill(title, body)``, level and domain from the row.

    The signature is JSON text of the valid shape: skills canonical, a level (``unknown`` where there is no kind), a
    focus. A failing row, or one whose signature isn't valid, has an error and no signature.
    """

    def one(t, b) -> tuple:
        try:
            r = with_retry(lambda: client.distill(t or "", b or ""))
            return [s for s in r["skills"] if isinstance(s, str)], str(r["focus"]), None
        except Exception as e:  # noqa: BLE001 - isolated by row
            return None, None, str(e)[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(t, b) for t, b in zip(pdf[title], pdf[body])], columns=["skills", "focus", "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[[*keys, kind, field]], got], axis=1)

    kept = list(dict.fromkeys([*keys, kind, field]))
    told = df.select(*dict.fromkeys([*kept, title, body])).mapInPandas(run, f"{_types(df, kept)}, skills array<string>, focus string, error string")
    none = F.array().cast("array<string>")
    parts = F.struct(
        canonical_terms(F.col("skills"), aliases).alias("skills"), F.when(F.col(field).isNotNull(), F.array(F.col(field))).otherwise(none).alias("domains"),
        F.coalesce(F.col(kind), F.lit("unknown")).alias("level"), clean("focus").alias("focus"),
    )
    made = F.when(F.col("error").isNull(), F.to_json(parts))
    good = valid_signature(made).isNotNull()
    return told.select(*keys, F.when(good, made).alias("signature"), F.when(F.col("error").isNull() & ~F.coalesce(good, F.lit(False)), "not a valid signature").otherwise(F.col("error")).alias("error"))


def extract_profile(client, text: str, aliases: dict[str, str]) -> dict:
    """A person's skills and focus by ``client.profile(text)``, as far as their evidence stands in the text.

    A skill without evidence is dropped and reported; a focus without evidence is an error.
    """
    flat = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    raw, whole = with_retry(lambda: client.profile(text)), flat(text)
    stands = lambda quote: bool(flat(quote)) and flat(quote) in whole
    if not stands(raw["focus"]["evidence"]):
        raise ValueError("the focus has no evidence in the text")
    named = [(flat(s["name"]), stands(s["evidence"])) for s in raw["skills"]]
    return {
        "skills": sorted({aliases.get(n, n) for n, ok in named if ok and n}),
        "focus": raw["focus"]["text"].strip(),
        "dropped": [n for n, ok in named if not ok],
    }
