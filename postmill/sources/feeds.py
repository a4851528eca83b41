"""Feeds: readers with explicit schemas, a paged data source, and the normalisers."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postmill.functions.models import RateGate
from postmill.functions.text import decode_entities, display_name, escape_html, html_to_text, url_key
from postmill.operators.timestamps import number_instant, text_instants
from postmill.schema import CATEGORY_FIELD, EMPLOYMENT_B, EMPLOYMENT_C, FEED_D, INTERVAL_B, INTERVAL_C, SPONSORSHIP, WORKPLACE_B, WORKPLACE_C, amount, clean, mapped


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array; the schema is given, never inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is skipped, the rest of its file is read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path, schema="id bigint, company string, title string, url string, label string")


def curated_feed(spark: SparkSession, path: str) -> DataFrame:
    """The curated list: entries that are active and visible."""
    return read_array(spark, path, FEED_D).where("active and is_visible")


def distinct_tokens(urls: DataFrame, token: Column) -> DataFrame:
    """The board tokens in captured URLs, each once."""
    return urls.select(token.alias("token")).where("token is not null").distinct()


class PagedFeed(DataSource):
    """``spark.read.format("postmill_feed")``: one partition for each board, pages read inside it.

    Options: ``boards`` (comma-separated tokens), ``fetcher`` (``module:function``, called with board,
    offset, size and stored validator, and with ``extra``, a JSON object of further arguments such as a
    timeout or a flag for pay), ``page_size``, ``max_pages``, ``validators`` (JSON object of
    board to validator), ``full`` (true: no validator is passed), ``gap`` and ``pause`` (seconds between calls
    of one host and after a refusal), ``pages`` (``all``: whole or not at all; ``skip``: a failed page is left out),
    ``required`` (fields that each record must have; others make the board an error).
    The fetcher returns ``(status, records, validator)``; ``not_modified`` is a row of its own, never an empty list,
    and a failed board gives a row with the error instead of failing the others. A page shorter than ``page_size``
    is the last. A validator counts only with the first page, and only if the whole board was read. Rows leave page by
    page; a board that fails later has a row of its own saying so, which voids the ones before.
    """

    @classmethod
    def name(cls) -> str:
        return "postmill_feed"

    def schema(self) -> str:
        return "board string, status string, validator string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in self.options.get("boards", "").split(",") if b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, board = self.options, partition.value
        module, function = o["fetcher"].split(":")
        fetch = getattr(importlib.import_module(module), function)
        size, most = int(o.get("page_size", 100)), int(o.get("max_pages", 500))
        validator = None if o.get("full", "false").lower() == "true" else json.loads(o.get("validators", "{}")).get(board)
        extra, required = json.loads(o.get("extra", "{}")), [f for f in o.get("required", "").split(",") if f]
        gate = RateGate(float(o.get("gap", 0)), float(o.get("pause", 0)))
        tag, any_row = None, False
        try:
            for page in range(most):
                gate.wait()
                try:
                    status, records, got = fetch(board, page * size, size, validator, **extra)
                except Exception:
                    gate.refused()
                    if o.get("pages", "all") != "skip":
                        raise
                    continue
                if status == "not_modified":
                    yield (board, "not_modified", validator, None, None)
                    return
                if not isinstance(records, list) or any(f not in r for r in records for f in required):
                    raise ValueError("the answer has not the expected shape")
                tag = got if page == 0 else tag
                for r in records:
                    any_row = True
                    yield (board, "ok", None, json.dumps(r), None)
                if len(records) < size:
                    yield (board, "complete" if any_row else "empty", tag, None, None)
                    return
            yield (board, "error", None, None, f"more than {most} pages")
        except Exception as e:  # noqa: BLE001 - a board's failure is a row
            yield (board, "error", None, None, str(e)[:500])


def complete_boards(fetched: DataFrame) -> DataFrame:
    """``board, validator`` of boards whose whole snapshot arrived, an empty one included: what may delist."""
    ends = fetched.where("payload is null").groupBy("board").agg(F.max("status").alias("status"), F.max("validator").alias("validator"), F.count_if(F.col("status") == "error").alias("bad"))
    return ends.where("bad = 0 and status in ('complete', 'empty')").select("board", "validator")


def board_outcome(status: Column, error: Column, records: Column, code: Column) -> Column:
    """valid, empty, rate_limited or error of a fetched board."""
    return F.when(code == 429, "rate_limited").when(error.isNotNull() | (status == "error"), "error").when(records > 0, "valid").otherwise("empty")


_KEYS = "array<struct<source:string,source_external_id:string>>"
_TYPES = {
    "published_at": "timestamp", "application_deadline": "timestamp", "comp_min": "decimal(12,2)", "comp_max": "decimal(12,2)",
    "duplicate_keys": _KEYS, "preclassified": "struct<kind:string,field:string,citizenship:string>",
}
_NAMES = ["source_external_id", "company", "title", "description_html", "description_plain", "location", "department", "employment_type", "workplace_type", "published_at", "application_deadline", "comp_min", "comp_max", "comp_currency", "comp_interval", "url", "duplicate_keys", "preclassified"]


def _listing(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The columns of LISTING, null where a feed has none; rows without id, company or title fall away."""
    columns.setdefault("duplicate_keys", F.array().cast(_KEYS))
    out = [columns.get(n, F.lit(None)).cast(_TYPES.get(n, "string")).alias(n) for n in _NAMES]
    return df.select(F.lit(source).alias("source"), *out).where("source_external_id <> '' and company <> '' and title <> ''")


def normalise_a(df: DataFrame) -> DataFrame:
    """Feed A: entity-encoded HTML, company in the payload; rows without a company are dropped."""
    body = decode_entities(F.col("content"))
    return _listing(
        df, "a", source_external_id=F.col("id").cast("string"), company=clean("company_name"), title=clean("title"), description_html=body,
        description_plain=html_to_text(body), location=F.col("location.name"), department=F.get("departments.name", F.lit(0)),
        published_at=F.try_to_timestamp("first_published"), url=F.col("absolute_url"),
    )


def normalise_b(df: DataFrame, board: str) -> DataFrame:
    """Feed B: company from the board's name, milliseconds, words for enums, pay as a range."""
    pay = lambda f: F.col("salaryRange")[f]
    return _listing(
        df, "b", source_external_id=F.col("id"), company=display_name(F.col(board)), title=clean("text"), description_html=F.col("description"),
        description_plain=F.col("descriptionPlain"), location=F.col("categories.location"), department=F.coalesce("categories.department", "categories.team"),
        employment_type=mapped(F.col("categories.commitment"), EMPLOYMENT_B), workplace_type=mapped(F.col("workplaceType"), WORKPLACE_B),
        comp_min=amount(pay("min")), comp_max=amount(pay("max")), comp_currency=pay("currency"), comp_interval=mapped(pay("interval"), INTERVAL_B),
        published_at=F.timestamp_millis("createdAt"), url=F.col("hostedUrl"),
    )


def salary_component(components: Column) -> Column:
    """The first component of type "Salary", whatever its interval; null where there is none."""
    return F.get(F.filter(components, lambda c: c["compensationType"] == "Salary"), F.lit(0))


def normalise_c(df: DataFrame, board: str, zones: DataFrame | None = None) -> DataFrame:
    """Feed C: listed postings only; a missing workplace falls back to remote, never to on site.

    ``publishedAt`` comes in many forms; ``zones`` ``(board, tz, date_style)`` tells what a value without
    a zone means (UTC without it). Its instants are read once for each distinct value of a zone and style.
    """
    listed = df.where("isListed")
    by = zones.select(F.col("board").alias(board), F.col("tz").alias("__board_tz"), F.col("date_style").alias("__board_style")) if zones is not None else None
    listed = listed.join(by, board, "left") if by is not None else listed.withColumns({"__board_tz": F.lit(None).cast("string"), "__board_style": F.lit(None).cast("string")})
    values = listed.select("publishedAt", "__board_tz", "__board_style").distinct()
    at = text_instants(values, ["publishedAt", "__board_tz", "__board_style"], "publishedAt", "__board_tz", "__board_style").toDF("__v", "__z", "__s", "__us")
    same = F.col("publishedAt").eqNullSafe(F.col("__v")) & F.col("__board_tz").eqNullSafe(F.col("__z")) & F.col("__board_style").eqNullSafe(F.col("__s"))
    workplace = F.coalesce(mapped(F.col("workplaceType"), WORKPLACE_C), F.when(F.col("isRemote"), "remote"))
    pay = salary_component(F.col("compensation.summaryComponents"))
    return _listing(
        listed.join(at, same, "left"), "c", source_external_id=F.col("id"), company=clean(board), title=clean("title"), description_html=F.col("descriptionHtml"),
        description_plain=F.col("descriptionPlain"), location=F.col("location"), department=F.col("department"),
        employment_type=mapped(F.col("employmentType"), EMPLOYMENT_C), workplace_type=workplace, published_at=F.timestamp_micros("__us"), url=F.col("jobUrl"),
        comp_min=amount(pay["minValue"]), comp_max=amount(pay["maxValue"]), comp_currency=pay["currencyCode"], comp_interval=mapped(pay["interval"], INTERVAL_C),
    )


def normalise_d(df: DataFrame, hosts: list[tuple[str, str]] = ()) -> DataFrame:
    """The curated feed: id, company, title and URL must be there; places joined; a description made of the facts.

    ``hosts`` are the patterns of ``url_key``: the key that a URL of a crawled host bears is the listing's
    alias. The feed has a verdict of its own: kind, field and citizenship.
    """
    told = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: clean(x)), lambda x: x != "")
    text = lambda c: F.nullif(clean(c), F.lit(""))
    places = F.nullif(F.array_join(told("locations"), "; "), F.lit(""))
    parts = [("Category", text("category")), ("Term", F.nullif(F.array_join(told("terms"), ", "), F.lit(""))), ("Locations", places), ("Degrees", F.nullif(F.array_join(told("degrees"), ", "), F.lit("")))]
    plain = F.concat_ws(". ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in parts], F.lit("Curated entry without a posting's text"))
    rows = df.where(F.col("active") & F.col("is_visible") & (clean("url") != ""))
    alias = url_key(F.col("url"), list(hosts)) if hosts else None
    keys = F.when(alias.isNotNull(), F.array(alias)).otherwise(F.array().cast(_KEYS)) if hosts else F.array().cast(_KEYS)
    citizenship = mapped(F.col("sponsorship"), SPONSORSHIP, fold=False)
    return _listing(
        rows, "d", source_external_id=clean("id"), company=clean("company_name"), title=clean("title"), description_html=F.concat(F.lit("<p>"), escape_html(plain), F.lit("</p>")),
        description_plain=plain, location=places, url=clean("url"), published_at=F.timestamp_micros(number_instant(F.col("date_posted"))), duplicate_keys=keys,
        preclassified=F.struct(F.lit("internship").alias("kind"), mapped(text("category"), CATEGORY_FIELD, fold=False).alias("field"), citizenship.alias("citizenship")),
    )


# What has a schema by itself in an evaluation: the sampled items, rankings, vectors, labels.
EVAL_FILES = {
    "sample": "id bigint, company string, title string, url string, cell string",
    "rankings": "approach string, rank int, id bigint",
    "vectors": "id bigint, vector array<double>",
}


def read_eval(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the files of an evaluation: a JSON array of known schema, or the labels."""
    return read_labels(spark, f"{folder}/labels.csv") if name == "labels" else read_array(spark, f"{folder}/{name}.json", EVAL_FILES[name])


def read_profile(text_path: str, answers_path: str) -> tuple[str, dict]:
    """A person's text and answers, read by the driver from two local files."""
    return Path(text_path).read_text(encoding="utf-8"), json.loads(Path(answers_path).read_text(encoding="utf-8"))


def crawl_list(spark: SparkSession, path: str) -> list[str]:
    """The ids of the URL index's crawls, newest first as listed; an empty list is an error. They are a few hundred at most."""
    ids = [r["id"] for r in read_array(spark, path, "id string").where("id is not null").collect()]
    if not ids:
        raise ValueError("the list of crawls is empty")
    return ids
