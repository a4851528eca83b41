"""New boards from captured URLs: the index's pages, the tokens in them, their validation, the merge into the targets."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postmill.functions.models import RateGate, with_retry
from postmill.operators.lifecycle import upsert_targets
from postmill.session import cut
from postmill.sources.feeds import distinct_tokens


class UrlIndex(DataSource):
    """``spark.read.format("postmill_index")``: captured URLs of hosts, one partition for each host, its pages one after the other.

    Options: ``hosts`` (comma-separated), ``crawl``, ``fetcher`` (``module:function`` that is called with crawl, host and page;
    with page None it gives the number of pages, else the text of a page: a JSON object in each line), ``gap``, ``pause``.
    A malformed line is left out, a failed page too; a host whose number of pages can't be had gives nothing but a row with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "postmill_index"

    def schema(self) -> str:
        return "host string, page int, url string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(dict(self.options))


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(h) for h in self.options.get("hosts", "").split(",") if h]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, host = self.options, partition.value
        module, function = o["fetcher"].split(":")
        fetch, crawl = getattr(importlib.import_module(module), function), o.get("crawl")
        gate = RateGate(float(o.get("gap", 0)), float(o.get("pause", 0)))
        ask = lambda page: with_retry(lambda: (gate.wait(), fetch(crawl, host, page))[1], tries=4, base=float(o.get("base", 1)))
        try:
            pages = int(ask(None))
        except Exception as e:  # noqa: BLE001 - a host's failure is a row
            yield (host, None, None, str(e)[:500])
            return
        for page in range(pages):
            try:
                lines = ask(page).splitlines()
            except Exception as e:  # noqa: BLE001 - a page's failure is a row
                gate.refused()
                yield (host, page, None, str(e)[:500])
                continue
            for line in lines:
                try:
                    url = json.loads(line).get("url")
                except (ValueError, AttributeError):
                    continue
                if isinstance(url, str):
                    yield (host, page, url, None)


def discover(spark: SparkSession, urls: DataFrame, token: Column, source: str, targets: DataFrame, validate, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The targets with the valid boards among the tokens of ``urls``, and ``token, outcome`` of each token asked.

    ``validate`` is a frame function: ``(tokens) -> (token, outcome)`` with the outcomes of ``board_outcome``. With ``limit``
    the first tokens by name are asked only. Known targets are asked again, and only get the time of discovery.
    """
    tokens = distinct_tokens(urls, token)
    tokens = tokens.orderBy("token").limit(limit) if limit else tokens
    asked = cut(validate(tokens))
    found = asked.where("outcome in ('valid', 'empty')").select(F.lit(source).alias("source"), "token")
    return upsert_targets(targets, found, ["source", "token"], now), asked
