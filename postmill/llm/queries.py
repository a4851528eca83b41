"""Queries of the llm operators over their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.encode import encode_texts
from postmill.llm.history import dedup_history, history_rows
from postmill.llm.leak import find_leaks
from postmill.llm.lines import repeated_blocks, without_blocks
from postmill.llm.names import link_names, name_pairs
from postmill.llm.neardup import NearDuplicates
from postmill.llm.places import resolve_places
from postmill.llm.spans import SharedSpans
from postmill.session import table

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _names(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "simplify").select(F.col("company_name").alias("name"))
    return typed.unionAll(table(spark, d, "labels").select("company"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(link_names(_names(spark, d)))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the most frequent spelling of its employer."""
    return link_names(_names(spark, d)).select("name", "canonical")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "ashby")).pairs()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with the first posting of its class of equal sets, and its number of links.

    Where p2_found links the copies of one text to the first of them only, that one's pairs and these classes give all pairs.
    """
    return NearDuplicates(table(spark, d, "ashby")).classes()


# Between blanks, after the stronger delimiters; upper case is the code of a region.
_VALUES = r"[;|]|(?<=\s)/(?=\s)"


def _place_values(spark: SparkSession, d: str) -> DataFrame:
    """Every single value of the two feeds: feed, record, value."""
    parts = F.flatten(F.transform(F.split("location", _VALUES), lambda v: F.split(F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""), r"[\s\p{Z}]+or[\s\p{Z}]+")))
    ashby = table(spark, d, "ashby").select(F.lit("ashby").alias("feed"), F.col("id").alias("record_id"), F.explode(parts).alias("value"))
    simplify = table(spark, d, "simplify").select(F.lit("simplify").alias("feed"), F.col("id").alias("record_id"), F.explode("locations").alias("value"))
    return ashby.unionByName(simplify)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = resolve_places(_place_values(spark, d), "value", table(spark, d, "places"))
    return found.where("place_id is not null").select("feed", "record_id", "place_id").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no listed place, and in how many records they stand."""
    found = resolve_places(_place_values(spark, d), "value", table(spark, d, "places"))
    return found.where("place_id = -1").groupBy("value").agg(F.countDistinct("feed", "record_id").alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_blocks(table(spark, d, "ashby")).select("board", F.explode("lines").alias("line")).distinct()


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The longest repeated blocks of each board, and in how many of its postings each stands."""
    return repeated_blocks(table(spark, d, "ashby")).select("board", F.array_join("lines", "\n").alias("block"), "n_docs")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each description without the lines that its board repeats."""
    ashby = table(spark, d, "ashby").select("board", "id", "descriptionPlain")
    return without_blocks(ashby, repeated_blocks(ashby)).select("board", "id", "clean_text").distinct()


def _cases(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "ashby_batches").select("batch_no", "seq", "board", "title", "location")
    batches = resolve_places(batches, "location", table(spark, d, "places"))
    # Null and empty locations are equal to each other; a location that names no place equals none.
    empty = F.col("place_id").isNull()
    place = F.when(empty, F.lit("none")).when(F.col("place_id") > 0, F.col("place_id").cast("string"))
    cases, state = dedup_history(history_rows(batches, place))
    state.drop()  # a caller with more batches to come keeps it
    return cases.distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)


def p7_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The rows that are accepted after all batches."""
    cases = _cases(spark, d).select(F.col("seq_b").alias("seq"))
    return table(spark, d, "ashby_batches").select("batch_no", "seq").where("batch_no is not null and seq is not null").join(cases, "seq", "left_anti")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked passage with its offsets in the document."""
    return _leaks(spark, d).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).pairs()


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of documents that share spans, with the places of these: all pairs follow from it."""
    return SharedSpans(table(spark, d, "documents")).classes()


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each document with a shared span, how much of its text stands elsewhere."""
    return SharedSpans(table(spark, d, "documents")).coverage()


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p5_found": p5_found, "p5_blocks": p5_blocks, "p5_clean": p5_clean, "p7_found": p7_found, "p7_accepted": p7_accepted, "p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_classes": p10_classes, "p10_coverage": p10_coverage}

_LINES = r"""
WITH line_rows AS (
    SELECT board, id, descriptionPlain, pos, raw, lower(trim(regexp_replace(raw, '[\s\p{Z}\x85\x1c-\x1f]+', ' ', 'g'))) AS line
    FROM (SELECT DISTINCT board, id, descriptionPlain,
                 unnest(string_split(descriptionPlain, chr(10))) AS raw,
                 unnest(range(len(string_split(descriptionPlain, chr(10))))) AS pos FROM ashby)
), totals AS (SELECT board, count(DISTINCT id) AS total FROM ashby GROUP BY board),
found AS (
    SELECT board, line FROM line_rows JOIN totals USING (board) WHERE line <> ''
    GROUP BY board, line, total HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.2 * total
)"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_TRIPLES = rf"""
WITH p AS (SELECT id, {_WORDS.format("coalesce(title, '') || chr(10) || descriptionPlain")} AS w FROM (SELECT DISTINCT id, title, descriptionPlain FROM ashby) WHERE descriptionPlain IS NOT NULL),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM p, unnest(range(1, len(w) - 1)) r(i) WHERE len(w) >= 20),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
x AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
"""
_RUNS = lambda name, key, table: f"{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS t FROM (SELECT {key}, {_WORDS.format('text')} AS w FROM {table}), unnest(range(1, len(w) - 10)) r(i))"

SQL: dict[str, str] = {
    "p2_found": f"""{_TRIPLES} SELECT id_a, id_b FROM x JOIN c ca ON ca.id = id_a JOIN c cb ON cb.id = id_b WHERE k * 100 >= 70 * (ca.n + cb.n - k)""",
    "p9_found": f"WITH {_RUNS('d', 'doc_id', 'documents')}, {_RUNS('e', 'item_id', 'eval_items')} SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (t)",
    "p10_found": """WITH w AS (SELECT DISTINCT doc_id, md5(text[i:i + 299]) AS h FROM documents, unnest(range(1, len(text) - 298)) r(i) WHERE len(text) >= 300)
 SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_coverage": """WITH w AS (SELECT DISTINCT doc_id, i, md5(text[i:i + 299]) AS h FROM documents, unnest(range(1, len(text) - 298)) r(i) WHERE len(text) >= 300),
 s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), k AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN s USING (h))
 SELECT doc_id, sum(least(300, i - coalesce(p, i - 300)))::BIGINT AS shared_chars FROM k GROUP BY doc_id""",
    "p2_classes": f"""{_TRIPLES}, l AS (SELECT id_a, id_b FROM x JOIN c ca ON ca.id = id_a JOIN c cb ON cb.id = id_b WHERE k * 100 >= 70 * (ca.n + cb.n - k)),
 e AS (SELECT id_a AS id, id_b AS other FROM l UNION ALL SELECT id_b, id_a FROM l), g AS (SELECT id, list_sort(list(t)) AS ts FROM s GROUP BY id)
 SELECT id, min(id) OVER (PARTITION BY ts) AS class_id, coalesce((SELECT count(*) FROM e WHERE e.id = g.id), 0)::BIGINT AS n_links FROM g""",
    "p5_found": f"{_LINES} SELECT board, line FROM found",
    "p5_blocks": f"""{_LINES},
texts AS (SELECT board, id, list(line ORDER BY pos) AS ls FROM (SELECT *, hash(descriptionPlain) AS t FROM line_rows WHERE line <> '') GROUP BY board, id, t),
parts AS (SELECT board, id, ls[i:i + n - 1] AS b FROM texts, unnest(range(1, len(ls) + 1)) a(i), unnest(range(1, len(ls) - i + 2)) c(n)),
kept AS (SELECT board, b, count(DISTINCT id) AS n FROM parts JOIN totals USING (board) GROUP BY board, b, total HAVING n >= 5 AND n >= 0.2 * total),
inside AS (SELECT board, b[:-2] AS b FROM kept WHERE len(b) > 1 UNION SELECT board, b[2:] FROM kept WHERE len(b) > 1)
SELECT board, array_to_string(b, chr(10)) AS block, n AS n_docs FROM kept k WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.board = k.board AND i.b = k.b)""",
    "p5_clean": f"""{_LINES}
SELECT DISTINCT a.board, a.id, CASE WHEN a.descriptionPlain IS NULL THEN NULL ELSE coalesce(k.clean_text, '') END AS clean_text
FROM ashby a LEFT JOIN (
    SELECT board, id, string_agg(raw, chr(10) ORDER BY pos) AS clean_text FROM line_rows l
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.board = l.board AND f.line = l.line) GROUP BY board, id
) k ON a.board = k.board AND a.id = k.id""",
}
