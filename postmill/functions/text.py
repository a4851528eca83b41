"""Scalar functions over text, all of them native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schema import clean

# The named entities that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# The elements whose beginning and end break a line.
BLOCKS = ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
# A tag of one of these elements, opening or closing, or a line break.
BREAK = rf"(?i)<\s*/?\s*(?:{'|'.join(BLOCKS)}|br)(?:[\s/][^<>]*)?>"
# A number, an optional plus, an optional range, and the word; the range keeps "0-3 years" at 0.
YEARS = r"(?i)(?:^|[^0-9])([0-9]{1,9})\s*\+?(?:\s*(?:-|–|—|to)\s*[0-9]{1,9}\s*\+?)?\s*years?"
# White space of every kind but line feeds.
_BLANKS = r"[ \t\x0B\f\r\p{Zs}\x{FEFF}]+"


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities to characters, in one pass; unknown and impossible ones stay as they are.

    The text is divided into entities and what lies between; each entity is turned into its character by a
    native expression, so nothing that a replacement makes is decoded again. Texts without ``&`` pass through.
    """
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(2), F.length(part) - 2)
        hexed = F.lower(F.substring(body, 2, 1)) == "x"
        digits = F.regexp_replace(F.when(hexed, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body))), "^0+(?=.)", "")
        code = F.when(F.length(digits) <= 8, F.conv(F.when(hexed, digits).otherwise(F.conv(digits, 10, 16)), 16, 10).cast("bigint"))
        fits = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        decoded = F.when(F.substring(body, 1, 1) == "#", char).otherwise(F.element_at(named, F.lower(body)))
        return F.when(part.startswith("&") & (F.length(part) > 2), F.coalesce(decoded, part)).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def html_to_text(text: Column) -> Column:
    """Tags off, a line end for each that breaks a line; entities decoded; blanks and empty lines run together.

    White space of every kind counts as ``clean`` counts it.
    """
    lines = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), "<[^>]+>", " ")
    lines = F.regexp_replace(decode_entities(lines), _BLANKS, " ")
    return clean(F.regexp_replace(lines, "\n(?: ?\n)+ ?", "\n\n"))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def display_name(slug: Column) -> Column:
    """A slug as a name: parts at dots, dashes, underscores and blanks, each with a capital."""
    return F.initcap(clean(F.regexp_replace(slug, r"[-_.\s]+", " ")))


def min_years(text: Column) -> Column:
    """The least number of years stated ("3+ years", "2-4 years"); null where none is."""
    found = F.regexp_extract_all(text, F.lit(YEARS), F.lit(1))
    return F.array_min(F.transform(found, lambda n: n.cast("int")))


def url_segment(url: Column, hosts: list[str], reserved: list[str] = (), parameter: str | None = None) -> Column:
    """First path segment in lower case of a URL on one of ``hosts``; on a reserved one a query parameter."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    token = first
    if reserved:
        other = F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter)) if parameter else F.lit(None).cast("string")
        token = F.when(first.isin(list(reserved)), other).otherwise(first)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lower(F.nullif(token, F.lit(""))))


def url_key(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """The natural key in a URL: for the first pattern that matches, its source and its first group."""
    tries = []
    for source, pattern in patterns:
        got = F.regexp_extract(url, pattern, 1)
        tries.append(F.when(got != "", F.struct(F.lit(source).alias("source"), F.lower(got).alias("source_external_id"))))
    return F.coalesce(*tries)


def stated_year(text: Column) -> Column:
    """The class year of "YYYY" or "YYYY-MM": from August on the next one; other texts give null."""
    t = clean(text)
    year, month = F.regexp_extract(t, r"^([0-9]{4})(?:-[0-9]{2})?\z", 1), F.regexp_extract(t, r"^[0-9]{4}-([0-9]{2})\z", 1)
    y, m = F.nullif(year, F.lit("")).cast("int"), F.nullif(month, F.lit("")).cast("int")
    return F.when(m.isNull(), y).when(m.between(1, 12), y + (m >= 8).cast("int"))


def strict_date(text: Column) -> Column:
    """The date of an exact YYYY-MM-DD; null for other shapes and impossible days."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def canonical_terms(terms: Column, aliases: dict[str, str]) -> Column:
    """Terms trimmed, lowered, put for their aliases, each once, sorted; null and blank ones left out."""
    table = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    folded = F.filter(F.transform(terms, lambda t: F.lower(clean(t))), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(F.transform(folded, lambda t: F.coalesce(F.element_at(table, t), t))))


def fingerprint(version: int, *parts: Column) -> Column:
    """SHA-256 over the JSON array of a version and parts: null told from empty, no part runs into another."""
    return F.sha2(F.concat(F.lit(f"[{version},"), F.substring(F.to_json(F.array(*[p.cast("string") for p in parts])), 2, 2**31 - 1)), 256)


def text_fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def plausible_years(date: Column, now: Column) -> tuple[Column, Column]:
    """A stated date and its class year, both null unless the year lies from one before to six after that of ``now``."""
    year = stated_year(date)
    good = year.between(F.year(now) - 1, F.year(now) + 6)
    return F.when(good, clean(date)), F.when(good, year)


def grounded(claim: Column, text: Column) -> Column:
    """Whether a claim stands in a text, apart from case and runs of white space."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.coalesce((flat(claim) != "") & flat(text).contains(flat(claim)), F.lit(False))


def label_of_line(line: Column, known: list[str]) -> Column:
    """The last field that isn't empty of a comma-separated line, if it is a known label."""
    fields = F.filter(F.transform(F.split(line, ","), lambda f: F.trim(f)), lambda f: f != "")
    last = F.try_element_at(fields, F.lit(-1))
    return F.when(last.isin(known), last)


def quoted(value: Column) -> Column:
    """A value as a quoted field of a comma-separated file."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


