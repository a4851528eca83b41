"""Locations to countries and regions by a dictionary table."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.schema import clean
from postmill.session import cut, small

# Dictionary entries up to this number are broadcast; a larger dictionary is joined by shuffle.
BROADCAST_TERMS = 200_000
# Words that a name in prose may have.
PROSE_WORDS = 4
_VALUES = r"[;|]|(?i:\s+or\s+)"
_TOKENS = r"[,/()–—-]"
_NO_WORD = r"[^\p{L}\p{N}]+"
# Latin letters with marks and what they are without, by their decomposition; fixed values: three that have none.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c).lower())) > 1 and d[0].isascii() and d[0].isalpha() and chr(c) == chr(c).lower()}
_MARKED |= {"ø": "o", "ł": "l", "đ": "d"}


def folded(c: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.regexp_replace(F.translate(F.lower(c), "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(folded(c), _NO_WORD), lambda w: w != "")


def dictionary(places: DataFrame, aliases: list[tuple[str, str]] = (), home: str | None = None) -> DataFrame:
    """Terms of a list of places: ``term, exact, priority, country, region``.

    Codes match as they are written, in capitals, before anything else: aliases of countries, then regions of
    other countries than ``home``, then its own. Names match folded, in the order region (others' first), country, city.
    Regions are told for ``home`` only, where one is given. Names of cities that stand for several regions are left out.
    """
    country, none = F.col("country"), F.lit(None).cast("string")
    away = (country != home).cast("int") if home else F.lit(1)
    region = F.when(country == home, F.col("region")) if home else F.col("region")
    row = lambda df, term, exact, priority, where=region: df.select(term.alias("term"), F.lit(exact).alias("exact"), priority.cast("int").alias("priority"), "country", where.alias("region"))
    lands = places.where("country is not null")
    code = row(lands.where("region_code is not null"), F.col("region_code"), True, 2 - away)
    names = row(lands.where("region is not null"), folded(F.col("region")), False, 4 - away)
    whole = row(lands, folded(country), False, F.lit(5), none)
    city = (
        places.groupBy(folded(F.col("city")).alias("term"))
        .agg(F.min(F.struct(country, F.col("region"))).alias("a"), F.max(F.struct(country, F.col("region"))).alias("b"))
        .where(F.col("a").eqNullSafe(F.col("b")) & F.col("a.country").isNotNull())
        .select("term", "a.country", "a.region")
    )
    out = code.unionByName(names).unionByName(whole).unionByName(row(city, F.col("term"), False, 6 + away))
    if aliases:
        more = places.sparkSession.createDataFrame(aliases, "term string, country string")
        out = out.unionByName(row(more, F.col("term"), True, F.lit(0), none))
    return out.distinct()


def location_facets(df: DataFrame, key: list[str], location: str, terms: DataFrame, phrases: list[tuple[str, str, str | None]] = ()) -> DataFrame:
    """``key, countries, regions``: sorted distinct arrays of what each location names, empty where nothing.

    A location is divided into values, a value into tokens. A token of two capitals is a code or nothing; any other takes
    the name of the least priority. ``phrases`` ``(pattern, country, region)`` are found in a folded value first and cut
    out of it, before their words can be taken for something else. Only a value in which nothing matched is gone through as
    prose, for names of up to four words. Distinct strings are resolved once and joined back; null and blank
    locations have empty arrays.
    """
    d = small(cut(terms), BROADCAST_TERMS)
    texts = df.select(F.col(location).alias("__v")).where("__v is not null").distinct()
    values = texts.select("__v", F.posexplode(F.split("__v", _VALUES)).alias("__n", "s")).withColumn("s", clean("s")).where("s <> ''")
    found = []
    for pattern, country, region in phrases:
        hit = folded(F.col("s")).rlike(pattern)
        found.append(values.where(hit).select("__v", "__n", F.lit(country).alias("country"), F.lit(region).cast("string").alias("region")))
        values = values.withColumn("s", F.when(hit, F.regexp_replace("s", f"(?iu){pattern}", "")).otherwise(F.col("s")))
    values = cut(values)
    tokens = values.select("__v", "__n", F.explode(F.transform(F.split("s", _TOKENS), lambda t: clean(t))).alias("t")).where("t <> ''").distinct()
    coded = F.col("t").rlike(r"^[A-Z]{2}\z")
    tokens = tokens.withColumn("k", F.when(coded, F.col("t")).otherwise(folded(F.col("t")))).withColumn("coded", coded)
    named = tokens.join(d, F.col("k") == F.col("term")).where(F.col("exact") == F.col("coded"))
    loose = tokens.where("not coded").join(d.where("exact"), F.col("t") == F.col("term"))  # aliases that aren't of two letters
    best = named.unionByName(loose).groupBy("__v", "__n", "t").agg(F.min(F.struct("priority", "country", "region")).alias("b")).select("__v", "__n", "b.country", "b.region")
    for f in found:
        best = best.unionByName(f)
    best = cut(best)
    rest = values.join(best.select("__v", "__n").distinct(), ["__v", "__n"], "left_anti").withColumn("w", _words(F.col("s")))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PROSE_WORDS)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " ")))))
    prose = rest.where(F.size("w") > 0).select("__v", "__n", F.explode(grams).alias("g")).where("g is not null")
    prose = prose.join(d.where("not exact").withColumn("term", F.array_join(_words(F.col("term")), " ")), F.col("g") == F.col("term")).select("__v", "__n", "country", "region")
    arrays = best.unionByName(prose).groupBy("__v").agg(F.array_sort(F.collect_set("country")).alias("countries"), F.array_sort(F.collect_set("region")).alias("regions"))
    empty = F.array().cast("array<string>")
    joined = df.select(*key, F.col(location).alias("__v")).join(arrays, "__v", "left")
    return joined.select(*key, F.coalesce("countries", empty).alias("countries"), F.coalesce("regions", empty).alias("regions"))


def user_countries(countries: Column, states: Column) -> Column:
    """The countries a user chose, each once, and US if any state was chosen."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(countries, none), F.when(F.size(F.coalesce(states, none)) > 0, F.array(F.lit("US"))).otherwise(none))
