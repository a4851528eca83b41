"""Schemas of feeds and state tables, and the keys of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of every kind, byte order mark included; Spark's trim takes blanks only.
_EDGE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z"

KEY = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_external_id", T.StringType())])

# What every feed is normalised to.
LISTING = (
    "source string, source_external_id string, company string, title string, description_html string, description_plain string, location string, department string, "
    "employment_type string, workplace_type string, published_at timestamp, application_deadline timestamp, comp_min decimal(12,2), comp_max decimal(12,2), "
    "comp_currency string, comp_interval string, url string, duplicate_keys array<struct<source:string,source_external_id:string>>, preclassified struct<kind:string,field:string,citizenship:string>"
)

FEED_A = "id bigint, title string, content string, absolute_url string, company_name string, location struct<name:string>, departments array<struct<name:string>>, first_published string"
FEED_B = "id string, text string, categories struct<commitment:string,location:string,department:string,team:string>, description string, descriptionPlain string, hostedUrl string, workplaceType string, salaryRange struct<min:double,max:double,currency:string,interval:string>, createdAt bigint"
FEED_C = "id string, title string, department string, employmentType string, location string, publishedAt string, isListed boolean, isRemote boolean, workplaceType string, jobUrl string, descriptionHtml string, descriptionPlain string, compensation struct<summaryComponents:array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>>"
FEED_D = "id string, company_name string, title string, url string, locations array<string>, category string, terms array<string>, degrees array<string>, sponsorship string, date_posted bigint, active boolean, is_visible boolean"

# The words of feeds B and C for kinds of employment, of workplace and of pay interval, and of the
# curated feed for fields of work and for sponsorship.
EMPLOYMENT_B = {
    "full-time": "full_time", "part-time": "part_time", "internship": "intern", "intern": "intern", "contract": "contract",
    "temporary": "temporary", "fixed-term": "temporary",
}
EMPLOYMENT_C = {"fulltime": "full_time", "parttime": "part_time", "intern": "intern", "contract": "contract", "temporary": "temporary"}
WORKPLACE_B = {"on-site": "onsite", "onsite": "onsite", "remote": "remote", "hybrid": "hybrid"}
WORKPLACE_C = {"onsite": "onsite", "remote": "remote", "hybrid": "hybrid"}
INTERVAL_B = {
    "hour": "hourly", "hourly": "hourly", "month": "monthly", "monthly": "monthly", "year": "yearly", "yearly": "yearly",
    "annual": "yearly", "one-time": "one_time", "one_time": "one_time",
}
INTERVAL_C = {"1 year": "yearly", "1 month": "monthly", "1 hour": "hourly", "one_time": "one_time", "one time": "one_time"}
CATEGORY_FIELD = {
    "Software": "swe", "Software Engineering": "swe", "AI/ML/Data": "ml_ai", "Data Science, AI & Machine Learning": "ml_ai",
    "Quant": "quant", "Hardware": "hardware_embedded", "Hardware Engineering": "hardware_embedded", "Product": "product", "Product Management": "product",
}
SPONSORSHIP = {"U.S. Citizenship is Required": "us_citizen_required", "Does Not Offer Sponsorship": "no_sponsorship", "Offers Sponsorship": "sponsorship_available"}


def clean(c: Column | str) -> Column:
    """Text without outer white space of any kind; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _EDGE, "")


def mapped(c: Column, table: dict[str, str], fold: bool = True) -> Column:
    """The value of ``c`` in a fixed table, null where it has none; keys are trimmed and lowered on demand."""
    key = F.lower(clean(c)) if fold else c
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def one_of(c: Column, allowed: list[str]) -> Column:
    """``c`` if it is an allowed value, else null."""
    return F.when(c.isin(allowed), c)


def amount(c: Column) -> Column:
    """A number as decimal(12,2); null unless it is finite, not negative and below 10^10."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < 1e10), v.cast("decimal(12,2)"))


def dedup_key(company: str, title: str, location: str) -> list[Column]:
    """Trimmed company and title, and the trimmed location with null as empty: equal for one posting."""
    return [clean(company), clean(title), F.coalesce(clean(location), F.lit(""))]


def role_key(company: str, title: str) -> list[Column]:
    return [clean(company), clean(title)]


def valid_keys(json: Column) -> Column:
    """The keys in a JSON array whose elements have two string fields; others are left out."""
    raw = F.from_json(json, "array<struct<source:string,source_external_id:string>>")
    return F.coalesce(F.filter(raw, lambda k: k["source"].isNotNull() & k["source_external_id"].isNotNull()), F.array().cast(T.ArrayType(KEY)))


def vector_text(vector: Column) -> Column:
    """``[a,b,...]`` of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    """The vector of a text; malformed and empty ones give null."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v)


def valid_signature(json: Column) -> Column:
    """The signature in a JSON object, null unless of its shape: 1 to 20 skills, a level, a focus of 1 to 300 UTF-16 units."""
    raw = F.try_parse_json(json)
    part = lambda name: F.try_variant_get(raw, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(part(name)), F.lit(""))
    s = F.from_json(json, "skills array<string>, domains array<string>, level string, focus string")
    texts = lambda name: kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(s[name], lambda x: x.isNull())
    good = texts("skills") & F.size(s["skills"]).between(1, 20) & texts("domains") & (kind("level") == "STRING") & (s["level"] != "")
    good = good & (kind("focus") == "STRING") & (clean(s["focus"]) != "") & (F.octet_length(F.encode(s["focus"], "UTF-16BE")) <= 600)
    return F.when(good, s)
