"""The engine's own operators over whole tables: feeds, cards, facets, filters, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.operators import predicates as P
from postmill.operators.cards import assemble, card_order, group_counts, new_divider, page_of, ranked_groups, role_groups, urgency
from postmill.operators.facets import facet_counts
from postmill.operators.location import dictionary, location_facets
from postmill.operators.predicates import SearchParams
from postmill.operators.rank import baseline_text, freshness
from postmill.operators.rules import Cascade, counters, first_rule, route
from postmill.operators.timestamps import number_instant
from postmill.schema import CATEGORY_FIELD, EMPLOYMENT_C, INTERVAL_C, SPONSORSHIP, WORKPLACE_C, amount, mapped
from postmill.session import table
from postmill.sources.feeds import normalise_c, normalise_d, salary_component

NOW = "2026-11-01 00:00:00"
NEW_SINCE = "2026-10-29 00:00:00"
FIELD_RULES = [("ml_ai", "machine learning|research scientist"), ("data", "data"), ("hardware", "hardware|firmware|embedded"), ("security", "security"), ("software", "software|frontend|backend|mobile|reliability"), ("product", "product")]
CASCADE = Cascade(accept_all=("engineer|scientist|analyst", "intern|co-op"), veto="intern|co-op|new grad|apprentice", reject_any=("designer|manager", "ii|iii"), max_years=0)
_ENDS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_clean = lambda c: f"regexp_replace({c}, '{_ENDS}', '', 'g')"
_told = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {_clean('x')}), lambda x: x <> '')"
_fold = lambda c: f"translate(strip_accents(lower({c})), '\u0142\u00f8\u0111', 'lod')"
_NUMBER = "CASE WHEN {0} BETWEEN 1704067200 AND 1830297599 THEN {0} * 1000000 WHEN {0} BETWEEN 1704067200000 AND 1830297599999 THEN {0} * 1000 WHEN {0} BETWEEN 1704067200000000 AND 1830297599999999 THEN {0} WHEN {0} BETWEEN 1704067200000000000 AND 1830297599999999999 THEN {0} // 1000 END"


def _case(column: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"


# The hosts of the tables whose URLs bear the keys of crawled feeds.
HOSTS = [("apply", r"apply\.listings\.example/j/([0-9]+-[0-9a-fA-F-]+)"), ("old", r"old\.listings\.example/([0-9]+/[0-9]+)")]


def feed_c(spark: SparkSession, d: str) -> DataFrame:
    """Every column that the feed fills, but for the instant of publication, which p4_found gives."""
    out = normalise_c(table(spark, d, "ashby"), "board", table(spark, d, "boards"))
    return out.select(
        "source", "source_external_id", "company", "title", "description_html", "description_plain", "location", "department", "employment_type", "workplace_type",
        F.col("comp_min").cast("double").alias("comp_min"), F.col("comp_max").cast("double").alias("comp_max"), "comp_currency", "comp_interval", "url",
    ).distinct()


def feed_d(spark: SparkSession, d: str) -> DataFrame:
    out = normalise_d(table(spark, d, "simplify"), HOSTS)
    return out.select(
        "source", "source_external_id", "company", "title", "description_html", "description_plain", "location", F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("published_us"), "url",
        F.array_join(F.transform("duplicate_keys", lambda k: F.concat(k["source"], F.lit(":"), k["source_external_id"])), ",").alias("aliases"),
        F.col("preclassified.kind").alias("kind"), F.col("preclassified.field").alias("field"), F.col("preclassified.citizenship").alias("citizenship"),
    ).distinct()


def pay(spark: SparkSession, d: str) -> DataFrame:
    """The salary component of each posting, amounts clamped."""
    rows = table(spark, d, "ashby").select("id", salary_component(F.col("compensation.summaryComponents")).alias("c"))
    return rows.select("id", amount(F.col("c.minValue")).cast("double").alias("low"), amount(F.col("c.maxValue")).cast("double").alias("high"), mapped(F.col("c.interval"), INTERVAL_C).alias("per")).distinct()


def search_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many roles an active search finds, and how many of them are new."""
    where = P.build_where(SearchParams(active="isListed", values={"employmentType": ("Intern", "none")}))
    groups = role_groups(table(spark, d, "ashby").where(where), "board", "title", "crawled_at")
    return group_counts(groups, F.lit(NEW_SINCE).cast("timestamp"))


def ranked_cards(spark: SparkSession, d: str) -> DataFrame:
    """Roles by their best score; the score is made of the length of the title and the freshness."""
    score = F.round(F.length("title") + freshness(F.col("crawled_at"), _now()), 6)
    rows = table(spark, d, "ashby").where("isListed").select("board", "title", "id", "crawled_at", score.alias("score")).distinct()
    groups = ranked_groups(rows, "board", "title", "score", "crawled_at", "id", F.lit(NEW_SINCE).cast("timestamp"), [])
    groups = page_of(groups, card_order("score"), 2, 50)
    return groups.select("company", "title", "best_score", "n_variants", "any_new", F.array_join("variants.key", ",").alias("keys"), F.col("place").cast("bigint").alias("place"))


def card_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The roles with the spellings, as stored, of their companies and titles."""
    groups = role_groups(table(spark, d, "simplify").withColumn("at", F.lit(NOW).cast("timestamp")), "company_name", "title", "at")
    return groups.select("company", "title", F.size("spellings").cast("bigint").alias("n_spellings"))


def sponsorship_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "simplify").select("id", mapped(F.col("sponsorship"), SPONSORSHIP, fold=False).alias("citizenship")).distinct()


def baseline_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby").select("id", F.md5(baseline_text(F.col("title"), F.coalesce("descriptionPlain", F.lit("")))).alias("text")).distinct()


def plausible_years(spark: SparkSession, d: str) -> DataFrame:
    """Class years of the dates that stand at the beginning of a value, where they are plausible."""
    date, year = X.plausible_years(F.regexp_extract("date_updated", r"^([0-9]{4}-[0-9]{2})", 1), _now())
    return table(spark, d, "simplify").select("id", date.alias("stated"), year.cast("bigint").alias("class_year")).where("class_year is not null").distinct()


def display_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "boards").select("board", X.display_name(F.col("board")).alias("name"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby").select("id", X.html_to_text(F.col("descriptionHtml")).alias("plain")).distinct()


def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby").select("id", X.escape_html(F.col("title")).alias("escaped")).distinct()


def url_keys(spark: SparkSession, d: str) -> DataFrame:
    key = X.url_key(F.col("url"), HOSTS)
    rows = table(spark, d, "simplify").select("url").unionByName(table(spark, d, "labels").select("url")).where("url is not null").distinct()
    return rows.select("url", key["source"].alias("source"), key["source_external_id"].alias("source_external_id"))


def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = X.url_segment(F.col("jobUrl"), ["jobs.boards.example"])
    return table(spark, d, "ashby").groupBy(token.alias("token")).agg(F.countDistinct("id").alias("n"))


def min_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.min_years(F.col("text")).cast("bigint").alias("years")).where("years is not null")


def field_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby").select("id", first_rule(F.col("title"), FIELD_RULES).alias("field")).distinct()


def route_cascade(spark: SparkSession, d: str) -> DataFrame:
    return route(table(spark, d, "ashby").select("id", "title", "descriptionPlain").distinct(), CASCADE, "title", "descriptionPlain").select("id", "route")


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return counters(route(table(spark, d, "ashby"), CASCADE, "title", "descriptionPlain"), "route")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return role_groups(table(spark, d, "ashby"), "board", "title", "crawled_at", deadline="crawled_at")


def card_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    return g.select("company", "title", F.unix_micros("max_seen").alias("seen_us"), F.unix_micros("min_deadline").alias("deadline_us"), "n_variants")


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _page(sort: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return page_of(_groups(spark, d), card_order(sort, _now()), 2, 50).select("company", "title", F.col("place").cast("bigint").alias("place"))

    return query


def cards_published(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simplify").withColumn("at", F.timestamp_micros(number_instant(F.col("date_posted"))))
    groups = role_groups(rows, "company_name", "title", "at", published="at")
    return page_of(groups, card_order("published"), 2, 50).select("company", "title", F.col("place").cast("bigint").alias("place"))


def card_variants(spark: SparkSession, d: str) -> DataFrame:
    ashby = table(spark, d, "ashby")
    page = page_of(_groups(spark, d), card_order("seen"), 1, 50)
    cards = assemble(ashby, page, "board", "title", "crawled_at", "id", F.lit(NEW_SINCE).cast("timestamp"), ["location"])
    return cards.select("company", "title", "n_variants", "any_new", F.array_join("variants.key", ",").alias("keys"))


def card_divider(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(NEW_SINCE).cast("timestamp")
    page = page_of(_groups(spark, d), card_order("seen"), 1, 200).withColumn("is_new", F.col("max_seen") >= since)
    return new_divider(page, [F.col("place")], "is_new").select("company", "title", "is_new", "divider")


def deadline_urgency(spark: SparkSession, d: str) -> DataFrame:
    state = urgency(F.col("crawled_at"), _now())
    return table(spark, d, "ashby").select("id", state.alias("urgency")).distinct()


def facet_scalar(spark: SparkSession, d: str) -> DataFrame:
    facets = {"employmentType": "none", "workplaceType": "none", "department": "scalar"}
    return facet_counts(table(spark, d, "ashby"), SearchParams(), facets, "board", "title")


def facet_self_omission(spark: SparkSession, d: str) -> DataFrame:
    params = SearchParams(values={"employmentType": ("Intern", "FullTime"), "workplaceType": ("Remote", "none")})
    return facet_counts(table(spark, d, "ashby"), params, {"employmentType": "none", "workplaceType": "none"}, "board", "title")


def facet_array(spark: SparkSession, d: str) -> DataFrame:
    return facet_counts(table(spark, d, "simplify"), SearchParams(values={"category": ("Software", "Hardware")}), {"terms": "array", "degrees": "array"}, "company_name", "title")


def facet_status(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("url is not null").groupBy("url").agg(F.min("label").alias("status"))
    rows = table(spark, d, "simplify").select("company_name", "title", "url").join(labels, "url", "left")
    return facet_counts(rows, SearchParams(), {"status": "none"}, "company_name", "title")


def filter_text(spark: SparkSession, d: str) -> DataFrame:
    where = P.build_where(SearchParams(text="Data SCIENTIST", text_columns=("title", "board")))
    return table(spark, d, "ashby").where(where).select("id", "title").distinct()


def filter_values(spark: SparkSession, d: str) -> DataFrame:
    where = P.build_where(SearchParams(values={"category": ("Product", "none"), "sponsorship": ("Other",)}))
    return table(spark, d, "simplify").where(where).select("id").distinct()


def filter_overlap(spark: SparkSession, d: str) -> DataFrame:
    where = P.build_where(SearchParams(overlaps={"terms": ("Summer 2026",), "degrees": ("PhD",)}))
    return table(spark, d, "simplify").where(where).select("id").distinct()


def filter_new(spark: SparkSession, d: str) -> DataFrame:
    where = P.build_where(SearchParams(since=("crawled_at", NEW_SINCE)))
    return table(spark, d, "ashby").where(where).select("id").distinct()


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of every pay component of each posting; one open window where there is none."""
    rows = table(spark, d, "ashby").select("id", F.explode_outer("compensation.summaryComponents").alias("c"))
    return rows.select("id", F.col("c.minValue").alias("low"), F.col("c.maxValue").alias("high"))


def filter_window(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).where(P.window_holds("low", "high", 60.0)).select("id").distinct()


def filter_windows_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).where(P.windows_overlap("low", "high", 40.0, 70.0)).select("id").distinct()


def filter_keep_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simplify")
    keep = P.keeps_null_in("category", ["Software", "Quant"]) & P.keeps_null_not_in("sponsorship", ["Other"])
    return rows.where(keep).select("id").distinct()


def filter_curated(spark: SparkSession, d: str) -> DataFrame:
    return P.curated(table(spark, d, "simplify"), table(spark, d, "boards"), "company_name", "company").select("id").distinct()


def location_conditions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simplify").select("id", "terms", "degrees", "active")
    return rows.where(P.location_allowed([("terms", ("Fall 2026",)), ("degrees", ())], F.col("active"), False)).select("id").distinct()


def enum_maps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ashby").select("id", mapped(F.col("employmentType"), EMPLOYMENT_C).alias("employment"), mapped(F.col("workplaceType"), WORKPLACE_C).alias("workplace")).distinct()


def strict_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "simplify").select("id", X.strict_date(F.col("date_updated")).cast("string").alias("day")).where("day is not null")
    return rows.distinct()


def class_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "simplify").select("id", X.stated_year(F.regexp_extract("date_updated", "[0-9]{4}-[0-9]{2}", 0)).cast("bigint").alias("class_year")).where("class_year is not null").distinct()


def canonical_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = X.canonical_terms(F.col("degrees"), {"phd": "doctorate", "bachelor's": "bachelor", "master's": "master"})
    return table(spark, d, "simplify").select("id", F.array_join(terms, "|").alias("degrees")).distinct()


def grounded_titles(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract("title", r"([A-Z][a-z]{5,})$", 1)
    return table(spark, d, "ashby").select("id", X.grounded(words, F.col("descriptionPlain")).alias("grounded")).distinct()


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("id").cast("string"), F.regexp_replace("title", ",", " "), F.coalesce("label", F.lit("")))
    return table(spark, d, "labels").select("id", X.label_of_line(line, ["relevant", "borderline", "irrelevant"]).alias("label")).distinct()


def quoted_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("id", F.concat_ws(",", X.quoted(F.col("company")), X.quoted(F.col("title"))).alias("line")).distinct()


def location_parts(spark: SparkSession, d: str) -> DataFrame:
    terms = dictionary(table(spark, d, "places"), [("USA", "United States"), ("US", "United States")], home="United States")
    out = location_facets(table(spark, d, "ashby").select("id", "location").distinct(), ["id"], "location", terms)
    return out.select("id", F.array_join("countries", "|").alias("countries"), F.array_join("regions", "|").alias("regions")).distinct()


QUERIES = {
    "feed_c": feed_c, "feed_d": feed_d, "display_names": display_names, "html_text": html_text, "html_escaped": html_escaped, "url_keys": url_keys,
    "url_tokens": url_tokens, "min_years": min_years, "field_rules": field_rules, "route_cascade": route_cascade, "run_counters": run_counters,
    "card_groups": card_groups, "cards_seen": _page("seen"), "cards_company": _page("company"), "cards_deadline": _page("deadline"),
    "cards_published": cards_published, "card_variants": card_variants, "card_divider": card_divider, "deadline_urgency": deadline_urgency,
    "facet_scalar": facet_scalar, "facet_self_omission": facet_self_omission, "facet_array": facet_array, "facet_status": facet_status,
    "filter_text": filter_text, "filter_values": filter_values, "filter_overlap": filter_overlap, "filter_new": filter_new, "filter_window": filter_window,
    "filter_windows_overlap": filter_windows_overlap, "filter_keep_null": filter_keep_null, "filter_curated": filter_curated,
    "location_conditions": location_conditions, "enum_maps": enum_maps, "strict_dates": strict_dates, "class_years": class_years,
    "canonical_terms": canonical_terms, "grounded_titles": grounded_titles, "label_lines": label_lines, "quoted_lines": quoted_lines, "location_parts": location_parts,
    "pay": pay, "search_counts": search_counts, "ranked_cards": ranked_cards, "card_spellings": card_spellings, "sponsorship_map": sponsorship_map, "baseline_texts": baseline_texts, "plausible_years": plausible_years,
}

_WORD = lambda c, p: f"coalesce(regexp_matches({c}, '(?i)(?:^|[^A-Za-z0-9_])(?:{p})(?:[^A-Za-z0-9_]|$)'), false)"
_EMPLOYMENT, _WORKPLACE = _case(f"lower({_clean('employmentType')})", EMPLOYMENT_C), _case(f"lower({_clean('workplaceType')})", WORKPLACE_C)
_YEARS = lambda c: f"list_min(list_transform(regexp_extract_all({c}, '{X.YEARS}', 1), lambda n: n::INT))"
_ROUTE = f"""CASE WHEN {_WORD("title", CASCADE.accept_all[0])} AND {_WORD("title", CASCADE.accept_all[1])} THEN 'accept'
 WHEN ({_WORD("title", CASCADE.reject_any[0])} OR {_WORD("title", CASCADE.reject_any[1])}) AND NOT {_WORD("title", CASCADE.veto)} THEN 'title_drop'
 WHEN coalesce({_YEARS("descriptionPlain")}, 0) > 0 THEN 'years_drop' ELSE 'model' END"""
_GROUPS = f"""SELECT {_clean("board")} AS company, {_clean("title")} AS title, max(crawled_at) AS max_seen, min(crawled_at) AS min_deadline,
 count(*)::BIGINT AS n_variants FROM ashby WHERE board IS NOT NULL AND title IS NOT NULL GROUP BY ALL"""
_NOW_SQL, _SINCE = f"TIMESTAMPTZ '{NOW}+00'", f"TIMESTAMPTZ '{NEW_SINCE}+00'"
_PAGE = lambda order: f"SELECT company, title, (row_number() OVER (ORDER BY {order}) - 1)::BIGINT AS place FROM ({_GROUPS}) ORDER BY place LIMIT 50 OFFSET 50"
_ROLE = lambda c: f"({_clean(c)}, {_clean('title')})"
_COMP = "(SELECT id, c.minValue AS low, c.maxValue AS high FROM (SELECT id, unnest(compensation.summaryComponents) AS c FROM ashby) UNION ALL SELECT id, NULL, NULL FROM ashby WHERE coalesce(len(compensation.summaryComponents), 0) = 0)"
_BREAK = X.BREAK.replace("(?i)", "")
# A value's instant by its shape, for the values that have a zone or a date alone; the rest is held against the truth of problem 4.
_PAY = "list_filter(compensation.summaryComponents, lambda c: c.compensationType = 'Salary')[1]"
_AMOUNT = lambda c: f"CASE WHEN isfinite({c}) AND {c} >= 0 AND {c} < 10000000000 THEN round({c}, 2) END"


SQL = {
    "feed_c": f"""SELECT DISTINCT 'c' AS source, id AS source_external_id, {_clean("board")} AS company, {_clean("title")} AS title, descriptionHtml AS description_html, descriptionPlain AS description_plain,
 location, department, {_EMPLOYMENT} AS employment_type, coalesce({_WORKPLACE}, CASE WHEN isRemote THEN 'remote' END) AS workplace_type,
 {_AMOUNT("c.minValue")} AS comp_min, {_AMOUNT("c.maxValue")} AS comp_max, c.currencyCode AS comp_currency, {_case(f"lower({_clean('c.interval')})", INTERVAL_C)} AS comp_interval, jobUrl AS url
 FROM (SELECT *, {_PAY} AS c FROM ashby WHERE isListed)""",
    "feed_d": rf"""WITH t AS (SELECT *, {_told("locations")} AS ls, {_told("terms")} AS ts, {_told("degrees")} AS ds, nullif({_clean("category")}, '') AS cat, {_clean("url")} AS u,
 regexp_extract(url, '{HOSTS[0][1]}', 1) AS a, regexp_extract(url, '{HOSTS[1][1]}', 1) AS o FROM simplify WHERE active AND is_visible),
 p AS (SELECT *, nullif(array_to_string(ls, '; '), '') AS loc FROM t),
 q AS (SELECT *, concat_ws('. ', 'Category: ' || cat, 'Term: ' || nullif(array_to_string(ts, ', '), ''), 'Locations: ' || loc, 'Degrees: ' || nullif(array_to_string(ds, ', '), ''), 'Curated entry without a posting''s text') AS plain FROM p)
 SELECT DISTINCT 'd' AS source, {_clean("id")} AS source_external_id, {_clean("company_name")} AS company, {_clean("title")} AS title,
 '<p>' || replace(replace(replace(replace(plain, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>' AS description_html, plain AS description_plain, loc AS location,
 coalesce({_NUMBER.format("date_posted")}, 0) AS published_us, u AS url, CASE WHEN a <> '' THEN 'apply:' || lower(a) WHEN o <> '' THEN 'old:' || lower(o) ELSE '' END AS aliases,
 'internship' AS kind, {_case("cat", CATEGORY_FIELD)} AS field, {_case("sponsorship", SPONSORSHIP)} AS citizenship FROM q
 WHERE u <> '' AND {_clean("id")} <> '' AND {_clean("company_name")} <> '' AND {_clean("title")} <> ''""",
    "pay": f"""SELECT DISTINCT id, {_AMOUNT("c.minValue")} AS low, {_AMOUNT("c.maxValue")} AS high, {_case(f"lower({_clean('c.interval')})", INTERVAL_C)} AS per FROM (SELECT id, {_PAY} AS c FROM ashby)""",
    "search_counts": f"""SELECT count(*) AS total, count(*) FILTER (m >= {_SINCE}) AS new_count FROM (SELECT max(crawled_at) AS m FROM ashby
 WHERE isListed AND (employmentType = 'Intern' OR employmentType IS NULL) AND board IS NOT NULL AND title IS NOT NULL GROUP BY {_clean("board")}, {_clean("title")})""",
    "ranked_cards": f"""WITH r AS (SELECT DISTINCT board, title, id, crawled_at, round(len(title) + exp(-ln(2.0) * greatest(0, (epoch_us({_NOW_SQL}) - epoch_us(crawled_at)) / 86400000000.0) / 30), 6) AS s FROM ashby WHERE isListed),
 g AS (SELECT {_clean("board")} AS company, {_clean("title")} AS title, max(s) AS best_score, count(*) AS n_variants, bool_or(crawled_at >= {_SINCE}) AS any_new, string_agg(id, ',' ORDER BY crawled_at DESC, id DESC) AS keys FROM r GROUP BY 1, 2)
 SELECT *, (row_number() OVER (ORDER BY best_score DESC, company, title) - 1)::BIGINT AS place FROM g ORDER BY place LIMIT 50 OFFSET 50""",
    "card_spellings": f"SELECT {_clean('company_name')} AS company, {_clean('title')} AS title, count(DISTINCT (company_name, title)) AS n_spellings FROM simplify WHERE company_name IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2",
    "sponsorship_map": f"SELECT DISTINCT id, {_case('sponsorship', SPONSORSHIP)} AS citizenship FROM simplify",
    "baseline_texts": "SELECT DISTINCT id, md5(title || chr(10) || coalesce(descriptionPlain, '')[1:6000]) AS text FROM ashby",
    "plausible_years": """SELECT DISTINCT id, t AS stated, y AS class_year FROM (SELECT id, t, (t[1:4]::INT + (t[6:7]::INT >= 8)::INT)::BIGINT AS y FROM
 (SELECT id, regexp_extract(date_updated, '^([0-9]{4}-[0-9]{2})', 1) AS t FROM simplify) WHERE t <> '' AND t[6:7]::INT BETWEEN 1 AND 12) WHERE y BETWEEN 2025 AND 2032""",
    "display_names": r"SELECT board, array_to_string(list_transform(string_split(trim(regexp_replace(board, '[-_.\s]+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM boards",
    "html_text": rf"""SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(
 replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(descriptionHtml, '(?i){_BREAK}', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&'),
 '{X._BLANKS}', ' ', 'g'), '\n(?: ?\n)+ ?', chr(10) || chr(10), 'g'), '{_ENDS}', '', 'g') AS plain FROM ashby""",
    "html_escaped": "SELECT DISTINCT id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM ashby",
    "url_keys": r"""SELECT url, CASE WHEN a <> '' THEN 'apply' WHEN o <> '' THEN 'old' END AS source, lower(coalesce(nullif(a, ''), nullif(o, ''))) AS source_external_id
 FROM (SELECT url, regexp_extract(url, 'apply\.listings\.example/j/([0-9]+-[0-9a-fA-F-]+)', 1) AS a, regexp_extract(url, 'old\.listings\.example/([0-9]+/[0-9]+)', 1) AS o
 FROM (SELECT url FROM simplify UNION SELECT url FROM labels) WHERE url IS NOT NULL)""",
    "url_tokens": "SELECT nullif(lower(regexp_extract(jobUrl, '^https://jobs\\.boards\\.example/+([^/?#]+)', 1)), '') AS token, count(DISTINCT id) AS n FROM ashby GROUP BY 1",
    "min_years": f"SELECT doc_id, y::BIGINT AS years FROM (SELECT doc_id, {_YEARS('text')} AS y FROM documents) WHERE y IS NOT NULL",
    "field_rules": "SELECT DISTINCT id, CASE " + " ".join(f"WHEN {_WORD('title', p)} THEN '{n}'" for n, p in FIELD_RULES) + " END AS field FROM ashby",
    "route_cascade": f"SELECT DISTINCT id, {_ROUTE} AS route FROM (SELECT DISTINCT id, title, descriptionPlain FROM ashby)",
    "run_counters": f"SELECT {_ROUTE} AS bucket, count(*) AS n FROM ashby GROUP BY 1",
    "card_groups": f"SELECT company, title, epoch_us(max_seen) AS seen_us, epoch_us(min_deadline) AS deadline_us, n_variants FROM ({_GROUPS})",
    "cards_seen": _PAGE("max_seen DESC, company, title"),
    "cards_company": _PAGE("company, title"),
    "cards_deadline": _PAGE(f"CASE WHEN min_deadline >= {_NOW_SQL} THEN 0 ELSE 2 END, min_deadline, company, title"),
    "cards_published": f"""SELECT company, title, (row_number() OVER (ORDER BY p DESC NULLS LAST, company, title) - 1)::BIGINT AS place FROM (
 SELECT {_clean("company_name")} AS company, {_clean("title")} AS title, max({_NUMBER.format("date_posted")}) AS p FROM simplify
 WHERE company_name IS NOT NULL AND title IS NOT NULL GROUP BY ALL) ORDER BY place LIMIT 50 OFFSET 50""",
    "card_variants": f"""WITH page AS (SELECT * FROM ({_GROUPS}) ORDER BY max_seen DESC, company, title LIMIT 50)
 SELECT p.company, p.title, p.n_variants, bool_or(a.crawled_at >= {_SINCE}) AS any_new, string_agg(a.id, ',' ORDER BY a.crawled_at DESC, a.id DESC) AS keys
 FROM page p JOIN ashby a ON {_clean("a.board")} = p.company AND {_clean("a.title")} = p.title GROUP BY ALL""",
    "card_divider": f"""WITH page AS (SELECT *, max_seen >= {_SINCE} AS is_new, row_number() OVER (ORDER BY max_seen DESC, company, title) AS r FROM ({_GROUPS}) QUALIFY r <= 200)
 SELECT company, title, is_new, coalesce(lag(is_new) OVER (ORDER BY r) AND NOT is_new, false) AS divider FROM page""",
    "deadline_urgency": f"""SELECT DISTINCT id, CASE WHEN epoch_us(crawled_at) <= epoch_us({_NOW_SQL}) THEN 'past'
 WHEN epoch_us(crawled_at) - epoch_us({_NOW_SQL}) < 14 * 86400000000 THEN 'soon' END AS urgency FROM ashby""",
    "facet_scalar": " UNION ALL ".join(
        f"SELECT '{f}' AS facet, {v} AS value, count(DISTINCT {_ROLE('board')}) AS n FROM ashby WHERE {v} IS NOT NULL GROUP BY ALL"
        for f, v in (("employmentType", "coalesce(employmentType, 'none')"), ("workplaceType", "coalesce(workplaceType, 'none')"), ("department", "department"))
    ),
    "facet_self_omission": f"""SELECT 'employmentType' AS facet, coalesce(employmentType, 'none') AS value, count(DISTINCT {_ROLE("board")}) AS n FROM ashby
 WHERE workplaceType = 'Remote' OR workplaceType IS NULL GROUP BY ALL UNION ALL
 SELECT 'workplaceType', coalesce(workplaceType, 'none'), count(DISTINCT {_ROLE("board")}) FROM ashby WHERE employmentType IN ('Intern', 'FullTime') GROUP BY ALL""",
    "facet_array": " UNION ALL ".join(
        f"""SELECT '{f}' AS facet, value, count(DISTINCT ({_clean("company_name")}, {_clean("title")})) AS n
 FROM (SELECT company_name, title, trim(unnest({f})) AS value FROM simplify WHERE category IN ('Software', 'Hardware'))
 WHERE value <> '' AND company_name IS NOT NULL AND title IS NOT NULL GROUP BY ALL"""
        for f in ("terms", "degrees")
    ),
    "facet_status": f"""SELECT 'status' AS facet, coalesce(l.status, 'none') AS value, count(DISTINCT ({_clean("s.company_name")}, {_clean("s.title")})) AS n
 FROM simplify s LEFT JOIN (SELECT url, min(label) AS status FROM labels WHERE url IS NOT NULL GROUP BY url) l USING (url)
 WHERE s.company_name IS NOT NULL AND s.title IS NOT NULL GROUP BY ALL""",
    "filter_text": "SELECT DISTINCT id, title FROM ashby WHERE contains(lower(title), 'data scientist') OR contains(lower(board), 'data scientist')",
    "filter_values": "SELECT DISTINCT id FROM simplify WHERE (category = 'Product' OR category IS NULL) AND sponsorship = 'Other'",
    "filter_overlap": "SELECT DISTINCT id FROM simplify WHERE list_contains(terms, 'Summer 2026') OR list_contains(degrees, 'PhD')",
    "filter_new": f"SELECT DISTINCT id FROM ashby WHERE crawled_at >= {_SINCE}",
    "filter_window": f"SELECT DISTINCT id FROM {_COMP} WHERE (low IS NULL OR low <= 60) AND (high IS NULL OR high >= 60)",
    "filter_windows_overlap": f"SELECT DISTINCT id FROM {_COMP} WHERE (low IS NULL OR low <= 70) AND (high IS NULL OR high >= 40)",
    "filter_keep_null": "SELECT DISTINCT id FROM simplify WHERE (category IS NULL OR category IN ('Software', 'Quant')) AND (sponsorship IS NULL OR sponsorship <> 'Other')",
    "filter_curated": f"SELECT DISTINCT id FROM simplify WHERE lower({_clean('company_name')}) IN (SELECT lower({_clean('company')}) FROM boards WHERE company IS NOT NULL)",
    "location_conditions": "SELECT DISTINCT id FROM simplify WHERE list_contains(terms, 'Fall 2026') OR (coalesce(len(terms), 0) = 0 AND coalesce(len(degrees), 0) = 0)",
    "enum_maps": f"SELECT DISTINCT id, {_EMPLOYMENT} AS employment, {_WORKPLACE} AS workplace FROM ashby",
    "strict_dates": "SELECT DISTINCT id, try_cast(date_updated AS DATE)::VARCHAR AS day FROM simplify WHERE regexp_matches(date_updated, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(date_updated AS DATE) IS NOT NULL",
    "class_years": """SELECT DISTINCT id, (CASE WHEN t = y THEN y::INT WHEN m BETWEEN 1 AND 12 THEN y::INT + (m >= 8)::INT END)::BIGINT AS class_year FROM (
 SELECT id, t, t[1:4] AS y, try_cast(t[6:7] AS INT) AS m FROM (SELECT id, regexp_extract(date_updated, '[0-9]{4}-[0-9]{2}') AS t FROM simplify) WHERE regexp_matches(t, '^[0-9]{4}(-[0-9]{2})?$'))
 WHERE t = y OR m BETWEEN 1 AND 12""",
    "canonical_terms": """SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(degrees, lambda x: lower(trim(x))), lambda x: x <> ''),
 lambda x: CASE x WHEN 'phd' THEN 'doctorate' WHEN 'bachelor''s' THEN 'bachelor' WHEN 'master''s' THEN 'master' ELSE x END))), '|') AS degrees FROM simplify""",
    "grounded_titles": r"""SELECT DISTINCT id, coalesce(w <> '' AND contains(trim(regexp_replace(lower(descriptionPlain), '\s+', ' ', 'g')), lower(w)), false) AS grounded
 FROM (SELECT *, regexp_extract(title, '([A-Z][a-z]{5,})$', 1) AS w FROM ashby)""",
    "label_lines": "SELECT DISTINCT id, CASE WHEN l IN ('relevant', 'borderline', 'irrelevant') THEN l END AS label FROM (SELECT id, trim(label) AS l FROM labels)",
    "quoted_lines": """SELECT DISTINCT id, '"' || replace(coalesce(company, ''), '"', '""') || '","' || replace(coalesce(title, ''), '"', '""') || '"' AS line FROM labels""",
    "location_parts": rf"""WITH p AS (SELECT *, country = 'United States' AS h FROM places), dict AS (
 SELECT DISTINCT region_code AS term, true AS exact, CASE WHEN h THEN 2 ELSE 1 END AS priority, country, CASE WHEN h THEN region END AS region FROM p WHERE region_code IS NOT NULL
 UNION SELECT {_fold("region")}, false, CASE WHEN h THEN 4 ELSE 3 END, country, CASE WHEN h THEN region END FROM p WHERE region IS NOT NULL
 UNION SELECT {_fold("country")}, false, 5, country, NULL FROM p
 UNION SELECT {_fold("city")}, false, CASE WHEN min(country) = 'United States' THEN 6 ELSE 7 END, min(country), CASE WHEN min(country) = 'United States' THEN min(region) END FROM p GROUP BY 1 HAVING count(DISTINCT (country, coalesce(region, ''))) = 1
 UNION SELECT x, true, 0, 'United States', NULL FROM (VALUES ('USA'), ('US')) v(x)),
v AS (SELECT DISTINCT location FROM ashby WHERE location IS NOT NULL),
s AS (SELECT location, n, {_clean("s")} AS s FROM (SELECT location, unnest(regexp_split_to_array(location, '[;|]|(?i:\s+or\s+)')) AS s, generate_subscripts(regexp_split_to_array(location, '[;|]|(?i:\s+or\s+)'), 1) AS n FROM v)),
t AS (SELECT DISTINCT location, n, {_clean("x")} AS t FROM (SELECT location, n, unnest(regexp_split_to_array(s, '[,/()\x{{2013}}\x{{2014}}-]')) AS x FROM s)),
h AS (SELECT location, n, t, country, region FROM t JOIN dict ON CASE WHEN exact THEN t = term ELSE NOT regexp_matches(t, '^[A-Z][A-Z]$') AND {_fold("t")} = term END WHERE t <> ''
 QUALIFY row_number() OVER (PARTITION BY location, n, t ORDER BY priority, country, region NULLS FIRST) = 1),
w AS (SELECT location, list_filter(regexp_split_to_array({_fold("s")}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.location = s.location AND h.n = s.n)),
g AS (SELECT DISTINCT location, array_to_string(w[i:i + k - 1], ' ') AS g FROM w, unnest([1, 2, 3, 4]) a(k), unnest(range(1, len(w) - k + 2)) b(i)),
f AS (SELECT location, country, region FROM h UNION SELECT location, country, region FROM g JOIN dict ON NOT exact AND g = array_to_string(list_filter(regexp_split_to_array(term, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ')),
r AS (SELECT location, array_to_string(list_sort(list_distinct(list(country))), '|') AS countries, coalesce(array_to_string(list_sort(list_distinct(list(region) FILTER (region IS NOT NULL))), '|'), '') AS regions FROM f GROUP BY location)
SELECT DISTINCT id, coalesce(countries, '') AS countries, coalesce(regions, '') AS regions FROM ashby LEFT JOIN r USING (location)""",
}
