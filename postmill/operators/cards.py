"""Role cards: rows grouped by role, sorted, paged, and put together with their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.schema import role_key
from postmill.session import small

# Cards of a page, at most, whose keys are broadcast.
PAGE_CARDS = 1_000


def role_groups(df: DataFrame, company: str, title: str, seen: str, published: str | None = None, deadline: str | None = None) -> DataFrame:
    """One row for each trimmed (company, title): latest sighting and publication, first deadline, size.

    Rows with a null company or title are left out. One exchange, with map-side combining.
    """
    c, t = role_key(company, title)
    null = F.lit(None).cast("timestamp")
    return (
        df.withColumns({"__c": c, "__t": t})
        .where("__c is not null and __t is not null")
        .groupBy(F.col("__c").alias("company"), F.col("__t").alias("title"))
        .agg(
            F.max(seen).alias("max_seen"),
            F.max(F.col(published) if published else null).alias("max_published"),
            F.min(F.col(deadline) if deadline else null).alias("min_deadline"),
            F.count("*").alias("n_variants"),
            F.array_sort(F.collect_set(F.struct(F.col(company).alias("company"), F.col(title).alias("title")))).alias("spellings"),
        )
    )


def group_counts(groups: DataFrame, new_since: Column) -> DataFrame:
    """How many roles there are, and how many of them were seen newly: one row."""
    return groups.agg(F.count("*").alias("total"), F.count_if(F.col("max_seen") >= new_since).alias("new_count"))


def ranked_groups(scored: DataFrame, company: str, title: str, score: str, seen: str, key: str, new_since: Column, variant: list[str]) -> DataFrame:
    """One row for each role of scored rows: the best score, and all variants, the newest first (ties: larger key).

    Any order of cards may follow; ``card_order("score")`` is best score, company, title.
    """
    c, t = role_key(company, title)
    item = F.struct(F.col(seen).alias("seen"), F.col(key).alias("key"), F.col(score).alias("score"), *[F.col(v).alias(f"v_{v}") for v in variant])
    rows = scored.withColumns({"__c": c, "__t": t}).where("__c is not null and __t is not null")
    return rows.groupBy(F.col("__c").alias("company"), F.col("__t").alias("title")).agg(
        F.max(score).alias("best_score"), F.count("*").alias("n_variants"), F.coalesce(F.bool_or(F.col(seen) >= new_since), F.lit(False)).alias("any_new"),
        F.sort_array(F.collect_list(item), asc=False).alias("variants"),
    )


def variant_row(new_since: Column, seen: str, status: str = "status", note: str = "note") -> Column:
    """What a card says of one variant besides its own columns: whether it is new, the status and the note, if any."""
    return F.struct((F.col(seen) >= new_since).alias("is_new"), F.col(status).alias("status"), F.col(note).alias("note"))


def recommendation(df: DataFrame, now: Column, deadline: str, unverified: list[str], columns: list[str]) -> DataFrame:
    """Items of a ranking as shown: ``columns``, the days left, and which of ``unverified`` the row doesn't state."""
    flags = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in unverified]), lambda x: x.isNotNull())
    return df.select(*columns, days_left(F.col(deadline), now).alias("days_left"), flags.alias("unverified"))


def badge(company: Column, curated: Column, text: str) -> Column:
    """A fixed text for a company on a curated list, else null. ``curated`` is a flag of the row, as a semi-join or a join gives it."""
    return F.when(curated & company.isNotNull(), F.lit(text))


def card_order(sort: str, now: Column | None = None, locale: bool = False) -> list[Column]:
    """Total orders of cards: ``seen``, ``published``, ``company``, ``deadline``, ``score``."""
    # Display order is by locale, so that case doesn't part names; equal ones by code point, so that it is total.
    name = [*[F.collate(c, "UNICODE").asc() for c in ("company", "title")], F.col("company").asc(), F.col("title").asc()] if locale else [F.col("company").asc(), F.col("title").asc()]
    if sort == "seen":
        return [F.col("max_seen").desc_nulls_last(), *name]
    if sort == "published":
        return [F.col("max_published").desc_nulls_last(), *name]
    if sort == "company":
        return name
    if sort == "score":
        return [F.col("best_score").desc_nulls_last(), *name]
    if sort == "deadline":  # to come, soonest first; none stated; passed
        d = F.col("min_deadline")
        bucket = F.when(d >= now, 0).when(d.isNull(), 1).otherwise(2)
        return [bucket.asc(), d.asc_nulls_first(), *name]
    raise ValueError(f"unknown sort {sort!r}")


def page_of(groups: DataFrame, order: list[Column], page: int, per: int) -> DataFrame:
    """One page of a total order, with the place of each card in the whole of it (from 0).

    A top-k plan: Spark keeps the first ``page * per`` rows of each partition only.
    """
    first = groups.orderBy(*order).limit(page * per)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # at most page * per rows
    return ranked.where(F.col("place") >= (page - 1) * per)


def assemble(df: DataFrame, cards: DataFrame, company: str, title: str, seen: str, key: str, new_since: Column, variant: list[str]) -> DataFrame:
    """Cards of a page with their variants, the newest first (ties: larger key), and whether any is new.

    The cards of a page are few; their keys are broadcast, and only rows of those roles are grouped.
    """
    c, t = role_key(company, title)
    keys = small(cards.select(F.col("company").alias("__c"), F.col("title").alias("__t")), PAGE_CARDS)
    rows = df.withColumns({"__c": c, "__t": t}).join(keys, ["__c", "__t"], "left_semi")
    item = F.struct(F.col(seen).alias("seen"), F.col(key).alias("key"), *[F.col(v).alias(f"v_{v}") for v in variant])
    grouped = rows.groupBy(F.col("__c").alias("company"), F.col("__t").alias("title")).agg(
        F.sort_array(F.collect_list(item), asc=False).alias("variants"), F.coalesce(F.bool_or(F.col(seen) >= new_since), F.lit(False)).alias("any_new")
    )
    return cards.join(grouped, ["company", "title"], "left")


def page_count(total: int, per: int) -> int:
    return max(1, -(-total // per))


def new_divider(cards: DataFrame, order: list[Column], is_new: str) -> DataFrame:
    """Cards of one page with a mark at the first that is no longer new."""
    before = F.lag(is_new).over(Window.orderBy(*order))
    return cards.withColumn("divider", F.coalesce(before & ~F.col(is_new), F.lit(False)))


def urgency(deadline: Column, now: Column, soon_days: int = 14) -> Column:
    left = (F.unix_micros(deadline) - F.unix_micros(now)) / F.lit(86_400_000_000)
    return F.when(left <= 0, "past").when(left < soon_days, "soon")


def days_left(deadline: Column, now: Column) -> Column:
    return F.ceil((F.unix_micros(deadline) - F.unix_micros(now)) / F.lit(86_400_000_000))


def grad_window(lowest: Column, highest: Column) -> Column:
    """A label of years of graduation: both, one, from one on, up to one; empty without any."""
    short = lambda y: F.concat(F.lit("\u2019"), F.substring(y.cast("string"), 3, 100))
    both = F.when(lowest == highest, short(lowest)).otherwise(F.concat(short(lowest), F.lit("\u2013"), short(highest)))
    return (
        F.when(lowest.isNull() & highest.isNull(), "")
        .when(highest.isNull(), F.concat(short(lowest), F.lit("+")))
        .when(lowest.isNull(), F.concat(F.lit("\u2264"), short(highest)))
        .otherwise(both)
    )
