"""Ranking by vector similarity and freshness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import cut, small

# Ranges of a ranking, at most, whose counts are broadcast.
RANGES = 100_000
# Weights of similarity and freshness, and the half-life of freshness in days.
SIMILARITY, FRESHNESS, HALF_LIFE = 0.95, 0.05, 30.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of different lengths, with a null, or of length zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one query vector, a literal in the plan: a map, no join."""
    if not query or not any(query):
        raise ValueError("the query vector is empty or zero")
    return cosine(vector, F.array(*[F.lit(float(x)) for x in query]))


def freshness(at: Column, now: Column) -> Column:
    """2 to the power of minus age over half-life; times to come count as now."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0))
    return F.exp(F.lit(-math.log(2)) * days / HALF_LIFE)


def blend(similarity: Column, fresh: Column) -> Column:
    return F.lit(SIMILARITY) * similarity + F.lit(FRESHNESS) * fresh


def usable(vector: str, model: str, template: str, current_model: str, current_template: int) -> Column:
    """Whether a stored vector fits the current model and template; never null."""
    return F.coalesce(F.col(vector).isNotNull() & (F.col(model) == current_model) & (F.col(template) == current_template), F.lit(False))


def global_rank(df: DataFrame, score: str, key: str, out: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row by score, best first, ties by key.

    Without a window over all rows in one task: rows are divided into ranges of score, counted, and
    ranked within their range; the ranges before it add their counts.
    """
    parts = df.repartitionByRange(F.col(score).desc_nulls_last(), F.col(key).asc()).withColumn("__p", F.spark_partition_id())
    parts = cut(parts)
    counts = parts.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()))
    return parts.join(small(starts, RANGES), "__p").withColumn(out, (F.col("__before") + own - 1).cast("bigint")).drop("__p", "__before")


def bands(ranked: DataFrame, rank: str = "rank", out: str = "band") -> DataFrame:
    """Strong below max(5, 10 % of all), then good for the next 25 %, else fair."""
    total = ranked.count()
    strong = max(5, math.ceil(total * 0.1))
    good = strong + math.ceil(total * 0.25)
    return ranked.withColumn(out, F.when(F.col(rank) < strong, "strong").when(F.col(rank) < good, "good").otherwise("fair"))


def fold_roles(ranked: DataFrame, by: list[str], rank: str, key: str, location: str) -> DataFrame:
    """One row for each role: its best-ranked row, the number of variants, locations in rank order."""
    return ranked.groupBy(*by).agg(
        F.min_by(key, rank).alias("best_key"),
        F.min(rank).alias("best_rank"),
        F.count("*").alias("n_variants"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(rank, location))), lambda s: s[location])).alias("locations"),
    )


def overlap_order() -> list[Column]:
    """Order of overlap scores: the best first, ties by id."""
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def needs_embedding(signature: str, vector: str, model: str, template: str, current_model: str, current_template: int) -> Column:
    """A signature is there, and no vector, or one of another model or template."""
    return F.col(signature).isNotNull() & ~usable(vector, model, template, current_model, current_template)


def baseline_text(title: Column, body: Column, prefix: str = "", most: int = 6000) -> Column:
    """The title and the first characters of a description: what is embedded without a signature."""
    return F.concat(F.lit(prefix), title, F.lit("\n"), F.substring(body, 1, most))


def overlap_score(terms: Column, wanted: list[str], bonus: Column) -> Column:
    """Shared terms, and half a point for the bonus."""
    shared = F.size(F.array_intersect(terms, F.array(*[F.lit(w) for w in wanted])))
    return F.greatest(shared, F.lit(0)) + F.when(bonus, 0.5).otherwise(0.0)


def render_lines(*parts: tuple[str, Column]) -> Column:
    """Labelled lines of the parts that are stated: the text that is embedded."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)) for label, c in parts])


def mean_pair_cosine(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean cosine over all pairs within one label, and over all pairs of two labels: ``intra, inter``.

    No pair is formed: the sum over all pairs of unit vectors follows from the length of their sum,
    ``(|sum|^2 - n) / 2``, for each label and for all rows. One grouping by label and dimension.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = df.withColumn("__norm", norm).where("__norm > 0").select(F.col(label).alias("l"), F.posexplode(vector).alias("d", "x"), "__norm")
    sums = unit.groupBy("l", "d").agg(F.sum(F.col("x").cast("double") / F.col("__norm")).alias("s"), F.count("*").alias("n"))
    by_label = sums.groupBy("l").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    intra = by_label.agg(F.sum((F.col("sq") - F.col("n")) / 2).alias("in_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("in_n"))
    every = sums.groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    every = every.agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    every = every.select(((F.col("sq") - F.col("n")) / 2).alias("all_sum"), (F.col("n") * (F.col("n") - 1) / 2).alias("all_n"))
    both = intra.unionByName(every, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("in_sum", "in_n", "all_sum", "all_n")])
    ratio = lambda a, b: F.when(b > 0, a / b)
    return both.select(
        ratio(F.col("in_sum"), F.col("in_n")).alias("intra"),
        ratio(F.col("all_sum") - F.col("in_sum"), F.col("all_n") - F.col("in_n")).alias("inter"),
    )
