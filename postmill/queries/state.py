"""Operators over stored state, rankings and evaluation, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.models import HashEmbedder, RuleClassifier, classify, embed
from postmill.functions.text import fingerprint
from postmill.operators import dedup as D
from postmill.operators import evaluate as E
from postmill.operators import lifecycle as L
from postmill.operators import rank as R
from postmill.schema import dedup_key, parse_vector, vector_text
from postmill.session import table

GAINS = {"relevant": 2.0, "borderline": 1.0, "irrelevant": 0.0}
NOW = "2026-11-01 00:00:00"


def _first_last(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The state that all snapshots but the newest left, each id as it was last, and the newest snapshot."""
    snaps = table(spark, d, "ashby_snapshots")
    newest = snaps.agg(F.max("snapshot_no")).first()[0]
    row = F.struct("board", "title", "location", "isListed", "loaded_at")
    last = lambda df: df.groupBy("id").agg(F.max_by(row, F.struct("snapshot_no", "loaded_at", "title", "location")).alias("r")).select("id", "r.*")
    return last(snaps.where(F.col("snapshot_no") < F.lit(newest))), last(snaps.where(F.col("snapshot_no") == F.lit(newest)))


def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ashby").select("id", "board", "title", "location").distinct()
    return D.survivors(rows, dedup_key("board", "title", "location"), "id").select("id", F.array_join("siblings", ",").alias("siblings"))


def dedup_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ashby_batches")
    stored = rows.where("batch_no = 0").withColumn("active", F.lit(True))
    out = D.owners(rows.where("batch_no > 0"), stored, "board", "title", "location", "id", "active")
    return out.select("seq", "owner", "outcome")


def alias_forward(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("url is not null").select(F.concat(F.lit("labels:"), F.col("id")).alias("key"), F.array("url").alias("aliases")).distinct()
    return D.alias_targets(labels, "aliases", "key", table(spark, d, "simplify").select("url"), "url").select("copy", "target")


def retire_carriers(spark: SparkSession, d: str) -> DataFrame:
    key = lambda source, c: F.struct(F.lit(source).alias("source"), F.col(c).cast("string").alias("source_external_id"))
    stored = table(spark, d, "labels").where("url is not null").groupBy("id").agg(F.min("url").alias("url"))
    stored = stored.select(key("labels", "id").alias("key"), F.array(key("feed", "url")).alias("keys"), F.lit(True).alias("active"))
    out = D.retire_carriers(table(spark, d, "simplify").select(key("feed", "url").alias("key")), stored, "key", "keys", "active")
    return out.select(F.col("carrier.source_external_id").alias("carrier"), F.col("target.source_external_id").alias("target"), F.size("fold").cast("bigint").alias("n_fold"))


def backfill_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ashby").select("id", "board", "title", "location", "isListed").distinct()
    out = D.collapse(rows, dedup_key("board", "title", "location"), "id", "isListed")
    return out.select("id", "isListed", F.coalesce(F.array_join("gained", ","), F.lit("")).alias("gained"))


def latest_action(spark: SparkSession, d: str) -> DataFrame:
    return D.latest(table(spark, d, "ashby_batches").select("board", "seq", "title"), ["board"], "seq")


def first_of_board(spark: SparkSession, d: str) -> DataFrame:
    return D.first_n(table(spark, d, "ashby").select("board", "id").distinct(), ["board"], [F.col("id")], 3)


def partition_seen(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    batch = table(spark, d, "ashby").select("id").distinct()
    return L.partition_seen(batch, new, old.where("not isListed"), ["id"])


def delist_board(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.delisted(old, new, new.select("board"), ["board"], ["board", "id"], "isListed").select("board", "id")


def board_company(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "boards").select("source", "company").unionByName(table(spark, d, "boards").select(F.col("board").alias("source"), "company"))
    return L.board_company(names, "source", "company")


def _state(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "location", "isListed", F.unix_micros("loaded_at").alias("first_seen"), F.unix_micros("loaded_at").alias("last_seen"))


def merge_keeps(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.merge(_state(old), _state(new), ["id"], once=["first_seen"], always={"isListed": F.lit(True)})


def merge_partial(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.merge(_state(old), _state(new), ["id"], only=["location", "last_seen"], insert=False)


def insert_rejects(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.insert_new(old.select("id", F.lit("old").alias("origin")), new.select("id", F.lit("new").alias("origin")), ["id"])


def sighting_bump(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.bump(_state(old).select("id", "last_seen"), new, ["id"], "last_seen", F.lit(0).cast("bigint"))


def not_modified_bump(spark: SparkSession, d: str) -> DataFrame:
    old, _ = _first_last(spark, d)
    rows = old.select("id", "board", "isListed", F.unix_micros("loaded_at").alias("last_seen"))
    return L.bump_where(rows, F.col("isListed") & F.col("board").startswith("n"), "last_seen", F.lit(0).cast("bigint")).select("id", "last_seen")


def status_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The labels, after those delivered again: another label replaces the first one, the same or none clears it."""
    rows = table(spark, d, "labels").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.count("*").alias("n"))
    changes = rows.where("n > 1").select("id", F.when(F.col("label") != F.col("other"), F.col("other")).alias("label"))
    return L.upsert_or_clear(rows.select("id", "label"), changes, "id", "label")


def fingerprint_stale(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    stored = fingerprint(1, F.col("kind"), F.col("lang"))
    return docs.withColumn("stored", stored).where(L.stale("stored", fingerprint(1, F.col("kind"), F.coalesce("lang", F.lit("en"))))).select("doc_id", "stored")


def recompute_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _first_last(spark, d)
    return L.changed_rows(old.select("id", "title", "location"), new.select("id", "title", "location"), ["id"], ["title", "location"])


def active_scan(spark: SparkSession, d: str) -> DataFrame:
    return L.active_scan(table(spark, d, "boards").select("board", "is_active"), "is_active", "board")


def walk_back(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("user_id").alias("n"))
    return L.walk_back(days, "day", "n", 25, 24)


def _query_vector(df: DataFrame) -> list[float]:
    row = df.where("vec_id = 0 and embedding is not null").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0]  # no vector to ask for: all similarities are null


def _scored(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    at = F.timestamp_seconds(F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.col("vec_id") * 7200)
    fresh = R.freshness(at, F.lit(NOW).cast("timestamp"))
    return emb.withColumn("sim", R.cosine_to(F.col("embedding"), _query_vector(emb))).withColumn("score", F.round(R.blend(F.col("sim"), fresh), 9))


def cosine_rank(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", F.round("sim", 6).alias("sim"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.global_rank(_scored(spark, d).select("vec_id", "label", "sim", "score"), "score", "vec_id")


def blend_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("vec_id", F.round("score", 6).alias("score"), "rank")


def rank_bands(spark: SparkSession, d: str) -> DataFrame:
    return R.bands(_ranked(spark, d)).select("vec_id", "band")


def role_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).withColumn("place", (F.col("vec_id") % 4).cast("string"))
    out = R.fold_roles(rows, ["label"], "rank", "vec_id", "place")
    return out.select("label", "best_key", "best_rank", "n_variants", F.array_join("locations", ",").alias("locations"))


def excluded_count(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").withColumn("model", F.when(F.col("vec_id") % 7 > 0, "m")).withColumn("template", (F.col("label") % 3).cast("int"))
    gate = R.usable("embedding", "model", "template", "m", 1)
    return emb.agg(F.count_if(gate).alias("usable"), F.count_if(~gate).alias("excluded"))


def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    score = R.overlap_score(F.coalesce("terms", F.array().cast("array<string>")), ["Summer 2026", "Fall 2026"], F.col("category") == "Software")
    return table(spark, d, "simplify").select("id", score.alias("score")).distinct()


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    text = R.render_lines(("title: ", F.col("title")), ("department: ", F.col("department")))
    return table(spark, d, "ashby").select("id", text.alias("text")).distinct()


def stratified_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_counts(table(spark, d, "ashby").select("board", "id").distinct(), "board", 200)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_sample(table(spark, d, "ashby").select("board", "id").distinct(), "board", "id", 200)


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return E.holdout(table(spark, d, "labels").select("id").distinct(), "id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("label") == 0, "relevant").when(F.col("label") <= 2, "borderline").otherwise("irrelevant")
    return _ranked(spark, d).withColumn("label", label)


def precision_at_10(spark: SparkSession, d: str) -> DataFrame:
    return E.precision_at_k(_judged(spark, d), 10).select(F.round("strict", 6).alias("strict"), F.round("lenient", 6).alias("lenient"))


def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg_at_k(_judged(spark, d), 10, GAINS).select(F.round("ndcg", 6).alias("ndcg"))


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scored = _scored(spark, d).select("vec_id", F.round("sim", 9).alias("sim"), "score")
    return R.global_rank(scored, "score", "vec_id").select(F.col("vec_id").alias("id"), "rank"), R.global_rank(scored, "sim", "vec_id").select(F.col("vec_id").alias("id"), "rank")


def pool_topk(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    return E.pool(a.withColumn("approach", F.lit(0)).unionByName(b.withColumn("approach", F.lit(1))), 20)


def topk_entered(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    return E.entered(a, b, 50)


def ranking_projected(spark: SparkSession, d: str) -> DataFrame:
    """The ranking restricted to the items of even labels, its order kept."""
    a, _ = _two_lists(spark, d)
    allowed = table(spark, d, "embeddings").where("label in (0, 2, 4, 6, 8)").select(F.col("vec_id").alias("id"))
    return E.project(a, allowed).select("id", "rank")


def top_relevant(spark: SparkSession, d: str) -> DataFrame:
    return E.top_label_count(_judged(spark, d), "relevant")


def overlap_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ids by their overlap score, the best first."""
    return R.global_rank(term_overlap(spark, d).groupBy("id").agg(F.max("score").alias("score")), "score", "id")


def active_targets(spark: SparkSession, d: str) -> DataFrame:
    return L.target_count(table(spark, d, "boards"))


def unvectored(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a signature whose vector is of another model or template."""
    emb = table(spark, d, "embeddings").withColumns({"model": F.when(F.col("vec_id") % 7 > 0, "m"), "template": (F.col("label") % 3).cast("int"), "signature": F.when(F.col("label") > 2, "s")})
    return emb.where(R.needs_embedding("signature", "embedding", "model", "template", "m", 1)).select("vec_id")


def sibling_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ashby_batches").select("id", "board", "title", "location").distinct()
    return D.sibling_rows(rows, dedup_key("board", "title", "location"), "id")


def field_clustering(spark: SparkSession, d: str) -> DataFrame:
    out = R.mean_pair_cosine(table(spark, d, "embeddings"), "embedding", "label")
    return out.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    out = E.batches(table(spark, d, "embeddings").select("vec_id"), "vec_id", 16)
    return out.select("vec_id", F.col("batch").cast("bigint").alias("batch"))


def vector_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = parse_vector(vector_text(F.transform("embedding", lambda x: x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", F.size(back).cast("bigint").alias("n"), F.round(R.dot(back, back), 4).alias("norm"))


def stub_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ashby").select("id", "title", "descriptionPlain").distinct()
    return classify(rows, RuleClassifier(), ["id"], "title", "descriptionPlain").select("id", "relevant", "kind")


def stub_embed(spark: SparkSession, d: str) -> DataFrame:
    out = embed(table(spark, d, "documents").select("doc_id", "text"), HashEmbedder(16), ["doc_id"], "text")
    return out.select("doc_id", F.coalesce(F.size("vector"), F.lit(0)).cast("bigint").alias("n"), "error")



QUERIES = {
    f.__name__: f
    for f in (
        dedup_survivors, dedup_outcomes, alias_forward, retire_carriers, backfill_collapse, latest_action, first_of_board, partition_seen, delist_board,
        board_company, merge_keeps, merge_partial, insert_rejects, sighting_bump, not_modified_bump, status_upsert, fingerprint_stale, recompute_diff,
        active_scan, walk_back, cosine_rank, blend_rank, rank_bands, role_fold, excluded_count, term_overlap, embed_text, stratified_counts,
        stratified_sample, holdout_split, precision_at_10, ndcg_at_10, pool_topk, topk_entered, field_clustering, embed_batches, vector_roundtrip,
        stub_classify, stub_embed, ranking_projected, top_relevant, overlap_ranked, active_targets, unvectored, sibling_keys,
    )
}

_ENDS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_k = lambda c: f"regexp_replace({c}, '{_ENDS}', '', 'g')"
_KEY = f"{_k('board')}, {_k('title')}, coalesce({_k('location')}, '')"
_ENDS_OF = """
WITH one AS (SELECT *, epoch_us(loaded_at) AS us, snapshot_no = (SELECT max(snapshot_no) FROM ashby_snapshots) AS newest FROM ashby_snapshots),
r AS (SELECT *, row_number() OVER (PARTITION BY newest, id ORDER BY snapshot_no DESC, loaded_at DESC, title DESC, location DESC NULLS LAST) AS r FROM one),
o AS (SELECT * FROM r WHERE r = 1 AND NOT newest), n AS (SELECT * FROM r WHERE r = 1 AND newest)
"""
_SCORED = """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.v) AS sim FROM embeddings, q),
scored AS (SELECT *, round(0.95 * sim + 0.05 * exp(-ln(2.0) * (vec_id * 7200 / 86400.0) / 30), 9) AS score FROM s),
ranked AS (SELECT *, (row_number() OVER (ORDER BY score DESC, vec_id) - 1)::BIGINT AS rank FROM scored),
judged AS (SELECT *, CASE WHEN label = 0 THEN 2.0 WHEN label <= 2 THEN 1.0 ELSE 0.0 END AS g FROM ranked)
"""
_BY_SIM = "(SELECT vec_id, row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id) - 1 AS rank FROM scored)"
_FP = lambda lang: f"sha256('[1,' || (to_json([kind, {lang}])::VARCHAR)[2:])"

SQL = {
    "dedup_survivors": f"""SELECT min(id) AS id, coalesce(array_to_string(list_sort(list_distinct(list(id)))[2:], ','), '') AS siblings
 FROM (SELECT DISTINCT id, board, title, location FROM ashby) GROUP BY {_KEY}""",
    "dedup_outcomes": f"""WITH s AS (SELECT {_k("board")} AS b, {_k("title")} AS t, coalesce({_k("location")}, '') AS l, min(id) AS owner FROM ashby_batches WHERE batch_no = 0 GROUP BY ALL)
 SELECT seq, owner, CASE WHEN owner IS NULL THEN 'new' WHEN owner = id THEN 'self' ELSE 'other' END AS outcome
 FROM ashby_batches a LEFT JOIN s ON s.b = {_k("a.board")} AND s.t = {_k("a.title")} AND s.l = coalesce({_k("a.location")}, '') WHERE batch_no > 0""",
    "alias_forward": "SELECT 'labels:' || id AS copy, min(url) AS target FROM labels WHERE url IN (SELECT url FROM simplify) GROUP BY 1",
    "retire_carriers": """SELECT id::VARCHAR AS carrier, url AS target, 1::BIGINT AS n_fold FROM (SELECT id, min(url) AS url FROM labels WHERE url IS NOT NULL GROUP BY id)
 WHERE url IN (SELECT url FROM simplify)""",
    "backfill_collapse": f"""WITH r AS (SELECT DISTINCT id, board, title, location, isListed FROM ashby),
 w AS (SELECT *, list(id) FILTER (isListed) OVER (PARTITION BY {_KEY}) AS ids, min(id) FILTER (isListed) OVER (PARTITION BY {_KEY}) AS f FROM r)
 SELECT id, isListed AND id = f AS isListed, CASE WHEN isListed AND id = f THEN coalesce(array_to_string(list_sort(list_distinct(ids))[2:], ','), '') ELSE '' END AS gained FROM w""",
    "latest_action": "SELECT board, seq, title FROM ashby_batches QUALIFY row_number() OVER (PARTITION BY board ORDER BY seq DESC) = 1",
    "first_of_board": "SELECT board, id FROM (SELECT DISTINCT board, id FROM ashby) QUALIFY row_number() OVER (PARTITION BY board ORDER BY id) <= 3",
    "partition_seen": f"""{_ENDS_OF} SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM o WHERE NOT isListed) THEN 'reject' WHEN id IN (SELECT id FROM n) THEN 'keep' ELSE 'unseen' END AS seen FROM ashby""",
    "delist_board": f"""{_ENDS_OF} SELECT board, id FROM o WHERE isListed AND board IN (SELECT board FROM n) AND (board, id) NOT IN (SELECT (board, id) FROM n)""",
    "board_company": f"""SELECT source, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS company FROM (
 SELECT source, nullif({_k("company")}, '') AS c FROM boards UNION ALL SELECT board, nullif({_k("company")}, '') FROM boards) GROUP BY source""",
    "merge_keeps": f"""{_ENDS_OF} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title,
 CASE WHEN n.id IS NULL THEN o.location ELSE n.location END AS location, CASE WHEN n.id IS NULL THEN o.isListed ELSE true END AS isListed,
 coalesce(o.us, n.us) AS first_seen, coalesce(n.us, o.us) AS last_seen FROM o FULL JOIN n ON o.id = n.id""",
    "merge_partial": f"""{_ENDS_OF} SELECT o.id, o.title, CASE WHEN n.id IS NULL THEN o.location ELSE n.location END AS location, o.isListed, o.us AS first_seen,
 coalesce(n.us, o.us) AS last_seen FROM o LEFT JOIN n ON o.id = n.id""",
    "insert_rejects": f"{_ENDS_OF} SELECT id, 'old' AS origin FROM o UNION ALL SELECT id, 'new' FROM n WHERE id NOT IN (SELECT id FROM o)",
    "sighting_bump": f"{_ENDS_OF} SELECT id, CASE WHEN id IN (SELECT id FROM n) THEN 0::BIGINT ELSE us END AS last_seen FROM o",
    "not_modified_bump": f"{_ENDS_OF} SELECT id, CASE WHEN isListed AND starts_with(board, 'n') THEN 0::BIGINT ELSE us END AS last_seen FROM o",
    "status_upsert": """SELECT id, CASE WHEN n > 1 THEN b ELSE a END AS label FROM (SELECT id, min(label) AS a, max(label) AS b, count(*) AS n FROM labels GROUP BY id)
 WHERE n = 1 OR a <> b""",
    "fingerprint_stale": f"SELECT doc_id, {_FP('NULL')} AS stored FROM documents WHERE lang IS NULL",
    "recompute_diff": f"{_ENDS_OF} SELECT n.id, n.title, n.location FROM n JOIN o ON n.id = o.id WHERE n.title IS DISTINCT FROM o.title OR n.location IS DISTINCT FROM o.location",
    "active_scan": "SELECT board, is_active FROM boards WHERE is_active",
    "walk_back": """WITH d AS (SELECT (ts::DATE)::VARCHAR AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 24)
 SELECT day, n FROM d ORDER BY n >= 25 DESC, CASE WHEN n >= 25 THEN day END DESC NULLS LAST, n DESC, day DESC LIMIT 1""",
    "cosine_rank": f"{_SCORED} SELECT vec_id, round(sim, 6) AS sim FROM scored",
    "blend_rank": f"{_SCORED} SELECT vec_id, round(score, 6) AS score, rank FROM ranked",
    "rank_bands": f"""{_SCORED} SELECT vec_id, CASE WHEN rank < greatest(5, ceil(t * 0.1)) THEN 'strong' WHEN rank < greatest(5, ceil(t * 0.1)) + ceil(t * 0.25) THEN 'good' ELSE 'fair' END AS band
 FROM ranked, (SELECT count(*) AS t FROM ranked)""",
    "role_fold": f"""{_SCORED}, p AS (SELECT label, (vec_id % 4)::VARCHAR AS place, min(rank) AS r FROM ranked GROUP BY ALL)
 SELECT r.label, arg_min(r.vec_id, r.rank) AS best_key, min(r.rank) AS best_rank, count(*) AS n_variants,
 (SELECT string_agg(place, ',' ORDER BY p.r) FROM p WHERE p.label = r.label) AS locations FROM ranked r GROUP BY r.label""",
    "stub_embed": "SELECT doc_id, CASE WHEN text <> '' THEN 16::BIGINT ELSE 0 END AS n, CASE WHEN coalesce(text, '') = '' THEN 'empty' END AS error FROM documents",
    "ranking_projected": f"{_SCORED} SELECT vec_id AS id, (row_number() OVER (ORDER BY rank) - 1)::BIGINT AS rank FROM ranked WHERE label % 2 = 0",
    "top_relevant": f"{_SCORED} SELECT count(*) FILTER (g = 2) AS n FROM judged WHERE rank < 20",
    "overlap_ranked": """SELECT id, s AS score, (row_number() OVER (ORDER BY s DESC, id) - 1)::BIGINT AS rank FROM (SELECT id, max(list_contains(coalesce(terms, []), 'Summer 2026')::INT + list_contains(coalesce(terms, []), 'Fall 2026')::INT
 + CASE WHEN category = 'Software' THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS s FROM simplify GROUP BY id)""",
    "active_targets": "SELECT source, count(*) FILTER (is_active) AS n FROM boards GROUP BY source",
    "unvectored": "SELECT vec_id FROM embeddings WHERE label > 2 AND NOT (embedding IS NOT NULL AND vec_id % 7 > 0 AND label % 3 = 1)",
    "sibling_keys": f"SELECT f AS survivor, id AS sibling FROM (SELECT id, min(id) OVER (PARTITION BY {_KEY}) AS f FROM (SELECT DISTINCT id, board, title, location FROM ashby_batches)) WHERE id <> f",
    "stratified_counts": """WITH c AS (SELECT board AS cell, count(DISTINCT id) AS size FROM ashby GROUP BY board), t AS (SELECT sum(size) AS total FROM c),
 f AS (SELECT cell, size, 200.0 * size / total AS e, least(size, greatest(1, floor(200.0 * size / total)))::BIGINT AS seats FROM c, t),
 g AS (SELECT *, (200 - sum(seats) OVER ())::BIGINT AS spare, CASE WHEN seats < size THEN row_number() OVER (PARTITION BY seats < size ORDER BY e - floor(e) DESC, cell) END AS r FROM f)
 SELECT cell, size, CASE WHEN spare > 0 AND r <= spare THEN seats + 1 ELSE seats END AS seats FROM g WHERE (SELECT min(spare) FROM g) >= 0
 UNION ALL SELECT cell, size, (seats - count(n))::BIGINT FROM (SELECT cell, size, seats, n FROM f LEFT JOIN (
  SELECT cell AS c2, n FROM (SELECT f.cell, f.seats - n + 1 AS level, n, row_number() OVER (ORDER BY f.seats - n + 1 DESC, f.cell DESC) AS k FROM f, unnest(range(1, f.seats)) u(n)) WHERE k <= (SELECT -min(spare) FROM g)
 ) x ON x.c2 = f.cell) WHERE (SELECT min(spare) FROM g) < 0 GROUP BY cell, size, seats""",
    "stub_classify": r"""SELECT DISTINCT id, k <> '' AS relevant, nullif(lower(k), '') AS kind
 FROM (SELECT id, regexp_extract(title, '(?i)\b(intern|co-op|apprentice|new grad)\b', 1) AS k FROM ashby)""",
    "excluded_count": """SELECT count(*) FILTER (vec_id % 7 > 0 AND label % 3 = 1) AS usable, count(*) FILTER (NOT (vec_id % 7 > 0 AND label % 3 = 1)) AS excluded FROM embeddings""",
    "term_overlap": """SELECT DISTINCT id, list_contains(coalesce(terms, []), 'Summer 2026')::INT + list_contains(coalesce(terms, []), 'Fall 2026')::INT
 + CASE WHEN category = 'Software' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score FROM simplify""",
    "embed_text": """SELECT DISTINCT id, concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'title: ' || title END, CASE WHEN coalesce(department, '') <> '' THEN 'department: ' || department END) AS text FROM ashby""",
    "holdout_split": "SELECT id, (row_number() OVER (ORDER BY id) - 1) % 5 = 4 AS held_out FROM (SELECT DISTINCT id FROM labels)",
    "precision_at_10": f"{_SCORED} SELECT round(avg((g = 2)::INT), 6) AS strict, round(avg((g > 0)::INT), 6) AS lenient FROM judged WHERE rank < 10",
    "ndcg_at_10": f"""{_SCORED} SELECT round((SELECT sum(g / log2(rank + 2)) FROM judged WHERE rank < 10)
 / (SELECT sum(g / log2(r + 2)) FROM (SELECT g, row_number() OVER (ORDER BY g DESC) - 1 AS r FROM judged) WHERE r < 10), 6) AS ndcg""",
    "pool_topk": f"""{_SCORED}, l AS (SELECT 0 AS a, vec_id, rank FROM ranked UNION ALL SELECT 1, vec_id, rank FROM {_BY_SIM})
 SELECT id, (row_number() OVER (ORDER BY a, r) - 1)::BIGINT AS place FROM (SELECT vec_id AS id, arg_min(a, a * 1000000 + rank) AS a, arg_min(rank, a * 1000000 + rank) AS r FROM l WHERE rank < 20 GROUP BY 1)""",
    "topk_entered": f"{_SCORED} SELECT vec_id AS id FROM ranked WHERE rank < 50 AND vec_id NOT IN (SELECT vec_id FROM {_BY_SIM} WHERE rank < 50)",
    "field_clustering": """WITH p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
 SELECT round(avg(s) FILTER (same), 6) AS intra, round(avg(s) FILTER (NOT same), 6) AS inter FROM p""",
    "embed_batches": "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 16)::BIGINT AS batch FROM embeddings",
    "vector_roundtrip": "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings",
}

