import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postmill import __main__ as cli
from postmill.functions.models import HashEmbedder, RuleClassifier
from postmill.functions.text import url_segment
from postmill.operators import lifecycle as L
from postmill.operators.rules import Cascade
from postmill.plans.discovery import UrlIndex, discover
from postmill.plans.enrich import ENRICHED, Enrichment
from postmill.plans.reclassify import reclassify
from postmill.plans.refresh import LISTINGS, REJECTS, Refresh
from postmill.plans.pointer import Conflict
from postmill.plans.store import SnapshotStore
from postmill.schema import FEED_A, FEED_B, FEED_C, FEED_D, LISTING
from postmill.sources import feeds as S
from postmill.streaming.refresh import recent_by_source, stream_refresh

DELIVERY = "source string, source_external_id string, company string, title string, location string, description_plain string, url string, duplicate_keys array<struct<source:string,source_external_id:string>>"
CASCADE = Cascade(accept_all=("engineer", "intern"), veto="intern", reject_any=("manager",))


def delivery(spark, *rows):
    return spark.createDataFrame([(s, i, "Acme", t, loc, "text", None, keys) for s, i, t, loc, keys in rows], DELIVERY)


def test_refresh_cycle(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    run = Refresh(store, CASCADE, delisting_sources=("c",))
    scope = spark.createDataFrame([("c", "Acme")], "source string, company string")
    first = delivery(spark, ("c", "1", "Engineer Intern", "X", None), ("c", "2", "Engineer Intern", "X ", None), ("c", "3", "Manager", "X", None), ("c", "4", "Clerk", "X", None), ("c", "5", "Data Intern", "X", None))
    counts = {r.bucket: r.n for r in run.run(first, scope, "2025-01-01 00:00:00").collect()}
    assert counts == {"keep": 2, "title_drop": 1, "model_reject": 1, "delisted": 0}
    rows = {r.source_external_id: r for r in store.read("listings", LISTINGS).collect()}
    assert set(rows) == {"1", "5"} and [k.source_external_id for k in rows["1"].duplicate_keys] == ["2"]
    assert [r.source_external_id for r in store.read("rejects", REJECTS).collect()] == ["4"]

    second = delivery(spark, ("c", "1", "Engineer Intern", "Y", None), ("c", "4", "Clerk", "X", None))
    counts = {r.bucket: r.n for r in run.run(second, scope, "2025-01-02 00:00:00").collect()}
    assert counts == {"keep": 1, "reject": 1, "delisted": 1}
    rows = {r.source_external_id: r for r in store.read("listings", LISTINGS).collect()}
    assert (rows["1"].location, rows["1"].first_seen, rows["5"].is_listed) == ("Y", dt.datetime(2025, 1, 1), False)

    third = delivery(spark, ("c", "5", "Data Intern", "X", None))  # comes again
    run.run(third, scope.limit(0), "2025-01-03 00:00:00")
    rows = {r.source_external_id: r.is_listed for r in store.read("listings", LISTINGS).collect()}
    assert rows == {"1": True, "5": True}

    carrier = delivery(spark, ("d", "9", "Web Intern", "Z", [("c", "8")]))
    run.run(carrier, scope.limit(0), "2025-01-04 00:00:00")
    run.run(delivery(spark, ("c", "8", "Web Intern II", "Z", None)), scope.limit(0), "2025-01-05 00:00:00")
    rows = {r.source_external_id: r.is_listed for r in store.read("listings", LISTINGS).collect()}
    assert rows["9"] is False and rows["8"] is True


def test_store_guards(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.number == 0 and store.read("t", "a int").count() == 0
    assert store.publish({"t": spark.range(3).selectExpr("cast(id as int) a")}, {"x": 1}) == 1
    assert store.publish({"u": spark.range(1).selectExpr("cast(id as int) a")}, expected=1) == 2
    assert store.read("t", "a int").count() == 3 and store.offsets == {"x": 1}
    with pytest.raises(RuntimeError):
        store.publish({}, expected=1)


def test_store_survives_crashes(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path), parts=4)
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as int) a")
    read = lambda: sorted(r.a for r in store.read("t", "a int").collect())
    store.publish({"t": rows(0, 3)}, {"x": 1})
    publish = store.pointers.publish
    for when in ("before", "after"):  # the tables are written, the pointer isn't; or it is, and nobody was told

        def dies(document, expected):
            if when == "after":
                publish(document, expected)
            raise OSError("lost")

        monkeypatch.setattr(store.pointers, "publish", dies)
        with pytest.raises(OSError):
            store.publish({"t": rows(10, 12)}, {"x": 2})
        monkeypatch.setattr(store.pointers, "publish", publish)
        assert (read(), store.offsets) == (([0, 1, 2], {"x": 1}) if when == "before" else ([10, 11], {"x": 2}))
    # Between: a half-written file under a name of its own is no state.
    (tmp_path / ".half").write_text("{")
    assert store.number == 2 and read() == [10, 11]
    # Of two writers that read the same state one fails.
    with pytest.raises(Conflict):
        publish({"tables": {}, "offsets": {}}, 1)
    assert store.publish({"t": rows(0, 1)}) == 3


def test_store_rewrites_touched_parts_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), parts=4)
    keyed = lambda n, v: spark.createDataFrame([(i, v) for i in range(n)], "k int, v string")
    store.publish({"t": keyed(40, "old")}, keys={"t": ["k"]})
    one = store.part_of(["k"]) == 1
    for n in range(4):
        store.publish({"t": keyed(40, f"new{n}").where(one)}, keys={"t": ["k"]}, only={"t": [1]})
    got = {r.k: r.v for r in store.read("t", "k int, v string").collect()}
    touched = {r.k for r in keyed(40, "").where(one).collect()}
    assert touched and {k for k, v in got.items() if v == "new3"} == touched and len(got) == 40
    assert {r.k for r in store.read("t", "k int, v string", only=[1]).collect()} == touched
    folders = [p.name for p in (tmp_path / "t").iterdir()]
    assert len(folders) == 4 and any(f.startswith("snapshot=1-") for f in folders)  # untouched parts stay where they are


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        delivery(spark, ("c", str(i), f"Engineer Intern {i}", "X", None)).coalesce(1).write.mode("append").parquet(folder)
    store = SnapshotStore(spark, str(tmp_path / "state"))
    q = stream_refresh(spark, folder, DELIVERY, Refresh(store, CASCADE), str(tmp_path / "cp"), lambda n: f"2025-01-0{n + 1} 00:00:00", boards_per_batch=2)
    q.awaitTermination(120)
    assert store.read("listings", LISTINGS).count() == 3 and store.offsets["batch"] == 1
    events = spark.readStream.schema("ts timestamp, source string").parquet(folder + "2") if (tmp_path / "in2").mkdir() is None else None
    assert recent_by_source(events, "ts", "source").isStreaming


def test_stream_scopes_and_failed_batches(spark, tmp_path):
    """An empty board delists, one not modified counts as seen, and the rows of a failed batch come again."""
    schema = DELIVERY + ", status string"
    folder = str(tmp_path / "in")
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    row = lambda i, co: ("c", i, co, f"Engineer Intern {i}", "X", "text", None, None, None)
    mark = lambda co, status: ("c", None, co, None, None, None, None, None, status)
    store = SnapshotStore(spark, str(tmp_path / "state"))
    failures, told = [], []
    classes = {"fail": False}

    class Run(Refresh):
        def run(self, *a, **k):
            if classes["fail"]:
                raise OSError("lost")
            return super().run(*a, **k)

    go = lambda: stream_refresh(spark, folder, schema, Run(store, CASCADE, delisting_sources=("c",)), str(tmp_path / "cp"), lambda n: f"2025-01-0{n + 1} 00:00:00", 50, lambda n, e: failures.append(n)).awaitTermination(300)
    put("a", [row("1", "Acme"), row("2", "Beta"), row("3", "Gamma")])
    go()
    classes["fail"] = True
    put("b", [row("4", "Acme"), row("1", "Acme")])
    go()
    assert failures == [1] and store.offsets["batch"] == 0
    classes["fail"] = False
    put("c", [mark("Beta", None), mark("Gamma", "not_modified")])
    go()
    got = {r.source_external_id: (r.is_listed, r.last_seen.day) for r in store.read("listings", LISTINGS).collect()}
    assert got == {"1": (True, 3), "2": (False, 1), "3": (True, 3), "4": (True, 3)}


def test_normalisers(spark):
    a = spark.createDataFrame([(1, "T ", "&lt;p&gt;a&lt;/p&gt;", "u", " Co ", ("X",), [("D",)], "2025-01-01T00:00:00Z"), (2, "T", None, "u", None, None, None, None)], FEED_A)
    r = S.normalise_a(a).collect()
    assert [(x.source_external_id, x.company, x.description_plain, x.department) for x in r] == [("1", "Co", "a", "D")]
    b = spark.createDataFrame([("i", "T", ("Intern", "L", None, "Team"), "d", "p", "u", "unspecified", (1.5, 1e12, "USD", "Annual"), 1735689600000)], FEED_B).selectExpr("*", "'acme-co' as board")
    x = S.normalise_b(b, "board").first()
    assert (x.company, x.employment_type, x.workplace_type, x.department, x.published_at) == ("Acme Co", "intern", None, "Team", dt.datetime(2025, 1, 1))
    assert (float(x.comp_min), x.comp_max, x.comp_currency, x.comp_interval) == (1.5, None, "USD", "yearly")
    pay = ([("EquityCashValue", "1 YEAR", "USD", None, None), ("Salary", "1 HOUR", "USD", 20.0, float("nan"))],)
    c = spark.createDataFrame([("1", "T", None, "FullTime", None, "Jan 5, 2025 10:00 AM", True, True, None, "u", "h", "p", pay), ("2", "T", None, None, None, None, False, True, None, "u", "h", "p", None), ("3", "T", None, "Full-time", None, "2025-01-05", True, False, None, "u", "h", "p", None)], FEED_C).selectExpr("*", "'b' as board")
    zones = spark.createDataFrame([("b", "America/New_York", "mdy")], "board string, tz string, date_style string")
    got = {x.source_external_id: x for x in S.normalise_c(c, "board", zones).collect()}
    assert {(i, x.employment_type, x.workplace_type) for i, x in got.items()} == {("1", "full_time", "remote"), ("3", None, None)}
    assert (got["1"].published_at, got["3"].published_at) == (dt.datetime(2025, 1, 5, 15), dt.datetime(2025, 1, 5, 5))
    assert (float(got["1"].comp_min), got["1"].comp_max, got["1"].comp_interval, got["3"].comp_min) == (20.0, None, "hourly", None)
    d = spark.createDataFrame([("1", "Co", "T<", "https://h/j/AB12", [" X", None, ""], "Quant", ["Fall"], [], "Does Not Offer Sponsorship", 1748779200, True, True), ("2", " ", "T", "u", None, None, None, None, None, None, True, True)], FEED_D)
    x = S.normalise_d(d, [("h", "/j/([0-9A-F]+)")]).collect()
    assert len(x) == 1 and (x[0].location, x[0].preclassified.field, x[0].preclassified.citizenship, x[0].published_at) == ("X", "quant", "no_sponsorship", dt.datetime(2025, 6, 1, 12))
    assert x[0].duplicate_keys == [("h", "ab12")] and x[0].description_plain.startswith("Category: Quant. Term: Fall. Locations: X. ")
    listing = spark.createDataFrame([], LISTING).columns
    assert all(n(f).columns == listing for n, f in ((S.normalise_a, a), (S.normalise_d, d)))


PAGES = {"full": [{"i": n} for n in range(5)], "empty": [], "odd": [{"i": 1}, {"j": 2}], "kept": [{"i": 0}], "gap": [{"i": n} for n in range(3)]}


def fetch(board, offset, size, validator):
    if board == "down":
        raise OSError("refused")
    if validator == "same":
        return "not_modified", [], validator
    if board == "gap" and offset == 0:
        raise OSError("page lost")
    return "ok", PAGES[board][offset : offset + size], "tag"


def test_paged_source(spark):
    spark.dataSource.register(S.PagedFeed)
    reader = spark.read.format("postmill_feed").option("fetcher", "test_flow:fetch").option("page_size", 2).option("required", "i")
    fetched = reader.option("boards", "full,empty,down,kept,odd").option("validators", json.dumps({"kept": "same"})).load().cache()
    by = {}
    for r in fetched.collect():
        by.setdefault(r.board, []).append(r)
    assert [json.loads(r.payload)["i"] for r in by["full"] if r.payload] == [0, 1, 2, 3, 4] and by["full"][-1].status == "complete"
    assert (by["empty"][0].status, by["empty"][0].payload) == ("empty", None) and by["kept"][0].status == "not_modified" and "refused" in by["down"][0].error
    assert by["odd"][-1].status == "error"
    assert {(r.board, r.validator) for r in S.complete_boards(fetched).collect()} == {("full", "tag"), ("empty", "tag")}
    full = reader.option("boards", "kept").option("validators", json.dumps({"kept": "same"})).option("full", "true").load()
    assert {r.status for r in full.collect()} == {"ok", "complete"}
    skipped = reader.option("boards", "gap").option("pages", "skip").load().collect()
    assert [json.loads(r.payload)["i"] for r in skipped if r.payload] == [2]
    code = spark.createDataFrame([("ok", None, 3, 200), ("ok", None, 0, 200), ("error", "x", 0, 500), ("ok", None, 0, 429)], "status string, error string, records int, code int")
    assert [r[0] for r in code.select(S.board_outcome(*map(F.col, code.columns))).collect()] == ["valid", "empty", "error", "rate_limited"]


INDEX = {"a": ['{"url": "https://b.example/One/x"}\nnot json\n{"url": "https://b.example/two"}', None, '{"url": "https://b.example/one"}\n{"no": 1}\n[]']}


def fetch_index(crawl, host, page):
    if host not in INDEX:
        raise OSError("no such host")
    if page is None:
        return len(INDEX[host])
    if INDEX[host][page] is None:
        raise OSError("page lost")
    return INDEX[host][page]


def test_discovery(spark, tmp_path):
    (tmp_path / "crawls.json").write_text('[{"id": "2026-10"}, {"id": "2026-05"}]')
    assert S.crawl_list(spark, str(tmp_path / "crawls.json")) == ["2026-10", "2026-05"]
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        S.crawl_list(spark, str(tmp_path / "none.json"))
    spark.dataSource.register(UrlIndex)
    urls = spark.read.format("postmill_index").option("fetcher", "test_flow:fetch_index").option("hosts", "a,z").option("crawl", "2026-10").option("base", "0").load().cache()
    assert {(r.host, r.page, r.error) for r in urls.where("error is not null").collect()} == {("a", 1, "page lost"), ("z", None, "no such host")}
    targets = spark.createDataFrame([("s", "one", False, None, None)], "source string, token string, is_active boolean, company string, last_seen_in_discovery_at timestamp")
    validate = lambda tokens: tokens.withColumn("outcome", F.when(F.col("token") == "two", "empty").otherwise("valid"))
    now = F.lit("2025-01-01").cast("timestamp")
    after, asked = discover(spark, urls, url_segment(F.col("url"), ["b.example"]), "s", targets, validate, now)
    assert {(r.token, r.is_active, r.last_seen_in_discovery_at is None) for r in after.collect()} == {("one", False, False), ("two", True, False)} and asked.count() == 2
    out = spark.createDataFrame([("s", "one", "boom", None, None), ("s", "two", None, "Two Co", "e1")], "source string, token string, error string, company string, etag string")
    rows = {r.token: r for r in L.crawl_health(after.withColumns({"last_crawled_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string"), "etag": F.lit("e0")}), out, ["source", "token"], now).collect()}
    assert (rows["one"].last_error, rows["one"].etag, rows["two"].company, rows["two"].etag) == ("boom", "e0", "Two Co", "e1")
    assert [r.source for r in L.source_scope(after.withColumn("source", F.concat("source", F.when(F.col("is_active"), "1").otherwise("2")))).collect()] == ["s1"]
    one = spark.createDataFrame([(1, "x")], "id int, v string")
    assert L.ensured(one.limit(0), one, "id").collect() == L.ensured(one, one.withColumn("v", F.lit("y")), "id").collect() == one.collect()


def test_readers_of_evaluations(spark, tmp_path):
    (tmp_path / "rankings.json").write_text('[{"approach": "a", "rank": 0, "id": 7}]')
    (tmp_path / "labels.csv").write_text("id,company,title,url,label\n1,a,b,c,relevant\n")
    assert S.read_eval(spark, str(tmp_path), "rankings").first() == ("a", 0, 7) and S.read_eval(spark, str(tmp_path), "labels").first().label == "relevant"
    (tmp_path / "cv.txt").write_text("é")
    (tmp_path / "q.json").write_text('{"types": []}')
    assert S.read_profile(str(tmp_path / "cv.txt"), str(tmp_path / "q.json")) == ("é", {"types": []})


class Signer:
    def distill(self, title, body):
        if "Bad" in title:
            raise ValueError("no answer")
        return {"skills": ["JS ", "python"], "focus": f" builds {title} "}


def test_enrichment_and_reclassification(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    rows = [("c", str(i), "Co", t, "text", "intern", None, i != 3) for i, t in enumerate(["Web Intern", "Bad Intern", "Lab Intern", "Off Intern", "Clerk"])]
    listings = spark.createDataFrame(rows, "source string, source_external_id string, company string, title string, description_plain string, kind string, field string, is_listed boolean")
    run = lambda **k: Enrichment(store, Signer(), HashEmbedder(4), "m", 1, aliases={"js": "javascript"}, **k).run(listings)
    assert run() == {"scanned": 4, "signed": 3, "sign_failed": 1, "embedded": 3, "embed_failed": 0, "up_to_date": 0}
    assert run() == {"scanned": 4, "signed": 0, "sign_failed": 1, "embedded": 0, "embed_failed": 0, "up_to_date": 3}
    got = {r.source_external_id: r for r in store.read("enriched", ENRICHED).collect()}
    assert set(got) == {"0", "2", "4"} and all(len(r.embedding) == 4 and r.embedding_model == "m" for r in got.values()) and "javascript" in got["0"].signature
    assert run(prompt=2)["signed"] == 3 and {len(r.embedding) for r in store.read("enriched", ENRICHED).collect()} == {4}

    held = spark.createDataFrame([], LISTINGS).unionByName(listings, allowMissingColumns=True).select(*spark.createDataFrame([], LISTINGS).columns)
    store.publish({"listings": held}, keys={"listings": ["company"]})
    number = store.number
    dry = {r.source_external_id: r.outcome for r in reclassify(store, RuleClassifier(), "2025-01-01 00:00:00", dry_run=True).collect()}
    assert dry == {"0": "kept", "1": "kept", "2": "kept", "4": "delisted"} and store.number == number
    assert reclassify(store, RuleClassifier(), "2025-01-01 00:00:00").count() == 4
    assert {r.source_external_id: r.is_listed for r in store.read("listings", LISTINGS).collect()} == {"0": True, "1": True, "2": True, "3": False, "4": False}
    assert [r.source_external_id for r in store.read("rejects", REJECTS).collect()] == ["4"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "active": True, "is_visible": True}, {"id": "2", "active": True, "is_visible": False}]))
    assert [r.id for r in S.curated_feed(spark, str(tmp_path / "a.json")).collect()] == ["1"]
    (tmp_path / "b.json").write_text('{"url": "x"}\nnot json\n{"url": "y"}\n')
    assert S.read_lines(spark, str(tmp_path / "b.json"), "url string").where("url is not null").count() == 2
    (tmp_path / "c.csv").write_text('id,company,title,url,label\n1,"A ""B"", C",t,u,relevant\n')
    assert S.read_labels(spark, str(tmp_path / "c.csv")).first().company == 'A "B", C'


def test_sinks(spark, tmp_path):
    from postmill.sources.sinks import write_csv, write_json

    df = spark.createDataFrame([(1, 'a "b"', "t", "u", "relevant")], "id bigint, company string, title string, url string, label string")
    write_csv(df, str(tmp_path / "c"))
    assert S.read_labels(spark, str(tmp_path / "c")).collect() == df.collect()
    write_json(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == df.collect()


def stored_rows(store):
    return {(r.source, r.source_external_id): (r.is_listed, [tuple(k) for k in r.duplicate_keys or []], r.last_seen.day) for r in store.read("listings", LISTINGS).collect()}


def test_refresh_folds_later_copies(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    run = Refresh(store, CASCADE, delisting_sources=("c",))
    scope = spark.createDataFrame([("c", "Acme")], "source string, company string")
    run.run(delivery(spark, ("c", "1", "Engineer Intern", "X", None), ("c", "8", "Web Intern", "Z", None), ("d", "5", "Data Intern", "Y", [("c", "9")])), scope.limit(0), "2025-01-01 00:00:00")
    # The same role under another id and in another feed, an alias of a stored row, and one in the batch.
    again = delivery(spark, ("c", "2", "Engineer Intern", "X ", None), ("d", "7", "Web Intern", "Z", None), ("d", "3", "Web Dev Intern", "Z", [("c", "8")]), ("c", "6", "Lab Intern", "V", None), ("d", "6", "Lab Intern II", "V", [("c", "6")]))
    for day in (2, 3):  # suppressed each time
        run.run(again, scope.limit(0), f"2025-01-0{day} 00:00:00")
        assert stored_rows(store) == {
            ("c", "1"): (True, [("c", "2")], day),
            ("c", "8"): (True, [("d", "3"), ("d", "7")], day),
            ("c", "6"): (True, [("d", "6")], day),
            ("d", "5"): (True, [("c", "9")], 1),
        }
    # The row that a carrier aliases is written: the carrier retires and its key is kept.
    run.run(delivery(spark, ("c", "9", "Data Intern II", "Y", None)), scope.limit(0), "2025-01-04 00:00:00")
    rows = stored_rows(store)
    assert rows[("c", "9")] == (True, [("d", "5")], 4) and rows[("d", "5")][0] is False
    # A folded key is no alias: its own row may come without the owner's being retired.
    run.run(delivery(spark, ("d", "7", "Robot Intern", "Z", None)), scope.limit(0), "2025-01-05 00:00:00")
    rows = stored_rows(store)
    assert rows[("c", "8")][0] and rows[("d", "7")][0]
    # A full snapshot without the owner delists it first, so the repost is a listing of its own.
    run.run(delivery(spark, ("c", "2", "Engineer Intern", "X", None)), scope, "2025-01-06 00:00:00")
    rows = stored_rows(store)
    assert not rows[("c", "1")][0] and rows[("c", "2")][0]


def test_refresh_siblings_of_several_sources(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    run = Refresh(store, CASCADE)
    none = spark.createDataFrame([], "source string, company string")
    run.run(delivery(spark, ("c", "1", "Engineer Intern", "X", None), ("d", "9", "Engineer Intern", "X", None), ("c", "2", "Web Intern", "X", None), ("d", "2", "Web Intern", "X", None)), none, "2025-01-01 00:00:00")
    assert stored_rows(store) == {("c", "1"): (True, [("d", "9")], 1), ("c", "2"): (True, [("d", "2")], 1)}


class Extractor:
    def extract(self, title, body):
        if "Web" in title:
            raise ValueError("no answer")
        return {"grad_year_min": 2027, "grad_year_max": "soon", "degree_status": "bachelor", "application_deadline": "2025-03-01"}


def test_refresh_fills_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    terms = spark.createDataFrame([("utah", False, 1, "US", "UT"), ("france", False, 2, "FR", None)], "term string, exact boolean, priority int, country string, region string")
    run = Refresh(store, CASCADE, places=terms, extractor=Extractor())
    none = spark.createDataFrame([], "source string, company string")
    plain = delivery(spark, ("c", "1", "Engineer Intern", "Utah", None), ("c", "2", "Web Engineer Intern", "France", None), ("c", "3", "Engineer Intern II", "Mars", None), ("d", "4", "Manager", "Utah", None))
    told = plain.selectExpr("*", "if(source_external_id in ('2', '3'), timestamp'2025-02-01', null) application_deadline", "if(source = 'd', 'new grad', null) preclassified_kind")
    run.run(told, none, "2025-01-01 00:00:00")
    rows = {r.source_external_id: r for r in store.read("listings", LISTINGS).collect()}
    assert {i: (r.countries, r.regions) for i, r in rows.items()} == {"1": (["US"], ["UT"]), "2": (["FR"], []), "3": ([], []), "4": (["US"], ["UT"])}
    assert {i: (r.grad_year_min, r.grad_year_max, r.degree_status) for i, r in rows.items()} == {"1": (2027, None, "bachelor"), "2": (None,) * 3, "3": (2027, None, "bachelor"), "4": (None,) * 3}
    assert {i: r.application_deadline and r.application_deadline.month for i, r in rows.items()} == {"1": 3, "2": 2, "3": 2, "4": None}
    assert rows["4"].kind == "new grad"
    run.run(delivery(spark, ("c", "1", "Engineer Intern", "France", None)), none, "2025-01-02 00:00:00")  # an edit makes the facets again
    row = store.read("listings", LISTINGS).where("source_external_id = '1'").first()
    assert (row.countries, row.grad_year_min, row.application_deadline.month) == (["FR"], 2027, 3)


def test_command_line(spark, tmp_path, capsys):
    put = lambda name, df: df.write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    first = put("d", delivery(spark, ("c", "1", "Engineer Intern", "X", None), ("c", "2", "Clerk", "X", None)))
    scopes = put("s", spark.createDataFrame([("c", "Acme")], "source string, company string"))
    state = str(tmp_path / "state")
    cli.main(["--now", "2025-01-01 00:00:00", "refresh", state, first, scopes])
    assert SnapshotStore(spark, state).read("listings", LISTINGS).count() == 1
    cli.main(["enrich", state])
    assert "'embedded': 1" in capsys.readouterr().out
    cli.main(["reclassify", state, "--dry-run"])
    assert "kept" in capsys.readouterr().out
    targets = put("t", spark.createDataFrame([("s", "one", True, None)], "source string, token string, is_active boolean, last_seen_in_discovery_at timestamp"))
    urls = put("u", spark.createDataFrame([("https://b.example/two/x",)], "url string"))
    cli.main(["discover", targets, urls, str(tmp_path / "found"), "--host", "b.example", "--source", "s"])
    assert {r.token for r in spark.read.parquet(str(tmp_path / "found")).collect()} == {"one", "two"}
    ranked = put("r", spark.createDataFrame([(1, 0), (2, 1)], "id bigint, rank int"))
    labels = put("l", spark.createDataFrame([(1, "relevant"), (2, "irrelevant")], "id bigint, label string"))
    cli.main(["eval", "score", ranked, labels, str(tmp_path / "scores"), "--k", "2"])
    assert tuple(spark.read.parquet(str(tmp_path / "scores")).first()) == (0.5, 0.5, 1.0)
    cli.main(["eval", "pool", ranked, ranked, "--k", "1"])
    assert "place" in capsys.readouterr().out
