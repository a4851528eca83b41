import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from postmill.functions import contracts as C
from postmill.functions import text as X
from postmill.functions.models import HashEmbedder, RateGate, RuleClassifier, Transient, classify, embed, with_retry
from postmill.functions.profile import Conflict, Guarded, LatestSlot, Version, active_profile, baseline_profile_text, needs_new_vector, profile_text, save_answers
from postmill.operators import dedup as D
from postmill.operators import lifecycle as L
from postmill.operators import predicates as P
from postmill.operators import rank as R
from postmill.operators import evaluate as E
from postmill.operators.cards import badge, card_order, days_left, page_count, page_of, ranked_groups, recommendation, role_groups, variant_row
from postmill.operators.location import dictionary, location_facets
from postmill.operators.evaluate import allocate, holdout, ndcg_at_k, precision_at_k, stratified_sample
from postmill.operators.facets import facet_counts, rail
from postmill.operators.rules import Cascade, counters, decide, route
from postmill.schema import clean, dedup_key, mapped, parse_vector, valid_keys, vector_text

T0 = dt.datetime(2025, 1, 1)


def one(spark, column, *values, schema="v string"):
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, X.html_to_text(v), "<p>a&amp;b</p><ul><li>x</li><li>&#8364;&#x41;&bogus;</li></ul> <b>c</b>  d") == "a&b\n\nx\n\n€A&bogus;\n c d"
    assert one(spark, X.html_to_text(v), None) is None
    assert one(spark, X.escape_html(v), '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, X.display_name(v), "acme-big_co.inc") == "Acme Big Co Inc"
    assert [one(spark, X.min_years(v), t) for t in ("0-3 years", "5+ years or 2 years", "in 2020 years", "2 — 4 + yearly", "none", None)] == [0, 2, 2020, 2, None, None]
    assert [one(spark, X.stated_year(v), t) for t in ("2026", "2026-08", "2026-07", "2026-13", "x")] == [2026, 2027, 2026, None, None]
    assert str(one(spark, X.strict_date(v), "2025-02-28")) == "2025-02-28" and one(spark, X.strict_date(v), "2025-02-30") is None
    assert one(spark, X.url_segment(v, ["h.example"], ["embed"], "for"), "https://h.example/Embed?for=X") == "embed"
    assert one(spark, X.url_segment(v, ["h.example"], ["embed"], "for"), "https://h.example/embed?for=X") == "x"
    assert one(spark, X.url_segment(v, ["h.example"]), "not a url") is None
    assert one(spark, X.url_key(v, [("s", r"/j/([0-9A-F]+)")])["source_external_id"], "x/j/AB1") == "ab1"
    assert one(spark, X.label_of_line(v, ["relevant"]), "1,a,relevant,,") == "relevant"
    assert one(spark, X.grounded(F.lit("A  b"), v), "x a\nB y") is True and one(spark, X.grounded(F.lit(""), v), "x") is False
    assert one(spark, X.fingerprint(1, F.lit(None).cast("string")) == X.fingerprint(1, F.lit("")), "x") is False
    assert one(spark, clean("v"), " ﻿ a\t\n") == "a"
    assert one(spark, mapped(v, {"x": "y"}), " X ") == "y" and one(spark, mapped(v, {"x": "y"}), None) is None
    assert one(spark, F.size(valid_keys(v)), '[{"source":"a","source_external_id":"1"},{"source":"a"},{}]') == 1
    assert one(spark, F.size(valid_keys(v)), "junk") == 0
    assert one(spark, parse_vector(v), "[1,2.5]") == [1.0, 2.5] and one(spark, parse_vector(v), "[]") is None and one(spark, parse_vector(v), "x") is None
    assert one(spark, vector_text(F.array(F.lit(1.5))), "x") == "[1.5]"
    terms = F.array(F.lit(" JS"), F.lit(None).cast("string"), F.lit("js"), F.lit("a"), F.lit(""))
    assert one(spark, X.canonical_terms(terms, {"js": "javascript"}), "x") == ["a", "javascript"]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "50%_off", "a", ["x", None]), (2, "plain", None, []), (3, None, "b", None)], "id int, t string, v string, a array<string>")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(P.contains_any(("t",), "%_O")) == [1]
    assert ids(P.in_or_none("v", ("a", "none"))) == [1, 2] and ids(P.in_or_none("v", ("b",))) == [3]
    assert ids(P.overlaps("a", ("x",))) == [1] and ids(P.keeps_null_in("v", ["a"])) == [1, 2] and ids(P.keeps_null_not_in("v", ["a"])) == [2, 3]
    assert ids(P.location_allowed([("a", ("y",))], F.lit(False), False)) == [2, 3]
    p = P.SearchParams(values={"v": ("a",)}, overlaps={"a": ("x",)})
    assert ids(P.build_where(p)) == [1] and ids(P.build_where(p, frozenset({"v", "a"}))) == [1, 2, 3]
    got = P.parse_params({"q": " x ", "page": "-3", "per": "5000", "kind": "a,zz"}, {"kind": ["a", "b"]})
    assert (got.text, got.page, got.per, got.values) == ("x", 1, 200, {"kind": ("a",)})
    assert P.parse_params({"page": "x"}, {}).per == 50


def test_cards(spark):
    rows = [(" A", "t", T0, T0), ("A ", "t", T0 + dt.timedelta(1), None), ("B", "t", T0, T0 + dt.timedelta(9)), (None, "t", T0, T0), ("C", "t", T0, None)]
    df = spark.createDataFrame(rows, "c string, t string, s timestamp, d timestamp")
    g = role_groups(df, "c", "t", "s", deadline="d")
    assert {(r.company, r.n_variants) for r in g.collect()} == {("A", 2), ("B", 1), ("C", 1)}
    now = F.lit(T0 + dt.timedelta(1))
    assert [r.company for r in page_of(g, card_order("deadline", now), 1, 10).orderBy("place").collect()] == ["B", "C", "A"]
    assert [(r.company, r.place) for r in page_of(g, card_order("seen"), 2, 2).collect()] == [("C", 2)]
    assert page_count(0, 10) == 1 and page_count(21, 10) == 3
    assert one(spark, days_left(F.lit(T0 + dt.timedelta(hours=25)), F.lit(T0)), "x") == 2
    with pytest.raises(ValueError):
        card_order("nope")


def test_facets(spark):
    df = spark.createDataFrame([("A", "t", "x", ["p", "p ", None]), ("A ", "t", "x", ["q"]), ("B", "t", None, None)], "c string, t string, v string, a array<string>")
    got = {(r.facet, r.value): r.n for r in facet_counts(df, P.SearchParams(values={"v": ("x",)}), {"v": "none", "a": "array"}, "c", "t").collect()}
    assert got == {("v", "x"): 1, ("v", "none"): 1, ("a", "p"): 1, ("a", "q"): 1}
    counts = spark.createDataFrame([("x", 5), ("y", 9), ("z", 9)], "value string, n bigint")
    assert [tuple(r) for r in rail(counts, ["x", "w"], 3).collect()] == [("x", 5), ("w", 0), ("y", 9)]


def test_rules_conserve(spark):
    cascade = Cascade(accept_all=("engineer", "intern"), veto="intern", reject_any=("manager",))
    rows = [(1, "Engineer Intern", None), (2, "Manager", ""), (3, "Manager Intern", "5 years"), (4, "Clerk", "3+ years"), (5, None, None), (6, "Interned éintern", "")]
    df = route(spark.createDataFrame(rows, "id int, t string, b string"), cascade, "t", "b")
    assert {r.id: r.route for r in df.collect()} == {1: "accept", 2: "title_drop", 3: "years_drop", 4: "years_drop", 5: "model", 6: "model"}
    done = decide(df.withColumns({"ok": F.lit(True), "kind": F.when(F.col("id") == 5, "x"), "err": F.when(F.col("id") == 6, "e")}), "ok", "kind", "err")
    assert {r.id: r.bucket for r in done.collect()} == {1: "keep", 2: "title_drop", 3: "years_drop", 4: "years_drop", 5: "keep", 6: "error_skip"}
    assert sum(r.n for r in counters(done, "bucket").collect()) == 6


def test_dedup(spark):
    rows = [("2", "A ", "t", None), ("1", "A", "t", ""), ("3", "A", "t", "x"), ("1", "A", "t", "")]
    df = spark.createDataFrame(rows, "id string, c string, t string, l string")
    got = {r.id: r.siblings for r in D.survivors(df, dedup_key("c", "t", "l"), "id").collect()}
    assert got == {"1": ["2"], "3": []}
    stored = spark.createDataFrame([("9", "A", "t", None, True), ("0", "A", "t", None, False), ("3", "A", "t", "x", True)], "id string, c string, t string, l string, on boolean")
    assert {(r.id, r.outcome) for r in D.owners(df, stored, "c", "t", "l", "id", "on").collect()} == {("2", "other"), ("1", "other"), ("3", "self")}
    back = {r.id: (r.on, r.gained) for r in D.collapse(stored.withColumn("l", F.lit(None).cast("string")), dedup_key("c", "t", "l"), "id", "on").collect()}
    assert back == {"9": (False, None), "0": (False, None), "3": (True, ["9"])}


def test_alias_pass_and_retire(spark):
    k = lambda s, i: (s, i)
    schema = "key struct<source:string,source_external_id:string>, keys array<struct<source:string,source_external_id:string>>"
    batch = spark.createDataFrame([(k("d", "1"), [k("c", "9"), k("c", "7")]), (k("c", "7"), None), (k("d", "2"), [k("c", "5")]), (k("d", "3"), [k("x", "1")])], schema)
    stored = spark.createDataFrame([(k("c", "5"), [], True), (k("c", "9"), [], False), (k("d", "8"), [k("c", "7"), k("b", "1")], True)], schema + ", on boolean")
    left, more = D.alias_pass(batch, stored, "key", "keys", "on")
    assert {tuple(r.key): [tuple(x) for x in r["keys"]] for r in left.collect()} == {("c", "7"): [("c", "9"), ("d", "1")], ("d", "3"): [("x", "1")]}
    assert {(tuple(r.target), tuple(tuple(x) for x in r["keys"])) for r in more.collect()} == {(("c", "5"), (("d", "2"),))}
    out = D.retire_carriers(left, stored, "key", "keys", "on").collect()
    assert [(tuple(r.carrier), tuple(r.target), {tuple(x) for x in r.fold}) for r in out] == [(("d", "8"), ("c", "7"), {("d", "8"), ("b", "1")})]


def test_lifecycle(spark):
    stored = spark.createDataFrame([("a", "x", 1, True), ("b", "x", 1, True), ("c", "y", 1, True), ("d", "x", 1, False)], "id string, scope string, v int, on boolean")
    new = spark.createDataFrame([("a", "x", 2, True), ("e", "x", 3, True)], stored.schema)
    scopes = spark.createDataFrame([("x",)], "scope string")
    assert [r.id for r in L.delisted(stored, new, scopes, ["scope"], ["id"], "on").collect()] == ["b"]
    assert L.delisted(stored, new.limit(0), scopes, ["scope"], ["id"], "on").count() == 2  # an empty snapshot delists
    assert L.delisted(stored, new.limit(0), scopes.limit(0), ["scope"], ["id"], "on").count() == 0  # not modified doesn't
    merged = L.merge(stored, new, ["id"], once=["v"])
    twice = L.merge(merged, new, ["id"], once=["v"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, twice.collect()))
    assert {r.id: r.v for r in merged.collect()} == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 3}
    assert {r.id for r in L.merge(stored, new, ["id"], insert=False).collect()} == {"a", "b", "c", "d"}
    assert L.insert_new(stored, new.union(new), ["id"]).count() == 5
    seen = L.partition_seen(new, stored, stored.where("id = 'a'"), ["id"])
    assert {r.id: r.seen for r in seen.collect()} == {"a": "reject", "e": "unseen"}
    names = spark.createDataFrame([("x", " A"), ("x", "A"), ("x", ""), ("y", "A"), ("y", "B"), ("z", None)], "b string, c string")
    assert {r.b: r.company for r in L.board_company(names, "b", "c").collect()} == {"x": "A", "y": None, "z": None}
    assert L.changed_rows(stored, stored, ["id"], ["v"]).count() == 0
    days = spark.createDataFrame([("1", 30), ("2", 3), ("3", 9)], "d string, n int")
    assert L.walk_back(days, "d", "n", 25, 24).first().d == "1" and L.walk_back(days, "d", "n", 99, 2).first().d == "3"


def test_ranking(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, R.cosine(v(1, 0), v(1, 1)), "x") == pytest.approx(math.sqrt(0.5))
    assert one(spark, R.cosine(v(1, 0), v(1)), "x") is None and one(spark, R.cosine(v(0, 0), v(1, 1)), "x") is None
    now = F.lit(T0)
    assert one(spark, R.freshness(F.lit(T0 - dt.timedelta(30)), now), "x") == pytest.approx(0.5)
    assert one(spark, R.freshness(F.lit(T0 + dt.timedelta(30)), now), "x") == 1.0
    df = spark.range(100).select("id", (F.col("id") % 10).cast("double").alias("s"))
    ranked = R.global_rank(df, "s", "id")
    assert [r.id for r in ranked.orderBy("rank").limit(3).collect()] == [9, 19, 29] and ranked.agg(F.countDistinct("rank")).first()[0] == 100
    assert {r.band: r["count"] for r in R.bands(ranked).groupBy("band").count().collect()} == {"strong": 10, "good": 25, "fair": 65}
    with pytest.raises(ValueError):
        R.cosine_to(F.col("v"), [0.0])


def test_evaluation(spark):
    assert allocate({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert allocate({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 1} and allocate({}, 5) == {}
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)], "id int, cell string")
    assert sorted((r.id) for r in stratified_sample(df, "cell", "id", 4).collect()) == [0, 1, 2, 9]
    assert [r.id for r in holdout(df, "id").where("held_out").orderBy("id").collect()] == [4, 9]
    ranked = spark.createDataFrame([(0, "relevant"), (1, "borderline"), (2, None)], "rank bigint, label string")
    assert tuple(precision_at_k(ranked, 2).first()) == (0.5, 1.0)
    assert ndcg_at_k(ranked, 2, {"relevant": 2.0, "borderline": 1.0}).first()[0] == pytest.approx(1.0)
    assert ndcg_at_k(ranked.where("label is null"), 2, {"relevant": 2.0}).first()[0] == 0.0
    assert precision_at_k(ranked.limit(0), 2).first()[0] is None


def test_models(spark):
    class Broken(RuleClassifier):
        def classify(self, title, body):
            if title == "bad":
                raise RuntimeError("no")
            return super().classify(title, body)

    df = spark.createDataFrame([(1, "Intern", None), (2, "bad", ""), (3, None, None)], "id int, t string, b string")
    assert {(r.id, r.relevant, r.kind, r.error) for r in classify(df, Broken(), ["id"], "t", "b").collect()} == {(1, True, "intern", None), (2, None, None, "no"), (3, False, None, None)}
    out = {r.id: (r.vector and len(r.vector), r.error) for r in embed(df, HashEmbedder(8), ["id"], "t").collect()}
    assert out == {1: (8, None), 2: (8, None), 3: (None, "empty")}
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Transient
        return "ok"

    assert with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    slept = []
    gate = RateGate(0.5, 60, clock=lambda: 10.0, sleep=slept.append)
    gate.wait()
    gate.wait()
    gate.refused()
    gate.wait()
    assert slept == [0.5, 60.0]


def test_profile():
    assert active_profile(None, None, "m", 1)[0] == "none" and active_profile(Version("d"), Version("a"), "m", 1)[0] == "draft"
    assert active_profile(None, Version("a", (1.0,), "m", 1), "m", 1)[0] == "approved" and active_profile(None, Version("a", (1.0,), "m", 1), "m", 2)[0] == "stale"
    g = Guarded()
    assert g.publish("x", 0) == 1
    with pytest.raises(Conflict):
        g.publish("y", 0)
    slot = LatestSlot()
    first, second = slot.begin(), slot.begin()
    assert slot.finish(second, "b") and not slot.finish(first, "a") and slot.held == (2, "b")
    assert needs_new_vector("a", "b") and not needs_new_vector("a", "a")


def test_alias_pass_loses_no_key(spark):
    schema = "key struct<source:string,source_external_id:string>, keys array<struct<source:string,source_external_id:string>>"
    batch = spark.createDataFrame([(("c", "1"), [("d", "1")]), (("d", "1"), [("c", "1")]), (("e", "1"), [("d", "1")])], schema)
    left, more = D.alias_pass(batch, batch.limit(0).selectExpr("*", "true as on"), "key", "keys", "on")
    assert {tuple(r.key): [tuple(x) for x in r["keys"]] for r in left.collect()} == {("c", "1"): [("d", "1")], ("e", "1"): [("d", "1")]}
    assert more.count() == 0


def test_small_functions_of_the_survey(spark):
    from postmill.operators.cards import grad_window
    from postmill.operators.evaluate import judged, retained
    from postmill.operators.location import user_countries
    from postmill.schema import valid_signature

    years = spark.createDataFrame([(None, None), (2026, 2026), (2026, 2028), (2026, None), (None, 2028)], "a int, b int")
    assert [r[0] for r in years.select(grad_window(F.col("a"), F.col("b"))).collect()] == ["", "’26", "’26–’28", "’26+", "≤’28"]
    chosen = spark.createDataFrame([(["CA"], ["UT"]), (["US"], ["UT"]), (["CA"], []), (None, None)], "c array<string>, s array<string>")
    assert [r[0] for r in chosen.select(user_countries(F.col("c"), F.col("s"))).collect()] == [["CA", "US"], ["US"], ["CA"], []]
    sig = lambda skills='["a"]', focus='"f"', level='"l"', domains="[]": f'{{"skills": {skills}, "domains": {domains}, "level": {level}, "focus": {focus}}}'
    good = [sig(), sig(focus=f'"{"x" * 300}"'), sig(skills=str(["a"] * 20).replace("'", '"'))]
    bad = [sig("[]"), sig("[1]"), sig('["a", null]'), sig('"a"'), sig(str(["a"] * 21).replace("'", '"')), sig(focus='" "'), sig(focus=f'"{"x" * 301}"'), sig(focus="1"), sig(level='""'), sig(domains="null"), "[]", "no", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    assert [r.i for r in df.where(valid_signature(F.col("t")).isNotNull()).orderBy("i").collect()] == [0, 1, 2]
    ranked = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    labels = spark.createDataFrame([(1, "relevant"), (3, "irrelevant"), (4, "relevant"), (5, "")], "id int, label string")
    assert {r.id: r.label for r in judged(ranked, labels, 1).collect()} == {1: "relevant", 2: None}
    with pytest.raises(Exception, match="unlabelled item 2"):
        judged(ranked, labels, 2).collect()
    items = spark.createDataFrame([(1,), (3,), (5,)], "id int")
    assert [r.id for r in retained(labels, ranked, items).collect()] == [3]


LANDS = [("Ontaria", "Canadia", "OA", "Torvale"), ("Washfield", "Usonia", "WF", "Seaport"), ("Georgo", "Usonia", "GO", "Atlan"), (None, "Georgo", None, "Tbili"), (None, "Brazilo", None, "São Veldro"), ("Dee Cee", "Usonia", "DC", "Washfield")]


def test_locations(spark):
    places = spark.createDataFrame(LANDS, "region string, country string, region_code string, city string")
    terms = dictionary(places, [("US", "Usonia"), ("USA", "Usonia")], home="Usonia")
    values = {
        "Torvale, OA": (["Canadia"], []), "US-WF-Seaport": (["Usonia"], ["Washfield"]), "sao veldro": (["Brazilo"], []), "Atlan, Georgo": (["Usonia"], ["Georgo"]),
        "Washfield, D.C.": (["Usonia"], ["Dee Cee"]), "Seaport, Washfield": (["Usonia"], ["Washfield"]), "Remote within the Usonia": (["Usonia"], []), "Greater Seaport area (Hybrid) or Tbili": (["Georgo", "Usonia"], ["Washfield"]),
        "Remote": ([], []), "OR": ([], []), None: ([], []), "  ": ([], []), "oa": ([], []),
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, location string")
    got = {r.id: (r.countries, r.regions) for r in location_facets(df, ["id"], "location", terms, [(r"washfield[ ,]+d[.]? ?c[.]?", "Usonia", "Dee Cee")]).collect()}
    assert {v: got[i] for i, v in enumerate(values)} == values


def test_entities_and_tags(spark):
    v = F.col("v")
    cases = {"&amp;lt;": "&lt;", "&#x1F600;&#00065;": "😀A", "&#xD800;&#99999999999;&#;&x": "&#xD800;&#99999999999;&#;&x", "a &AMP; b": "a & b", "": "", "no entity": "no entity", "&#0169;": "©"}
    assert {t: one(spark, X.decode_entities(v), t) for t in cases} == cases
    assert one(spark, X.html_to_text(v), "<H2 class='x'>a</H2>\u00a0 b<br/>c<table><tr><td>d</td></tr></table><pre>e</pre>") == "a\n b\nc \n d \n e"
    assert one(spark, X.fingerprint(1, F.lit("a"), F.lit('b"')) == X.fingerprint(1, F.lit('a","b"')), "x") is False
    assert one(spark, X.text_fingerprint(v), "x") == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    now = F.lit("2026-01-01").cast("timestamp")
    assert [one(spark, F.struct(*X.plausible_years(v, now)), t) for t in ("2027-08", " 2025", "2034", "2020-01", "soon")] == [("2027-08", 2028), ("2025", 2025), (None, None), (None, None), (None, None)]


class Talker:
    def __init__(self, *answers):
        self.answers = list(answers)

    def answer(self, system, user, schema, temperature):
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    def profile(self, text):
        return {"skills": [{"name": "JS", "evidence": "used  js"}, {"name": "Rust", "evidence": "eager"}], "focus": {"text": " f ", "evidence": self.answers[0]}}


def test_contracts(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": ["string", "null"], "enum": ["x", None]}}}
    assert C.chat_json(Talker(Transient("429"), '{"a": [1], "b": null}'), "s", "u", schema, sleep=lambda _: None) == {"a": [1], "b": None}
    for bad in ('{"b": "x"}', '{"a": [true]}', '{"a": ["1"]}', "[]", '{"a": [], "b": 3}'):
        with pytest.raises(ValueError):
            C.chat_json(Talker(bad), "s", "u", schema)
    assert [C.model_for("extract", s, "d") for s in ({}, {"model": "m"}, {"model": "m", "model.extract": "e"})] == ["d", "m", "e"]
    assert one(spark, C.prompt_text(F.col("v"), ("Title", F.lit("T")), most=3), "abcdef") == "Title: T\n\nDescription:\nabc"
    raw = spark.createDataFrame([("2027-09", "1990", "maybe", "pursuing", "June 1"), (None, "2028", "no_sponsorship", None, "2026-02-03")], "grad_date_min string, grad_date_max string, citizenship_status string, degree_status string, application_deadline string")
    got = [r.asDict() for r in C.guarded_extract(raw, F.lit("2026-01-01").cast("timestamp"), ["no_sponsorship"], ["pursuing"]).collect()]
    assert (got[0]["grad_year_min"], got[0]["grad_date_max"], got[0]["grad_year_max"], got[0]["citizenship_status"], got[0]["application_deadline"]) == (2028, None, None, None, None)
    assert (got[1]["grad_year_max"], got[1]["application_deadline"].day, got[1]["citizenship_status"]) == (2028, 3, "no_sponsorship")
    assert C.extract_profile(Talker("Built X"), "I used js and built\n x", {"js": "javascript"}) == {"skills": ["javascript"], "focus": "f", "dropped": ["rust"]}
    with pytest.raises(ValueError):
        C.extract_profile(Talker("never said"), "I used js", {})
    assert profile_text(" did ", ["Intern"], ["swe"], " ml ") == "Experience: did\nSeeking: Intern roles in swe — ml" and profile_text("d", [], [], "").endswith("Seeking: early-career roles")
    assert baseline_profile_text("abcdef", ["Intern"], "", most=3) == "abc\nIntern"
    g = Guarded()
    assert save_answers(g, "a", "b", "p", 0, str) == "none"
    g.publish(("p", "v"), 0)
    assert save_answers(g, "a", "a", "q", 1, str) == "plain" and g.value == ("q", "v")
    assert save_answers(g, "a", "b", "r", 2, str.upper) == "embedded" and g.value == ("r", "B")
    with pytest.raises(Conflict):
        save_answers(g, "a", "a", "q", 1, str)


@pytest.mark.parametrize("target", [3, 20, 37, 150])
def test_allocation_by_windows_equals_the_driver(spark, target):
    sizes = {f"c{i:02d}": n for i, n in enumerate([1, 1, 2, 3, 5, 8, 13, 40, 40, 7, 1, 1])}
    counted = spark.createDataFrame(list(sizes.items()), "cell string, size bigint")
    assert {r.cell: r.seats for r in E._allocate_rows(counted, target).collect()} == E.allocate(sizes, target)


def test_evaluation_helpers(spark):
    ranked = spark.createDataFrame([(10, 0, "relevant"), (11, 1, "irrelevant"), (12, 2, "relevant"), (13, 3, None)], "id bigint, rank bigint, label string")
    assert {(r.id, r["rank"]) for r in E.project(ranked, ranked.where("id in (13, 12)")).collect()} == {(12, 0), (13, 1)}
    assert E.top_label_count(ranked, "relevant", 2).first().n == 1
    assert E.with_metadata(ranked.select("id"), spark.createDataFrame([(10, "t")], "id bigint, title string")).where("title is not null").count() == 1
    t = lambda day: dt.datetime(2025, 1, day)
    rows = spark.createDataFrame([(1, "A ", "T", 0.5, t(1), None), (2, "A", "T", 0.9, t(2), t(9)), (3, "B", "T", 0.9, t(1), None)], "id bigint, c string, t string, score double, seen timestamp, due timestamp")
    groups = ranked_groups(rows, "c", "t", "score", "seen", "id", F.lit("2025-01-02").cast("timestamp"), ["due"])
    got = page_of(groups, card_order("score"), 1, 10).orderBy("place").collect()
    assert [(r.company, r.best_score, r.any_new, [v.key for v in r.variants]) for r in got] == [("A", 0.9, True, [2, 1]), ("B", 0.9, False, [3])]
    shown = recommendation(rows, F.lit("2025-01-08 12:00:00").cast("timestamp"), "due", ["due"], ["id"]).orderBy("id").collect()
    assert [(r.days_left, r.unverified) for r in shown] == [(None, ["due"]), (1, []), (None, ["due"])]
    assert rows.withColumns({"status": F.lit("saved"), "note": F.lit(None).cast("string")}).select(variant_row(F.lit("2025-01-02").cast("timestamp"), "seen").alias("v")).orderBy("v").first().v == (False, "saved", None)
    assert one(spark, badge(F.col("v"), F.lit(True), "Selective"), "Co") == "Selective" and one(spark, badge(F.col("v"), F.lit(False), "Selective"), "Co") is None
    names = spark.createDataFrame([("b", "x"), ("A", "x"), ("a", "x"), ("B", "x")], "company string, title string")
    assert [r.company for r in names.orderBy(*card_order("company", locale=True)).collect()] == ["a", "A", "b", "B"]


def test_collapse_keeps_gained_keys_on_the_first_row(spark):
    df = spark.createDataFrame([("1", "k", True), ("2", "k", True), ("3", "k", False), ("4", "z", False)], "id string, k string, active boolean")
    got = {r.id: (r.active, r.gained) for r in D.collapse(df, [F.col("k")], "id", "active").collect()}
    assert got == {"1": (True, ["2"]), "2": (False, None), "3": (False, None), "4": (False, None)}
    assert {tuple(r) for r in D.sibling_rows(df, [F.col("k")], "id").collect()} == {("1", "2"), ("1", "3")}


def test_search_parameters_of_places_and_years():
    p = P.parse_params({"country": "us, ca", "gradYear": "2027", "sort": "score", "page": "x"}, {}, codes={"country": "countries"}, year=("gradYear", "low", "high"))
    assert p.overlaps == {"countries": ("US", "CA")} and p.window == ("low", "high", 2027) and p.sort == "score" and p.page == 1
    p = P.parse_params({"gradYear": "1990", "sort": "odd"}, {}, year=("gradYear", "low", "high"))
    assert p.window is None and p.sort == "seen"
