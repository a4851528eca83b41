import ast
import random
import string
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import spans as SP
from postmill.llm.encode import PrefixEncoder, encode_texts, load_ranks
from postmill.llm.history import AcceptedState, _owned_within, dedup_history, history_rows, one_slip, role_parts
from postmill.llm.leak import Blocks, find_leaks
from postmill.llm.lines import repeated_blocks, suffix_array, without_blocks
from postmill.llm.names import channel, link_names, name_pairs, words_of
from postmill.llm.neardup import BANDS, ROWS, NearDuplicates, Shingler, bands_of, dart_signature, mix
from postmill.llm.places import BKTree, distances, fold, resolve_places

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- names -----------------------------------------------------------------------------------------


def groups(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = {}
    for r in link_names(df).collect():
        out.setdefault(r.employer, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_names_link(spark):
    a = ["Folsespan Juniper Laboratories"] * 9 + ["Folsespan Juniper Labs", "Folsespan J. Laboratories", "FOLSESPAN JUNIPER LABORATORIES", "Fölsespan Juniper Laboratories", "FOLSESPANJUNIPERLABORATORIES",
         "Juniper Folsespan Laboratories", "FolsespanJuniperLaboratories", "Folsespaan Juniper Laboratories", "Folsespan", "Folsespan Juniper Laboratories GmbH", "FJL Careers"]
    b = ["Wewitras Juniper Laboratories"] * 5 + ["Wewitras Juniper Laboratories Inc"]
    # Remarks are learned from how they come and go, of one word or of several.
    more = [[n, n, f"{n} Careers", f"{n} - People Team"] for n in ("Korvan Ridge Systems", "Tilmes Canyon Robotics", "Druplo Harbor Energy")]
    got = groups(spark, [*a, *b, *sum(more, []), None, "", "  ", "!!"])
    assert got == sorted([sorted(set(a)), sorted(set(b)), *[sorted(set(m)) for m in more]])


def test_names_of_one_first_word_and_short_words(spark):
    """Another word in the place of one that was meant makes another employer, with variants of its own."""
    air = ["Delta Airlines"] * 9 + ["Delta Airlines Inc", "DELTA AIRLINES", "Delta Arlines"]
    dental = ["Delta Dental"] * 5 + ["Delta Dental LLC", "Delta Dentall"]
    nova = ["Nova Labs"] * 6 + ["Nvoa Labs", "Nova Labs Ltd"]
    got = groups(spark, [*air, *dental, *nova])
    assert got == sorted([sorted(set(air)), sorted(set(dental)), sorted(set(nova))])
    # A rare employer beside a frequent one of the same first word is gone through in a second round.
    got = groups(spark, [*["Delta Airlines"] * 400, *dental, "Delta Airlnes"])
    assert got == sorted([["Delta Airlines", "Delta Airlnes"], sorted(set(dental))])


def test_names_learned_shortenings(spark):
    names = [f"{w} Ridge {k}" for w in ("Korvan", "Tilmes", "Druplo") for k in ("Therapeutics", "Therapeutics", "Tx")]
    assert groups(spark, names) == [[f"{w} Ridge Therapeutics", f"{w} Ridge Tx"] for w in ("Druplo", "Korvan", "Tilmes")]


def test_names_pairs_and_ties(spark):
    df = spark.createDataFrame([("Korvan Systems",), ("Korvan Systems Inc",), ("Korvan Systems Inc",), (" Korvan Systems",)], "name string")
    pairs = {tuple(r) for r in name_pairs(link_names(df)).collect()}
    assert pairs == {(" Korvan Systems", "Korvan Systems"), (" Korvan Systems", "Korvan Systems Inc"), ("Korvan Systems", "Korvan Systems Inc")}
    assert link_names(df.limit(0)).count() == 0
    assert link_names(df.withColumns({"words": F.lit(1), "mark": F.lit(2), "n": F.lit(3), "form": F.lit(4)})).count() == 3


def test_names_channel():
    assert words_of("The Acme-Data Company") == [("acme", False), ("data", False)] and words_of("ABC Inc") == [("abc", True)] and words_of("Inc") == [("inc", False)]
    assert channel(["systems"], ["systems"]) == 0 and channel(["sys"], ["systems"]) == -1.5 and channel(["robotics"], ["systems"]) < -12
    assert channel(["tx"], ["therapeutics"]) < -12 and channel(["tx"], ["therapeutics"], frozenset({("tx", "therapeutics")})) == -1.5
    assert channel(["systems", "team"], ["systems"]) == -6 and channel([], ["systems"]) == -1
    assert channel(["networks", "ridge"], ["ridge", "networks"]) == 0


# --- near duplicates -------------------------------------------------------------------------------


def jaccard_pairs(rows, percent=70):
    sh, sets = Shingler(3, 20), {}
    for k, t, b in rows:
        if b is not None and (s := sh(f"{t or ''}\n{b}")) is not None:
            sets.setdefault(k, set()).add(tuple(s.tolist()))
    out = set()
    for a in sets:
        for b in sets:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        i = len(set(x) & set(y))
                        if i * 100 >= percent * (len(x) + len(y) - i):
                            out.add((a, b))
    return out


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choices(string.ascii_lowercase, k=5)) for _ in range(300)]
    base = [[r.choice(words) for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((f"k{i}", r.choice(["Title", None]), " ".join(t)))
    rows += [("copy1", "x", rows[0][2]), ("copy2", "x", rows[0][2]), ("copy2", "x", rows[0][2]), ("nul", "x", None), ("tiny", "x", "a b c"), ("empty", "", ""), ("long", None, " ".join(words * 60))]
    df = spark.createDataFrame(rows, "id string, title string, descriptionPlain string").withColumns({"k": F.lit(1), "cls": F.lit(2), "items": F.lit(3)})
    near = NearDuplicates(df)
    got = {tuple(x) for x in near.pairs().collect()}
    want = jaccard_pairs(rows)
    assert got == want and len(want) > 50
    links = {x.id: x.n_links for x in near.classes().collect()}
    assert all(links[k] == sum(k in p for p in want) for k in links) and "nul" not in links and "tiny" not in links
    assert NearDuplicates(df.limit(0)).pairs().count() == 0


def test_hot_class_is_not_expanded(spark, monkeypatch):
    monkeypatch.setattr("postmill.llm.neardup.ALL_PAIRS_WITHIN", 5)
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(f"k{i:02d}", "t", text) for i in range(20)], "id string, title string, descriptionPlain string")
    near = NearDuplicates(df)
    assert {tuple(x) for x in near.pairs().collect()} == {("k00", f"k{i:02d}") for i in range(1, 20)}
    assert {(x.class_id, x.n_links) for x in near.classes().collect()} == {("k00", 19)}


def test_hot_class_lists_pairs_of_its_texts(spark, monkeypatch):
    monkeypatch.setattr("postmill.llm.neardup.ALL_PAIRS_WITHIN", 5)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"k{i:02d}", "t", t) for i, t in enumerate([text] * 7 + [text.upper()] * 2 + [text.replace(" ", ", ")])]
    near = NearDuplicates(spark.createDataFrame(rows, "id string, title string, descriptionPlain string"))
    star = {("k00", f"k{i:02d}") for i in range(1, 7)}
    full = {("k00", "k07"), ("k00", "k08"), ("k00", "k09"), ("k07", "k08"), ("k07", "k09"), ("k08", "k09")}
    assert {tuple(x) for x in near.pairs().collect()} == star | full
    assert {(x.class_id, x.n_links) for x in near.classes().collect()} == {("k00", 9)}


def test_dart_similarity():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 300).astype(np.uint64)
    w1 = r.random(300) * 6 + 0.05
    w2 = w1 * r.choice([0.5, 1, 3], 300)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    got = np.mean([(dart_signature(mix(x + np.uint64(k)), w1, 512) == dart_signature(mix(x + np.uint64(k)), w2, 512)).mean() for k in range(10)])
    assert abs(got - want) < 0.03
    assert bands_of(np.stack([dart_signature(x, np.ones(300), ROWS * BANDS)]), ROWS).shape == (1, BANDS)
    assert not dart_signature(x[:0], np.zeros(0), 8).any()


# --- places ----------------------------------------------------------------------------------------

PLACES = [(1, "Quillvale", "Quebec", "QC", "Canada"), (2, "Quillvale", "Oregon", "OR", "United States"), (3, "Lake Hesper", "Maine", "ME", "United States"),
          (4, "Belmérac", None, None, "France"), (5, "Fort Yelling", "Ohio", "OH", "United States"), (6, "Oakenmere", "Nevada", "NV", "United States")]
VALUES = {
    "Quillvale": -1, "quillvale, qc": 1, "Quillvale OR": 2, "Quillvale, Canada": 1, "US-ME-Lake Hesper": 3, "LakeHesper": 3, "Lake Hespr, Maine": 3, "Lаke Hesper": 3, "Greater Oakenmere Area": 6,
    "BELMERAC (France)": 4, "Ft. Yelling": 5, "Oake nmere NV": 6, "Oaknmree": 6, "Quillvale, Ohio": -1, "Remote": -1, "Ohio, United States": -1, "Ijsselkerke, Ohio": -1, "": None, "  ": None, "x" * 5000: -1, "Ohio - Fort Yelling": 5,
}


def test_places(spark):
    places = spark.createDataFrame(PLACES, "place_id int, city string, region string, region_code string, country string")
    df = spark.createDataFrame([(k,) for k in VALUES] + [(None,), ("Quillvale",)], "value string").withColumns({"city": F.lit("x"), "region": F.lit(1)})
    out = resolve_places(df, "value", places).collect()
    assert {r.value: r.place_id for r in out if r.value is not None} == VALUES and len(out) == len(VALUES) + 2
    assert {r.place_id for r in resolve_places(df, "value", places.limit(0)).collect()} == {None, -1}
    assert resolve_places(df.limit(0), "value", places).count() == 0


@pytest.mark.parametrize("whole", [0, 100])
def test_places_sharded(spark, monkeypatch, whole):
    monkeypatch.setattr("postmill.llm.places.SHARD_ENTRIES", 1)
    monkeypatch.setattr("postmill.llm.places.BROADCAST_ENTRIES", whole)
    places = spark.createDataFrame(PLACES, "place_id int, city string, region string, region_code string, country string")
    df = spark.createDataFrame([(k,) for k in VALUES], "value string").withColumns({"found": F.lit(1), "shard": F.lit(2)})
    got = {r.value: r.place_id for r in resolve_places(df, "value", places).collect()}
    assert got == VALUES


def plain_distance(a, b):
    last, h = {}, {}
    big = len(a) + len(b) + 1
    h[-1, -1] = big
    for i in range(len(a) + 1):
        h[i, -1], h[i, 0] = big, i
    for j in range(len(b) + 1):
        h[-1, j], h[0, j] = big, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            h[i, j] = min(h[i - 1, j - 1] + cost, h[i, j - 1] + 1, h[i - 1, j] + 1, h[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return h[len(a), len(b)]


def test_bk_tree_gives_every_entry():
    r = random.Random(2)
    names = sorted({"".join(r.choices("abcd", k=r.randint(1, 8))) for _ in range(150)})
    queries = ["".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(60)]
    tree = BKTree(names)
    for radius in (1, 2):
        got = tree.within(queries, radius)
        for i, q in enumerate(queries):
            assert sorted(got.get(i, [])) == sorted((plain_distance(q, n), k) for k, n in enumerate(names) if plain_distance(q, n) <= radius)
    assert fold("Łódź Straße") == "lodz strasse" and BKTree([]).within(["a"], 2) == {}
    assert distances(*[np.zeros((0, 1), np.uint32), np.zeros(0, np.int64)] * 2).shape == (0,)


# --- lines -----------------------------------------------------------------------------------------


def test_lines(spark):
    legal, head = "Equal  Opportunity ", "about us"
    rows = [("b", f"i{i}", f"{legal}\nown {i}\n\n{head if i < 5 else ''}") for i in range(8)] + [("b", "i0", f"{legal}\nown 0\n\n{head}")]
    rows += [("c", f"j{i}", legal) for i in range(4)] + [("b", "nul", None), ("b", "rep", "again\n" * 50), (None, "x", legal), ("b", None, legal), ("e", "z", "")]
    df = spark.createDataFrame(rows, "board string, id string, descriptionPlain string").withColumns({"s": F.lit(1), "k": F.lit(2), "block": F.lit(3), "lines": F.lit(4)})
    found = repeated_blocks(df)
    assert {(r.board, tuple(r.lines), r.n_docs) for r in found.collect()} == {("b", ("equal opportunity",), 8), ("b", ("about us",), 5)}
    block = [("b", f"i{i}", f"own {i}\nShare\nthis \n\npost\nown too {i}") for i in range(6)] + [("b", f"k{i}", "share") for i in range(6)]
    longest = repeated_blocks(spark.createDataFrame(block, "board string, id string, descriptionPlain string"))
    assert {(tuple(r.lines), r.n_docs) for r in longest.collect()} == {(("share", "this", "post"), 6)}
    assert {r.clean_text for r in without_blocks(df.where("id = 'i7'").selectExpr("board", "'share\nx' descriptionPlain"), longest).collect()} == {"x"}
    clean = {(r.board, r.id): r.clean_text for r in without_blocks(df, found).collect()}
    assert clean["b", "i1"] == "own 1\n" and clean["b", "nul"] is None and clean["c", "j0"] == legal and clean["b", "rep"] == "again\n" * 50
    assert repeated_blocks(df.limit(0)).count() == 0


def test_blocks_of_two_lines(spark):
    rows = [("b", f"i{i}", f"x{i}\nA\nB\ny{i}") for i in range(6)] + [("b", f"k{i}", f"A\nz{i}\nB") for i in range(6)]
    df = spark.createDataFrame(rows, "board string, id string, descriptionPlain string")
    found = repeated_blocks(df, min_lines=2)
    assert {tuple(r.lines) for r in found.collect()} == {("a", "b")}
    clean = {r.id: r.clean_text for r in without_blocks(df, found, min_lines=2).collect()}
    assert clean["i0"] == "x0\ny0" and clean["k0"] == "A\nz0\nB"


def test_suffix_array():
    r = random.Random(4)
    s = np.array([r.randint(0, 2) for _ in range(200)], dtype=np.int64)
    order, common = suffix_array(s, 4)
    cut = [tuple(s[i : i + 4]) for i in order]
    assert sorted(order.tolist()) == list(range(200))
    for i in range(1, 200):
        lcp = next((k for k, (a, b) in enumerate(zip(cut[i - 1], cut[i])) if a != b), min(len(cut[i - 1]), len(cut[i])))
        assert common[i] == lcp
    full = {}
    for i in range(200):
        full.setdefault(tuple(s[i : i + 4]), []).append(i)
    assert len([c for c in common if c < 4]) >= len([k for k in full if len(k) == 4])


# --- history ---------------------------------------------------------------------------------------


def cases(spark, rows):
    df = spark.createDataFrame(rows, "batch_no int, seq bigint, board string, title string, place string").withColumns({"h": F.lit(1), "words": F.lit(2)})
    out, state = dedup_history(history_rows(df, F.col("place")))
    got = {tuple(r) for r in out.collect()}
    state.drop()
    return got


def test_history(spark):
    rows = [
        (0, 1, "b", "Data Engineer II - Cloud Foxtrel", "p"), (0, 2, "b", "Data Engineer II - Cloud Foxtrel", "p"), (0, 3, "b", "Test Analyst", None),
        (1, 10, "b", "Foxtrel: cloud data ENG. II!", "p"), (1, 11, "b", "Data Engineer III - Cloud Foxtrel", "p"), (1, 12, "b", "Data Engineer II - Cloud Foxtrle", "p"),
        (1, 13, "b", "Data Engineer II - Cloud Foxtrel", "q"), (1, 14, "c", "Data Engineer II - Cloud Foxtrel", "p"), (1, 15, "b", "Test Analyst", None), (1, 16, "b", "Data Engineer - Cloud Foxtrel", "p"),
        (2, 20, "b", "Data Engineer III Cloud Foxtrel", "p"), (2, 21, "b", "New Role", "p"), (2, 22, "b", "new role", "p"), (2, 23, "b", "New Rolle", "p"), (2, 24, "b", None, "p"), (2, 25, "b", "", "p"), (2, 26, None, "New Role", "p"),
        (3, 30, "b", "Nwe Role", "p"), (3, 31, "b", "Test Analyst 2026", "p"), (4, 40, "b", "Test Analyst 2027", "p"), (None, 50, "b", "New Role", "p"), (4, 41, "c", "Data Engineer II - Cloud Foxtrel", "q"),
    ]
    assert cases(spark, rows) == {(1, 10), (1, 12), (11, 20), (21, 22), (21, 23), (21, 30)}
    assert cases(spark, []) == set()


def test_history_chain_within_a_batch(spark):
    # each is one slip from the next only: the first is accepted, the second is its case, the third is accepted
    rows = [(0, 1, "b", "other", "p"), (1, 2, "b", "Zalmor Pilot", "p"), (1, 3, "b", "Zalmorx Pilot", "p"), (1, 4, "b", "Zalmorxy Pilot", "p"), (1, 5, "b", "Zalmorxy Pilot", "p")]
    assert cases(spark, rows) == {(2, 3), (4, 5)}


def test_history_state_is_carried_on(spark):
    df = spark.createDataFrame([(0, 1, "b", "Data Engineer", "p"), (1, 2, "b", "Engineer, Data", "p"), (1, 3, "b", "Pilot", "p")], "batch_no int, seq bigint, board string, title string, place string")
    first, state = dedup_history(history_rows(df, F.col("place")))
    assert {tuple(r) for r in first.collect()} == {(1, 2)}
    later = spark.createDataFrame([(2, 9, "b", "Pilott", "p")], df.schema)
    more, state = dedup_history(history_rows(later, F.col("place")), state)
    assert {tuple(r) for r in more.collect()} == {(3, 9)}
    asked = spark.range(100_000).select(F.col("id").alias("h"), F.col("id").alias("g"))
    plan = state.table("full").join(asked.hint("merge"), ["h", "g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # the state is read by its buckets
    state.drop()


ROWS = [(0, 1, "b", "Data Engineer", "p"), (0, 2, "b", "Data Engineer", "p"), (1, 3, "b", "Engineer, Data", "p"), (1, 4, "b", "Pilot", "p"), (2, 5, "b", "Pilott", "p"), (2, 6, "b", "Cook", "p"), (3, 7, "b", "Coook", "p"), (3, 8, "b", "Data Engineer", "q")]
BATCHES = "batch_no int, seq bigint, board string, title string, place string"
LATER = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from postmill.llm.history import AcceptedState, dedup_history, history_rows
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
state = AcceptedState.open(spark, sys.argv[1])
rows = spark.createDataFrame([(2, 5, "b", "Pilott", "p"), (2, 6, "b", "Cook", "p")], "batch_no int, seq bigint, board string, title string, place string")
out, _ = dedup_history(history_rows(rows, F.col("place")), state)
print("CASES", sorted(tuple(r) for r in out.collect()))
"""


def test_history_in_two_applications(spark, tmp_path, monkeypatch):
    """A later application opens the state and takes one batch only; together they give what one run gives."""
    frame = lambda numbers: history_rows(spark.createDataFrame([r for r in ROWS if r[0] in numbers], BATCHES), F.col("place"))
    whole, state = dedup_history(frame({0, 1, 2, 3}))
    want = {tuple(r) for r in whole.collect()}
    state.drop()
    first, state = dedup_history(frame({0, 1}), AcceptedState.create(spark, str(tmp_path / "state")))
    got = {tuple(r) for r in first.collect()}
    # What a lost run appended without publishing is never read.
    state._append({"full": spark.createDataFrame([(1, 1, 0, 99)], "h bigint, g bigint, batch_no int, seq bigint")}, "lost")
    run = subprocess.run([sys.executable, "-c", LATER, str(tmp_path / "state"), str(tmp_path / "shared")], capture_output=True, text=True, timeout=300)
    assert "CASES" in run.stdout, run.stderr[-2000:]
    got |= set(ast.literal_eval(run.stdout.split("CASES ")[1]))
    state = AcceptedState.open(spark, str(tmp_path / "state"))
    assert state.document["batches"] == [0, 1, 2]
    state.compact()
    monkeypatch.setattr("postmill.llm.history.COMPACT_AFTER", 0)  # and once more after the next batch
    for _ in range(2):  # run again as after a crash: the same cases, accepted once
        last, state = dedup_history(frame({3}), AcceptedState.open(spark, str(tmp_path / "state")))
        assert {tuple(r) for r in last.collect()} == {(6, 7)}
    got |= {(6, 7)}
    assert got == want == {(1, 3), (4, 5), (6, 7)}
    assert state.table("full").count() == 4 and len(state.document["appends"]) == 1
    state.drop()


def test_history_reads_one_batch(spark, tmp_path):
    """A batch reads its own rows, not those of the history or of other batches."""
    df = spark.createDataFrame([(0, n, "b", f"Role {n}", "p") for n in range(500)] + [(1, 900, "b", "Pilot", "p")], BATCHES)
    read = []
    one = dedup_history.__globals__["dedup_batch"]
    seen = lambda state, rows, number: read.append((number, rows.count())) or one(state, rows, number)
    dedup_history.__globals__["dedup_batch"] = seen
    try:
        out, state = dedup_history(history_rows(df, F.col("place")))
    finally:
        dedup_history.__globals__["dedup_batch"] = one
    assert read == [(1, 1)] and out.count() == 0
    state.drop()


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_history_links_within_a_batch(spark, monkeypatch, bound):
    monkeypatch.setattr("postmill.llm.history.ORDERED_LINKS", bound)
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (6, 7), (3, 8), (7, 8)]
    got = {tuple(r) for r in _owned_within(spark.createDataFrame(edges, "early bigint, late bigint")).select("early", "late").collect()}
    assert got == {(1, 2), (3, 4), (1, 5), (6, 7), (3, 8)}


@pytest.mark.parametrize(("a", "b", "same"), [("analyst", "anlayst", True), ("analyst", "analysts", True), ("ii", "iii", False), ("2026", "2027", False), ("spring", "string", True), ("abcd", "badc", False), ("team", "team", False)])
def test_one_slip(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(one_slip("a", "b")).first()[0] is same


def test_role_parts(spark):
    df = spark.createDataFrame([("SRE, Co-op",), (None,), (" -- ",)], "t string").select(role_parts(F.col("t")))
    assert [r[0] for r in df.collect()] == [["co", "engineer", "op", "reliability", "site"], [], []]
    assert role_parts(F.lit("x y"), {}) is not None


# --- encoding --------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    ref.encode_special_tokens = True
    r = random.Random(6)
    letters = list(" \n\t\r\x0b\x1c\x85 　​") + list("aAbéñ漢字Жш١23½👍🏽'sltrevmd<|endoftext|>—…=-_/\\#@")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 50))) for _ in range(2000)] + ["a" * 20000, "=" * 5000, " " * 3000, "<|endoftext|>", "", None, "the cat's 42 hats"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    got = {x.doc_id: x.ids for x in encode_texts(df, VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode(t, add_special_tokens=False).ids if t else [])
    assert encode_texts(df.limit(0), VOCABULARY).count() == 0


def test_encoding_round_trip():
    enc = PrefixEncoder(load_ranks(VOCABULARY))
    for text in ("naïve café — 東京 🎌\r\n\r\n  x", "'ll'd've", "﻿\x00\x01"):
        assert b"".join(enc.token[i] for i in enc.encode(text)).decode() == text


# --- leaks -----------------------------------------------------------------------------------------

QUESTION = "Which of the seven old bridges over the river should be crossed first when Bob walks home at 5?"


def test_leaks(spark):
    docs = [(1, "x " + QUESTION.upper().replace(" ", "\n> ") + " y"), (2, " ".join(QUESTION.split()[:12])), (3, " ".join(QUESTION.split()[:11])), (4, None), (5, ""),
            (6, QUESTION.replace("seven", "eight")), (7, ("pad " * 50_000) + QUESTION), (8, QUESTION + " and " + QUESTION)]
    items = [(10, QUESTION), (11, QUESTION), (12, "too short"), (13, None), (14, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "start": F.lit(2)})
    e = spark.createDataFrame(items, "item_id bigint, text string")
    out = find_leaks(d, e)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got == {(i, q) for i in (1, 2, 6, 7, 8) for q in (10, 11)}
    for r in out.where("item_id = 10 and doc_id in (1, 7)").collect():
        text = dict(docs)[r.doc_id]
        assert text[r.start : r.end].lower().replace("\n> ", " ") == QUESTION[:-1].lower()
    assert out.where("doc_id = 8 and item_id = 10").count() == 2
    assert find_leaks(d, e.limit(0)).count() == 0 and find_leaks(d.limit(0), e).count() == 0


def leaks(spark, docs, items):
    out = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {tuple(r) for r in out.collect()}


def test_leaks_by_windows(spark, monkeypatch):
    """Beyond one automaton the same passages come from hashes that meet by shuffle."""
    r = random.Random(21)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(r.choices(words, k=r.randint(5, 40)))) for n in range(30)]
    items += [(90, items[3][1]), (91, None), (92, "")]
    docs = []
    for n in range(40):
        parts = r.choice(items[:30])[1].split()
        a = r.randint(0, len(parts))
        docs.append((n, " - ".join([*r.choices(words, k=r.randint(0, 9)), *parts[a : a + r.randint(8, 20)], "x", *r.choices(words, k=r.randint(0, 9))])))
    docs += [(95, None), (96, "")]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr("postmill.llm.leak.AUTOMATON_WORDS", 1)
    assert leaks(spark, docs, items) == whole and len(whole) > 5
    want = set()
    for d, t in docs:
        for i, q in items:
            a, b = (t or "").replace(" - ", " ").split(), (q or "").split()
            if {tuple(a[k : k + 12]) for k in range(len(a) - 11)} & {tuple(b[k : k + 12]) for k in range(len(b) - 11)}:
                want.add((d, i))
    assert {(d, i) for d, i, *_ in whole} == want


def test_a_million_words_in_one_automaton():
    r = random.Random(22)
    words = [f"{a}{b}" for a in string.ascii_lowercase for b in range(4000)]
    items = [(n, " ".join(r.choices(words, k=100))) for n in range(10_000)]
    blocks = Blocks(items, 12)
    text = "so " + " ".join(items[77][1].split()[30:45]) + " and " + items[4000][1]
    assert sorted(blocks.passages(text)) == [(77, 1, 15), (4000, 17, 116)]
    assert len(blocks.automaton) <= 170_000


# --- shared spans ----------------------------------------------------------------------------------


def brute_spans(docs, length):
    at = {}
    for i, t in docs:
        for k in range(len(t or "") - length + 1):
            at.setdefault(t[k : k + length], set()).add(i)
    pairs = {(a, b) for s in at.values() for a in s for b in s if a < b}
    cover = {}
    for i, t in docs:
        hit = set()
        for k in range(len(t or "") - length + 1):
            if len(at[t[k : k + length]]) > 1:
                hit |= set(range(k, k + length))
        if hit:
            cover[i] = len(hit)
    return pairs, cover


@pytest.mark.parametrize("bucket", [SP.BUCKET_WINDOWS, 0])
def test_shared_spans(spark, bucket):
    r = random.Random(8)
    text = lambda n: "".join(r.choices("ab cdé👍漢", k=n))
    shared = [text(40), text(60), "=" * 45]
    docs = [(i, text(r.randint(0, 120)) + r.choice([*shared, ""]) + text(r.randint(0, 60)) + r.choice([*shared, ""])) for i in range(40)]
    docs += [(97, docs[3][1]), (98, docs[3][1]), (90, None), (91, ""), (92, text(31) * 3), (93, shared[1][:29]), (94, shared[1][:30]), (95, "=" * 2000)]
    df = spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string").withColumns({"doc": F.lit(1), "mini": F.lit(2), "hot": F.lit(3)})
    pairs, cover = brute_spans(docs, 30)
    spans = SP.SharedSpans(df, length=30, bucket_windows=bucket)
    assert {tuple(x) for x in spans.pairs().collect()} == pairs and len(pairs) > 100
    assert {x.doc_id: x.shared_chars for x in spans.coverage().collect()} == cover
    groups = {}
    for x in spans.classes().collect():
        groups.setdefault(x.span_class, set()).add(x.doc_id)
        text = dict(docs)[x.doc_id]
        assert 30 <= x.stop - x.start and x.stop <= len(text)
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == pairs
    assert SP.SharedSpans(df.limit(0), length=30).pairs().count() == 0


def test_many_equal_texts_are_not_expanded(spark, monkeypatch):
    monkeypatch.setattr("postmill.llm.spans.ALL_PAIRS_WITHIN", 5)
    text = "".join(random.Random(3).choices(string.ascii_letters, k=60))
    df = spark.createDataFrame([(i, text) for i in range(20)] + [(50, text[:40] + "xx"), (51, "yy" + text[10:45])], "doc_id bigint, text string")
    spans = SP.SharedSpans(df, length=30)
    assert {tuple(x) for x in spans.pairs().collect()} == {(0, i) for i in range(1, 20)} | {(0, 50), (0, 51), (50, 51)}
    assert {x.doc_id: x.shared_chars for x in spans.coverage().collect()} == {i: 60 for i in range(20)} | {50: 40, 51: 35}


def test_a_span_of_many_texts(spark):
    """A span in 2,000 different texts is a class of 2,000 rows, in no more rows than that."""
    r = random.Random(31)
    text = lambda n: "".join(r.choices(string.ascii_letters, k=n))
    shared = text(40)
    df = spark.createDataFrame([(i, chr(0x4E00 + i) * 20 + shared + chr(0x5E00 + i) * 20) for i in range(2000)], "doc_id bigint, text string")
    rows = SP.SharedSpans(df, length=30).classes().collect()
    assert len(rows) == 2000 and len({x.span_class for x in rows}) == 1 and {(x.start, x.stop) for x in rows} == {(20, 60)}


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(SP, "SEGMENT", 50)
    codes = np.array([ord(c) for c in "".join(random.Random(9).choices("abc", k=400))], dtype=np.uint32)
    whole = SP.sliding_least(SP.window_hashes(codes, 10), 11)
    assert len(whole) == 381 and (whole == [min(SP.window_hashes(codes, 10)[i : i + 11]) for i in range(381)]).all()
    least, first, n = SP.super_kmers(codes, 20)
    assert n.sum() == 381 and first[0] == 0
