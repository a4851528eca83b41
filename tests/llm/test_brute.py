"""Operators that SQL can't express, against brute force over whole small tables or made-up truth."""

import collections
import os
import random
import re

import pandas as pd
import pytest
from oracle import FOLDER
from pyspark.sql import functions as F
from test_llm import plain_distance

from postmill.llm import places as PL
from postmill.llm import queries as Q
from postmill.llm.history import SHORTENINGS, dedup_history, history_rows
from postmill.llm.names import link_names, name_pairs
from postmill.llm.places import RADIUS, Areas, Index, read_values, words_of

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
NUMERAL = re.compile(r"[ivx]+|.*\d.*")


def slip(a, b):
    if a == b or NUMERAL.fullmatch(a) or NUMERAL.fullmatch(b) or max(len(a), len(b)) < 3:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def same_role(x, y):
    a, b = collections.Counter(x) - collections.Counter(y), collections.Counter(y) - collections.Counter(x)
    return not (a or b) or (sum(a.values()) == sum(b.values()) == 1 and slip(*a, *b))


def parts(title):
    return sorted(x for w in re.findall(r"[^\W_]+", title.lower()) for x in SHORTENINGS.get(w, w).split())


def brute_history(rows):
    accepted, cases = collections.defaultdict(list), set()
    for batch, seq, board, title, place in sorted(rows, key=lambda r: (r[0], r[1])):
        if board is None or place is None or not title or not parts(title):
            continue
        p = parts(title)
        hit = [s for s, q in accepted[board, place] if same_role(q, p)]
        if batch and hit:
            cases.add((hit[0], seq))
        else:
            accepted[board, place].append((seq, p))
    return cases


def test_history(spark):
    r = random.Random(11)
    words = ["data", "test", "cloud", "zalmor", "zalmro", "zalmo", "pilot", "pilott", "ii", "iii", "2026", "eng", "engineer"]
    rows = []
    for seq in range(260):
        title = " ".join(r.sample(words, r.randint(1, 3))) if r.random() < 0.95 else None
        rows.append((r.choice([0, 0, 1, 2, 3]), seq, r.choice(["a", "a", "a", "b", None]), title, r.choice(["p", "p", "q", None])))
    df = spark.createDataFrame(rows, "batch_no int, seq bigint, board string, title string, place string")
    out, state = dedup_history(history_rows(df, F.col("place")))
    got = {tuple(x) for x in out.collect()}
    state.drop()
    want = brute_history(rows)
    assert got == want and len(want) > 30


def table(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def gazetteer():
    """The whole list, and a reader of values by it."""
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in table("places")[["place_id", "city", "region", "region_code", "country"]].values.tolist()]
    split = [words_of(r[1]) for r in rows]
    keys = ["".join(w) for w in split]
    areas = Areas([r[2:] for r in rows], min(map(len, keys)), max(map(len, keys)), max(map(len, split)))
    index = Index([(r[0], k, r[2], r[4]) for r, k in zip(rows, keys)])
    return index, lambda values: read_values(areas, index, values)


@needs_data
def test_places_against_a_full_scan():
    index, read = gazetteer()
    values = sorted({v for x in table("simplify").locations.dropna() for v in x if v and v.strip()})
    for v, found in zip(values, read(values)):
        words = words_of(v)
        runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        close = {p for key, places in index.places.items() for p, *_ in places if any(abs(len(r) - len(key)) <= RADIUS and plain_distance(r, key) <= RADIUS for r in runs)}
        assert set(found) <= close


@needs_data
def test_places_whatever_the_shards(spark, monkeypatch):
    """One tree, a tree for each name, and a task for each shard: row for row the same."""
    places = spark.read.parquet(f"{FOLDER}/places.parquet")
    df = spark.read.parquet(f"{FOLDER}/simplify.parquet").select("id", F.explode_outer("locations").alias("value"))
    rows = lambda: sorted(map(repr, PL.resolve_places(df, "value", places).collect()))
    want = rows()
    monkeypatch.setattr(PL, "SHARD_ENTRIES", 20)
    monkeypatch.setattr(PL, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(PL, "SALT_VALUES", 100)
    assert rows() == want
    index, read = gazetteer()
    monkeypatch.setattr(PL, "SHARD_ENTRIES", 1)
    entries = [(p, k, r, c) for k, rows_ in index.places.items() for p, r, c in rows_]
    single = PL.Index(entries)
    assert len(single.trees) == len(index.places)
    values = sorted({v for (v,) in df.select("value").where("value is not null").distinct().collect()})
    keys = sorted({w for v in values for w in words_of(v)})
    one, many = index.within(keys, RADIUS), single.within(keys, RADIUS)
    assert {q: sorted(h) for q, h in one.items()} == {q: sorted(h) for q, h in many.items()}


def test_places_memory_and_trees(monkeypatch):
    """A worker that forgets readings gives the same ones, and builds its trees once for a list."""
    built = []
    monkeypatch.setattr(PL, "REMEMBERED", 3)
    monkeypatch.setattr(PL, "SHARD_ENTRIES", 1)
    monkeypatch.setattr(PL, "BKTree", lambda names, make=PL.BKTree: built.append(names) or make(names))
    cities = ["Quillvale", "Oakenmere", "Fernbury", "Wrenbury", "Lindenhaven"]
    areas = Areas([], 8, 11, 1)
    entries = [(n, c.lower(), None, None) for n, c in enumerate(cities)]
    for _ in range(3):
        got = PL._remembered("list", areas, lambda: entries, [*cities, "Quilvale", "nowhere"])
        assert [got[c] for c in cities] == [[n] for n in range(5)] and got["Quilvale"] == [0] and got["nowhere"] == []
        assert len(PL._memory) <= 3
    assert len(built) == 5
    # Of two names one slip away the one with the same first letter is meant.
    assert read_values(areas, Index(entries), ["Frenbury", "Wernbury"]) == [[2], [3]]


@needs_data
def test_p3_and_p7_over_tables(spark):
    read, cache = gazetteer()[1], {}

    def place(v):
        if v not in cache:
            found = read([v])[0]
            cache[v] = found[0] if len(found) == 1 else -1
        return cache[v]

    want = set()
    for r in table("ashby").itertuples():
        for part in re.split(r"[;|]|(?<=\s)/(?=\s)", r.location or ""):
            for v in re.split(r"\s+or\s+", part.strip()):
                if v.strip():
                    want.add(("ashby", r.id, place(v)))
    for r in table("simplify").itertuples():
        for v in r.locations if r.locations is not None else []:
            if v and v.strip():
                want.add(("simplify", r.id, place(v)))
    assert {tuple(x) for x in Q.p3_found(spark, FOLDER).collect()} == want
    rows = [
        (r.batch_no, r.seq, r.board, r.title, "none" if not (r.location or "").strip() else (place(r.location) if place(r.location) > 0 else None))
        for r in table("ashby_batches").itertuples()
    ]
    assert {tuple(x) for x in Q.p7_found(spark, FOLDER).collect()} == brute_history(rows)


def test_names_against_made_up_truth(spark):
    r = random.Random(12)
    syllables = ["kor", "van", "til", "mes", "dru", "pol", "shu", "ger", "nax", "wim", "bel", "fos", "rin", "cha"]
    nouns, kinds = ["Ridge", "Canyon", "Harbor", "Ember"], ["Systems", "Robotics", "Analytics", "Logistics"]
    truth, rows, used = {}, [], set()
    while len(used) < 60:
        w = "".join(r.choices(syllables, k=3))
        if all(sum(x != y for x, y in zip(w, u)) > 2 or len(w) != len(u) for u in used):
            used.add(w)
    for w in sorted(used):
        name = [w.capitalize(), r.choice(nouns), r.choice(kinds)]
        full = " ".join(name)
        i = r.randrange(2, len(w) - 1)
        slipped = " ".join([(w[:i] + "q" + w[i + 1 :]).capitalize(), *name[1:]])
        swapped = " ".join([(w[:i] + w[i + 1] + w[i] + w[i + 2 :]).capitalize() if w[i] != w[i + 1] else name[0], *name[1:]])
        for v, n in ((full, 12), (full.upper(), 2), (full + " Inc", 2), (" ".join([name[0], name[2], name[1]]), 1), (name[0], 2), (f"{name[0]} {name[1][0]}. {name[2]}", 1), (f"{name[0]} {name[1]} {name[2][:3]}.", 1), (slipped, 2), (swapped, 1), ("".join(name), 1)):
            truth.setdefault(v, w)
            rows += [(v,)] * n
    df = spark.createDataFrame(rows, "name string")
    got = {tuple(x) for x in name_pairs(link_names(df)).collect()}
    names = sorted(truth)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if truth[a] == truth[b]}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.99
