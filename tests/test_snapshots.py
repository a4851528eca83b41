import datetime as dt
import random

from postmill.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, id string, a string, b boolean, loaded_at timestamp, value string, sign int, cell string"
T0 = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, T0 + dt.timedelta(hours=i), "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)


def brute(rows, fields=2):
    state = {}
    for n, k, *v in rows:
        if n is not None and k is not None:
            state.setdefault(n, {})[k] = v  # later rows win
    numbers, out = sorted(state), set()
    for before, now in zip(numbers, numbers[1:]):
        a, b = state[before], state[now]
        out |= {(now, k, "added") for k in b.keys() - a.keys()} | {(now, k, "removed") for k in a.keys() - b.keys()}
        out |= {(now, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def run(spark, rows):
    return {tuple(r)[:3] for r in snapshot_changes(frame(spark, rows), ["a", "b"]).collect()}


def test_kinds_and_fields(spark):
    rows = [(1, "k", "x", True), (1, "gone", "x", True), (1, "same", None, None), (4, "k", None, False), (4, "same", None, None), (4, "new", "", True)]
    got = {r.id: (r.change, r.changed_fields) for r in snapshot_changes(frame(spark, rows), ["a", "b"]).collect()}
    assert got == {"k": ("changed", ["a", "b"]), "gone": ("removed", None), "new": ("added", None)}


def test_null_empty_and_last_row(spark):
    rows = [(1, "k", None, True), (2, "k", "", True), (2, "k", "late", True), (3, "k", "late", True), (3, None, "x", True), (None, "k", "x", True)]
    assert run(spark, rows) == {(2, "k", "changed")}


def test_empty_table(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "k", "x", True)]) == set()


def test_random_against_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 2, 5, 9]), r.choice("abcdefgh") if r.random() < 0.7 else "hot", r.choice(["x", "y", None, ""]), r.choice([True, False, None])) for _ in range(300)]
    assert run(spark, rows) == brute(rows)
