"""Free-entered values mapped to a reference list (problem 3).

The reference names stand in a BK-tree under the unrestricted Damerau-Levenshtein distance, which is a
true metric: whatever a node's distance to a query is, only children at about that distance can hold
an entry within the threshold. Queries go down the tree together, a batch at a time, so that the
distances of all their current nodes are worked out in one vectorised step.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut

# Entries of the reference that one tree holds; a longer list is divided over several trees.
SHARD_ENTRIES = 50_000
# A list of up to so many entries (some 20 MB) goes to every worker whole; of a longer one each task gets one shard.
BROADCAST_ENTRIES = 200_000
# Distinct values that one task holds against one shard, where the list is too long for every worker.
SALT_VALUES = 50_000
# Resolved values that a worker remembers: a bound on its memory, not on what is resolved.
REMEMBERED = 100_000
RADIUS = 2

# Letters that look like Latin ones, or that no decomposition turns into Latin ones.
_LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
        "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g",
        "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ß": "ss", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "œ": "oe", "æ": "ae", "þ": "th",
    }
)
# Usual shortenings of the first words of place names.
_SHORT = {"st": "saint", "ste": "sainte", "ft": "fort", "mt": "mount", "pt": "port", "lk": "lake"}
# Other names of two countries.
_COUNTRIES = {"usa": "united states", "us": "united states", "u s a": "united states", "u s": "united states", "america": "united states", "can": "canada", "ca": "canada"}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters made Latin."""
    text = unicodedata.normalize("NFKD", text.lower()).translate(_LOOKALIKES)
    return "".join(c for c in text if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    return [_SHORT.get(w, w) for w in _WORD.findall(fold(text))]


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, texts), default=0) or 1
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return codes, np.array([len(t) for t in texts], dtype=np.int64)


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of pairs of rows of character codes."""
    p, n = a.shape
    m = b.shape[1]
    big = np.int16(n + m + 1)
    h = np.full((p, n + 2, m + 2), big, dtype=np.int16)
    h[:, 1:, 1] = np.arange(n + 1)
    h[:, 1, 1:] = np.arange(m + 1)
    pairs = np.arange(p)
    last_row = np.zeros((p, m), dtype=np.int64)  # for each place in b, the last row whose letter equals it
    for i in range(1, n + 1):
        same = a[:, i - 1 : i] == b
        last_col = np.zeros(p, dtype=np.int64)
        for j in range(1, m + 1):
            eq = same[:, j - 1]
            k = last_row[:, j - 1]
            across = h[pairs, k, last_col] + (i - k - 1) + 1 + (j - last_col - 1)
            best = np.minimum(h[:, i, j] + np.where(eq, 0, 1), np.minimum(h[:, i + 1, j], h[:, i, j + 1]) + 1)
            h[:, i + 1, j + 1] = np.minimum(best, np.where((k > 0) & (last_col > 0), across, big))
            last_col = np.where(eq, j, last_col)
        last_row = np.where(same, i, last_row)
    return h[pairs, la + 1, lb + 1].astype(np.int64)


class BKTree:
    """Distinct names by their distances; ``within`` gives every name within a radius of each query."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.codes, self.lengths = _matrix(names)
        self.children: list[dict[int, int]] = [{} for _ in names]
        # Built a level at a time: names of one subtree are compared with its root together.
        todo = [(0, np.arange(1, len(names)))] if names else []
        while todo:
            root, rest = todo.pop()
            if not len(rest):
                continue
            d = self._to(np.full(len(rest), root), self.codes[rest], self.lengths[rest])
            for edge in np.unique(d):
                part = rest[d == edge]
                self.children[root][int(edge)] = int(part[0])
                todo.append((int(part[0]), part[1:]))

    def _to(self, nodes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=np.int64)
        for lo in range(0, len(nodes), 8192):
            at = slice(lo, lo + 8192)
            out[at] = distances(codes[at], lengths[at], self.codes[nodes[at]], self.lengths[nodes[at]])
        return out

    def within(self, queries: list[str], radius: int) -> dict[int, list[tuple[int, int]]]:
        """For each query with a hit: (distance, name) of every name within ``radius``."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not queries or not self.names:
            return hits
        codes, lengths = _matrix(queries)
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        while len(q):
            d = self._to(node, codes[q], lengths[q])
            near = d <= radius
            for i, x, n in zip(q[near].tolist(), d[near].tolist(), node[near].tolist()):
                hits[i].append((x, n))
            next_q, next_node = [], []
            for n in np.unique(node):
                here = node == n
                qs, ds = q[here], d[here]
                for edge, child in self.children[n].items():
                    go = qs[np.abs(ds - edge) <= radius]  # the triangle inequality rules out the rest
                    if len(go):
                        next_q.append(go)
                        next_node.append(np.full(len(go), child))
            q = np.concatenate(next_q) if next_q else np.zeros(0, np.int64)
            node = np.concatenate(next_node) if next_node else q
        return hits


class Areas:
    """What values may say beside a city: the regions and countries of the whole list, and the measures of its names."""

    def __init__(self, areas: list[tuple[str | None, str | None, str | None]], shortest: int, longest: int, most_words: int) -> None:
        self.shortest, self.longest, self.most_words = shortest, longest, most_words + 1
        self.regions: dict[tuple[str, ...], str] = {}
        self.countries: dict[tuple[str, ...], str] = {}
        for region, code, country in areas:
            for name in (region, code):
                if name and (w := tuple(_WORD.findall(fold(name)))):
                    self.regions[w] = fold(region or name)
            if country and (w := tuple(_WORD.findall(fold(country)))):
                self.countries[w] = fold(country)
        for alias, country in _COUNTRIES.items():
            if country in self.countries.values():
                self.countries.setdefault(tuple(alias.split()), country)
        self.known_words = {w for k in (*self.regions, *self.countries) for w in k}

    def runs(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """Runs of words that may be a city, written together."""
        for i in range(len(words)):
            for j in range(i + 1, min(i + self.most_words, len(words)) + 1):
                key = "".join(words[i:j])
                if len(key) > self.longest + RADIUS:
                    break
                if len(key) >= self.shortest - RADIUS and not all(w in self.known_words for w in words[i:j]):
                    yield key, i, j

    def said(self, words: list[str]) -> tuple[set[str], set[str]]:
        """Regions and countries that words name."""
        regions, countries = set(), set()
        for i in range(len(words)):
            for j in range(i + 1, min(i + 4, len(words) + 1)):
                w = tuple(words[i:j])
                if w in self.regions:
                    regions.add(self.regions[w])
                if w in self.countries:
                    countries.add(self.countries[w])
        return regions, countries

    def choose(self, words: list[str], hits: list[tuple]) -> list[int]:
        """Of hits ``(distance, key, i, j, places of the key)`` the places of the best reading, whatever their order.

        A run of words that is exactly a listed name means that name: it isn't read as another one
        misspelt, not even where its own places are ruled out by what stands beside it.
        """
        taken = {n for d, _, i, j, _ in hits if d == 0 for n in range(i, j)}
        options: dict[int, tuple] = {}
        for d, key, i, j, places in hits:
            if d and not taken.isdisjoint(range(i, j)):
                continue
            regions, countries = self.said(words[:i] + words[j:])
            run = "".join(words[i:j])
            for place, region, country in places:
                if regions and region not in regions:
                    # Of a code that is both a country and a region the country may be meant.
                    if region is not None or not countries or country not in countries:
                        continue
                if not regions and countries and country not in countries:
                    continue
                # A run that ends in a region's word takes in what should tell places apart. First letters are
                # seldom mistyped, so of names as near the one with the same first letter is meant.
                edge = j - i > 1 and (words[i] in self.known_words or words[j - 1] in self.known_words)
                rank = (d, edge, key[:1] != run[:1], -len(key))
                if place not in options or rank < options[place]:
                    options[place] = rank
        best = min(options.values(), default=None)
        return sorted(p for p, r in options.items() if r == best)


class Index:
    """The names of a list, or of a shard of it, in BK-trees of at most ``SHARD_ENTRIES`` names each."""

    def __init__(self, entries: list[tuple[int, str, str | None, str | None]]) -> None:
        self.places: dict[str, list[tuple]] = defaultdict(list)
        for place, key, region, country in entries:
            self.places[key].append((place, fold(region) if region else None, fold(country) if country else None))
        names = sorted(self.places)
        self.trees = [BKTree(names[lo : lo + SHARD_ENTRIES]) for lo in range(0, len(names), SHARD_ENTRIES)]

    def within(self, queries: list[str], radius: int) -> dict[int, list[tuple[int, str]]]:
        """For each query with a hit: (distance, name) over all trees."""
        out: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for tree in self.trees:
            for q, found in tree.within(queries, radius).items():
                out[q] += [(d, tree.names[n]) for d, n in found]
        return out


def read_values(areas: Areas, index: Index, values: list[str]) -> list[list[int]]:
    """The places that each value may name: one where it names a place, none or several where it names none."""
    split = [words_of(v) for v in values]
    asked: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for n, words in enumerate(split):
        for key, i, j in areas.runs(words):
            asked[key].append((n, i, j))
    out: list[list[int]] = [[] for _ in values]
    near: dict[int, list[tuple]] = defaultdict(list)
    left = sorted(asked)
    for radius in range(RADIUS + 1):  # most values are free of slips or have one, and a small radius prunes best
        fresh: dict[int, list[tuple]] = defaultdict(list)
        for q, found in index.within(left, radius).items():
            for n, i, j in asked[left[q]]:
                fresh[n] += [(d, key, i, j, index.places[key]) for d, key in found if d == radius]
        for n, found in fresh.items():
            near[n] += found
            out[n] = areas.choose(split[n], near[n])
        left = [k for k in left if any(not out[n] for n, _, _ in asked[k])]
    return out


_indexes: dict[str, Index] = {}
_memory: dict[str, list[int]] = {}
_current: list[str] = []


def _remembered(token: str, areas: Areas, entries, values: list[str]) -> dict[str, list[int]]:
    """Readings of distinct values; the worker keeps one list's trees and its latest readings."""
    if _current != [token]:
        _indexes.clear()
        _memory.clear()
        _current[:] = [token]
        _indexes[token] = Index(entries())
    out = {v: _memory[v] for v in values if v in _memory}
    fresh = [v for v in values if v not in out]
    out.update(zip(fresh, read_values(areas, _indexes[token], fresh)))
    _memory.update((v, out[v]) for v in fresh if len(v) < 200)
    for v in list(_memory)[: max(0, len(_memory) - REMEMBERED)]:  # the oldest
        del _memory[v]
    return out


def _told(at: pd.Series) -> np.ndarray:
    return np.array([isinstance(v, str) and bool(v.strip().strip("\u200b\ufeff")) for v in at], dtype=bool)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [words_of(c) for c in pdf["city"]]
        pdf = pdf.assign(key=["".join(w) for w in words], n_words=[len(w) for w in words])
        yield pdf[pdf["key"] != ""]


def _by_shards(values: DataFrame, entries: DataFrame, areas: Areas, n_entries: int) -> DataFrame:
    """``value, found``: readings of distinct values where no worker can hold the whole list.

    Each task holds one shard of the names against one part of the values, all within the bounds
    above; the hits of the shards are then put together for each value.
    """
    shards, salts = -(-n_entries // SHARD_ENTRIES), -(-values.count() // SALT_VALUES)
    entries = entries.withColumn("shard", (F.xxhash64("key") % shards + shards) % shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(salts, 1) - 1))))
    asked = values.withColumn("salt", (F.xxhash64("value") % salts + salts) % salts if salts else F.lit(0)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def hold(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        index = Index(list(entries[["place_id", "key", "region", "country"]].astype(object).where(entries.notna(), None).itertuples(index=False, name=None)))
        rows = [(v, key, i, j) for v in asked["value"] for key, i, j in areas.runs(words_of(v))]
        keys = sorted({r[1] for r in rows})
        hits = {keys[q]: found for q, found in index.within(keys, RADIUS).items()}
        out = [(v, d, name, i, j, *p) for v, key, i, j in rows for d, name in hits.get(key, ()) for p in index.places[name]]
        return pd.DataFrame(out, columns=["value", "d", "name", "i", "j", "place", "region", "country"])

    hits = asked.groupBy("shard", "salt").cogroup(entries.groupBy("shard", "salt"))
    hits = hits.applyInPandas(hold, "value string, d int, name string, i int, j int, place bigint, region string, country string")
    hits = hits.groupBy("value").agg(F.collect_list(F.struct("d", "name", "i", "j", "place", "region", "country")).alias("hits"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [areas.choose(words_of(v), [(h["d"], h["name"], h["i"], h["j"], [(h["place"], h["region"], h["country"])]) for h in hits]) for v, hits in zip(pdf["value"], pdf["hits"])]
            yield pd.DataFrame({"value": pdf["value"], "found": found})

    return hits.mapInPandas(decide, "value string, found array<bigint>")


def resolve_places(df: DataFrame, value: str, places: DataFrame, out: str = "place_id") -> DataFrame:
    """``df`` with ``out``: the place that the text ``value`` names, or -1 where it names none.

    A value names a place if some run of its words, folded and written together, lies within two
    edits of the place's city, and nothing else in the value speaks against the place's region or
    country; the nearest city wins. Every run goes down the tree, exact names included. Cities of one
    name are told apart by region or country; where the value does not say, it names none. Defined
    results: null and blank values give null; equal entries of the list count once, of two entries
    alike the value names none; all other columns pass through, whatever their names; an empty list
    gives -1 for every value. The result doesn't depend on how the list is divided.

    Plan: a map, no exchange, while the list has at most ``BROADCAST_ENTRIES`` entries (counted
    first). A longer list is divided into shards of ``SHARD_ENTRIES`` names, and the distinct values
    are held against one shard in each task. Only its regions and countries go to every worker.
    """
    spark = df.sparkSession
    rows = places.select(*[F.col(c).cast(t) for c, t in (("place_id", "bigint"), ("city", "string"), ("region", "string"), ("region_code", "string"), ("country", "string"))])
    rows = rows.where("place_id is not null and city is not null").distinct()
    entries = cut(rows.mapInPandas(_keyed, "place_id bigint, city string, region string, region_code string, country string, key string, n_words int"))
    n, shortest, longest, most = entries.agg(F.count("*"), F.min(F.length("key")), F.max(F.length("key")), F.max("n_words")).first()
    areas = Areas([tuple(r) for r in entries.select("region", "region_code", "country").distinct().collect()], shortest or 0, longest or 0, most or 0)
    entries = entries.select("place_id", "key", "region", "country").distinct()
    if n > BROADCAST_ENTRIES:
        told = df.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct()
        told = cut(told.mapInPandas(lambda batches: (pdf[_told(pdf["value"])] for pdf in batches), "value string"))
        read = _by_shards(told, entries, areas, n)
        one = told.join(read, "value", "left").select(F.col("value").alias("__v"), F.when(F.size("found") == 1, F.col("found")[0]).otherwise(-1).cast("int").alias("__p"))
        return df.join(one, F.col(value) == F.col("__v"), "left").withColumn(out, F.col("__p")).drop("__v", "__p")
    token, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((areas, [tuple(r) for r in entries.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf[value]
            told = _told(at)
            found = _remembered(token, shared.value[0], lambda: shared.value[1], list(dict.fromkeys(at[told])))
            pdf[out] = pd.array([(found[v][0] if len(found[v]) == 1 else -1) if t else None for v, t in zip(at, told)], dtype="Int64")
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, `{out}` bigint").withColumn(out, F.col(out).cast("int"))
