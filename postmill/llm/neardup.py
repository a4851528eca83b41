"""Near-duplicate records by weighted minimum hashing with darts (problem 2).

Every element of a set owns an endless plane of darts at fixed random places: their weight runs along
one axis and their rank along the other. A set sees those darts of its elements that lie below the
element's weight and below a rank that lets it see about as many as it has coordinates to fill. Each
dart belongs to one coordinate, and the dart of least rank is the coordinate's value. Two sets agree
in a coordinate with a probability equal to their weighted similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut, small

# Bands of rows. A pair at similarity 0.70 is missed with a probability of (1 - 0.7^7)^100 = 0.0002,
# one at 0.75 with 3e-7; a pair at 0.2, as of two texts of one board, is looked at with 0.001.
ROWS, BANDS = 7, 100
# Candidates are joined to their texts by broadcast up to this many of them, else by shuffle.
BROADCAST_CANDIDATES = 100_000
# Groups of equal texts with more members than this are linked to their first member only.
ALL_PAIRS_WITHIN = 1_000

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Area of a region of the plane of darts, and the distribution of the number of darts in one.
_AREA = 4
_POISSON = np.cumsum([math.exp(-_AREA) * _AREA**c / math.factorial(c) for c in range(40)])
# A dart's hash gives its place in the strip (40 bits) and its coordinate (24 bits).
_PLACE, _SLOT = np.uint64(40), np.uint64(24)


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _darts(elements: np.ndarray, weights: np.ndarray, limit: float, size: int) -> np.ndarray:
    """Keys of the darts below ``weights`` and of rank under about ``limit``: coordinate, then rank.

    The plane of an element is cut into regions of one area: level 0 has the weights from 0 to 1, a
    level v above it those from 2^(v-1) to 2^v, in strips of rank as high as the area demands. A
    region holds a number of darts with a Poisson distribution. The rank is kept as a fixed-point
    number, whose 54 bits also serve as the dart's identity within its coordinate.
    """
    keys = []
    top = max(0, math.ceil(math.log2(weights.max()))) if len(weights) else -1
    for level in range(top + 1):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        reach = weights > low
        here, bound = elements[reach], weights[reach]
        strips = math.ceil(limit * width / _AREA)
        with np.errstate(over="ignore"):
            numbers = mix(np.arange(strips, dtype=np.uint64) + np.uint64(level << 40))
            region = mix((here[:, None] ^ numbers).ravel())
            count = np.searchsorted(_POISSON, _unit(region), side="right")
            ends = np.cumsum(count)
            nth = np.arange(1, int(ends[-1]) + 1, dtype=np.uint64) if len(ends) else np.zeros(0, dtype=np.uint64)
            nth -= np.repeat((ends - count).astype(np.uint64), count)
            dart = mix(np.repeat(region, count) + nth * _GOLD)
            strip = np.repeat(np.tile(np.arange(strips, dtype=np.uint64), len(here)), count)
            slot = ((dart & np.uint64(0xFFFFFF)) * np.uint64(size)) >> _SLOT
            # Within its strip, of height area / width, the place is 40 bits; above it the strip's number.
            rank = (((strip << _PLACE) | (dart >> _SLOT)) * np.uint64(_AREA)) >> np.uint64(max(0, level - 1))
        key = (slot << np.uint64(54)) | rank
        if (bound < low + width).any():
            at = low + width * _unit(mix(dart ^ np.uint64(1)))
            key = key[at < np.repeat(np.repeat(bound, strips), count)]
        keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def dart_signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` (at most 1024) coordinates of a weighted set of 64-bit elements with positive weights."""
    total = float(weights.sum())
    if total <= 0:
        return np.zeros(size, dtype=np.uint64)
    throw = size * (math.log(size) + 1.5)
    slots = np.arange(size, dtype=np.uint64)
    while True:
        keys = np.sort(_darts(elements, weights, throw / total, size))
        at = np.searchsorted(keys, slots << np.uint64(54))
        found = keys[np.minimum(at, len(keys) - 1)] if len(keys) else slots
        # A coordinate is full if its least dart is there; ranks beyond the limit aren't complete.
        rank = (found & np.uint64((1 << 54) - 1)).astype(np.float64) * 2.0**-40
        if len(keys) and ((found >> np.uint64(54)) == slots).all() and (rank < throw / total).all():
            return found
        throw *= 1.5


def bands_of(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Of each signature, one 64-bit key for each band of ``rows`` coordinates, different bands apart."""
    table = signatures.reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(table.shape[1], dtype=np.uint64), table.shape[:2])
    for k in range(rows):
        key = mix(key ^ table[:, :, k])
    return key.view(np.int64)


class Shingler:
    """Distinct runs of ``n`` words as sorted 64-bit numbers."""

    def __init__(self, n: int, min_words: int) -> None:
        import regex
        import xxhash

        self.find = regex.compile(r"[\p{L}\p{N}]+").findall
        self.hash = xxhash.xxh3_64_intdigest
        self.n, self.min_words, self.known = n, min_words, {}

    def __call__(self, text: str) -> np.ndarray | None:
        words = self.find(text.lower())
        if len(words) < max(self.min_words, self.n):
            return None
        if len(self.known) > 500_000:
            self.known.clear()
        known, numbers = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self.hash(w)
            numbers.append(h)
        x = np.array(numbers, dtype=np.uint64)
        count = len(x) - self.n + 1
        with np.errstate(over="ignore"):
            key = np.zeros(count, dtype=np.uint64)
            for k in range(self.n):
                key = mix(key ^ x[k : k + count])
        return np.unique(key.view(np.int64))


def _text_of(title, body):
    return f"{title or ''}\n{body}"


def _sets(df: DataFrame, key: str, title: str, body: str, n: int, min_words: int, with_bands: bool) -> DataFrame:
    """Of each record with enough words: key, class (hash of its set), hash of its text, set size and its bands or its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n, min_words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512).to_pydict()
                keys, classes, texts, sizes, lists = [], [], [], [], []
                for k, t, b in zip(part["k"], part["t"], part["b"]):
                    text = _text_of(t, b)
                    s = shingle(text)
                    if s is None:
                        continue
                    keys.append(k)
                    classes.append(shingle.hash(s.tobytes()))
                    texts.append(shingle.hash(text))
                    sizes.append(len(s))
                    lists.append(dart_signature(s.view(np.uint64), np.ones(len(s)), ROWS * BANDS) if with_bands else s)
                if with_bands and lists:
                    lists = list(bands_of(np.stack(lists), ROWS))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.string()),
                        pa.array(np.array(classes, dtype=np.uint64).view(np.int64), pa.int64()),
                        pa.array(np.array(texts, dtype=np.uint64).view(np.int64), pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["k", "cls", "txt", "n", "items"],
                )

    rows = df.where(F.col(key).isNotNull() & F.col(body).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(body).alias("b"))
    return rows.mapInArrow(run, "k string, cls bigint, txt bigint, n int, items array<bigint>")


class NearDuplicates:
    """Records whose sets of word runs have a Jaccard similarity of at least ``percent`` / 100.

    Records with equal sets form a class, and only classes are compared: their signatures are joined
    by band, and each candidate pair of classes is then checked exactly on the whole sets. All later
    results are made of ``members`` (class, record) and ``links`` (class, class), so copies are never
    expanded unless asked for.

    Defined results: records with a null body or fewer than ``min_words`` words are left out; a null
    title is an empty one; repeated deliveries count once; a key delivered with different texts links
    by each of them, never with itself; an empty table gives no rows; other columns are not read.

    Plan: one map over the texts writes keys, classes and bands; the band table (a number and a class
    in each row) is the one large exchange, spread over as many keys as there are bands and texts. The
    sets, far larger, are made again for candidates only. A band that holds many classes is a skewed
    join key, which adaptive execution splits; nothing is collected by band.
    """

    def __init__(
        self,
        df: DataFrame,
        *,
        key: str = "id",
        title: str = "title",
        body: str = "descriptionPlain",
        n: int = 3,
        min_words: int = 20,
        percent: int = 70,
    ) -> None:
        signed = cut(_sets(df, key, title, body, n, min_words, True))
        self.members = signed.select("cls", "k").distinct()
        self.texts = signed.select("cls", "txt", "k").distinct()
        classes = signed.groupBy("cls").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("items").alias("bands"))
        banded = classes.select("cls", "n", F.explode("bands").alias("band"))
        a, b = banded.select("band", F.col("cls").alias("a"), F.col("n").alias("na")), banded.select("band", F.col("cls").alias("b"), F.col("n").alias("nb"))
        close = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        pairs = cut(a.join(b, "band").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        # One record of each candidate class; its set is made again from its text.
        firsts = cut(signed.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("k").alias("k")))
        ids = small(firsts.select(F.col("k").alias(key)), BROADCAST_CANDIDATES)
        texts = df.join(ids, key, "left_semi")
        sets = _sets(texts, key, title, body, n, min_words, False).select("cls", "items")
        sets = sets.join(small(firsts.select("cls"), BROADCAST_CANDIDATES), "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items"))
        sets = cut(sets)
        shared = F.size(F.array_intersect("ia", "ib"))
        self.links = cut(
            pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("items").alias("ib")), "b")
            .withColumn("shared", shared)
            .withColumn("either", F.size("ia") + F.size("ib") - F.col("shared"))
            .where(F.col("shared") * 100 >= F.col("either") * percent)
            .select("a", "b", (F.col("shared") / F.col("either")).alias("similarity"))
        )

    def pairs(self) -> DataFrame:
        """All pairs of records ``id_a < id_b``.

        Within a class all are paired. Only more than ``ALL_PAIRS_WITHIN`` records of exactly one text
        aren't expanded: the first stands for them in pairs with other texts, and they are linked to it.
        """
        m = self.texts
        groups = m.groupBy("cls", "txt").agg(F.count("*").alias("size"), F.min("k").alias("first"))
        copies = cut(m.join(groups, ["cls", "txt"]))
        shown = copies.where((F.col("size") <= ALL_PAIRS_WITHIN) | (F.col("k") == F.col("first"))).select("cls", "k").distinct()
        across = (
            self.links.join(shown.select(F.col("cls").alias("a"), F.col("k").alias("x")), "a")
            .join(shown.select(F.col("cls").alias("b"), F.col("k").alias("y")), "b")
            .select("x", "y")
        )
        inner = shown.select("cls", F.col("k").alias("x")).join(shown.select("cls", F.col("k").alias("y")), "cls").where("x < y")
        star = copies.where((F.col("size") > ALL_PAIRS_WITHIN) & (F.col("k") > F.col("first"))).select(F.col("first").alias("x"), F.col("k").alias("y"))
        both = across.unionByName(inner.select("x", "y")).unionByName(star).where("x <> y")
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def classes(self) -> DataFrame:
        """One row for each record: the first record of its class, and its number of links."""
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("size"), F.min("k").alias("class_id"))
        ends = self.links.select("a", "b").union(self.links.select("b", "a")).toDF("cls", "other")
        beside = ends.join(sizes.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("others"))
        return (
            self.members.join(sizes, "cls")
            .join(beside, "cls", "left")
            .groupBy(F.col("k").alias("id"))
            .agg(F.min("class_id").alias("class_id"), F.max(F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        )
