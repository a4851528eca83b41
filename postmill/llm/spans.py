"""Long exact spans shared between records (problem 10).

Every window of the wanted length has a minimiser, the run of half that length in it with the least
hash. Equal windows have equal minimisers, and windows that follow one another mostly share theirs,
so they travel together as one packed string to the bucket of their minimiser, where the windows are
sorted and equal ones counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.neardup import mix
from postmill.session import cut

# Code points that are worked on at once; longer texts are taken in overlapping segments.
SEGMENT = 400_000
# Classes of equal texts with more members than this are linked to their first member only.
ALL_PAIRS_WITHIN = 1_000
# A bucket with more windows than this is not sorted in one task: its windows are exchanged one by one.
BUCKET_WINDOWS = 1_000_000

# Odd bases of two rolling hashes modulo 2^64, and their inverses.
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; kept for later calls."""
    had = _powers.get(int(base))
    if had is None or len(had) < n:
        with np.errstate(over="ignore"):
            had = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SEGMENT + 4096) - 1, base)]))
        if n <= 4 * SEGMENT:
            _powers[int(base)] = had
    return had[:n]


def window_hashes(codes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` code points."""
    n = len(codes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        terms = mix(codes.astype(np.uint64) + np.uint64(which << 32)) * _power(_BASES[which], n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix((sums[length:] - sums[:-length]) * _power(_INVERSES[which], n - length + 1))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from minima forwards and backwards in blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def super_kmers(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of windows with one minimiser."""
    k = length // 2
    least = sliding_least(window_hashes(codes, k), length - k + 1)
    if not len(least):
        return least, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.concatenate([first, [len(least)]]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def _cut_out(length: int):
    """Texts to their super-k-mers, by place only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            rows = 0
            for doc, value in zip(batch.column(0), batch.column(1)):
                text = value.as_py()
                if len(text) < length:
                    continue
                codes = _codes(text)
                for at in range(0, len(codes) - length + 1, SEGMENT):
                    least, first, count = super_kmers(codes[at : at + SEGMENT + length - 1], length)
                    held.append((doc.as_py(), least, first + at, count))
                    rows += len(least)
                if rows > 100_000:
                    yield _places(held)
                    held, rows = [], 0
            yield _places(held)

    return run


def _places(held: list) -> pa.RecordBatch:
    join = lambda i: np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64)
    docs = np.repeat(np.array([h[0] for h in held], dtype=np.int64), [len(h[1]) for h in held])
    columns = [join(1).astype(np.uint64).view(np.int64), docs, join(2).astype(np.int64), join(3).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["mini", "doc", "start", "n"])


def _pack(length: int):
    """Texts and the places wanted of them to packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mini", "hot", "doc", "start", "n", "packed"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for doc, value, places in zip(*(batch.column(i).slice(lo, 256) for i in range(3))):
                    codes = _codes(value.as_py())
                    for p in places.as_py():
                        s, n = p["start"], p["n"]
                        if s + n + length - 1 > len(codes):  # a place in another text of the same key
                            continue
                        for column, x in zip(out, (p["mini"], p["hot"], doc.as_py(), s, n, _text(codes[s : s + n + length - 1]))):
                            column.append(x)
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _windows(docs: list, starts: list, counts: list, packed: list, length: int) -> tuple[np.ndarray, ...]:
    """Every window of packed strings: two hashes, document and place."""
    if not docs:
        zero = np.zeros(0, np.int64)
        return zero.astype(np.uint64), zero.astype(np.uint64), zero, zero
    codes = np.concatenate([_codes(p) for p in packed])
    n = np.array(counts, dtype=np.int64)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(base, n) + offset
    return (
        window_hashes(codes, length, 0)[at],
        window_hashes(codes, length, 1)[at],
        np.repeat(np.array(docs, dtype=np.int64), n),
        np.repeat(np.array(starts, dtype=np.int64), n) + offset,
    )


_GROUP = "g1 bigint, g2 bigint, doc bigint, start bigint, `end` bigint"


def _runs(g1: np.ndarray, g2: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows that follow one another in a document and stand in the same documents, joined to spans."""
    order = np.lexsort((at, doc, g2, g1))
    g1, g2, doc, at = g1[order], g2[order], doc[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
    columns = [g1[first].view(np.int64), g2[first].view(np.int64), doc[first], at[first], at[last] + length]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g1", "g2", "doc", "start", "end"])


def _count(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Sorts windows and keeps those in two or more documents, named by the set of their documents."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    group = np.cumsum(new) - 1
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    n_docs = np.bincount(group[other], minlength=int(group[-1]) + 1) if len(at) else np.zeros(0, np.int64)
    names = []
    for which in (1, 2):
        with np.errstate(over="ignore"):
            terms = np.where(other, mix(doc.astype(np.uint64) ^ mix(np.uint64(which))), np.uint64(0))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            edges = np.concatenate([np.flatnonzero(new), [len(at)]])
            names.append((sums[edges[1:]] - sums[edges[:-1]])[group] if len(at) else terms)
    keep = n_docs[group] > 1 if len(at) else np.zeros(0, bool)
    return _runs(names[0][keep], names[1][keep], doc[keep], at[keep], length)


def _buckets(length: int):
    """Packed strings in the order of their minimisers: whole buckets are sorted and counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        windows, mini = 0, None
        for batch in batches:
            for m, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if m != mini and windows > BUCKET_WINDOWS // 4:
                    yield _count(*_windows(*held, length), length)
                    held, windows = [[], [], [], []], 0
                mini = m
                windows += row[2]
                for column, x in zip(held, row):
                    column.append(x)
        yield _count(*_windows(*held, length), length)

    return run


def _loose(length: int):
    """Packed strings of hot buckets to their single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = [batch.column(i).slice(lo, 256).to_pylist() for i in range(4)]
                h1, h2, doc, at = _windows(*part, length)
                columns = [h1.view(np.int64), h2.view(np.int64), doc, at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "doc", "start"])

    return run


class SharedSpans:
    """Spans of at least ``length`` code points that stand in two or more records.

    Records with equal texts form a class whose first record stands for it; spans are searched among
    first records only. ``spans`` has ``g1, g2, doc, start, end``: the span of ``doc`` from ``start`` to
    before ``end``; spans with equal (g1, g2) consist of windows that stand in exactly the same set of
    records. ``copies`` has ``doc, first, size, chars`` of each record of a class of two or more.
    ``key`` must be an integer. Windows are compared by 128 bits of hash; all of a text is looked at.

    Defined results: null keys, null, empty and short texts give nothing; a stretch repeated within
    one record only is no case; repeated deliveries of a record are one record. A key that comes with
    different texts is one record too, whose spans may lie in any of them.

    Plan: (1) a map writes minimisers and places, some 32 bytes for every 75 characters; (2) a grouping
    with map-side combining keeps the minimisers of more than one record; (3) only records with
    such a place have their text exchanged, and only those places are cut out and sent to their
    bucket. A bucket whose windows are too many for one task is counted by exchanging its windows
    instead, pre-aggregated; both ways give the same rows.
    """

    def __init__(self, df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 300, bucket_windows: int = BUCKET_WINDOWS) -> None:
        rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
        rows = rows.where(F.length("text") >= length)
        named = cut(rows.select("doc", F.md5("text").alias("h"), F.length("text").alias("chars")).distinct())
        classes = named.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("size")).where("size > 1")
        self.copies = cut(named.join(classes, "h").select("doc", "first", "size", "chars"))
        places = rows.mapInArrow(_cut_out(length), "mini bigint, doc bigint, start bigint, n bigint")
        places = cut(places.join(self.copies.where("doc <> first").select("doc"), "doc", "left_anti"))
        self.spans = _shared(rows, places, length, bucket_windows)

    def pairs(self) -> DataFrame:
        """Pairs ``doc_id_a < doc_id_b`` that share a span, each once.

        All members of a class are paired, unless it has more than ``ALL_PAIRS_WITHIN``: then its
        first record stands for it in pairs with other texts, and its members are linked to the first.
        Every pair of different texts is listed, so a span of many texts gives many; ``classes`` says the same without them.
        """
        few = self.copies.where(F.col("size") <= ALL_PAIRS_WITHIN)
        members = few.select("first", F.col("doc").alias("member"))
        groups = self.spans.select("g1", "g2", "doc").distinct()
        full = groups.join(members, groups["doc"] == members["first"], "left").select("g1", "g2", "doc", F.coalesce("member", "doc").alias("x"))
        a, b = full.withColumnsRenamed({"doc": "da", "x": "a"}), full.withColumnsRenamed({"doc": "db", "x": "b"})
        across = a.join(b, ["g1", "g2"]).where("da < db").select("a", "b")
        inner = members.join(members.withColumnRenamed("member", "b"), "first").where("member < b").select(F.col("member").alias("a"), "b")
        star = self.copies.where((F.col("size") > ALL_PAIRS_WITHIN) & (F.col("doc") > F.col("first"))).select(F.col("first").alias("a"), F.col("doc").alias("b"))
        both = across.unionByName(inner).unionByName(star).where("a <> b")
        return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()

    def classes(self) -> DataFrame:
        """Groups of records that share spans: ``span_class, doc_id, start, stop``, linear in the spans.

        Two records share a span if, and only if, they have a row each of one class. A class is a set of
        records, with all spans that stand in exactly these; records of equal texts have the rows of
        their first one, and a class of their own over the whole text. Nothing is expanded into pairs.
        """
        name = F.concat_ws(":", F.hex("g1"), F.hex("g2"))
        own = self.spans.select(name.alias("span_class"), F.col("doc").alias("first"), "start", F.col("end").alias("stop"))
        members = self.copies.select("first", F.col("doc").alias("member"))
        spread = own.join(members, "first", "left").select("span_class", F.coalesce("member", "first").alias("doc_id"), "start", "stop")
        whole = self.copies.select(F.concat(F.lit("copies of "), F.col("first").cast("string")).alias("span_class"), F.col("doc").alias("doc_id"), F.lit(0).cast("bigint").alias("start"), F.col("chars").cast("bigint").alias("stop"))
        return spread.unionByName(whole).distinct()

    def coverage(self) -> DataFrame:
        """Of each record with a shared span: how many of its code points lie in one."""
        own = self.spans.select("doc", "start", "end").unionByName(self.copies.select("doc", F.lit(0).cast("bigint").alias("start"), F.col("chars").cast("bigint").alias("end")))
        order = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))
        return (
            own.distinct()
            .withColumn("fresh", fresh)
            .groupBy(F.col("doc").alias("doc_id"))
            .agg(F.sum(F.when(F.col("fresh") > 0, F.col("fresh")).otherwise(0)).alias("shared_chars"))
        )


def _shared(rows: DataFrame, places: DataFrame, length: int, bucket_windows: int) -> DataFrame:
    shared = (
        places.groupBy("mini")
        .agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.sum("n").alias("windows"))
        .where("a <> b")
        .select("mini", (F.col("windows") > bucket_windows).alias("hot"))
    )
    wanted = places.join(shared, "mini").groupBy("doc").agg(F.collect_set(F.struct("mini", "hot", "start", "n")).alias("places"))
    packed = rows.join(wanted, "doc").select("doc", "text", "places")  # a repeated delivery repeats windows, which count once
    packed = cut(packed.mapInArrow(_pack(length), "mini bigint, hot boolean, doc bigint, start bigint, n bigint, packed string"))
    cold = packed.where("not hot").select("mini", "doc", "start", "n", "packed").repartition("mini").sortWithinPartitions("mini")
    spans = cold.mapInArrow(_buckets(length), _GROUP)

    loose = packed.where("hot").select("doc", "start", "n", "packed").mapInArrow(_loose(length), "h1 bigint, h2 bigint, doc bigint, start bigint")
    sets = (
        loose.select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc, 1))").alias("g1"), F.expr("bit_xor(xxhash64(doc, 2))").alias("g2"))
        .where("n > 1")
    )
    own = loose.join(sets, ["h1", "h2"]).select("g1", "g2", "doc", "start")
    before = F.lag("start").over(Window.partitionBy("g1", "g2", "doc").orderBy("start"))
    run_no = F.sum(F.when(F.col("start") - F.col("before") <= 1, 0).otherwise(1)).over(Window.partitionBy("g1", "g2", "doc").orderBy("start"))
    hot = (
        own.withColumn("before", before)
        .withColumn("run", run_no)
        .groupBy("g1", "g2", "doc", "run")
        .agg(F.min("start").alias("start"), (F.max("start") + length).alias("end"))
        .drop("run")
    )
    return cut(spans.unionByName(hot))
