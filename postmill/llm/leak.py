"""Evaluation texts that stand in training text (problem 9).

A passage of ``n`` words of an item holds one of the blocks of about half as many words into which the
item is divided from its beginning. One Aho-Corasick automaton holds the blocks of all items, each
word as one symbol; it goes over each text once, and where a block stands the run of words that text
and item share is followed to both sides.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.neardup import mix
from postmill.session import cut

# Words are the maximal runs of letters and digits, in lower case.
WORDS = r"[\p{L}\p{N}]+"
# One automaton holds the items up to so many words (some 15 MB broadcast, 100 MB in a worker); a larger set is joined by shuffle.
AUTOMATON_WORDS = 1_000_000

_built: dict[str, object] = {}


def _symbol(n: int) -> str:
    """A character for the word number ``n``; 0 is for words that no item has."""
    return chr(n + 1 if n < 0xD7FF else n + 0x801)


class Blocks:
    """The items as strings of symbols, and the automaton over their blocks."""

    def __init__(self, items: list[tuple[int, str]], n_words: int) -> None:
        import ahocorasick
        import regex

        self.n, self.find, self.spans = n_words, regex.compile(WORDS).findall, regex.compile(WORDS).finditer
        self.size = (n_words + 1) // 2  # any n words of an item hold a block of this size that begins at a multiple of it
        self.symbols: dict[str, str] = {}
        self.items: list[tuple[int, str]] = []
        have: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = [w.lower() for w in self.find(text)]
            if len(words) < n_words:
                continue
            coded = "".join([self.symbols.setdefault(w, _symbol(len(self.symbols) + 1)) for w in words])
            for at in range(0, len(coded) - self.size + 1, self.size):
                have[coded[at : at + self.size]].append((len(self.items), at))
            self.items.append((item, coded))
        self.automaton = ahocorasick.Automaton()
        for block, places in have.items():
            self.automaton.add_word(block, places)
        if have:
            self.automaton.make_automaton()
        self.any = bool(have)

    def passages(self, text: str) -> list[tuple[int, int, int]]:
        """``item, first word, last word`` of each longest run of at least ``n`` words that text and item share."""
        get, other = self.symbols.get, _symbol(0)
        coded = "".join([get(w.lower(), other) for w in self.find(text)])
        if len(coded) < self.n or not self.any:
            return []
        done: dict[tuple[int, int], int] = {}
        runs: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, places in self.automaton.iter(coded):
            for number, at in places:
                shift = end - self.size + 1 - at
                if done.get((number, shift), -1) >= end:  # within a run that was followed already
                    continue
                item, want = self.items[number]
                low, high = end - self.size + 1, end
                while low > 0 and low - 1 - shift >= 0 and coded[low - 1] == want[low - 1 - shift]:
                    low -= 1
                while high + 1 < len(coded) and high + 1 - shift < len(want) and coded[high + 1] == want[high + 1 - shift]:
                    high += 1
                done[number, shift] = high
                if high - low + 1 >= self.n:
                    runs[item].add((low, high))
        return [(item, a, b) for item, found in runs.items() for a, b in _outermost(found)]


def _outermost(found: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that lie in no other one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda r: (r[0], -r[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _held(token: str, items, n_words: int) -> Blocks:
    """The worker's automaton, built once; of an older set nothing is kept."""
    if token not in _built:
        _built.clear()
        _built[token] = Blocks(items(), n_words)
    return _built[token]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    n_words: int = 12,
    doc_key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Passages of items in documents: ``doc_key, item_key, start, end``, one row for each passage.

    A passage is a longest run of at least ``n_words`` consecutive words that document and item share; what
    stands between the words does not matter. ``start`` and ``end`` are the offsets, in code points,
    of the passage in the text as stored. Only texts with a passage are read again for the offsets.

    Plan: a map over the documents, no exchange, one scan for all items while these have at most
    ``AUTOMATON_WORDS`` words (counted first). Beyond that, documents and items send the least hashes of
    their windows, with the words around, to one another, and the words are compared.
    Defined results: null, empty and short texts and items give nothing; items with equal text are
    each reported; repeated documents give repeated rows from the automaton; texts are scanned whole.
    """
    spark = docs.sparkSession
    kinds = f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, `{item_key}` bigint, start bigint, `end` bigint"
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_key), F.col(text))
    asked = cut(items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).distinct())
    total = asked.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if total > AUTOMATON_WORDS:
        return _by_windows(rows, asked, n_words, doc_key, text, item_key)
    shared, token = spark.sparkContext.broadcast([tuple(r) for r in asked.orderBy("item", "text").collect()]), uuid.uuid4().hex
    schema = pa.schema([(doc_key, pa.int64()), (item_key, pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _held(token, lambda: shared.value, n_words)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, value in zip(batch.column(0), batch.column(1)):
                t = value.as_py()
                if found := blocks.passages(t):
                    at = [m.span() for m in blocks.spans(t)]
                    out += [(doc.as_py(), item, at[a][0], at[b][1]) for item, a, b in found]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, kinds)


_WINDOW = "h bigint, owner bigint, at int, words array<string>, starts array<int>, ends array<int>"


def _least_windows(n_words: int):
    """Texts to the blocks of half a passage with the least hash in some passage, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, size = regex.compile(WORDS).finditer, (n_words + 1) // 2
        width, names = n_words - size + 1, [c.split()[0] for c in _WINDOW.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for owner, value in zip(batch.column(0), batch.column(1)):
                found = [(m.group().lower(), *m.span()) for m in find(value.as_py())]
                if len(found) < n_words:
                    continue
                x = np.array([xxhash.xxh3_64_intdigest(w) for w, _, _ in found], dtype=np.uint64)
                key = np.zeros(len(x) - size + 1, dtype=np.uint64)
                for k in range(size):
                    key = mix(key ^ x[k : k + len(key)])
                least = np.lib.stride_tricks.sliding_window_view(key, width).argmin(axis=1) + np.arange(len(key) - width + 1)
                for at in np.unique(least).tolist():
                    low, high = max(0, at - n_words + size), min(len(found), at + n_words)
                    near = found[low:high]
                    for column, v in zip(out, (int(key[at : at + 1].view(np.int64)[0]), owner.as_py(), at - low, *map(list, zip(*near)))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _by_windows(rows: DataFrame, items: DataFrame, n_words: int, doc_key: str, text: str, item_key: str) -> DataFrame:
    """The same passages for a set of items of any size: hashes meet by shuffle, words are compared."""
    size = (n_words + 1) // 2
    docs = rows.select(F.col(doc_key).cast("bigint").alias("owner"), F.col(text).alias("text")).mapInArrow(_least_windows(n_words), _WINDOW)
    asked = items.mapInArrow(_least_windows(n_words), _WINDOW).select("h", F.col("owner").alias("item"), F.col("at").alias("i_at"), F.col("words").alias("i_words"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b, i, j = r["words"], r["i_words"], r["at"], r["i_at"]
                if a[i : i + size] != b[j : j + size]:
                    continue
                low, high = 0, size - 1
                while i + low > 0 and j + low > 0 and a[i + low - 1] == b[j + low - 1]:
                    low -= 1
                while i + high + 1 < len(a) and j + high + 1 < len(b) and a[i + high + 1] == b[j + high + 1]:
                    high += 1
                if high - low + 1 >= n_words:
                    out.append((r["owner"], r["item"], r["starts"][i + low], r["ends"][i + high]))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "item", "start", "end"])

    hits = docs.join(asked, "h").select("owner", "at", "words", "starts", "ends", "item", "i_at", "i_words").mapInArrow(follow, "doc bigint, item bigint, start bigint, `end` bigint").distinct()
    # Pieces of one run overlap, as each holds the least blocks of the passages around; joined they are the run.
    order = Window.partitionBy("doc", "item").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") < before, 0).otherwise(1)).over(order)
    joined = hits.withColumn("run", run).groupBy("doc", "item", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(F.col("doc").cast(rows.schema[doc_key].dataType).alias(doc_key), F.col("item").alias(item_key), "start", "end")
