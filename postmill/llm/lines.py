"""Lines repeated across the documents of one source (problem 5).

Each line of a source becomes a 64-bit identifier. The identifiers of a source's documents, one
document after the other with a border between, are sorted as suffixes; suffixes with a common prefix
stand together, and for each length of prefix the documents among them are counted. A source of any size
is worked on in bounded shards of whole documents; since a document lies in one shard only, the
counts of the shards add up exactly. A block is given in its longest form: one line more, before or
behind, and it would stand in too few documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.spans import window_hashes
from postmill.session import cut, small

# At most so many repeated blocks are broadcast; beyond that they are joined by shuffle.
BROADCAST_BLOCKS = 100_000
# Documents that one suffix array holds.
SHARD_DOCS = 4_096

# Fixed value: all white space, no-break space included, as one character class.
_SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"


def line_form(line: Column) -> Column:
    """The form in which lines are compared: white space runs as one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, _SPACE + "+", " ")))


def _lines(text: Column) -> Column:
    """The lines of a text in compared form; empty ones stay, so that positions hold."""
    return F.transform(F.split(text, "\n"), line_form)


def _ids(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``symbols`` in the order of the suffixes that begin there, and common prefixes.

    The second array has, for each place in that order, how many symbols it shares with the one
    before it, at most ``depth``. Ranks are doubled until they tell suffixes apart or cover ``depth``
    symbols. Symbols must be unique where documents end, so no common prefix runs over a border.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < depth and n:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - span] = rank[span:] if span < n else after[:0]
        pair = (rank << 32) | (after + 1)
        new = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        done = len(np.unique(new)) == n
        rank, span = new, span * 2
        if done:
            break
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    same = np.ones(max(n - 1, 0), dtype=bool)
    for k in range(depth):  # one comparison for each line of the block, over the whole array at once
        a, b = order[:-1] + k, order[1:] + k
        within = (a < n) & (b < n)
        same &= within & (symbols[np.where(within, a, 0)] == symbols[np.where(within, b, 0)])
        common[1:] += same
    return order, common


def _shard_blocks(runs: list[np.ndarray], owner: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length from ``least`` on, the distinct blocks of a shard's runs of lines.

    Gives arrays: two hashes of the block, the number of its owners, the hashes of the block without its last
    and without its first line, and a place where it stands (owner, and position in the owner's lines).
    """
    lengths = np.array([len(r) + 1 for r in runs], dtype=np.int64)
    ends = np.cumsum(lengths) - 1
    border = np.zeros(int(lengths.sum()), dtype=bool)
    border[ends] = True
    flat = np.zeros(len(border), dtype=np.int64)
    flat[~border] = np.concatenate(runs)
    symbols = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    symbols[border] = symbols.max() + 1 + np.arange(len(runs))
    longest = int(lengths.max()) - 1
    order, common = suffix_array(symbols, longest)
    run_of = np.repeat(np.arange(len(runs)), lengths)
    left = ends[run_of[order]] - order  # lines before the border
    place = at[run_of] + np.arange(len(flat)) - (ends - lengths + 1)[run_of]
    codes = flat.view(np.uint64)
    hashes = lambda n: [window_hashes(codes, n, w).view(np.int64) for w in (0, 1)] if n else [np.zeros(len(flat) + 1, np.int64)] * 2
    shorter = hashes(least - 1)
    for depth in range(least, longest + 1):
        whole = left >= depth
        # A group of equal blocks begins where the common prefix with any suffix since the last whole one is shorter.
        group = np.cumsum(common < depth)[whole]
        here, owners = order[whole], owner[run_of[order[whole]]]
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        counts = np.bincount(np.unique(np.stack([group, owners]), axis=1)[0])
        now, rep = hashes(depth), here[first]
        yield (*[h[rep] for h in now], counts, *[h[rep] for h in shorter], *[h[rep + 1] for h in shorter], owners[first], place[rep], depth)
        shorter = now


_BLOCK = "s string, size int, h1 bigint, h2 bigint, n bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint, k string, at int"


def _blocks(least: int):
    """Documents with their lines, in which 0 stands for a line that no block can hold, to blocks of their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(lo, SHARD_DOCS).to_pydict()
                by_source: dict[str, list[tuple[int, int, np.ndarray]]] = {}
                for i, (s, lines) in enumerate(zip(part["s"], part["lines"])):
                    x = np.array(lines, dtype=np.int64)
                    cuts = np.flatnonzero(x == 0)
                    for a, b in zip([0, *(cuts + 1)], [*cuts, len(x)]):
                        if b - a >= least:
                            by_source.setdefault(s, []).append((i, a, x[a:b]))
                for s, runs in by_source.items():
                    keys = np.array(part["k"], dtype=object)
                    for h1, h2, n, a1, a2, b1, b2, owner, at, size in _shard_blocks([r for *_, r in runs], np.array([i for i, *_ in runs]), np.array([a for _, a, _ in runs]), least):
                        columns = [pa.array([s] * len(n), pa.string()), pa.array(np.full(len(n), size), pa.int32()), *[pa.array(c, pa.int64()) for c in (h1, h2, n, a1, a2, b1, b2)], pa.array(keys[owner], pa.string()), pa.array(at, pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_blocks(
    df: DataFrame,
    *,
    source: str = "board",
    key: str = "id",
    text: str = "descriptionPlain",
    min_docs: int = 5,
    min_share: float = 0.2,
    min_lines: int = 1,
) -> DataFrame:
    """The longest blocks of ``min_lines`` lines or more in at least ``min_docs`` and ``min_share`` of a source's documents.

    Columns: ``source, block, lines, n_docs``, where ``block`` is the array of the lines' identifiers
    and ``lines`` their text; empty lines don't count. Every shorter block within one given stands in as
    many documents at least. Defined results: a document is a distinct ``key`` within its source; a null
    text counts as a document without lines; rows with a null source or key are left out; a block that one
    document repeats counts once; rows delivered several times count once; an empty table gives no rows.
    Identifiers are compared within a source, by 64 bits for a line and 128 for a block of several.

    Plan: only identifiers (8 bytes a line) are exchanged, by document, never by source or line, so a
    source with a third of all rows is spread like any other. Lines that too few documents have are cut out
    first, by a count with map-side combining; suffix arrays are built over bounded shards of what is left, and
    their counts summed. Text is read a second time for the lines of the blocks found, of which a
    source has at most ``1 / min_share`` times the lines of a document.
    """
    known = df.where(F.col(source).isNotNull() & F.col(key).isNotNull())
    docs = known.select(
        F.col(source).cast("string").alias("s"), F.col(key).cast("string").alias("k"), F.coalesce(_ids(_lines(F.col(text))), F.array().cast("array<bigint>")).alias("ids")
    )
    # Rows of one document come together, a border between them; equal deliveries fall away before the exchange.
    docs = docs.distinct().groupBy("s", "k").agg(F.flatten(F.transform(F.array_sort(F.collect_list("ids")), lambda x: F.array_append(x, F.lit(0).cast("bigint")))).alias("ids"))
    docs = cut(docs)
    totals = docs.groupBy("s").agg(F.count("*").alias("total"))
    enough = (F.col("n_docs") >= min_docs) & (F.col("n_docs") >= min_share * F.col("total"))
    single = docs.select("s", F.explode(F.array_distinct("ids")).alias("line_id")).groupBy("s", "line_id").agg(F.count("*").alias("n_docs"))
    wanted = cut(single.where("line_id <> 0").join(totals, "s").where(enough).select("s", "line_id"))
    good = wanted.groupBy("s").agg(F.collect_set("line_id").alias("good"))
    lines = F.transform("ids", lambda x: F.when(F.array_contains("good", x), x).otherwise(F.lit(0).cast("bigint")))
    cleared = docs.join(small(cut(good), BROADCAST_BLOCKS), "s").select("s", "k", lines.alias("lines")).where(F.exists("lines", lambda x: x != 0))
    found = (
        cleared.mapInArrow(_blocks(min_lines), _BLOCK)
        .groupBy("s", "size", "h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.min(F.struct("k", "at")).alias("place"), *[F.first(c).alias(c) for c in ("a1", "a2", "b1", "b2")])
        .join(totals, "s")
        .where(enough)
    )
    found = cut(found)
    inner = found.select("s", (F.col("size") - 1).alias("size"), F.col("a1").alias("h1"), F.col("a2").alias("h2"))
    inner = inner.union(found.select("s", F.col("size") - 1, "b1", "b2")).distinct()
    longest = found.join(inner, ["s", "size", "h1", "h2"], "left_anti").select("s", "place.k", "place.at", "size", "n_docs")
    longest = docs.join(small(cut(longest), BROADCAST_BLOCKS), ["s", "k"]).select("s", F.slice("ids", F.col("at") + 1, F.col("size")).alias("block"), "n_docs")
    longest = cut(longest)
    # The text of the lines of the blocks found: few, whatever the number of documents.
    text_of = known.select(
        F.col(source).cast("string").alias("s"), F.explode(F.filter(_lines(F.col(text)), lambda x: x != "")).alias("line")
    ).withColumn("line_id", F.xxhash64("line"))
    names = text_of.join(small(wanted, BROADCAST_BLOCKS), ["s", "line_id"], "left_semi").groupBy("s", "line_id").agg(F.min("line").alias("line"))
    out = (
        longest.select("s", "block", "n_docs", F.posexplode("block").alias("pos", "line_id"))
        .join(names, ["s", "line_id"])
        .groupBy("s", "block", "n_docs")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    )
    return out.select(F.col("s").alias(source), "block", F.col("lines.line").alias("lines"), "n_docs")


def without_blocks(
    df: DataFrame, blocks: DataFrame, *, source: str = "board", text: str = "descriptionPlain", out: str = "clean_text", min_lines: int = 1
) -> DataFrame:
    """``df`` with ``out``: the text without the lines that lie in a repeated block of its source.

    A part of a block, of at least ``min_lines`` lines, is a repeated block too, and is deleted wherever it
    stands. Lines that stay keep their text as stored. A null text stays null; a source without blocks keeps
    its texts. The blocks of a source are few (see ``repeated_blocks``); they are joined by broadcast
    where their count is within the bound, else by shuffle.
    """
    parts = F.transform(F.sequence(F.lit(0), F.size("block") - min_lines), lambda i: F.slice("block", i + 1, F.lit(min_lines)))
    per_source = blocks.where(F.size("block") >= min_lines).groupBy(F.col(source).alias("__s")).agg(F.array_distinct(F.flatten(F.collect_list(parts))).alias("__blocks"))
    raw, formed = F.split(F.col(text), "\n"), _lines(F.col(text))
    joined = df.join(small(cut(per_source), BROADCAST_BLOCKS), F.col(source).cast("string") == F.col("__s"), "left").withColumn("__n", F.when(F.col("__s").isNotNull(), min_lines))
    # Identifiers of the lines that are not empty, with their places; a block covers its places.
    places = F.filter(F.transform(formed, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    ids = F.transform(F.col("__places"), lambda i: F.xxhash64(F.get(F.col("__formed"), i)))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("__ids") - F.col("__n"), F.lit(0))),
        lambda p: F.array_contains(F.col("__blocks"), F.slice(F.col("__ids"), p + 1, F.col("__n"))),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(starts, lambda p: F.transform(F.slice(F.col("__places"), p + 1, F.col("__n")), lambda i: i)))
    )
    kept = F.filter(raw, lambda _, i: ~F.array_contains(F.col("__covered"), i))
    return (
        joined.withColumn("__formed", formed)
        .withColumn("__places", places)
        .withColumn("__ids", ids)
        .withColumn("__covered", F.when(F.col("__n").isNotNull(), covered))
        .withColumn(out, F.when(F.col("__covered").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .drop("__s", "__blocks", "__n", "__formed", "__places", "__ids", "__covered")
    )
