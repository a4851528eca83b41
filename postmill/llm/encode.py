"""Encoding of a corpus with a byte-level pair-encoding vocabulary (problem 8).

For every prefix of a piece of text there is exactly one last token that its encoding ends with. The
encoder walks once over the piece, takes the tokens that end at each place from an automaton over the
whole vocabulary, and stores the token that is compatible with the last token of the prefix before
it. Back-pointers from the end give the ids. No merge queue is needed and no piece is ever cut.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pattern that divides a text into pieces before encoding.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Encodings of short pieces that a worker keeps: a bound on its memory, not on what is encoded.
CACHED_PIECES, CACHED_LENGTH, KNOWN_PAIRS = 200_000, 24, 300_000


class PrefixEncoder:
    """Encodes pieces of text exactly as merging by rank would, by dynamic programming over prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.pieces = regex.compile(PIECES).findall
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        # The two tokens that a token is merged of: the last merge of its own encoding.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[i] = two = self._split(t, i)
            if two[0] != i:
                self.merged[two] = i
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, array] = {}

    def _split(self, t: bytes, i: int) -> tuple[int, int]:
        """The pair of older tokens whose merge gives ``t``; ``(i, i)`` for a single byte."""
        if len(t) == 1:
            return i, i
        ids = [self.ranks[t[k : k + 1]] for k in range(len(t))]
        texts = [t[k : k + 1] for k in range(len(t))]
        while len(ids) > 2:
            best, at = i, -1
            for k in range(len(ids) - 1):
                r = self.ranks.get(texts[k] + texts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            texts[at : at + 2] = [texts[at] + texts[at + 1]]
            ids[at : at + 2] = [best]
        return (ids[0], ids[1]) if len(ids) == 2 else (i, i)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is itself an encoding: no merge would cross their border.

        The border's two neighbours are taken apart, the younger first, as merging would have put
        them together; at each state the pair at the border must not merge earlier than the state
        was built.
        """
        pair = (left, right)
        if (had := self.known.get(pair)) is not None:
            return had
        until, fine = len(self.token) + 1, True
        merged, halves = self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across is not None and across < until:
                fine = False
                break
            # A tie goes to the right-hand one: of equal ranks the left merge is made first.
            take_left = left > right and halves[left][1] != left
            take_right = not take_left and halves[right][0] != right
            if take_left:
                until, left = left, halves[left][1]
            elif take_right:
                until, right = right + 1, halves[right][0]
            elif halves[left][1] != left:
                until, left = left, halves[left][1]
            else:
                break
        if len(self.known) < KNOWN_PAIRS:
            self.known[pair] = fine
        return fine

    def piece(self, text: str) -> array:
        data = text.encode()
        if (whole := self.ranks.get(data)) is not None:
            return array("i", (whole,))
        n = len(data)
        last, length = array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        compatible, reached, done = self.compatible, bytearray(n + 1), -1
        reached[0] = 1
        # Of the tokens that end at one place the automaton gives the longest first.
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - size
            if reached[start] and (start == 0 or compatible(last[start], token)):
                last[end + 1], length[end + 1], reached[end + 1], done = token, size, 1, end
        out, at = array("i"), n
        while at:
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def encode_into(self, text: str, out: array) -> None:
        cache = self.cache
        for p in self.pieces(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= CACHED_LENGTH and len(cache) < CACHED_PIECES:
                    cache[p] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


def load_ranks(path: str) -> dict[bytes, int]:
    """A public vocabulary file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


_encoders: dict[str, PrefixEncoder] = {}


def _encoder(path: str, ranks) -> PrefixEncoder:
    """The worker's encoder, built once; ``ranks`` gives the vocabulary that was broadcast."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PrefixEncoder(ranks())
    return _encoders[path]


def encode_texts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """``key`` and the token ids of each row's text, without special tokens.

    ``path`` is the vocabulary file, read by the driver and broadcast (under 2 MB, whatever the
    corpus). One pass, no exchange: each worker builds the encoder once and keeps the encodings of
    short pieces, which make up nearly all of a text. Defined results: null and empty texts give an empty list; the strings of special
    tokens are ordinary text; repeated rows give repeated rows; texts of any length are encoded whole.
    """

    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, lambda: ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, ends = array("i"), array("i", (0,))
                for value in part.column(1):
                    if (t := value.as_py()) is not None:
                        enc.encode_into(t, flat)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(
                    pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]),
                    pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
