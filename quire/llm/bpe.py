"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of the prefix's encoding. It is found among the tokens that end
there (an Aho-Corasick automaton lists them) by asking whether the pair (last token before it, token) can stand side by side in an encoding.
A table of these last tokens gives the encoding of every prefix; appending bytes only adds entries, and after an edit only the
entries from the edit to the point where both tables agree again are computed anew.

Texts are cut into pieces by the tokenizer's pattern, and each piece is encoded by itself. A text is first cut where a white-space
run begins, which is always a border of pieces, and the encodings of short cuts are cached in a bounded table.

Defined results: null text is empty and has no token; no special token is ever produced; a text of any length is encoded as a whole, its ids in
memory of one task; encodings have no ties (a prefix has one valid last token); repeated rows get equal ids; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, strings

#: Entries of the pair table and the piece cache of a Python worker, and the longest cached cut.
MAX_PAIRS, MAX_CACHED, CACHED_CHARS = 1_000_000, 600_000, 40


class Vocabulary:
    """Ranks with what the prefix tables need: how each token is made, and an automaton of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: b for b, r in ranks.items()}
        #: The two tokens whose merge makes a token; single bytes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.longest = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                made = self._halves(token, rank)
                if made is None:  # no merge makes it, so it never occurs inside a longer piece
                    continue
                self.halves[rank] = made
                self.pairs[made] = rank
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._side_by_side: dict[int, bool] = {}  # by both tokens in one number

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """Merges a token's bytes, lowest rank first, with the ranks below its own; its halves if two parts are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = (self.ranks.get(p) for p in parts)
        return None if a is None or b is None else (a, b)

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether an encoding may hold the two tokens next to each other.

        Undoes merges of both tokens along their border, latest merge first: if at some moment the two border tokens
        could have been merged before either of the merges still to come, the pair can't stand.
        """
        a, b = left, right
        before = 1 << 60  # a merge across the border counts if its rank is lower than this
        ok = True
        while True:
            if self.pairs.get((a, b), before) < before:
                ok = False
                break
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                break
            # Ranks give the order of merges; of equal ones the left is merged first, so the right is undone first.
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]
        if len(self._side_by_side) >= MAX_PAIRS:
            self._side_by_side.clear()
        self._side_by_side[left << 32 | right] = ok
        return ok

    def extend(self, data: bytes, last: list[int], start: int, stop: Callable[[int], bool] | None = None) -> None:
        """Fills ``last`` (the last token of every prefix, by its length) from prefix length start + 1 on."""
        tokens, done, known = self.tokens, start, self._side_by_side.get
        behind = max(0, start - self.longest + 1)
        for end, (size, token) in self.automaton.iter(data[behind:].decode("latin-1")):
            at = end + behind + 1
            if at <= done:
                continue
            before = at - size
            if before:
                ok = known(last[before] << 32 | token)
                if ok is None:
                    ok = self.side_by_side(last[before], token)
            else:
                ok = True
            if ok:
                last.append(token)
                done = at
                if stop is not None and stop(at):
                    return
        if done != len(data):
            raise ValueError(f"no token ends at byte {done + 1}; {len(tokens)} tokens")

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        last = [-1]
        self.extend(data, last, 0)
        return self.walk(last)

    def walk(self, last: list[int], length: int | None = None) -> list[int]:
        """The encoding of a prefix, read backwards from its last token."""
        out, at = [], len(last) - 1 if length is None else length
        while at:
            token = last[at]
            out.append(token)
            at -= len(self.tokens[token])
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """A piece that can grow and be edited, with its encoding kept up to date."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.computed = 0  # entries computed so far
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.vocabulary.extend(self.data, self.last, start)
        self.computed += len(more)

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes, or of all."""
        return self.vocabulary.walk(self.last, length)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces data[start:end]; entries are computed from the edit until the old table holds again.

        The entry of a prefix depends on the bytes of one longest token before it and on the entries there. So once that many
        entries in a row behind the edit are as they were, all the rest are too.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        behind, same, stopped = start + len(new), 0, False
        need = self.vocabulary.longest

        def agrees(at: int) -> bool:
            nonlocal same, stopped
            token = self.last[at]
            kept = at - len(self.vocabulary.tokens[token]) >= behind and old[at - shift] == token
            same = same + 1 if kept else 0
            stopped = same >= need
            return stopped

        self.vocabulary.extend(self.data, self.last, start, agrees)
        self.computed += len(self.last) - start - 1
        if stopped:
            self.last += old[len(self.last) - shift :]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a rank file (base64 token and rank in each line); once in each Python worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})


_CUTS = re.compile(r"\s*\S+|\s+")
#: White space for Python, but not for the tokenizer's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class TextEncoder:
    """Whole texts to ids, with a bounded cache of short cuts."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def _cut(self, cut: str) -> bytes:
        """The ids of a cut that isn't cached."""
        short = len(cut) <= CACHED_CHARS
        word = cut[1:] if cut[0] == " " else cut
        if word.isalpha():  # one piece
            out = np.array(self.vocabulary.encode(cut.encode()), dtype="<u4").tobytes()
        elif short and cut[-1] in ".,;:!?" and cut[-2:-1].isalpha():  # a border of pieces lies between them
            out = self._known(cut[:-1]) + self._known(cut[-1])
        elif short and cut[0] == "\n" and len(cut) > 1 and not cut[1].isspace():  # and here
            out = self._known("\n") + self._known(cut[1:])
        else:
            ids: list[int] = []
            for piece in self.pieces.findall(cut):
                ids += self.vocabulary.encode(piece.encode())
            out = np.array(ids, dtype="<u4").tobytes()
        if short:
            if len(self.cache) >= MAX_CACHED:
                self.cache.clear()
            self.cache[cut] = out
        return out

    def _known(self, cut: str) -> bytes:
        return self.cache.get(cut) or self._cut(cut)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if _ODD_SPACE.search(text):
            return self._cut(text)
        get, make = self.cache.get, self._cut
        return b"".join([get(c) or make(c) for c in _CUTS.findall(text)])


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; no shuffle."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        encoder = TextEncoder(load(path), pattern)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = [np.frombuffer(encoder.encode(t), dtype="<i4") for t in strings(batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], schema=kind)

        return each

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(source, make, "doc_id bigint, ids array<int>")


@functools.lru_cache(maxsize=2)
def load_tokens(path: str) -> list[bytes]:
    """The tokens by id, which is all that decoding needs."""
    with open(path, "rb") as lines:
        known = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    return [known.get(i, b"") for i in range(max(known, default=-1) + 1)]


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded binary``, the bytes that the ids stand for."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        token = load_tokens(path).__getitem__

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(1)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)
            decoded = [b"".join(map(token, values[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(kind.field(1).type), pa.array(decoded, pa.binary())], schema=kind)

        return each

    return map_batches(encoded, make, "doc_id bigint, ids array<int>, decoded binary")
