"""Hierarchical packing of documents into sequences of several context sizes.

Tiers are powers of two up to the longest window (by default 256, 512, 1024 and 2048 tokens). A document's whole windows are cut off first
and are full sequences of the longest tier. What remains is routed to the shortest tier that it fits in. Each tier is packed
by best fit, longest piece first; gaps that are left in the longer windows are filled from the shorter tiers, and at last by
cutting pieces. What is left after all windows are full is cut into sequences whose lengths are powers of two, which need no
padding. Sequences are then dealt to step groups so that the groups' attention costs balance.

Packing needs no shuffle: every task packs its own documents, in rounds of a bounded number of tokens. Ids of sequences
combine partition, round and number, so a task that runs again makes the same ids.

Defined results: null text is empty (a document of the closing id alone); a text of any length is packed as a whole, its tokens in memory in one
task; pieces of equal length are packed in the order of their rows; repeated rows are packed each by itself; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, strings, tidied

TIERS = (256, 512, 1024, 2048)
#: The id that closes a document.
END_ID = 1
#: Tokens packed in one round of a task, and sequences in a step group.
ROUND_TOKENS, STEP_SEQUENCES = 2_000_000, 64
#: Entries of the token cache of a task, and the longest cached word.
MAX_CACHED, CACHED_CHARS = 1_000_000, 40

#: Characters that str.isspace and the tokenizer take differently.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Texts of these characters alone may be put in lower case before the tokenizer does so itself, with the same result.
_NOT_PLAIN = re.compile("[^\x00-\u024f\u2000-\u206f\u20ac]")
#: Letters and then ASCII marks other than the apostrophe: two tokens' worth of text, each with an end of its own.
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)[!-&(-/:-@\[-^`{-~]+")
#: Words that are given to the tokenizer as one text.
JOINED = 256


class WordTokenizer:
    """A tokenizer that never joins text across white space, with a bounded cache of words.

    Special tokens' strings in a text become their ids, as the tokenizer itself does by default: they are looked for in the text as it is, before anything
    else, and parts between them are words of their own. Words are then given to it with that recognition switched off.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or not t.special for t in added.values()):
            raise ValueError("added tokens that aren't plain special strings aren't supported")
        self.special = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str | bytes]:
        """Strings to be parted into words, and ids that are known already."""
        if self.specials and any(x in text for x in self.special):
            cut = self.specials.split(text)
            return [x for i, part in enumerate(cut) for x in ([self.special[part]] if i % 2 else self._plain_parts(part))]
        return self._plain_parts(text)

    def _plain_parts(self, text: str) -> list[str | bytes]:
        if _ODD_SPACE.search(text):
            return self._each([text])
        return [text if _NOT_PLAIN.search(text) else text.lower()]

    def _each(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words. Words whose number of ends is known are encoded many at once and told apart by their ends."""
        known: list[tuple[str, int]] = []
        for w in words:
            if w.isalpha():
                known.append((w, 1))
            elif (m := _LETTERS_MARKS.fullmatch(w)) and m[1].isalpha():
                known.append((w, 2))
        out: dict[str, bytes] = {}
        groups = [known[i : i + JOINED] for i in range(0, len(known), JOINED)]
        made = self.tokenizer.encode_batch_fast([" ".join([w for w, _ in g]) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, made, strict=True):
            ids = np.array(encoding.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            last = np.cumsum([n for _, n in group])
            if len(ends) == last[-1]:
                data = ids.tobytes()
                bounds = [0, *ends[last - 1].tolist()]
                out.update((w, data[a:b]) for (w, _), a, b in zip(group, bounds, bounds[1:], strict=False))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._each(rest), strict=True))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache where they are in it; a full stop or comma behind a letter is a token of its own."""
        cache = self.cache
        if len(cache) > MAX_CACHED:
            cache.clear()
        out = list(map(cache.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        stems: dict[int, str] = {}
        alone: set[str] = set()
        for i in missing:
            w = words[i]
            if w[-1:] in (".", ",") and len(w) > 1 and w[-2].isalpha() and w[-2] != "\u0130":
                stems[i] = stem = w[:-1]
                alone.add(stem)
                alone.add(w[-1])
            else:
                alone.add(w)
        made = self._encode(list(alone.difference(cache)))
        cache.update(made)
        for i in missing:
            w = words[i]
            if stem := stems.get(i):
                out[i] = ids = cache[stem] + cache[w[-1]]
                if len(w) <= CACHED_CHARS:
                    cache[w] = ids
            else:
                out[i] = cache[w]
        for w in made:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return out  # type: ignore[return-value]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. Words are parted, made distinct and put together again by Arrow."""
        parts = [self._parts(t) for t in texts]
        rows = pc.ascii_split_whitespace(pa.array([x for own in parts for x in own if isinstance(x, str)], pa.large_string()))
        words = rows.flatten().dictionary_encode()
        placed = pa.array(self._ids(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        _, ends, data = placed.buffers()
        data = memoryview(data or b"")
        at = np.frombuffer(ends, np.int64)[rows.offsets.to_numpy()].tolist() if ends else [0] * (len(rows) + 1)
        spans = iter(zip(at, at[1:], strict=False))
        out = []
        for own in parts:
            found = [x if isinstance(x, bytes) else data[slice(*next(spans))] for x in own]
            out.append(bytes(found[0]) if len(found) == 1 else b"".join(found))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    """The tokenizer of a file; once in each Python worker."""
    return WordTokenizer(path)


Piece = tuple[int, int, int]  # document's number in the round, start, length


def _binary(n: int) -> list[int]:
    """Powers of two, falling, whose sum is n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces (document, start, length) that hold every token of documents of these lengths once.

    Every sequence's length is a power of two, at most the longest tier.
    """
    longest = tiers[-1]
    full: list[list[Piece]] = []
    waiting: dict[int, list[tuple[int, Piece]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= longest:
            full.append([(doc, start, longest)])
            start += longest
        if n > start:
            tier = tiers[bisect.bisect_left(tiers, n - start)]
            waiting[tier].append((n - start, (doc, start, n - start)))

    # Each tier by best fit, longest first: open windows by the room they have.
    short: list[tuple[int, list[Piece]]] = []  # room, pieces
    for tier in tiers:
        open_rooms: list[int] = []
        by_room: dict[int, list[list[Piece]]] = {}
        for size, piece in sorted(waiting[tier], reverse=True):
            i = bisect.bisect_left(open_rooms, size)
            if i < len(open_rooms):
                room = open_rooms[i]
                window = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], open_rooms[i]
            else:
                room, window = tier, []
            window.append(piece)
            if room == size:
                full.append(window)
                continue
            room -= size
            if room not in by_room:
                bisect.insort(open_rooms, room)
                by_room[room] = []
            by_room[room].append(window)
        short += [(room, w) for room in sorted(by_room) for w in by_room[room] if tier == longest or room]
        # Windows of a shorter tier that aren't full are fill for the longer ones.
        if tier != longest:
            short, fill = [], [p for _, w in short for p in w]
            nxt = tiers[bisect.bisect_left(tiers, tier) + 1]
            waiting[nxt] += [(p[2], p) for p in fill]

    # The longest windows with the least room are completed first, with the pieces of those that have the most.
    short.sort(key=lambda x: x[0])
    i, j = 0, len(short) - 1
    spare: list[Piece] = []
    while i <= j:
        room, window = short[i]
        while room and (spare or i < j):
            if not spare:
                spare = short[j][1]
                j -= 1
            doc, start, n = spare.pop()
            take = min(room, n)
            window.append((doc, start, take))
            room -= take
            if n > take:
                spare.append((doc, start + take, n - take))
        if room:
            spare = window
        else:
            full.append(window)
        i += 1
    # The rest is less than one window: cut at powers of two.
    rest = list(reversed(spare))
    for size in _binary(sum(p[2] for p in rest)):
        window, room = [], size
        while room:
            doc, start, n = rest.pop()
            take = min(room, n)
            window.append((doc, start, take))
            room -= take
            if n > take:
                rest.append((doc, start + take, n - take))
        full.append(window)
    return full


def step_groups(costs: Sequence[int], size: int = STEP_SEQUENCES) -> list[int]:
    """A step group for each sequence: costliest first, to the group that has cost least and still has a place."""
    groups = max(1, -(-len(costs) // size))
    heap = [(0, g, 0) for g in range(groups)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        cost, g, n = heapq.heappop(heap)
        out[i] = g
        if n + 1 < size:
            heapq.heappush(heap, (cost + costs[i], g, n + 1))
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
_KIND = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
    ]
)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, round_tokens: int = ROUND_TOKENS
) -> DataFrame:
    """One row per piece; ``ids`` holds the piece's little-endian unsigned 32-bit ids."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def flush(held: list[tuple[int | None, bytes]], partition: int, number: int) -> Iterator[pa.RecordBatch]:
        windows = pack([len(ids) // 4 for _, ids in held], tiers)
        totals = [sum(p[2] for p in w) for w in windows]
        groups = step_groups([n * n for n in totals])
        # Fields of 22, 21 and 20 bits: partition, round in the task, number in the round.
        base = (partition << 41) | (number << 20)
        cols: list[list] = [[] for _ in _KIND]
        size = 0
        for k, window in enumerate(windows):
            offset = 0
            for doc, start, n in window:
                doc_id, ids = held[doc]
                for c, v in zip(cols, (doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base | k, offset, totals[k], base | groups[k]), strict=True):
                    c.append(v)
                offset += n
                size += n
            if size >= 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KIND, strict=True)], schema=_KIND)
                cols, size = [[] for _ in _KIND], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KIND, strict=True)], schema=_KIND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        tokenizer = load(tokenizer_path)
        try:
            yield from packed(tokenizer, partition, batches)
        finally:  # the worker goes on to other stages
            tokenizer.cache.clear()

    def packed(tokenizer: WordTokenizer, partition: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        tokens = number = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(strings(batch.column(1))), strict=True):
                held.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= round_tokens:
                    yield from flush(held, partition, number)
                    held, tokens, number = [], 0, number + 1
        if held:
            yield from flush(held, partition, number)

    bound_batches(docs.sparkSession)
    return source.mapInArrow(tidied(run), PIECES)
