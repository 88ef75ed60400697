"""Similarity join of documents by the Jaccard index of their word n-grams.

Texts with the same set of n-grams form a class; classes are joined, copies are not. All documents' n-grams are counted in a sketch of
fixed size, and a class's n-grams are ordered by that count, rarest first. Two sets that are similar enough share an n-gram in their
prefixes of this order (prefix filter). Prefix entries meet by n-gram; pairs pass the length filter and the positional filter, are made
distinct, pass a suffix filter (a bound of the sets' difference from counts by hash range), and are verified once against the full sets,
which are made again from the texts.

The positional filter counts on the first n-gram that a pair shares: nothing before it is shared, so all of the intersection lies in what
follows it in both sets. A similar pair passes there; whether it passes at a later n-gram doesn't matter.

Entries that share an n-gram with few others are paired directly. The entries of a frequent n-gram are dealt to blocks of bounded size.
``join`` pairs all of them, block by block, and so returns every link; its work grows with the number of links, the square of a group's size.
``join_components`` first ties the entries of each block by a spanning forest of the pairs that pass, nearest by the suffix filter's bound first, and
then pairs entries only across the components that these links give: near copies by the thousands cost about one link each, no link that
joins two components is lost, but most links inside a component are.

Hashes are 64 bits for n-grams and 128 bits for sets. Words are what white space ``[\\x20\\x09-\\x0D]`` separates, with A-Z in lower case.

Defined results: a text without words (null too) has an empty set and is linked with nothing; one with fewer words than n has its whole sequence as
one n-gram; a component's id is the smallest doc_id of its rows (null ids don't count; null if there is no other); repeated rows fall in one class;
an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, checkpointed, emit_blocks, give_back, keep_rows, key_filter, map_batches, merge_blocks, release, strings, tidied

#: Counters of the sketch, in blocks.
SKETCH, BLOCK = 1 << 18, 1 << 14
#: Hash ranges in a set's signature; pairs of one centre that are verified in one group.
RANGES, STAR_PAIRS = 128, 500
#: Entries of an n-gram that are paired directly; entries in a block of a frequent one. A group holds two blocks at most, so at most
#: the square of that many pairs are in memory at once.
DIRECT, BLOCK_ENTRIES = 8, 2_000
#: Entries of one n-gram, by the sketch's count, that may come to one task while entries are sorted.
PIECE_ENTRIES = 50_000
#: Pairs that are looked at in one step.
CHUNK_PAIRS = 200_000
#: Frequent n-grams before an entry's own that the entry knows; a pair that shares one of them has met there.
KNOWN_BEFORE = 4
#: Words whose hashes a Python worker remembers.
MAX_WORDS = 500_000


@dataclass(frozen=True)
class Rule:
    """Words in an n-gram, and the threshold in percent."""

    n: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        """Length of the prefix in which a similar set must share an n-gram."""
        return size - -(-size * self.percent // 100) + 1

    def overlap(self, a: Any, b: Any) -> Any:
        """The least intersection of similar sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))


class _Words(dict):
    """Hashes of words, computed when missing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Sets of n-gram hashes, sorted."""

    def __init__(self, n: int):
        self.n, self.words = n, _Words()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
        if not words:
            return np.zeros(0, np.uint64)
        k = min(self.n, len(words))
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        m = len(words) - k + 1
        out = np.full(m, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, np.uint64)
        for i in range(k):
            out ^= h[i : i + m]
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def _arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)


# --------------------------------------------------------------------------- counts
def ngram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Documents per n-gram, summed up by the low bits of its hash, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, part = Shingler(n), np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            found = [shingle(t) for t in strings(batch.column(0))]
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield emit_blocks(part, np.minimum(counts, 0xFFFFFFFF // 64).astype(np.uint32), BLOCK)

    source = texts.select("text", F.spark_partition_id().cast("long").alias("part"))
    return merge_blocks(_arrow(source, run, "part bigint, block int, data binary"), source.rdd.getNumPartitions(), _saturating_add, "u4")


def _saturating_add(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    total = a.astype(np.uint64) + b
    out[:] = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return out


# --------------------------------------------------------------------------- classes and their prefixes
def _signature(found: np.ndarray) -> bytes:
    """Counts of a set's members by hash range, saturating."""
    counts = np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=RANGES)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _described(docs: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(id, th, n, digest, sig, prefix) of every row (th: a hash of its text); the prefix is a binary of hashes, rarest first; digest is null for empty sets."""
    kind = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("prefix", pa.binary())])

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        shingle = Shingler(rule.n)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[list[Any]] = [[], [], [], []]
            for text in strings(batch.column(2)):
                found = shingle(text)
                n = len(found)
                if n:
                    order = np.lexsort((found, counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)]))[: rule.prefix(n)]
                    row = (n, xxhash.xxh3_128_digest(found.tobytes()), _signature(found), found[order].tobytes())
                else:
                    row = (0, None, None, None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(out, list(kind)[2:], strict=True))], schema=kind)

        return each

    return map_batches(docs.select("id", F.xxhash64("text").alias("th"), "text"), make, "id bigint, th bigint, n bigint, digest binary, sig binary, prefix binary")


#: An entry: n-gram, size and position in one number (so that entries sort by size), class; and the piece of a very frequent n-gram, else 0.
_ENTRY = "h bigint, at bigint, node bigint"
_ENTRY_KIND = pa.schema([("h", pa.int64()), ("at", pa.int64()), ("node", pa.int64()), ("piece", pa.int32())])


def _entries(nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row for every n-gram in a class's prefix."""
    pieces = -(-counts.astype(np.int64) // PIECE_ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            found = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
            if not found:
                continue
            lengths = np.array(list(map(len, found)))
            h = np.concatenate(found)
            pos = np.concatenate([np.arange(n, dtype=np.int64) for n in lengths])
            of = np.repeat(node, lengths)
            k = pieces[h & (SKETCH - 1)]
            piece = np.where(k > 1, 1 + (of * 0x9E3779B1 >> 16) % np.maximum(k, 1), 0).astype(np.int32)
            columns = (h, np.repeat(size, lengths) << 32 | pos, of, piece)
            for i in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], schema=_ENTRY_KIND)

    return _arrow(nodes.select("node", "n", "prefix"), run, f"{_ENTRY}, piece int")


# --------------------------------------------------------------------------- filters
def _passes(rule: Rule, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of one n-gram's entries (size and position) may be similar if it is the first that they share: length and positional filter."""
    sa, pos_a, sb, pos_b = a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF
    most = np.minimum(sa - pos_a, sb - pos_b)
    return (np.minimum(sa, sb) * 100 >= rule.percent * np.maximum(sa, sb)) & (most >= rule.overlap(sa, sb))


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16)


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose sets can't differ in more members than similar sets of their sizes do; the difference is bounded below by
    the counts of members by hash range."""
    sig = nodes.select("node", "n", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (_signatures(batch.column(i)) for i in (4, 5))
            keep = np.abs(x - y).sum(axis=1) <= na + nb - 2 * rule.overlap(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], schema=kind)

        return each

    return map_batches(both.select("a", "b", "na", "nb", "sa", "sb"), make, "a bigint, b bigint")


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], schema=_FOUND)


_FOUND = pa.schema([(name, pa.int64()) for name in ("a", "b", "h", "at", "node")])


def _first_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of few entries, and the entries (h, at, node) of frequent n-grams.

    Entries come sorted by n-gram and are read as a stream; of an n-gram that goes on, at most DIRECT entries are kept. A very frequent
    n-gram comes in pieces, to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # entries of the n-gram that the last batch ended in, as long as they are few
        going: int | None = None  # the frequent n-gram that goes on

        def frequent(h: np.ndarray, at: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(h), pa.array(at), pa.array(node)], schema=_FOUND)

        def few(at: np.ndarray, node: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """All pairs inside short runs, by the distance of the two in the run."""
            lengths = ends - starts
            for d in range(1, int(lengths.max(initial=1))):
                chosen = lengths > d
                counts = lengths[chosen] - d
                x = np.repeat(starts[chosen], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                ok = _passes(rule, at[x], at[x + d])
                if ok.any():
                    yield _pairs_batch(node[x][ok], node[x + d][ok])

        def take(c: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, going
            if held is not None:
                c, held = [np.concatenate([a, b]) for a, b in zip(held, c, strict=True)], None
            h, at, node = c
            if not len(h):
                return
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            starts, ends = cuts[:-1], cuts[1:]
            many = ends - starts > DIRECT
            many[0] |= going is not None and h[0] == going
            if not last and not many[-1]:
                held = [x[starts[-1] :].copy() for x in c]
                starts, ends, many = starts[:-1], ends[:-1], many[:-1]
            elif not last:
                going = int(h[-1])
            short = ~many & (ends - starts >= 2)
            if short.any():
                yield from few(at, node, starts[short], ends[short])
            if many.any():
                chosen = np.repeat(many, ends - starts)
                n = len(chosen)
                yield frequent(h[:n][chosen], at[:n][chosen], node[:n][chosen])

        for batch in batches:
            if batch.num_rows:
                *c, piece = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                if piece.any():  # pieces are frequent as such
                    yield frequent(*(x[piece > 0] for x in c))
                    c = [x[piece == 0] for x in c]
                yield from take(c, False)
        yield from take([np.zeros(0, np.int64)] * 3, True)

    ordered = entries.repartition("h", "piece").sortWithinPartitions("h", "at", "node")
    return _arrow(ordered, run, f"a bigint, b bigint, {_ENTRY}")


class _Block:
    """Entries of one n-gram, sorted by size."""

    def __init__(self, table: pa.Table, rule: Rule):
        table = table.sort_by([("at", "ascending"), ("node", "ascending")])
        self.rule = rule
        self.at, self.node, self.comp, self.side = (table.column(x).to_numpy() for x in ("at", "node", "comp", "side"))
        self.size, self.sig = self.at >> 32, _signatures(table.column("sig"))
        before = table.column("before").combine_chunks()
        self.before = before.flatten().to_numpy(zero_copy_only=False).reshape(-1, KNOWN_BEFORE)

    def candidates(self, xs: np.ndarray, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) of entries of similar length that pass, by bounded numbers; with ``later`` only those with y behind x."""
        percent = self.rule.percent
        lo = xs + 1 if later else np.searchsorted(self.size, -(-self.size[xs] * percent // 100))
        n = np.maximum(np.searchsorted(self.size, self.size[xs] * 100 // percent, "right") - lo, 0)
        ends, start = np.cumsum(n), 0
        while start < len(xs):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_PAIRS, "right")))
            each = n[start:stop]
            x = np.repeat(xs[start:stop], each)
            y = np.arange(len(x)) - np.repeat(np.cumsum(each) - each - lo[start:stop], each)
            ok = _passes(self.rule, self.at[x], self.at[y])
            yield x[ok], y[ok]
            start = stop

    def room(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Members that the pairs' sets may still differ in beyond their signatures' difference; below 0 they can't be similar."""
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), CHUNK_PAIRS // 10):
            a, b = x[i : i + CHUNK_PAIRS // 10], y[i : i + CHUNK_PAIRS // 10]
            size = self.size[a] + self.size[b]
            out[i : i + len(a)] = size - 2 * self.rule.overlap(self.size[a], self.size[b]) - np.abs(self.sig[a] - self.sig[b]).sum(axis=1)
        return out

    def first_met(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs aren't known to share an earlier frequent n-gram."""
        same = (self.before[y][:, :, None] == self.before[x][:, None, :]) & (self.before[x] != _NONE)[:, None, :]
        return ~same.any(axis=(1, 2))

    def pairs(self, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        a = np.concatenate([self.node[x] for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([self.node[y] for _, y in found]) if found else np.zeros(0, np.int64)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: In place of an n-gram before the first one.
_NONE = -1


def _placed(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, at, node, sig, before) of frequent n-grams' entries; before: the last few frequent n-grams ahead of it in its class's prefix."""
    ahead = Window.partitionBy("node").orderBy("at")
    before = F.array(*(F.lag("h", i, _NONE).over(ahead) for i in range(1, KNOWN_BEFORE + 1)))
    return entries.join(nodes.select("node", "sig"), "node").withColumn("before", before)


def _forest(n: int, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Which of the edges x-y between n entries make a spanning forest, those with most room first (Boruvka's method)."""
    order = np.argsort(-room, kind="stable")
    x, y = x[order], y[order]
    label, taken, left = np.arange(n), np.zeros(len(x), bool), np.arange(len(x))
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return order[taken]
        best = np.full(n, -1)
        for end in (y, x):  # the last assignment stays: the edge with most room
            now = best.copy()
            now[label[end[left]][::-1]] = left[::-1]
            best = np.where((now >= 0) & ((best < 0) | (now < best)), now, best)
        for e in np.unique(best[best >= 0]):
            a, b = label[x[e]], label[y[e]]
            if a != b:
                taken[e] = True
                label[label == max(a, b)] = min(a, b)


def _nearest_pairs(placed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that tie the entries of a block together, those that may be most similar first: at most one for each entry.

    Blocks are dealt anew for each n-gram, so that they overlap.
    """
    sizes = placed.groupBy(F.col("h").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ENTRIES).alias("k"))
    dealt = placed.join(sizes, F.col("h") == F.col("_h")).select(
        "h", F.pmod(F.xxhash64("node", "h"), "k").alias("block"), "at", "node", F.col("node").alias("comp"), F.lit(0).alias("side"), "sig", "before"
    )

    def nearest(table: pa.Table) -> pa.Table:
        block = _Block(table, rule)
        found = [np.zeros((3, 0), np.int64)]
        for x, y in block.candidates(np.arange(len(block.at)), True):
            room = block.room(x, y)
            found.append(np.stack([x, y, room])[:, room >= 0])
        x, y, room = np.concatenate(found, axis=1)
        kept = _forest(len(block.at), x, y, room)
        out = block.pairs([(x[kept], y[kept])])
        if len(x) > CHUNK_PAIRS:
            del block, found, x, y, room
            give_back()
        return out

    return dealt.groupBy("h", "block").applyInArrow(nearest, "a bigint, b bigint")


def _dealt_pairs(placed: DataFrame, labels: DataFrame | None, rule: Rule) -> DataFrame:
    """Pairs of frequent n-grams' entries, through all filters: across components, or without labels all.

    Of each n-gram, the entries of its most frequent component needn't meet one another. The others are dealt to blocks, and every two blocks meet
    in a group (side 0 and 1); every block of the others also meets every block of the most frequent component (side 2).
    """
    own = placed.withColumn("comp", F.col("node")) if labels is None else placed.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    each = own.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy(F.col("h").alias("_h")).agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"))
    if labels is None:
        top, rest = F.lit(None).cast("bigint"), F.col("total")
    else:
        top, rest = F.col("top.comp"), F.col("total") - F.col("top.n")
    most = most.select("_h", top.alias("top"), F.ceil(rest / BLOCK_ENTRIES).cast("int").alias("k"), F.ceil((F.col("total") - rest) / BLOCK_ENTRIES).cast("int").alias("k_top"))
    mine = own.join(most.filter("k > 0"), F.col("h") == F.col("_h")).withColumn("of_top", F.col("comp").eqNullSafe(F.col("top")))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("of_top"), F.col("k_top")).otherwise(F.col("k"))).cast("int"))

    def upto(k: str) -> Column:
        return F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def place(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    block = F.col("block")
    of_top = F.transform(upto("k"), lambda i: place(1, i, block, F.lit(2)))
    with_top = F.transform(upto("k_top"), lambda j: place(1, block, j, F.lit(0)))
    with_others = F.transform(upto("k"), lambda o: place(0, F.least(block, o), F.greatest(block, o), block > o))
    dealt = mine.withColumn("to", F.explode(F.when(F.col("of_top"), of_top).otherwise(F.concat(with_top, with_others))))
    dealt = dealt.select("h", "to.kind", "to.i", "to.j", "to.side", "at", "node", "comp", "sig", "before")

    def pair(table: pa.Table) -> pa.Table:
        across = table.column("kind")[0].as_py() == 1 or table.column("i")[0].as_py() != table.column("j")[0].as_py()
        block = _Block(table, rule)
        found = []
        for x, y in block.candidates(np.flatnonzero(block.side == 0) if across else np.arange(len(block.at)), not across):
            ok = block.comp[x] != block.comp[y]
            if across:
                ok &= block.side[y] > 0
            x, y = x[ok], y[ok]
            ok = block.first_met(x, y)
            x, y = x[ok], y[ok]
            ok = block.room(x, y) >= 0
            found.append((x[ok], y[ok]))
        return block.pairs(found)

    return dealt.groupBy("h", "kind", "i", "j").applyInArrow(pair, "a bigint, b bigint")


# --------------------------------------------------------------------------- verification
def _involved_texts(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(id, th, text) of the documents that stand for classes to verify, and of some others.

    The whole table passes a filter by id hash first, so that only few texts are shuffled in the exact join that follows.
    """
    hit = key_filter(involved.select(F.xxhash64(F.coalesce("id", F.lit(-1))).alias("key")))
    # The function sees the key alone; texts stay in the JVM.
    return docs.filter(hit(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1))))).select("id", F.xxhash64("text").alias("th"), "text")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets are similar, each verified once.

    A pair is dealt to the one of its classes that has more pairs, its centre. A centre's text and those of its partners meet in groups of
    bounded size (a centre of many pairs gets several), where sets are made from the texts, one partner at a time.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = checkpointed(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    rated = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    centred = rated.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("d")
    ).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / STAR_PAIRS)).cast("int"))
    centred = checkpointed(centred.select("centre", "salt", "node"))
    # Where each class's text goes: to its centres, and as a centre to its own groups.
    goes = centred.unionByName(centred.select("centre", "salt").distinct().withColumn("node", F.col("centre")))
    keys = nodes.select("node", F.col("first_id").alias("id"), "th")
    involved = checkpointed(degree.select("node").join(keys, "node"))
    texts = _involved_texts(docs, involved)
    of_class = texts.join(involved, texts.id.eqNullSafe(involved.id) & texts.th.eqNullSafe(involved.th)).select("node", "text")
    met = of_class.join(goes, "node").select("centre", "salt", (F.col("node") != F.col("centre")).alias("partner"), "node", "text")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(rule.n)
        group, own, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for centre, salt, partner, node, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (centre, salt, node) == last:  # a repeated row
                    continue
                last = (centre, salt, node)
                if not partner:
                    group, own = (centre, salt), shingle(text)
                    continue
                assert group == (centre, salt), "a centre's text is missing"
                other = shingle(text)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= rule.percent * (len(own) + len(other) - shared):
                    out[0].append(min(centre, node))
                    out[1].append(max(centre, node))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=kind)

    ordered = met.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "partner", "node")
    return checkpointed(_arrow(ordered, run, "a bigint, b bigint"))


# --------------------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node that it is connected with.

    Large-star and small-star steps: every node's neighbours are tied to the smallest of them, until nothing changes.
    Only minima are gathered by node; a node of many links is a join that AQE can split. Each round ends in a checkpoint.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    state: Any = None
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        tied = large.join(least, F.col("u") == F.col("w"))
        edges = checkpointed(
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


# --------------------------------------------------------------------------- the join
@dataclass
class Joined:
    """rows: (id, th, n, digest) of every document; classes: (node, digest, first_id, copies, label); links between classes: all, or
    those that the components need."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame


def join(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """All links between the documents' classes, and the components."""
    return _join(docs, rule, id_col, text_col, True)


def join_components(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """Links enough for the components, and these; other links inside a component may be missing."""
    return _join(docs, rule, id_col, text_col, False)


def _join(docs: DataFrame, rule: Rule, id_col: str, text_col: str, complete: bool) -> Joined:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = ngram_counts(source, rule.n)
    described = checkpointed(_described(source, counts, rule))
    rows = checkpointed(described.select("id", "th", "n", "digest"))
    # Of a class, the row with the smallest id stands for it.
    nodes = checkpointed(
        described.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("prefix").alias("prefix"),
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"), F.count(F.lit(1)).alias("copies"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "digest", "n", "sig", "prefix", F.col("k.id").alias("first_id"), F.col("k.th").alias("th"), "copies")
    )
    del described
    met = checkpointed(_first_pairs(_entries(nodes, counts), rule))
    nodes = checkpointed(nodes.drop("prefix"))
    release(docs)
    placed = checkpointed(_placed(met.filter("h is not null").select("h", "at", "node"), nodes))
    pairs = _suffix_filter(met.filter("a is not null").select("a", "b").distinct(), nodes, rule)
    if not complete:
        pairs = pairs.unionByName(_nearest_pairs(placed, rule)).distinct()
    pairs = checkpointed(pairs)
    links = _verified(source, nodes, pairs, rule)
    release(docs)
    labels = checkpointed(components(links))
    more = checkpointed(_dealt_pairs(placed, None if complete else labels, rule).distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(_verified(source, nodes, more, rule))
        labels = checkpointed(components(links))
    release(docs)
    classes = nodes.select("node", "digest", "first_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return Joined(rows, classes, links)


def components_of(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found = join_components(docs, rule, id_col, text_col)
    smallest = found.classes.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("component"))
    classes = found.classes.join(smallest, F.col("label") == F.col("l")).select(F.col("digest").alias("d"), "component")
    return found.rows.join(classes, F.col("digest") == F.col("d"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def link_counts(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links: the classes that its own is linked with."""
    found = join(docs, rule, id_col, text_col)
    ends = found.links.select(F.col("a").alias("end")).unionByName(found.links.select(F.col("b").alias("end")))
    counts = ends.groupBy("end").agg(F.count(F.lit(1)).alias("k"))
    classes = found.classes.join(counts, F.col("node") == F.col("end"), "left").select(F.col("digest").alias("d"), "k")
    return found.rows.join(classes, F.col("digest") == F.col("d"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("k", F.lit(0)).alias("n_links")
    )


def representatives(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest id (null ids last), of such rows
    the one whose text's hash is smallest, and one of repeated rows; every row with an empty set. Whole rows are shuffled only where they may go."""
    found = join_components(docs, rule, id_col, text_col)
    rows = found.rows.filter("digest is not null").join(found.classes.select(F.col("digest").alias("d"), "label"), F.col("digest") == F.col("d"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    best = rows.groupBy(F.col("label").alias("_label")).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    decided = rows.join(best, F.col("label") == F.col("_label")).select("id", "th", (order == F.col("best")).alias("kept"))
    return keep_rows(docs, decided, id_col, text_col)
