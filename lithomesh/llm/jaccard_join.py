"""Exact Jaccard self-join of documents on distinct word shingles, by set relations.

A set's elements are put in one global order, rare ones first, and only those at
the first positions, of which two similar sets must share one, are indexed. An
index list is cut into blocks of sets of one size that have the element at one
position. Two sets are found in the list of their first common element, and from
its positions there on they cannot share more than the shorter rest; so block by
block a list is skipped against blocks whose sizes and positions cannot reach the
threshold. Lists whose sets are known to be one component are skipped whole.

Answers are derived from those of highly similar sets. The first round reads the
lists of the few elements of a set with the smallest hashes, at which similar sets
mostly agree, and compares each set with one pivot of its list. What a set shares
with a pivot bounds what it shares with all that the pivot was compared with: the
second round takes over the pivot's component, and derives from the overlap of two
pivots, and of each set with its own, which of their sets, block by block, cannot be
linked. Only what neither positions nor derived bounds decide is compared in full:
sets that resemble one pivot in blocks, where each set is sent once a block and not
once a pair, others in pairs.

Elements are 64-bit hashes of shingles and sets are 96-bit hashes of their sorted
elements. Two different shingles of one pair of documents are taken for one with a
probability under 1e-10, two different sets of ten billion with one under 1e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.operators.components import connected_components
from lithomesh.plans.session import prepare_workers
from lithomesh.plans.storage import discard, materialise, release_shuffles

WORDS = 5
#: Elements by smallest hash whose lists the first round reads.
FIRST = 4
#: Slots of the count sketch that orders elements are 2 ** SKETCH_BITS; the order only steers the work, any order is exact.
SKETCH_BITS = 24
PART_BITS = 14
#: Sets that resemble one pivot (a third of the smaller union) are compared in blocks where they are at least this many.
BIG_CELL = 32
#: Sets of a block.
BLOCK = 256
#: Lists up to this length are paired many at a time, and sets of a block of a longer list.
SHORT, LIST_BLOCK = 32, 512
#: Postings that a bucket of lists holds on average, whatever the data.
BUCKET = 4_000_000
#: Pairs that one text is sent for.
PAIRS = 1024
#: Postings that a task gathers before it sends them on.
FLUSH = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words seen; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of the whole sequence where there are fewer words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += w[i : i + n] * _ODD[i]
    return np.unique(mix(total))


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """A 96-bit hash as a signed 64-bit and an unsigned 32-bit number."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:12], "little")


def _pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _texts(batch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sets(batches):
    """A row for each document, and the task's part of the count sketch over its distinct sets."""
    hashes, seen = WordHashes(), set()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    slots, held = [], 0
    names = ["id", "n", "key", "key2", "part", "blob"]

    def count():
        nonlocal held
        if slots:
            at, n = np.unique(np.concatenate(slots), return_counts=True)
            counts[at] += n.astype(np.uint32)
        slots.clear()
        held = 0

    for batch in batches:
        sizes, keys = [], []
        for text in _texts(batch):
            e = shingles(text, hashes)
            key = set_key(e) if len(e) else (None, None)
            sizes.append(len(e))
            keys.append(key)
            if len(e) and key not in seen:
                seen.add(key)
                slots.append((e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                held += len(e)
                if held > FLUSH:
                    count()
        m = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    count()
    size = 1 << PART_BITS
    parts = [(i, counts[i * size : (i + 1) * size]) for i in range(len(counts) // size)]
    rows = [(i, int(c.sum(dtype=np.int64)), _pack([c])) for i, c in parts if c.any()]
    if rows:
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array([r[1] for r in rows], pa.int64()), none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=names)


def _add_parts(usual: float):
    """Sums of sketch parts as classes, of the parts in which a count is more than usual."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                one = _unpack(blob, 1 << PART_BITS, [np.uint32])[0]
                sums[part] = sums[part] + one if part in sums else one.astype(np.uint64)
        level_class = np.ceil(np.maximum(0, np.arange(256) - usual) / 4).astype(np.uint8)
        classes = {part: level_class[(4 * np.log2(x + 1.0)).astype(np.uint8)] for part, x in sums.items()}
        rows = [(part, _pack([x])) for part, x in classes.items() if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "classes"])

    return run


class Classes:
    """For each slot of the sketch 0 where its count is usual, else the power of two by which it is more.

    Travels compressed; a worker spreads it out once.
    """

    def __init__(self, parts: dict[int, bytes]):
        self.parts = parts
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << SKETCH_BITS, np.uint8)
            for part, blob in self.parts.items():
                self._table[part << PART_BITS : (part + 1) << PART_BITS] = _unpack(blob, 1 << PART_BITS, [np.uint8])[0]
        return self._table


def rarity_classes(sketch: DataFrame, partitions: int) -> Classes:
    """The classes of all slots.

    The sketch covers all documents and has a fixed size. Only its total and the parts
    with counts that are not usual come to the driver, compressed, and are broadcast.
    """
    total = sketch.agg(F.sum("n")).first()[0] or 0
    usual = float(4 * np.log2(2 * total / (1 << SKETCH_BITS) + 5))
    rows = sketch.select("part", "blob").repartition(partitions, "part").mapInArrow(_add_parts(usual), "part int, classes binary").collect()
    return Classes({r["part"]: bytes(r["classes"]) for r in rows})


def indexed(n: int) -> int:
    """Positions of which two sets with Jaccard 0.75 or more, one of size n, share one."""
    return n - (75 * n + 99) // 100 + 1


def _postings(classes, buckets: int):
    """Blobs of postings by range of hashes: element, set, the element's position in it, the set's size, the end of its indexed positions and how many frequent elements they hold.

    Only lists of frequent elements are skipped by position; for others the position is told as 0, which skips nothing.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def run(batches):
        table = classes.value.table()
        hashes, seen = WordHashes(), set()
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            e = np.concatenate([x[0] for x in held])
            lengths = [len(x[0]) for x in held]
            row = np.repeat(np.arange(len(held)), lengths)
            kind = np.concatenate([x[4] for x in held])
            place = np.concatenate([x[5] for x in held])
            order = np.argsort(e, kind="stable")
            e, row, kind, place = e[order], row[order], kind[order], place[order]
            keys = np.array([x[1] for x in held], np.int64)
            sizes = np.array([x[2] for x in held], np.uint32)
            ends = np.array([x[3] for x in held], np.uint32)
            often = np.array([x[6] for x in held], np.uint32)
            cuts = np.searchsorted(e >> shift, np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo == hi:
                    continue
                used, at = np.unique(row[lo:hi], return_inverse=True)
                delta = np.diff(e[lo:hi], prepend=np.uint64(0))
                flagged = (at.astype(np.uint32) << np.uint32(2)) | kind[lo:hi]
                out.append((b, int(hi - lo), len(used), _pack([delta, flagged, place[lo:hi]]), _pack([keys[used, 0], keys[used, 1].astype(np.uint32), sizes[used], ends[used], often[used]])))
            held.clear()
            size = 0
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=["bucket", "n", "sets", "postings", "nodes"])

        for batch in batches:
            for text in _texts(batch):
                e = shingles(text, hashes)
                if not len(e):
                    continue
                key = set_key(e)
                if key in seen:
                    continue
                seen.add(key)
                level = table[(e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rank = (level.astype(np.uint64) << np.uint64(56)) | (e >> np.uint64(8))
                p = indexed(len(e))
                head = np.argpartition(rank, p - 1)[:p] if p < len(e) else np.arange(len(e))
                until = int(rank[head].max() >> np.uint64(32))
                kind = np.zeros(len(e), np.uint32)
                kind[head] = INDEXED
                kind[:FIRST] |= EARLY  # elements are sorted
                place = np.zeros(len(e), np.uint32)
                place[head[np.argsort(rank[head], kind="stable")]] = np.arange(len(head))
                place[level == 0] = 0
                some = np.flatnonzero(kind)
                held.append((e[some], key, len(e), until, kind[some], place[some], int(np.count_nonzero(level[head]))))
                size += len(some)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


LISTS = "element long, key long, key2 long, n int, until long, place int, often int, other long, other2 long"
#: What a posting is for.
EARLY, INDEXED = np.uint32(1), np.uint32(2)


def _shared(e: np.ndarray) -> np.ndarray:
    """Which of sorted elements occur more than once."""
    out = np.zeros(len(e), bool)
    same = e[1:] == e[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _lists(batches):
    """Index lists that several sets share, and for the first round pairs of a set and its block's pivot.

    A block is a run of sizes within the threshold of each other; its pivot is the
    set with the smallest scrambled key, so that lists agree on pivots.
    """
    parts: list[tuple] = []
    for batch in batches:
        for n, m, postings, nodes in zip(*(batch.column(x).to_pylist() for x in ("n", "sets", "postings", "nodes"))):
            delta, flagged, place = _unpack(postings, n, [np.uint64, np.uint32, np.uint32])
            keys, keys2, sizes, ends, often = _unpack(nodes, m, [np.int64, np.uint32, np.uint32, np.uint32, np.uint32])
            at = flagged >> np.uint32(2)
            parts.append((np.cumsum(delta, dtype=np.uint64), keys[at], keys2[at].astype(np.int64), sizes[at], ends[at], place, often[at], flagged & np.uint32(3)))
    if not parts:
        return
    columns = [np.concatenate(x) for x in zip(*parts)]
    parts.clear()
    # most elements occur once
    order = np.argsort(columns[0], kind="stable")
    order = order[_shared(columns[0][order])]
    columns = [x[order] for x in columns]
    # a set that several tasks sent counts once
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [x[order] for x in columns]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:3]])
    everything = [x[fresh] for x in columns]
    names = ["element", "key", "key2", "n", "until", "place", "often", "other", "other2"]
    chosen = (everything[7] & INDEXED) > 0
    e, key, key2, n, until, place, often = (x[chosen] for x in everything[:7])
    some = _shared(e)
    e, key, key2, n, until, place, often = (x[some] for x in (e, key, key2, n, until, place, often))
    for i in range(0, len(e), 100_000):
        s = slice(i, i + 100_000)
        none = pa.nulls(len(e[s]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(e[s].view(np.int64)), pa.array(key[s]), pa.array(key2[s]), pa.array(n[s].astype(np.int32)), pa.array(until[s].astype(np.int64)), pa.array(place[s].astype(np.int32)), pa.array(often[s].astype(np.int32)), none, none], names=names)
    chosen = (everything[7] & EARLY) > 0
    e, key, key2, n = (x[chosen] for x in everything[:4])
    order = np.lexsort((n, e))
    e, key, key2, n = (x[order] for x in (e, key, key2, n))
    starts = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else []
    pairs = []
    for lo, hi in zip(starts, [*starts[1:], len(e)]):
        while hi - lo > 1:
            end = lo + int(np.searchsorted(75 * n[lo:hi].astype(np.int64), 100 * int(n[lo]), side="right"))
            if end - lo > 1:
                pivot = lo + int(np.argmin(mix(key[lo:end].view(np.uint64))))
                rest = np.delete(np.arange(lo, end), pivot - lo)
                pairs.append(np.column_stack([key[rest], key2[rest], np.full(len(rest), key[pivot]), np.full(len(rest), key2[pivot])]))
            lo = end
    if pairs:
        found = np.unique(np.concatenate(pairs), axis=0)
        for i in range(0, len(found), 100_000):
            s = found[i : i + 100_000]
            none, small = pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.array(s[:, 0]), pa.array(s[:, 1]), small, none, small, small, pa.array(s[:, 2]), pa.array(s[:, 3])], names=names)


def _compare(batches):
    """Sizes and overlap of the two texts of each row; rows come with equal first texts side by side."""
    hashes, last, first = WordHashes(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist()):
            if first is None or a != last[0] or x != last[1]:
                first, last = shingles(x, hashes), (a, x)
            second = shingles(y, hashes)
            both = np.concatenate([first, second])
            both.sort(kind="stable")
            out.append((len(first), len(second), int(np.count_nonzero(both[1:] == both[:-1]))))
        c = np.array(out, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(c[:, 2])], names=["a", "b", "n_a", "n_b", "overlap"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """n_a, n_b and overlap of each pair (a, b) of ids.

    A document of many pairs, as a pivot, is dealt out: its text is sent once for each
    so many pairs, and they meet it by a hash of the other document. Texts are shuffled
    once for both sides.
    """
    pairs = materialise(pairs.select("a", "b"), "jaccard-pairs")
    # so at most 200,000 documents are dealt out and told to all tasks
    most = max(PAIRS, pairs.count() // 100_000)
    counts = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    hot = materialise(counts.select("id", F.ceil(F.col("n") / most).alias("parts")), "jaccard-hot")
    if hot.isEmpty():
        for side in "ba":
            pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
        return _compared(pairs)
    hot = F.broadcast(hot)
    sent = texts.select("id", "text").join(hot, "id", "left").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"), "text")
    for side, other in ("ab", "ba"):
        own = hot.select(F.col("id").alias(side), "parts")
        pairs = pairs.join(F.broadcast(own), side, "left").withColumn(f"part_{side}", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    for side in "ba":
        pairs = pairs.join(sent.select(F.col("id").alias(side), F.col("part").alias(f"part_{side}"), F.col("text").alias(f"text_{side}")), [side, f"part_{side}"]).drop(f"part_{side}")
    return _compared(pairs)


def _compared(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long, n_a long, n_b long, overlap long")


LINKED = "100 * overlap >= 75 * (n_a + n_b - overlap)"


CROSS = "a long, b long, rest long, shared long, cell_a long, cell_b long"


def _reach(n_a, rest_a, n_b, rest_b):
    """Whether sets of these sizes can be similar, if from their first common element on they have these many elements."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= 75 * large) & (7 * np.minimum(rest_a, rest_b) >= 3 * (n_a + n_b))


def _blocks(n: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal size and position, of ``most`` entries at most, of a list in that order."""
    new = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (place[1:] != place[:-1])))
    lengths = np.diff(np.append(new, len(n)))
    parts = -(-lengths // most)
    first = np.repeat(new, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return first, np.minimum(most, np.repeat(new + lengths, parts) - first)


def _block_pairs(n, place, one, two):
    """Pairs of entries of two blocked selections of a list; blocks that cannot reach the threshold are skipped.

    Yields index arrays of bounded length. ``one`` and ``two`` are indices in order of size and position.
    """
    first_a, size_a = _blocks(n[one], place[one], LIST_BLOCK)
    first_b, size_b = _blocks(n[two], place[two], LIST_BLOCK)
    n_a, n_b = n[one][first_a], n[two][first_b]
    rest_a, rest_b = n_a - place[one][first_a], n_b - place[two][first_b]
    held, total = [], 0
    for at in range(0, len(first_a), 256):
        s = slice(at, at + 256)
        low, high = np.searchsorted(n_b, [0.74 * n_a[s][0], 1.35 * n_a[s][-1] + 1])
        x, y = np.nonzero(_reach(n_a[s][:, None], rest_a[s][:, None], n_b[None, low:high], rest_b[None, low:high]))
        x, y = x + at, y + low
        work = np.cumsum(size_a[x] * size_b[y])
        for k in np.split(np.arange(len(x)), np.flatnonzero(np.diff(work // FLUSH)) + 1):
            if len(k):
                counts = size_a[x[k]] * size_b[y[k]]
                which = np.repeat(k, counts)
                offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                yield one[first_a[x[which]] + offset // size_b[y[which]]], two[first_b[y[which]] + offset % size_b[y[which]]]


def _met_cells(n, place, comp, cell) -> list[tuple[int, int]]:
    """Pairs of big cells with sets of different components in blocks of one list that can reach the threshold."""
    first, size = _blocks(n, place, len(n))
    names, column = np.unique(cell, return_inverse=True)
    low, high = (f.reduceat(comp[np.argsort(column, kind="stable")], np.append(0, np.cumsum(np.bincount(column))[:-1])) for f in (np.minimum, np.maximum))
    member = np.zeros((len(first), len(names)), np.float32)
    member[np.repeat(np.arange(len(first)), size), column] = 1
    n_a, rest = n[first], n[first] - place[first]
    met = np.zeros((len(names), len(names)), np.float32)
    for at in range(0, len(first), 1024):
        s = slice(at, at + 1024)
        met += member[s].T @ (_reach(n_a[s][:, None], rest[s][:, None], n_a[None], rest[None]).astype(np.float32) @ member)
    alike = (low[:, None] == high[:, None]) & (low[None] == high[None]) & (low[:, None] == low[None])
    c, d = np.nonzero(np.triu((met > 0) & ~alike))
    return list(zip(names[c].tolist(), names[d].tolist()))


def _cross_pairs(batches):
    """Of each list the pairs of sets in different components that sizes, positions and common pivots allow, with the number of lists that a pair shares here.

    Of sets in big cells only the pair of cells is told, once.
    """
    held = [[np.asarray(batch.column(x)) for x in ("element", "node", "comp", "n", "place", "until", "often", "pivot", "common", "cell")] for batch in batches if batch.num_rows]
    if not held:
        return
    columns = [np.concatenate(x) for x in zip(*held)]
    held.clear()
    order = np.lexsort((columns[4], columns[3], columns[0]))
    columns = [x[order] for x in columns]
    starts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
    sizes = np.diff(np.append(starts, len(columns[0])))
    # a list of one component has nothing to tell
    mixed = np.repeat(np.minimum.reduceat(columns[2], starts) != np.maximum.reduceat(columns[2], starts), sizes)
    e, node, comp, n, place, until, often, pivot, common, cell = (x[mixed] for x in columns)
    if not len(e):
        return
    place = place.astype(np.int64)
    starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
    sizes = np.diff(np.append(starts, len(e)))
    cells: set = set()
    for lo, hi in zip(starts, starts + sizes):
        big = lo + np.flatnonzero(cell[lo:hi] >= 0)
        if len(big) > 1:
            cells.update(_met_cells(n[big], place[big], comp[big], cell[big]))
    if cells:
        pairs = np.array(sorted(cells), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=NAMES)

    def allowed(i, j):
        # what both share with one pivot bounds what they share with each other
        bound = np.minimum(common[i], common[j]) + np.minimum(n[i] - common[i], n[j] - common[j])
        ok = (comp[j] != comp[i]) & ((cell[i] < 0) | (cell[j] < 0)) & ((pivot[j] != pivot[i]) | (pivot[i] < 0) | (7 * bound >= 3 * (n[i] + n[j])))
        first = ok & _reach(n[i], n[i] - place[i], n[j], n[j] - place[j])
        i, j, first = i[ok], j[ok], first[ok]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        # the side whose indexed positions end first has all the rest beyond them, or in lists that were skipped
        rest_i, rest_j = n[i] - _indexed(n[i]) + often[i], n[j] - _indexed(n[j]) + often[j]
        rest = np.where(until[j] == until[i], np.maximum(rest_i, rest_j), np.where(until[i] < until[j], rest_i, rest_j))
        return np.column_stack([a, b, 7 * rest - 3 * (n[i] + n[j])])[first]

    found, gathered = [], 0
    sizes = np.repeat(sizes, sizes)
    short = np.flatnonzero(sizes <= SHORT)
    steps = []
    for d in range(1, SHORT):
        i = short[short + d < len(e)]
        i = i[e[i] == e[i + d]]
        if not len(i):
            break
        steps += [(i[k : k + FLUSH], i[k : k + FLUSH] + d) for k in range(0, len(i), FLUSH)]

    def long_lists():
        """In a long list the sets in no big cell meet all others."""
        for lo in starts[sizes[starts] > SHORT]:
            own = np.arange(lo, lo + sizes[lo])
            free = own[cell[own] < 0]
            if len(free):
                for i, j in _block_pairs(n, place, free, own):
                    once = (j > i) | (cell[j] >= 0)
                    yield i[once], j[once]

    for group in (steps, long_lists()):
        for i, j in group:
            rows = allowed(i, j)
            found.append(rows)
            gathered += len(rows)
            if gathered > FLUSH:
                yield _counted(found)
                found, gathered = [], 0
    if gathered:
        yield _counted(found)


def _indexed(n):
    return n - (75 * n + 99) // 100 + 1


def _counted(found: list[np.ndarray]):
    rows, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(counts.astype(np.int64)), none, none], names=NAMES)


NAMES = ["a", "b", "rest", "shared", "cell_a", "cell_b"]


def _compare_block(key, table):
    """A forest of the links between two blocks of sets of different components, from their texts."""
    hashes = WordHashes()
    table = table.combine_chunks()
    node, comp, side = (np.asarray(table.column(x).combine_chunks()) for x in ("node", "comp", "side"))
    sets = [shingles(t, hashes) for t in table.column("text").cast(pa.binary()).to_pylist()]
    n = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), n)
    element, dense = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, int))
    shared = np.bincount(dense, minlength=len(element)) > 1
    number = np.cumsum(shared) - 1
    kept = shared[dense]
    row, column = row[kept], number[dense[kept]]
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    width = int(shared.sum())
    for at in range(0, width, 4096):
        here = (column >= at) & (column < at + 4096)
        r, c = row[here], column[here] - at
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        x[place[r[place[r] >= 0]], c[place[r] >= 0]] = 1
        y[other[r[other[r] >= 0]], c[other[r] >= 0]] = 1
        overlap += x @ y.T
    linked = (100 * overlap >= 75 * (n[left][:, None] + n[right][None] - overlap)) & (comp[left][:, None] != comp[right][None])
    joined: dict[int, int] = {}

    def find(x):
        while joined.get(x, x) != x:
            joined[x] = joined.get(joined[x], joined[x])
            x = joined[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(comp[left[i]])), find(int(comp[right[j]]))
        if a != b:
            joined[max(a, b)] = min(a, b)
            out.append((int(node[left[i]]), int(node[right[j]])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of each row.

    Words are runs without ASCII white space, with A-Z in lower case. Rows link
    where 100 * overlap >= 75 * union of their sets. A text without words, empty or
    null, has no shingles and links with nothing; a text of one to four words has
    one shingle. Rows with equal ids count as one document with several sets; rows
    with a null id link with nothing and have a null component. Texts are read whole,
    however long. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark, 256)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    first = materialise(named.mapInArrow(_sets, "id long, n long, key long, key2 long, part int, blob binary"), "jaccard-sets")
    sets = first.filter("part is null").select("id", "n", "key", "key2")
    both = ["key", "key2"]
    classes = spark.sparkContext.broadcast(rarity_classes(first.filter("part is not null"), max(8, partitions)))
    reps = materialise(sets.filter("key is not null and id is not null").groupBy(*both).agg(F.min("id").alias("node"), F.max("n").alias("n")), "jaccard-reps")
    # A quarter of the shingles is indexed, so buckets grow with the data and what a worker holds of lists does not.
    shape = reps.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).agg(F.sum("n").alias("n"), F.max("k").alias("k")).first()
    postings = (shape["n"] or 0) // 4
    several = (shape["k"] or 0) > 1
    buckets = 1 << (max(64, partitions, postings // BUCKET) - 1).bit_length()

    texts = named.filter("id is not null")
    blobs = texts.mapInArrow(_postings(classes, buckets), "bucket int, n int, sets int, postings binary, nodes binary")
    lists = materialise(blobs.repartition(buckets, "bucket").mapInArrow(_lists, LISTS), "jaccard-lists")
    classes.destroy()
    release_shuffles(spark)

    def named_pairs(pairs):
        """Keys of sets to the ids of their first documents, the smaller one first."""
        a = pairs.join(reps.select(*both, F.col("node").alias("a")), both).select("a", "other", "other2")
        b = a.join(reps.select(F.col("key").alias("other"), F.col("key2").alias("other2"), F.col("node").alias("b")), ["other", "other2"])
        return b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    starred = materialise(compare(named_pairs(lists.filter("element is null").select(*both, "other", "other2").distinct()), texts), "jaccard-compared")
    release_shuffles(spark)
    # several sets of one id are one document
    found = starred.filter(LINKED)
    comps = materialise(connected_components(found, "a", "b"), "jaccard-components")

    # What each set shares with one pivot, of those it was compared with the one compared most.
    sides = starred.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "overlap", "n_a", "n_b").union(starred.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "overlap", "n_a", "n_b"))
    if several:
        many = reps.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("node")
        sides = sides.join(many, "node", "left_anti").join(many.select(F.col("node").alias("pivot")), "pivot", "left_anti")
    sides = sides.filter("4 * overlap >= n_a + n_b - overlap").select("node", "pivot", "overlap")
    degrees = sides.groupBy(F.col("node").alias("pivot")).agg(F.count(F.lit(1)).alias("d"))
    ranked = sides.join(degrees, "pivot").select("node", "pivot", "overlap", "d")
    own = degrees.select(F.col("pivot").alias("node"), "pivot", F.lit(None).cast("long").alias("overlap"), "d")
    near = ranked.union(own).groupBy("node").agg(F.max_by(F.struct("pivot", "overlap"), F.struct("d", "pivot")).alias("p")).select("node", "p.pivot", "p.overlap")
    near = materialise(near, "jaccard-near")
    cells = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= BIG_CELL)
    labels = comps.select(F.col("id").alias("node"), "component")
    largest = reps.groupBy("node").agg(F.max("n").alias("n")) if several else reps.select("node", "n")
    placed = largest.join(labels, "node", "left").join(near.join(cells.select("pivot", "size"), "pivot", "left"), "node", "left")
    placed = placed.select(
        "node",
        "n",
        F.coalesce("component", "node").alias("comp"),
        F.coalesce("pivot", F.lit(-1).cast("long")).alias("pivot"),
        F.coalesce("overlap", F.when(F.col("pivot") == F.col("node"), F.col("n")), F.lit(0)).cast("long").alias("common"),
        F.when(F.col("size").isNotNull(), F.col("pivot")).otherwise(F.lit(-1).cast("long")).alias("cell"),
    )
    placed = materialise(placed, "jaccard-placed")

    members = lists.filter("element is not null").withColumn("n", F.col("n").cast("long")).join(reps.drop("n"), both).drop(*both).join(placed.drop("n"), "node")
    labelled = members.select("element", "node", "comp", "n", "place", "until", "often", "pivot", F.when(F.col("pivot") == F.col("node"), F.col("n")).otherwise(F.col("common")).alias("common"), "cell")
    crossing = materialise(labelled.repartition(buckets, "element").mapInArrow(_cross_pairs, CROSS), "jaccard-crossing")
    discard(lists, near)
    release_shuffles(spark)
    left = crossing.filter("a is not null").groupBy("a", "b").agg(F.max("rest").alias("rest"), F.sum("shared").alias("shared")).filter("7 * shared + rest >= 0").select("a", "b")
    left = left.join(starred.select("a", "b"), ["a", "b"], "left_anti")
    rest = materialise(compare(left, texts).filter(LINKED).select("a", "b"), "jaccard-linked")
    release_shuffles(spark)

    meetings = materialise(crossing.filter("cell_a is not null").select("cell_a", "cell_b").distinct(), "jaccard-cells")
    if meetings.limit(1).count():
        rest = rest.union(materialise(_cell_links(meetings, placed, texts), "jaccard-linked"))
    if rest.limit(1).count():
        comps = materialise(connected_components(found.select("a", "b").union(rest), "a", "b"), "jaccard-components")
    discard(starred, placed, crossing, meetings)
    release_shuffles(spark)

    return (
        sets.join(reps.drop("n"), both, "left")
        .join(comps.select(F.col("id").alias("node"), "component"), "node", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id"))
    )


def _cell_links(meetings: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between sets of cells that meet, block against block.

    Of two cells the pivots are compared first. What a set shares with another is at
    most what the pivots share and what either lacks of its own pivot, so sets are
    dealt to blocks by how much that is, and blocks that cannot reach the threshold
    are not compared. Small components of a cell are dealt to blocks together, large ones to blocks
    of their own, and a component's blocks are not compared with each other.
    """
    # seven times what a set lacks of its pivot, less three times its size; in eighths of the size
    slack = placed.filter("cell >= 0").select("node", "n", "comp", "cell", "common", (4 * F.col("n") - 7 * F.col("common")).alias("slack")).withColumn("grade", F.floor(8 * F.col("slack") / F.col("n")))
    counts = slack.groupBy("cell", "grade", "comp").agg(F.count(F.lit(1)).alias("own"))
    own = counts.filter(F.col("own") >= BLOCK).select("cell", "grade", "comp", F.ceil(F.col("own") / BLOCK).alias("own_blocks"))
    shared = counts.filter(F.col("own") < BLOCK).groupBy("cell", "grade").agg(F.ceil(F.sum("own") / BLOCK).alias("blocks"))
    dealt = slack.join(own, ["cell", "grade", "comp"], "left").join(shared, ["cell", "grade"], "left")
    alone = F.concat(F.lit("c"), F.col("comp").cast("string"), F.lit(":"), F.pmod(F.xxhash64("node"), F.col("own_blocks")).cast("string"))
    together = F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.col("blocks")).cast("string"))
    block = F.concat(F.col("grade").cast("string"), F.when(F.col("own_blocks").isNotNull(), alone).otherwise(together))
    blocked = materialise(dealt.select("node", "n", "comp", "cell", "common", "slack", block.alias("block")), "jaccard-blocks")
    stats = {"low": F.min("comp"), "high": F.max("comp"), "least": F.min("n"), "most": F.max("n"), "slack": F.max("slack"), "common": F.max("common"), "lack": F.max(F.col("n") - F.col("common"))}
    ranges = blocked.groupBy("cell", "block").agg(*[e.alias(c) for c, e in stats.items()])
    one, two = (ranges.select(*[F.col(c).alias(f"{c}_{k}") for c in ("cell", "block", *stats)]) for k in "ab")
    between = compare(meetings.filter("cell_a <> cell_b").select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")), texts)
    known = meetings.join(between.select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b"), F.col("overlap").alias("pivots")).distinct(), ["cell_a", "cell_b"], "left")
    met = known.join(one, "cell_a").join(two, "cell_b").filter(
        "(cell_a <> cell_b or block_a <= block_b) and not (low_a = high_a and low_b = high_b and low_a = low_b)"
        " and 100 * most_a >= 75 * least_b and 100 * most_b >= 75 * least_a"
        " and if(cell_a <> cell_b, 7 * pivots + slack_a + slack_b >= 0, 7 * (least(common_a, common_b) + least(lack_a, lack_b)) >= 3 * (least_a + least_b))"
    )
    met = met.select("cell_a", "block_a", "cell_b", "block_b")
    same = F.col("cell_a").eqNullSafe(F.col("cell_b")) & F.col("block_a").eqNullSafe(F.col("block_b"))
    sent = met.select("*", F.col("cell_a").alias("cell"), F.col("block_a").alias("block"), F.when(same, 1).otherwise(0).alias("side")).union(met.filter(~same).select("*", F.col("cell_b"), F.col("block_b"), F.lit(2)))
    sent = sent.join(blocked.select("cell", "block", "node", "comp"), ["cell", "block"]).join(texts.select(F.col("id").alias("node"), "text"), "node")
    return sent.select("cell_a", "block_a", "cell_b", "block_b", "side", "node", "comp", "text").groupBy("cell_a", "block_a", "cell_b", "block_b").applyInArrow(_compare_block, "a long, b long")


def group_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all of them where rows repeat an id.

    Rows with a null id all stay, and so do those with null or empty texts, which
    link with nothing. An empty table stays empty; columns keep their names and values.
    """
    found = jaccard_components(docs, id_col, text_col)
    dropped = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_dropped")).distinct()
    return docs.join(dropped, docs[f"`{id_col}`"].cast("long") == dropped["_dropped"], "left_anti")


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS e FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
c AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) ON id = d.doc_id
"""
