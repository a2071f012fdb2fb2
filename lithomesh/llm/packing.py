"""Packing of token ids into fixed windows by Karmarkar-Karp multiway differencing.

Each task tokenises its own documents and packs them batch by batch, so no ids
are shuffled. In a batch every item (a document, or what is left of one after
whole windows were cut off it) starts as a partial partition of m windows; the
two partial partitions with the largest imbalance are merged, fullest windows
against emptiest, until one is left. That leaves near-equal windows. m begins with
the fewest windows that could hold the ids and rises whenever one of them exceeds
the capacity. Only where that would pad more than ``PADDING`` of a batch are
documents cut: each window that holds more than the mean gives the excess off as an
item of its own, and differencing begins anew.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.llm.tokens import chunk_tokenizer
from lithomesh.plans.session import prepare_workers

#: Windows that a batch fills.
BATCH_WINDOWS = 256
#: Ids short of full windows that a batch is taken with, for each window: differencing rarely leaves exactly equal sums.
SLACK = 12
#: Share of a batch that windows beyond the fewest may add as padding.
PADDING = 0.005
#: Documents are joined to items of at least this many ids, so a batch has a bounded number of items.
LEAST_ITEM = 32
#: Power-of-two sequences that the last ids of a task may form; these are not padded.
TAIL_PARTS = 3


def differencing(sizes: list[int], m: int) -> np.ndarray:
    """Window of each item, for m windows of near-equal sums."""
    n = len(sizes)
    if n <= m:
        return np.arange(n)
    nodes: list = []  # for each merge: left, right, permutations of their windows
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, size))
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}

    while len(heap) > 1:
        _, a, size_a = heapq.heappop(heap)
        _, b, size_b = heapq.heappop(heap)
        if a < n and b < n:
            merged = np.zeros(m, np.int64)
            merged[0], merged[-1] = size_a, size_b
        elif b < n or a < n:
            merged = sums.pop(max(a, b))  # items have the smaller numbers
            merged[-1] += size_b if b < n else size_a
            if a < n:
                a, b = b, a
        else:
            merged = sums.pop(a) + sums.pop(b)[::-1]
        order = merged.argsort(kind="stable")[::-1]
        merged = merged[order]
        merged -= merged[-1]
        node = n + len(nodes)
        nodes.append((a, b, order))
        sums[node] = merged
        heapq.heappush(heap, (-int(merged[0]), node, 0))
    window = np.zeros(n, np.int64)
    labels = {heap[0][1]: np.arange(m)}
    for k in range(len(nodes) - 1, -1, -1):
        a, b, order = nodes[k]
        mine = labels.pop(n + k)
        left = np.empty(m, np.int64)
        left[order] = mine
        right = left[::-1]
        for child, own in ((a, left), (b, right)):
            if child < n:
                window[child] = own[0]
            else:
                labels[child] = own
    return window


def fewest_windows(sizes: list[int], capacity: int, padding: float = PADDING) -> tuple[int, np.ndarray, bool]:
    """The least window count at which differencing exceeds no window, each item's window, and whether there is such a count.

    The count begins where the ids just fit and rises while that adds at most the
    share ``padding`` of the ids; if no count is enough, the fewest windows are told.
    """
    total = sum(sizes)
    least = -(-total // capacity)
    first = None
    for m in range(least, max(least, int(total * (1 + padding) // capacity)) + 1):
        window = differencing(sizes, m)
        if np.bincount(window, weights=sizes, minlength=m).max() <= capacity:
            return m, window, True
        first = window if first is None else first
    return least, first, False


def _cut(item: list[tuple], at: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``at`` ids of an item, and the rest."""
    head, tail = [], []
    for doc, start, ids, total in item:
        n = min(len(ids), at)
        if n:
            head.append((doc, start, ids[:n], total))
        if n < len(ids):
            tail.append((doc, start + n, ids[n:], total))
        at -= n
    return head, tail


def least_powers(least: int, parts: int) -> list[int]:
    """At most ``parts`` powers of two with the smallest sum that is ``least`` or more."""
    out: list[int] = []
    while least > 0:
        if len(out) == parts - 1:
            out.append(1 << (least - 1).bit_length())
            break
        out.append(1 << (least.bit_length() - 1))
        least -= out[-1]
    return out


class Packer:
    """Packs the documents of one task; ``rows`` of a batch are pieces of documents."""

    def __init__(self, capacity: int, first_sequence: int, batch_windows: int = BATCH_WINDOWS):
        self.capacity, self.sequence, self.batch = capacity, first_sequence, batch_windows * capacity
        self.waiting: list[tuple] = []  # doc, start, ids, tokens of the document
        self.tokens = 0

    def _emit(self, pieces: list[tuple], out: list) -> None:
        """One sequence from pieces in order."""
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), total, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray, out: list) -> None:
        """Whole windows of a long document become sequences of their own; the rest waits."""
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._emit([(doc, at, ids[at : at + self.capacity], total)], out)
        if whole < total:
            self.waiting.append((doc, whole, ids[whole:], total))
            self.tokens += total - whole
        while self.tokens >= self.batch:
            self._pack(self.batch - SLACK * (self.batch // self.capacity), out)

    def _take(self, tokens: int) -> list[tuple]:
        """Pieces from the front of what waits, ``tokens`` ids in all; the last one is cut."""
        got, left = [], tokens
        k = 0
        while left > 0:
            doc, start, ids, total = self.waiting[k]
            if len(ids) <= left:
                got.append(self.waiting[k])
                left -= len(ids)
                k += 1
            else:
                got.append((doc, start, ids[:left], total))
                self.waiting[k] = (doc, start + left, ids[left:], total)
                left = 0
        del self.waiting[:k]
        self.tokens -= tokens
        return got

    def _pack(self, tokens: int, out: list) -> None:
        """The next ``tokens`` ids into near-equal windows; where no count fits, windows give off what they hold over the mean, and it is placed anew."""
        items: list[list] = [[]]
        size = 0
        for piece in self._take(tokens):
            if size and (size >= LEAST_ITEM or size + len(piece[2]) > self.capacity):
                items.append([])
                size = 0
            items[-1].append(piece)
            size += len(piece[2])
        while True:
            sizes = [sum(len(p[2]) for p in item) for item in items]
            windows, window, fits = fewest_windows(sizes, self.capacity)
            order = np.argsort(window, kind="stable")
            held = np.split(order, np.flatnonzero(np.diff(window[order])) + 1)
            if fits:
                break
            for own in held:
                over = sum(sizes[i] for i in own) - sum(sizes) // windows
                if over > 0 and max(sizes[i] for i in own) > 1:
                    longest = max(own, key=sizes.__getitem__)
                    head, tail = _cut(items[longest], sizes[longest] - min(over, sizes[longest] // 2))
                    items[longest] = head
                    items.append(tail)
        for own in held:
            self._emit([p for i in own for p in items[i]], out)

    def finish(self, out: list) -> None:
        """The last batch: whole windows by differencing, what is over as a few power-of-two sequences."""
        windows = self.tokens // self.capacity
        over = self.tokens - windows * (self.capacity - SLACK)
        for length in least_powers(over, TAIL_PARTS if windows else 64):
            for at in range(0, length, self.capacity):
                if self.tokens:
                    self._emit(self._take(min(length - at, self.capacity, self.tokens)), out)
        if self.tokens:
            self._pack(self.tokens, out)


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``capacity`` ids.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. A document
    is its text's ids and then ``end_id``, so a null or empty text is one piece of one
    id; repeated rows are packed as rows of their own; a null id stays null. Long
    texts are cut into whole windows and a rest. Sequences are full, except at a
    task's end: there a few may fall short by some ids, and up to three (in a task
    with less than a window's ids: up to twelve) have a power of two as length. An empty table gives no pieces. Other columns are ignored.
    """
    prepare_workers(docs.sparkSession, 512)

    def run(batches):
        tokenizer = chunk_tokenizer(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)

        def rows(out):
            columns = list(zip(*out))
            arrays = [pa.array(columns[i], pa.int64()) for i in range(6)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([x.astype("<u4").tobytes() for x in columns[6]], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            out: list = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                packer.add(doc, np.concatenate([tokenizer.encode(text or b""), end]), out)
            for i in range(0, len(out), 4096):
                yield rows(out[i : i + 4096])
        out = []
        packer.finish(out)
        if out:
            yield rows(out)

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return named.mapInArrow(run, SCHEMA)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
