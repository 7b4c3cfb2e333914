"""Best-fit-decreasing packing of token ids into fixed windows.

A document longer than a window is first cut into full windows; its rest and
every shorter document are pieces.  Pieces go, longest first, into the open
window with the least remaining capacity that still holds them; a segment tree
indexed by remaining capacity finds it in log(window) steps.

Each Spark task packs its own rows in buffers of about ``buffer_tokens`` ids,
so nothing is shuffled, memory is bounded whatever the table's size, and a
task that is run again gives the same sequences.  A task's last buffer leaves
windows that are partly empty, so small partitions are first merged (without a
shuffle) until they hold about ``TASK_BYTES`` of text each: padding then hangs
on the text's size and not on how the table happens to be split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import utf8
from equitally.llm.tokens import default_path, encoder

WINDOW = 2048
END_ID = 1
BUFFER_TOKENS = 6_000_000
#: Text of a task: tables in smaller partitions are packed in fewer tasks.
TASK_BYTES = 8_000_000
#: A sequence id is the task's partition number above these bits and a count below.
COUNT_BITS = 33


class CapacityTree:
    """Open windows by remaining capacity, with the tightest fit in log steps."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [0] * (2 * self.leaves)  # open windows below each tree node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.any[node] += change
            node >>= 1

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, id) of the tightest window with room for ``need``."""
        tree, node = self.any, self.leaves + need
        while not tree[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1  # the right sibling
        while node < self.leaves:
            node *= 2
            if not tree[node]:
                node += 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) for pieces of at most ``window`` ids, and the
    number of windows; longest first, ties in the given order."""
    tree, number, offset, opened = CapacityTree(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] == window:
            number[i], opened = opened, opened + 1
            continue
        fit = tree.take(lengths[i])
        if fit is None:
            fit, opened = (window, opened), opened + 1
        capacity, number[i] = fit
        offset[i] = window - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], number[i])
    return number, offset, opened


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, window: int, end_id: int, buffer_tokens: int):
    def emit(rows: list, first_id: int) -> tuple[pa.RecordBatch, int]:
        number, offset, opened = best_fit([r[2] for r in rows], window)
        doc, start, length, ids, total = zip(*rows)
        cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(ids, pa.binary()), pa.array(total, pa.int64()),
                pa.array([first_id + n for n in number], pa.int64()), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")]), first_id + opened

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], "<u4")
        next_id = TaskContext.get().partitionId() << COUNT_BITS
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                ids = np.concatenate([encode(text), end])
                for at in range(0, len(ids), window):
                    piece = ids[at:at + window]
                    rows.append((doc_id, at, len(piece), piece.tobytes(), len(ids)))
                    held += len(piece)
                    if held >= buffer_tokens:
                        out, next_id = emit(rows, next_id)
                        rows, held = [], 0
                        yield out
        if rows:
            yield emit(rows, next_id)[0]
    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit, as binary), doc_tokens, sequence_id and offset in the sequence.

    A null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are packed as often as they come; an empty table gives no
    rows.  A very long text becomes as many full windows as it fills.
    ``tokenizer_path`` must name the file wherever a task runs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(1, size // TASK_BYTES))
    return rows.mapInArrow(_packer(tokenizer_path or default_path(), window, end_id, buffer_tokens), SCHEMA)


def crc32_column():
    """Unsigned CRC-32 of a piece's id bytes."""
    return F.crc32("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences that pieces make up."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")) \
        .select("sequence_id", "length", F.expr(
            "aggregate(parts, cast('' as binary), (made, p) -> concat(made, p.ids))").alias("ids"))


def padding(lengths: np.ndarray, window: int = WINDOW) -> int:
    """Ids of padding: up to the window, none for a power of two."""
    lengths = np.asarray(lengths, np.int64)
    return int((window - lengths)[(lengths & (lengths - 1)) != 0].sum())


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
