"""Compression of vectors to one code byte a part, with memoised grid cells.

Components become integers, ``floor(256 * x)``; a vector is cut into equal
consecutive parts, and every part position has a codebook that two rounds of
assignment and averaging fit.  A part is assigned through a grid: the coarse
cell that it lies in is hashed, and the first part of a cell works out which
entries can be nearest anywhere in the cell's box.  An entry stays if its least
distance to the box is not above the smallest greatest distance of any entry;
all others are farther than some entry wherever in the box the part lies.  The
cell's list is remembered in the worker, and only its entries are evaluated
exactly.  Entries at equal distance are never dropped, so ties fall to the
lower index as they do without the grid.

A codebook holds ``entries`` x dimension integers whatever the table's size: it
is the only thing that reaches the driver or goes back to the tasks.  Sums for
the averages are added up in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import totals_of, write_table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# A grid cell's width is the span of the codebook's components over this.
CELLS_ACROSS = 8
# Cells remembered per part position in a worker; beyond it the memory starts anew.
REMEMBERED = 20_000
# Components up to this magnitude square and add up within 64 bits.
SMALL = 2 ** 24
ROWS_AT_ONCE = 2_048
LIMB = 10 ** 18


def cuts(dimension: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end; parts are equal if ``parts`` divides the
    dimension, else the first ones are longer by one."""
    size, more = divmod(dimension, parts)
    return [p * size + min(p, more) for p in range(parts + 1)]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as 64-bit integers if they are small, else as Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    exact = [int(s) if np.isfinite(s) else int(x) * SCALE for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(exact, object).reshape(scaled.shape)


class Cells:
    """Nearest entries of one part position's codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.width = max(1, int(book.max() - book.min()) // CELLS_ACROSS) if book.size else 1
        self.known: dict[bytes | tuple, int] = {}
        self.near = np.zeros((0, len(book)), bool)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """Entries that are not dominated across each cell's box."""
        low = (cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        below, above = low - self.book, self.book - high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        least, most = (least * least).sum(2), (most * most).sum(2)
        return (least <= most.min(1)[:, None]).astype(bool)

    def _rows_of(self, cells: np.ndarray) -> np.ndarray:
        """Position in ``near`` of every part's cell."""
        if cells.dtype == object or not cells.shape[1]:
            keys = [tuple(c) for c in cells.tolist()]
        else:
            keys = cells.astype(np.int64, order="C").view(f"V{8 * cells.shape[1]}").ravel().tolist()
        new = {k: i for i, k in enumerate(keys) if k not in self.known}
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.near = {}, np.zeros((0, len(self.book)), bool)
                new = {k: i for i, k in enumerate(keys)}
            at = list(new.values())
            found = [self._candidates(cells[at[i:i + 256]]) for i in range(0, len(at), 256)]
            self.known.update(zip(new, range(len(self.near), len(self.near) + len(new))))
            self.near = np.concatenate([self.near, *found])
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part; ties to the lower index."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, entry = np.nonzero(self.near_of(parts))
        gap = parts[row] - self.book[entry]
        far = (gap * gap).sum(1)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(far, begins)
        hit = np.flatnonzero(far == np.repeat(best, np.diff(np.append(begins, len(row)))))
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return entry[first], best

    def near_of(self, parts: np.ndarray) -> np.ndarray:
        at = self._rows_of(parts // self.width)
        return self.near[at]


class Codebooks:
    """The codebooks of all part positions: (entries x dimension) integers."""

    def __init__(self, book: np.ndarray, parts: int = PARTS):
        self.book, self.at = book, cuts(book.shape[1], parts)
        self._cells: dict[type, list[Cells]] = {}

    def __getstate__(self):
        return {"book": self.book, "at": self.at, "_cells": {}}  # tasks remember cells of their own

    def assign(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, entries, squared distances) for every part position."""
        kind = np.int64 if rows.dtype == self.book.dtype == np.int64 else object
        if kind not in self._cells:
            self._cells[kind] = [Cells(self.book[:, a:b].astype(kind)) for a, b in zip(self.at, self.at[1:])]
        for p, cells in enumerate(self._cells[kind]):
            yield p, *cells.nearest(rows[:, self.at[p]:self.at[p + 1]].astype(kind))

    def sha256(self) -> str:
        inner = (self.book[:, a:b].ravel().tolist() for a, b in zip(self.at, self.at[1:]))
        return hashlib.sha256(",".join(str(int(c)) for part in inner for c in part).encode()).hexdigest()


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of few rows with their integer matrix."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            yield batch, integers(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension))


def _sums(books: Codebooks):
    """Counts and sums of the parts of every entry, added up within a task."""
    def add(batches):
        k, d = books.book.shape
        n, total = np.zeros((len(books.at) - 1, k), np.int64), np.zeros((k, d), object)
        for _, rows in _matrices(batches, d):
            for p, entry, _ in books.assign(rows):
                a, b = books.at[p], books.at[p + 1]
                part = np.zeros((k, b - a), rows.dtype)
                np.add.at(part, entry, rows[:, a:b])
                total[:, a:b] += part
                n[p] += np.bincount(entry, minlength=k)
        out = []
        for p in range(len(books.at) - 1):
            for e in np.flatnonzero(n[p]).tolist():
                out.append((p, e, -1, 0, int(n[p, e])))
                for c in range(books.at[p], books.at[p + 1]):
                    value, limb = int(total[e, c]), 0
                    while limb == 0 or value not in (0, -1):
                        value, low = divmod(value, LIMB)
                        out.append((p, e, c, limb, low))
                        limb += 1
                    if value:
                        out.append((p, e, c, limb, value))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["part", "entry", "at", "limb", "value"])
    return add


def averaged(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """One round: assign every part, then average the parts of every entry
    (componentwise, rounded down); unused entries stay."""
    sums = rows.select("vec").mapInArrow(_sums(books), "part long, entry long, at long, limb long, value long") \
        .groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    n, total = {}, {}
    for r in sums.collect():  # entries x (dimension + parts) values and no more, whatever the table's size
        if r["at"] < 0:
            n[r["part"], r["entry"]] = int(r["value"])
        else:
            place = r["part"], r["entry"], r["at"]
            total[place] = total.get(place, 0) + int(r["value"]) * LIMB ** r["limb"]
    book = books.book.astype(object)
    for (p, e, c), value in total.items():
        book[e, c] = value // n[p, e]
    small = max(map(abs, book.ravel().tolist()), default=0) < SMALL
    return Codebooks(book.astype(np.int64) if small else book, parts)


def fit(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (vec_id, vec: arrays of ``dimension``)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    books = Codebooks(integers(np.array([r["vec"] for r in first], np.float64).reshape(len(first), dimension)), parts)
    for _ in range(rounds):
        books = averaged(rows, books, parts)
    return books


def _encoder(books: Codebooks):
    def encode(batches):
        limit = 2 ** 63 - 1
        for batch, rows in _matrices(batches, books.book.shape[1]):
            codes, error = np.zeros((len(rows), len(books.at) - 1), np.uint8), np.zeros(len(rows), object)
            for p, entry, far in books.assign(rows):
                codes[:, p] = entry
                error += far
            digits, step = codes.tobytes().hex(), 2 * codes.shape[1]
            text = [digits[i * step:(i + 1) * step] for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()),
                 pa.array([int(e) if e <= limit else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
    return encode


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, label, code (two hex digits a part), error
    (squared distances of its parts to their entries), label_error (error of all
    vectors of the label, null labels together) and codebooks_sha256.

    A vector that is null or holds null or non-finite components has no row.
    All others take part, repeated rows and ids as often as they come; a null
    id sorts last.  Vectors are coded in the commonest length (ties: the
    longer); those of any other length come back with code and error null and
    count in nothing.  An error beyond 64 bits, or a label's sum beyond them,
    is null.  With fewer rows than ``entries`` the codebook has as many entries
    as there are rows; an empty table gives no rows.  ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    vec = F.col(vector_col).cast("array<double>")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")) \
        .where(vec.isNotNull() & whole)
    length = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = length["d"] if length else 0
    rows = kept.where(F.size("vec") == dimension)
    books = fit(rows, dimension, parts, entries, rounds)
    label = vectors.schema[label_col].dataType.simpleString()
    coded = rows.mapInArrow(_encoder(books), f"vec_id long, label {label}, code string, error long")
    other = kept.where(F.size("vec") != dimension).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = write_table(coded.unionByName(other), "vector-codes")
    counted = done.where("code is not null")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = counted.groupBy("label").agg(
        F.count("*").alias("n"), F.when(F.count("error") == F.count("*"), total).alias("label_error"))
    with_sums = totals_of(done, sums, "label", ["label_error"])
    return with_sums.select(
        "vec_id", "label", "code", "error",
        F.when(F.col("code").isNotNull(), F.expr("try_cast(label_error as bigint)")).alias("label_error"),
        F.lit(books.sha256()).alias("codebooks_sha256"))
