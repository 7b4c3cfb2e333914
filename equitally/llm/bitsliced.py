"""Exact top-k by inner product over a bit-sliced index.

Every attribute (vector component) of a block of rows is stored as bit slices:
slice ``b`` is a bitmap of the rows whose offset from the block's minimum has
bit ``b`` set.  A query's score is a weighted sum of attributes, so it is the
sum of slices shifted by weight bits, added with bitmap carry-save arithmetic.
Weights are quantised first (bits below ``drop_bits`` are left out), which
gives every row a lower bound and the whole block one error bound.  The k-th
largest lower bound is read from the most significant slice downward; rows
within the error bound of it are the boundary, and are scored exactly.

Every block of rows meets every group of query blocks in one task, which gets
the block once and then the group's queries one after the other; each pair
gives k rows per query, and a query's best k of all blocks are kept.  Vectors
with components too large for slices lie in blocks of their own, which are
scored without an index, in Python integers where a long could overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equitally.llm.common import rows_of, spread, write_table

SCALE = 256
ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 64
#: Queries that a block of rows meets in one task at most, and tasks a core for
#: which smaller groups are made.
QUERIES_PER_GROUP, TASKS_PER_CORE = 8_192, 4
#: A block of rows is some megabytes; few of them go to Python at once.
BLOCK_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
DROP_BITS = 5
#: Quantised components of an indexed block stay below, so that scores fit in a long.
LIMIT = 1 << 26
#: Scores at or beyond ± this do not fit in a long.
MOST = (1 << 63) - 1


class BitSlicedIndex:
    """Slices of one block of rows (int64 matrix rows x attributes)."""

    def __init__(self, values: np.ndarray):
        self.rows, self.values = len(values), values
        self.low = values.min(0)
        offsets = values - self.low
        self.bits = max(1, int(offsets.max()).bit_length())
        words = -(-self.rows // 64)
        padded = np.zeros((words * 64, values.shape[1]), np.int64)
        padded[:self.rows] = offsets
        packed = np.empty((values.shape[1], self.bits, words * 8), np.uint8)
        for b in range(self.bits):
            packed[:, b] = np.packbits((padded >> b & 1).astype(np.uint8), axis=0, bitorder="little").T
        self.slices = packed.view(np.uint64)  # attribute, bit, word
        self.real = np.packbits(np.arange(words * 64) < self.rows, bitorder="little").view(np.uint64)

    def sum_slices(self, query: np.ndarray, drop_bits: int) -> tuple[list[np.ndarray], int]:
        """Slices of every row's quantised score, and the most a row's exact
        score (less the same constant) can lie above quantised << drop_bits."""
        weights = np.abs(query)
        error, levels = 0, {}
        for b in range(self.bits):
            shifted = weights << b
            kept = shifted >> drop_bits
            error += int((shifted - (kept << drop_bits)).sum())
            for level in range(int(kept.max(initial=0)).bit_length()):
                on = np.flatnonzero(kept >> level & 1)
                if len(on):
                    planes = self.slices[on, b]
                    # a negative weight counts the distance from the top instead
                    planes = np.where((query[on] < 0)[:, None], ~planes, planes)
                    levels.setdefault(level, []).append(planes)
        total, level, carried = [], 0, []
        while levels or carried:
            group = [*levels.pop(level, []), *carried]
            carried = []
            planes = np.concatenate(group) if group else np.zeros((0, self.slices.shape[2]), np.uint64)
            while len(planes) > 1:
                if len(planes) == 2:
                    a, b = planes
                    carried.append((a & b)[None])
                    planes = (a ^ b)[None]
                    break
                n = len(planes) // 3
                a, b, c, rest = planes[:n], planes[n:2 * n], planes[2 * n:3 * n], planes[3 * n:]
                half = a ^ b
                carried.append((a & b) | (half & c))
                planes = np.concatenate([half ^ c, rest])
            total.append(planes[0] if len(planes) else np.zeros(self.slices.shape[2], np.uint64))
            level += 1
        return total, error

    def at_least(self, total: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of the rows whose sum is ``bound`` or more."""
        if bound <= 0:
            return self.real
        if bound >> len(total):
            return np.zeros_like(self.real)
        above, equal = np.zeros_like(self.real), self.real.copy()
        for level in range(len(total) - 1, -1, -1):
            if bound >> level & 1:
                equal &= total[level]
            else:
                above |= equal & total[level]
                equal &= ~total[level]
        return above | equal

    def kth_largest(self, total: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward."""
        sure, open_, value = 0, self.real, 0
        for level in range(len(total) - 1, -1, -1):
            high = open_ & total[level]
            n = int(np.bitwise_count(high).sum())
            if sure + n >= k:
                open_, value = high, value | 1 << level
            else:
                sure, open_ = sure + n, open_ & ~total[level]
        return value

    def candidates(self, query: np.ndarray, k: int, drop_bits: int = DROP_BITS) -> np.ndarray:
        """Row numbers that hold the k best and every tie with them."""
        if self.rows <= k:
            return np.arange(self.rows)
        total, error = self.sum_slices(query, drop_bits)
        if not total:
            return np.arange(self.rows)
        bound = self.kth_largest(total, k) - (error >> drop_bits) - (1 if error & ((1 << drop_bits) - 1) else 0)
        bitmap = self.at_least(total, bound)
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:self.rows])

    def top(self, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, drop_bits: int = DROP_BITS):
        """(ids, scores) of the k best rows other than ``query_id``, ties to smaller ids."""
        # one row more for the query's own; more still where its id repeats
        own = int((ids == query_id).sum())
        rows = self.candidates(query, k + own, drop_bits)
        rows = rows[ids[rows] != query_id]
        scores = self.values[rows] @ query
        best = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][best], scores[best]


def scores_of(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, held at ±MOST where they do not fit."""
    most = [int(np.abs(x).max(initial=0)) for x in (values, query)]
    if most[0] * most[1] * len(query) < MOST:
        return values.astype(np.int64) @ query.astype(np.int64)
    exact = values.astype(object) @ query.astype(object)
    return np.array([max(-MOST, min(MOST, int(x))) for x in exact], np.int64)


def top_unindexed(ids: np.ndarray, values: np.ndarray, query: np.ndarray, query_id: int, k: int):
    """As ``BitSlicedIndex.top``, every row scored."""
    other = ids != query_id
    ids, scores = ids[other], scores_of(values[other], query)
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def quantised(vector: Column) -> Column:
    """array<double> of floor(256 x); null where the vector takes no part: null,
    or holding a null or non-finite component."""
    v = vector.cast("array<double>")
    # a double of 2^52 and more is whole, and may be too large for floor's long
    scaled = F.transform(v, lambda x: F.when(F.abs(x * SCALE) < float(1 << 52), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(v.isNotNull() & sound, scaled)


def beyond(v: Column) -> Column:
    """Whether a quantised vector is too large for an indexed block."""
    return F.exists(v, lambda x: F.abs(x) >= float(LIMIT))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, values, width, far): the rows of each block in one row; a
    partition holds whole blocks, sorted.  Values are four-byte integers, in a
    far block doubles."""
    from equitally.llm.common import sorted_runs, starts_of_runs

    for run in sorted_runs(batches, ["block"], 1):
        block, ids, vectors, far = run["block"].to_numpy(), run["vec_id"].to_numpy(), run["v"], run["far"].to_numpy()
        cut = np.append(starts_of_runs(block), len(block))
        for a, b in zip(cut[:-1], cut[1:]):
            rows = vectors.slice(a, b - a).to_pylist()
            width = max(map(len, rows))
            m = np.zeros((b - a, width), "<f8" if far[a] else "<i4")
            for i, r in enumerate(rows):
                m[i, :len(r)] = r
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[a:a + 1]), pa.array([ids[a:b].astype("<i8").tobytes()], pa.binary()),
                 pa.array([m.tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array(far[a:a + 1])],
                ["block", "ids", "values", "width", "far"])


BLOCK_SCHEMA = "block long, ids binary, values binary, width int, far boolean"


def build_blocks(rows: DataFrame, per_block: int, name: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) dealt by hash into blocks of about ``per_block``; the
    numbers of far blocks follow the others'."""
    rows = rows.withColumn("far", beyond(F.col("v")))
    sizes = {r["far"]: r["count"] for r in rows.groupBy("far").count().collect()}
    near, far = (-(-sizes.get(which, 0) // per_block) for which in (False, True))
    near = max(1, near)
    h = F.xxhash64("vec_id")
    block = F.when(F.col("far"), near + F.pmod(h, F.lit(max(1, far)))).otherwise(F.pmod(h, F.lit(near)))
    dealt = rows.withColumn("block", block.cast("long"))
    made = spread(dealt, "block").sortWithinPartitions("block", "vec_id").mapInArrow(_blocks, BLOCK_SCHEMA)
    return write_table(made, name), near + far


def _matrix(ids: bytes, values: bytes, width: int, to_width: int, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole numbers of a block: longs, in a far block Python integers."""
    own = np.frombuffer(ids, "<i8")
    m = np.frombuffer(values, "<f8" if far else "<i4").reshape(len(own), width)
    if far:
        m = np.array([int(x) for x in m.flat], object).reshape(m.shape)
    out = np.zeros((len(own), to_width), object if far else np.int64)
    out[:, :width] = m
    return own, out


def _search(k: int, drop_bits: int):
    """Of a stream that is sorted by (block, q_group, q_block): the block of rows
    (q_block -1), then the blocks of queries that it meets."""
    def search(batches):
        held, built, ids, m, index = None, None, None, None, None
        for batch in batches:
            for r in rows_of(batch, 4):
                if r["q_block"] < 0:
                    held, built = r, None
                    continue
                if held is None or held["block"] != r["block"]:
                    continue  # no row has this block's number
                width = max(held["width"], r["width"], 1)
                if built != width:
                    ids, m = _matrix(held["ids"], held["values"], held["width"], width, held["far"])
                    built, index = width, None
                q_ids, q = _matrix(r["ids"], r["values"], r["width"], width, r["far"])
                if held["far"] or r["far"]:
                    found = [(int(i), *top_unindexed(ids, m, v, i, k)) for i, v in zip(q_ids, q)]
                else:
                    index = index or BitSlicedIndex(m)
                    found = [(int(i), *index.top(ids, v, i, k, drop_bits)) for i, v in zip(q_ids, q)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                     pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                     pa.array(np.concatenate([f[2] for f in found]), pa.int64())], ["query_id", "vec_id", "score"])
    return search


def meetings(index: DataFrame, n_blocks: int, queries: DataFrame, n_queries: int, per_group: int) -> DataFrame:
    """Every block of rows with every block of queries: (block, q_group, q_block,
    ...), where the queries' blocks lie in groups of ``per_group`` at most and
    the row of a group's block of rows has q_block -1.  A block is there once a
    group and a query once a block, not a block for every query."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(n_queries, max(-(-n_queries // per_group), -(-TASKS_PER_CORE * cores // n_blocks))))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    packed = ["ids", "values", "width", "far"]
    return index.select("block", every(groups).alias("q_group"), F.lit(-1).cast("long").alias("q_block"), *packed).unionByName(
        queries.select(every(n_blocks).alias("block"), F.pmod("block", F.lit(groups).cast("long")).alias("q_group"),
                       F.col("block").alias("q_block"), *packed))


def top_k(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK, drop_bits: int = DROP_BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest
    integer inner product, the query's own id left out, ties to smaller ids.

    Rows or queries with a null id, or with a vector that is null or holds nulls
    or non-finite components, take no part.  Vectors of unequal length count as
    padded with zeros.  A row that repeats counts as often as it comes; of
    queries that share an id the smallest vector asks.  Components may be as
    large as a double scales to; a score of the result that does not fit in a
    long is an error.  Empty tables give no rows.
    """
    def sound(df):
        return df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")) \
            .where("vec_id is not null and v is not null")

    index, n_blocks = build_blocks(sound(rows), per_block, "bsi-rows")
    asked = sound(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    q, n_queries = build_blocks(asked, queries_per_block, "bsi-queries")
    met = meetings(index, n_blocks, q, n_queries, -(-QUERIES_PER_GROUP // queries_per_block))
    found = spread(met, "block", "q_group").sortWithinPartitions("block", "q_group", "q_block") \
        .mapInArrow(_search(k, drop_bits), "query_id long, vec_id long, score long")
    found = write_table(found, "bsi-found", settings=BLOCK_BATCHES)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", F.when(F.abs("score") >= MOST, F.raise_error(F.lit("a score does not fit in a long")).cast("long"))
                .otherwise(F.col("score")).alias("score"))
