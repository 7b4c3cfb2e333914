"""Repeated byte windows by a depth-limited radix sort of suffixes.

Every suffix of every text matters only through its first ``window`` bytes
(the threshold), and groups of equal suffixes at that depth are exactly the
repeated windows.  The sort runs most significant digit first, and each pass
only keeps groups that can still hold two equal windows:

1. The first digit is the ``digit`` bytes at a place that a window's own
   content chooses: its smallest hashed gram (a minimizer).  Equal windows
   choose alike, neighbouring windows mostly share a place, so a few rows per
   hundred bytes stand for all suffixes.  Digits that occur once end here.
2. The second digit is the whole context of the place, all bytes of all its
   windows.  Where it is equal, all these windows repeat; equal contexts
   collapse, so a group of copies is one row from here on.
3. The last passes order the windows of the different contexts of one first
   digit by their bytes, eight at a time; groups that are still together at
   full depth repeat.  A first digit with very many contexts is spread window
   by window instead.

Polynomial hashes only bring together what may be equal: different texts with
an equal hash are easily made.  Equality is settled by the bytes themselves, or
by a 128-bit BLAKE2b digest where they are not in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import rows_of, sorted_runs, starts_of_runs, utf8, write_table

WINDOW = 400
DIGIT = 100
#: Contexts of one first digit that a task sorts in memory; more are spread.
CONTEXTS_IN_TASK = 4_000
SEGMENT = 1 << 17
PLACE_BITS = 24
#: Rows and bytes of one Arrow batch made here.
OUT_ROWS, OUT_BYTES = 4_000, 2_000_000
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
KEY = ["id", "r"]
NO_ID = -(1 << 63)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(97).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i below ``n``."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, SEGMENT + WINDOW), b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return [p[:n] for p in _powers]


def digest(stretch: bytes) -> bytes:
    return blake2b(stretch, digest_size=16).digest()


class Hashes:
    """Polynomial hashes of any stretch of a buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[:-1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Buffers of about SEGMENT bytes: (text number, offset, bytes) parts; a
    long text becomes parts that overlap by ``window`` - 1 bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - window + 1), SEGMENT):
            part = t[at:at + SEGMENT + window - 1]
            if held and size + len(part) > SEGMENT + window:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def places(parts: list[tuple[int, int, bytes]], window: int, digit: int):
    """(part number, place, first window, last window, digit hash, context
    digest) for every chosen place of a buffer; positions within the part."""
    held = b"".join(p[2] for p in parts)
    data = np.frombuffer(held, np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    grams = hashes.all(digit)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((mixed(grams) & ~low) | np.arange(len(grams), dtype=np.uint64), window - digit + 1)
    count = sizes - window + 1  # windows of each part
    part = np.repeat(np.arange(len(parts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    place = (least[start] & low).astype(np.int64)
    first = starts_of_runs(part, place)
    last = np.append(first[1:], len(part)) - 1
    lo, hi, at, own = start[first], start[last], place[first], part[first]
    context = [digest(held[i:j]) for i, j in zip(lo.tolist(), (hi + window).tolist())]
    return own, at - begin[own], lo - begin[own], hi - begin[own], grams[at], context


PLACE_SCHEMA = "id long, r long, a int, lo int, hi int, h long, c binary"


def _place_batches(window: int, digit: int):
    def find(batches):
        for batch in batches:
            ids, rs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for parts in segments(utf8(batch.column(2)), window):
                own, a, lo, hi, h, c = places(parts, window, digit)
                text = np.array([p[0] for p in parts])[own]
                base = np.array([p[1] for p in parts])[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text]), pa.array(rs[text]), *[pa.array((x + base).astype(np.int32)) for x in (a, lo, hi)],
                     pa.array(h.view(np.int64)), pa.array(c, pa.binary())], ["id", "r", "a", "lo", "hi", "h", "c"])
    return find


def _pack_batches(batches):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([squeeze(t) for t in utf8(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "r", "packed"])


def _context_batches(window: int):
    """Texts with a list of places -> one row per place with its context's bytes."""
    def out(rows):
        ids, rs, spots, cut = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rs, pa.int64()), pa.array([s["h"] for s in spots], pa.int64()),
             *[pa.array([s[k] for s in spots], pa.int32()) for k in ("a", "lo", "hi")],
             *[pa.array([s[k] for s in spots], pa.bool_()) for k in ("known", "hot")], pa.array(cut, pa.binary())],
            ["id", "r", "h", "a", "lo", "hi", "known", "hot", "bytes"])

    def cut(batches):
        open_, rows, size = zstandard.ZstdDecompressor().decompress, [], 0
        for batch in batches:
            for row in rows_of(batch):
                text = open_(row["packed"])
                for s in row["spots"]:
                    rows.append((row["id"], row["r"], s, text[s["lo"]:s["hi"] + window]))
                    size += len(rows[-1][-1])
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)
    return cut


def windows_of(run: dict, window: int):
    """(bytes, start in them, context number, position in the text) of every
    window of a run of contexts."""
    held = run["bytes"].combine_chunks() if isinstance(run["bytes"], pa.ChunkedArray) else run["bytes"]
    data = b"".join(held.to_pylist())
    lo, hi = (run[k].to_numpy().astype(np.int64) for k in ("lo", "hi"))
    count = hi - lo + 1
    sizes = count + window - 1
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(lo)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return data, begin[own] + step, own, lo[own] + step


def grouped(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of two and more; ``group`` is sorted."""
    same = group[1:] == group[:-1]
    kept = np.zeros(len(group), bool)
    kept[1:] |= same
    kept[:-1] |= same
    return order[kept], group[kept]


def repeated_windows(data: np.ndarray, start: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Whether each window equals another one byte by byte.

    Windows of different ``key`` are known to differ.  The others are ordered
    by passes over their bytes, most significant first; a window alone in its
    group ends there, a digit that parts no group needs no sorting.
    """
    order = np.argsort(key, kind="stable")
    order, group = grouped(order, key[order])
    width = 8 if window >= 8 else 1
    digits = np.ndarray(len(data) - width + 1, f">u{width}", data, strides=(1,))
    for at in [*range(0, window - width, width), window - width]:
        digit = digits[start[order] + at]
        if not ((digit[1:] != digit[:-1]) & (group[1:] == group[:-1])).any():
            continue
        again = np.lexsort((digit, group))
        order, group, digit = order[again], group[again], digit[again]
        new = np.zeros(len(order), np.int64)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        order, group = grouped(order, np.cumsum(new))
    repeated = np.zeros(len(start), bool)
    repeated[order] = True
    return repeated


def _spans(run: dict, own: np.ndarray, position: np.ndarray, repeated: np.ndarray, window: int) -> pa.RecordBatch:
    """Stretches of repeated windows of contexts not known to repeat as a whole."""
    keep = np.flatnonzero(repeated & ~run["known"].to_numpy(zero_copy_only=False)[own])
    own, position = own[keep], position[keep]
    first = starts_of_runs(own, position - np.arange(len(position)))
    last = np.append(first[1:], len(own)) - 1 if len(own) else first
    ids, rs = run["id"].to_numpy(), run["r"].to_numpy()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[own[first]]), pa.array(rs[own[first]]), pa.array(position[first].astype(np.int32)),
         pa.array((position[last] + window).astype(np.int32))], ["id", "r", "s", "e"])


def _sort_batches(window: int):
    def sort(batches):
        for run in sorted_runs(batches, ["h"], 500):
            held, start, own, position = windows_of(run, window)
            data = np.frombuffer(held, np.uint8)
            a, h = run["a"].to_numpy().astype(np.int64), run["h"].to_numpy().view(np.uint64)
            group = h[own] + (a[own] - position).astype(np.uint64) * MIX
            key = mixed(Hashes(data).at(start, start + window) ^ mixed(group))
            yield _spans(run, own, position, repeated_windows(data, start, key, window), window)
    return sort


def _window_batches(window: int):
    """Contexts -> one row per window, for first digits with very many contexts."""
    def windows(batches):
        for run in sorted_runs(batches, ["h"], 500):
            held, start, own, position = windows_of(run, window)
            known = run["known"].to_numpy(zero_copy_only=False)[own]
            ids, rs = run["id"].to_numpy()[own], run["r"].to_numpy()[own]
            for at in range(0, len(start), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(held[i:i + window]) for i in start[s].tolist()], pa.binary()), pa.array(ids[s]), pa.array(rs[s]),
                     pa.array(position[s].astype(np.int32)), pa.array(known[s])], ["k", "id", "r", "p", "known"])
    return windows


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, r, text: rows that agree in (id, r) are the same document text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("r"), text.alias("text"))


def repeated_spans(rows: DataFrame, packed: DataFrame, window: int, digit: int,
                   contexts_in_task: int) -> tuple[DataFrame, DataFrame]:
    """((id, r, s, e) stretches of bytes that repeated windows cover, maybe
    overlapping; the packed texts of all documents that may have any)."""
    found = write_table(rows.mapInArrow(_place_batches(window, digit), PLACE_SCHEMA), "repeat-places")
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = write_table(found.join(again, "h", "left_semi"), "repeat-shared", found.count())
    n = shared.count()  # bounds what follows; counts come from the files' footers
    # second digit: contexts, one representative each
    contexts = write_table(shared.groupBy("h", "c").agg(
        F.min(F.struct("id", "r", "a", "lo", "hi")).alias("of"), F.count("*").alias("n")), "repeat-contexts", n)
    whole = shared.join(contexts.where("n > 1").select("h", "c"), ["h", "c"], "left_semi") \
        .select("id", "r", F.col("lo").alias("s"), (F.col("hi") + window).alias("e"))
    several = contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    spots = contexts.join(several, "h").select(
        F.col("of.id").alias("id"), F.col("of.r").alias("r"),
        F.struct("h", "of.a", "of.lo", "of.hi", (F.col("n") > 1).alias("known"), (F.col("m") > contexts_in_task).alias("hot")).alias("spot"))
    texts = write_table(packed.join(shared.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY), "repeat-texts", n, 10_000)
    # a document's places in lists of bounded length
    listed = spots.withColumn("part", F.floor(F.col("spot.a") / (1 << 18))).groupBy(*KEY, "part") \
        .agg(F.collect_list("spot").alias("spots")).drop("part")
    cut = write_table(texts.join(listed, KEY).select("id", "r", "packed", "spots").mapInArrow(
        _context_batches(window), "id long, r long, h long, a int, lo int, hi int, known boolean, hot boolean, bytes binary"),
        "repeat-cut", n, 40_000)
    sorted_ = cut.where("not hot").repartition("h").sortWithinPartitions("h") \
        .mapInArrow(_sort_batches(window), "id long, r long, s int, e int")
    every = write_table(cut.where("hot").mapInArrow(
        _window_batches(window), "k binary, id long, r long, p int, known boolean"), "repeat-windows")
    twice = every.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    spread = every.where("not known").join(twice, "k", "left_semi") \
        .select("id", "r", F.col("p").alias("s"), (F.col("p") + window).alias("e"))
    return whole.unionByName(sorted_).unionByName(spread), texts


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def _remove_batches(batches):
    open_, rows, size = zstandard.ZstdDecompressor().decompress, [], 0
    for batch in batches:
        for row in rows_of(batch):
            text, spans = open_(row["packed"]), merged([(s["s"], s["e"]) for s in row["spans"]])
            edges = [0, *(x for span in spans for x in span), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append({"id": row["id"], "r": row["r"], "n_removed": len(text) - len(rest),
                         "removed": [{"s": s, "e": e} for s, e in spans],
                         "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest})
            size += len(rest)
            if size >= OUT_BYTES or len(rows) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, REMOVED)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, REMOVED)


REMOVED = pa.schema([("id", pa.int64()), ("r", pa.int64()), ("n_removed", pa.int64()),
                     ("removed", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                     ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   digit: int = DIGIT, contexts_in_task: int = CONTEXTS_IN_TASK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, removed (merged byte
    spans s, e), kept_sha256 and kept (the remaining bytes; null where nothing
    was removed, the text itself is then what is left).

    A byte goes if some ``window``-byte string that covers it also starts
    anywhere else in ``docs``, the same row included.  Null texts count as
    empty; texts shorter than the window stay whole; repeated rows are copies
    of each other; a null doc_id stays null; an empty table gives no rows.
    """
    if not 0 < digit <= window:
        raise ValueError("digit must be 1 to window bytes")
    rows = keyed(docs, id_col, text_col)
    packed = rows.where(F.octet_length("text") >= window).mapInArrow(_pack_batches, "id long, r long, packed binary")
    spans, texts = repeated_spans(rows, packed, window, digit, contexts_in_task)
    # a set: copies of a row bring the same spans
    listed = spans.groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    removed = listed.join(texts, KEY).select("id", "r", "packed", "spans") \
        .mapInArrow(_remove_batches, "id long, r long, n_removed long, removed array<struct<s int, e int>>, kept_sha256 string, kept binary")
    return rows.select("id", "r", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own")) \
        .join(removed, KEY, "left").select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<struct<s:int,e:int>>")).alias("removed"),
            F.coalesce("kept_sha256", "own").alias("kept_sha256"), "kept")
