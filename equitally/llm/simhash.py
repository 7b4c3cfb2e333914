"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight bytes at eight positions.  Two fingerprints that differ
in at most ``distance`` bits agree in at least ``8 - distance`` positional
bytes, the guaranteed minimum of matches.  The inverted index therefore posts
every fingerprint under each choice of that many positions together with their
bytes: a pair that reaches the minimum meets in a posting list, and lists stay
short because a key fixes four bytes.  Within a list the shared positional
bytes of a pair are tallied, pairs below the minimum drop, and the rest are
verified by their differing bits.

Exact copies of a fingerprint meet before the index, so a group of copies is
one posting.  A list yields the links of a spanning forest only, never all
pairs; components come from star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import connected_components, sorted_runs, starts_of_runs, utf8, write_table

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
POSITIONS = 8


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats
    counted); 0 for a text without words."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    digest, k = xxhash.xxh64_intdigest, words_per_shingle
    if len(words) <= k:
        return digest(joined, SEED)
    begins = list(accumulate((len(w) + 1 for w in words), initial=0))
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 65536):  # bounded memory on very long texts
        to = min(n, at + 65536)
        h = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(begins[at:to], begins[at + k:to + k])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _posting_batches(distance: int):
    def posts(batches):
        chosen = list(combinations(range(POSITIONS), POSITIONS - distance))
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at = fp.view(np.uint8).reshape(-1, POSITIONS).astype(np.int64)
            for start in range(0, len(fp), 8192):
                own, keys = at[start:start + 8192], []
                for c, positions in enumerate(chosen):
                    key = np.full(len(own), c, np.int64)
                    for p in positions:
                        key = (key << 8) | own[:, p]
                    keys.append(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.tile(fp[start:start + 8192], len(chosen)))], ["key", "fp"])
    return posts


def verified_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of every posting list (rows sorted by key)."""
    chosen = list(combinations(range(POSITIONS), POSITIONS - distance))
    first_shared = {}  # the list that owns a pair: the first choice of positions that it shares
    for byte_mask in range(256):
        same = [p for p in range(POSITIONS) if byte_mask >> p & 1]
        first_shared[byte_mask] = chosen.index(tuple(same[:POSITIONS - distance])) if len(same) >= POSITIONS - distance else -1
    owner_of = np.array([first_shared[m] for m in range(256)])
    weights = 1 << np.arange(POSITIONS)
    start = starts_of_runs(key)
    left = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key)))) - np.arange(len(key))
    choice = key >> (8 * (POSITIONS - distance))
    group = np.arange(len(key))
    found_a, found_b = [], []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = int(group[x])
        return x

    at, shift = np.flatnonzero(left > 1), 1
    while len(at):
        differ = fp[at] ^ fp[at + shift]
        equal = differ.view(np.uint8).reshape(-1, POSITIONS) == 0
        tally = equal.sum(1)
        keep = (tally >= POSITIONS - distance) & (np.bitwise_count(differ.view(np.uint64)) <= distance)
        keep &= owner_of[(equal * weights).sum(1)] == choice[at]
        for i in at[keep].tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                group[max(a, b)] = min(a, b)
                found_a.append(i)
                found_b.append(i + shift)
        shift += 1
        at = at[left[at] > shift]
    return fp[np.array(found_a, int)], fp[np.array(found_b, int)]


def links(distinct_fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints at ``distance`` or fewer
    bits, enough of them to connect all that are linked."""
    def find(batches):
        for run in sorted_runs(batches, ["key"]):
            a, b = verified_links(run["key"].to_numpy(), run["fp"].to_numpy(), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    posted = distinct_fps.select("fp").mapInArrow(_posting_batches(distance), "key long, fp long")
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links reach.

    A null or empty text has fingerprint zero and links like any other.
    Repeated rows come back as often as they came in.  A row without a doc_id
    belongs to its component, and has component_id null if that has no doc_id
    at all.  An empty table gives no rows.  ``distance`` is 4 at most, or
    posting lists would fix fewer than four bytes.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance must be 0 to 4")
    fps = write_table(fingerprints(docs, id_col, text_col), "simhash-fps")
    n = fps.count()
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct", n)
    roots = connected_components(links(distinct, distance), "simhash", n)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    by_root = grouped.where("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    # only fingerprints of several rows or with links need a lookup
    lookup = grouped.where("linked").join(by_root, "root").select("fp", "component_id") \
        .unionByName(grouped.where("not linked and n > 1").select("fp", F.col("least").alias("component_id")))
    return fps.join(lookup, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
