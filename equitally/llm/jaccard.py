"""Jaccard self-join of word-shingle sets, heavy and light by size.

Equal sets are one set first.  A set's shingles are posted under 64-bit tokens,
and sets that share no rare shingle with any other drop out.  What is left is
joined by size.  Sets below a boundary enumerate the subsets of fixed size that
a partner must share: two sets of sizes s and t link exactly if they share
``overlap(s, t)`` shingles, so both list their subsets of that many and meet
under one.  Sets from the boundary on scan inverted lists instead.  The
boundary is where the counted cost of both is least: subsets to enumerate
against list entries to scan, from the sizes and shingle frequencies of the
table.  It moves work, never results.

A list needs few of a set's shingles.  Linked sets share so many that a prefix
of each in any common order holds a shared one, and the order here is rarest
first.  Frequencies are only counted for each set's ``indexed(n)`` least
tokens (all, for sets up to ``FULL``), of which the ``dropped(n)`` most
frequent may go: linked sets share more of their least tokens than either
drops.  So a passage in a third of all documents has no list, unless it makes
up most of them.

Lists never emit all their pairs.  First every member meets the first of its
list and size class, the one with the fewest tokens of its own: in a family of
near copies that is the text that the others were made of.  Members that this
joins into one component are done with each other.  Only pairs of different
components that share a list are then compared, and only those that two bounds
leave open: tokens of a set's own are in no intersection, and the parity
bitmaps of two sets differ in at most as many bits as the sets in shingles.
Both bounds are exact; what they rule out does not link.  Near copies share
hundreds of lists and would meet in each: every member names its ``NAMED`` least
lists, and two that name one in common meet in the least of those alone.  Every
pair left is verified by the shingles of both texts themselves.  A hot member's
partners are dealt over many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import connected_components, rows_of, totals_of, utf8, write_table

SHINGLE_WORDS = 4
PERCENT = 85
# Sets up to this size are indexed whole.
FULL = 128
# Sets from this size on are never enumerated: C(40, 6) subsets are millions.
LARGEST_LIGHT = 40
# Copies remembered in a task, so that most post their shingles once.
REMEMBERED = 200_000
PAIRS_PER_PART = 2_000
# Lists that a member names, for others to know where it meets them.
NAMED = 16
# 64-bit words of a set's parity bitmap: bit i tells whether an odd number of
# its shingles have tokens equal to i, modulo the bitmap's size.
WORDS = 8
BITMAP = [f"bits_{i}" for i in range(WORDS)]


def shingles(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> set[bytes]:
    """Distinct word shingles, A-Z lower-cased; the whole sequence if it is shorter."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return set()
    joined, k = b" ".join(words), words_per_shingle
    if len(words) <= k:
        return {joined}
    begins = list(accumulate((len(w) + 1 for w in words), initial=0))
    return {joined[a:b - 1] for a, b in zip(begins, begins[k:])}


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of sizes ``s`` and ``t``."""
    return -(-percent * (s + t) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Elements of a set, first in a common order, that hold one of any linked set's."""
    return n - -(-percent * n // 100) + 1


def indexed(n: int, percent: int = PERCENT) -> int:
    return min(n, max(FULL, 2 * prefix(n, percent)))


@cache
def dropped(n: int, percent: int = PERCENT) -> int:
    """How many of its indexed tokens a set of size ``n`` may leave out.

    Linked sets A and B share at least ``min(e(A), e(B)) + 1`` indexed tokens,
    e being the tokens indexed beyond the prefix; so the rarest of those stays
    in both if neither drops more than the least e of any size it may link to.
    Where all such sizes are indexed whole, the plain prefix is enough.
    """
    least, most = -(-percent * n // 100), 100 * n // percent
    if most <= FULL:
        return n - prefix(n, percent)
    t = np.arange(least, most + 1)
    p = t - -(-percent * t // 100) + 1
    return int((np.minimum(t, np.maximum(FULL, 2 * p)) - p).min())


def _setter(words_per_shingle: int, percent: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 33, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, ns, digests, tokens, bits, kept = utf8(batch.column(1)), [], [], [], [], []
                for i, text in enumerate(texts):
                    own = shingles(text, words_per_shingle)
                    n = len(own)
                    digest = hashlib.blake2b(b"\n".join(sorted(own)), digest_size=16).digest() if n else None
                    ns.append(n)
                    digests.append(digest)
                    if not n or digest in seen:
                        tokens.append(None)
                        bits.append(None)
                        kept.append(None)
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    hashes = np.sort(np.array([xxhash.xxh3_64_intdigest(s) for s in own], np.uint64).view(np.int64))
                    tokens.append(hashes[:indexed(n, percent)])
                    odd = (np.bincount(hashes & (64 * WORDS - 1), minlength=64 * WORDS) & 1).astype(np.uint8)
                    bits.append(np.packbits(odd).view(np.int64))
                    kept.append(text)
                rows = np.arange(row, row + len(texts))
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), batch.column(0), pa.array(ns, pa.int32()),
                     pa.array([dropped(n, percent) if n else 0 for n in ns], pa.int32()), pa.array(digests, pa.binary()),
                     pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    ["row", "doc_id", "size", "drop", "digest", "tokens", "bits", "text"])
    return sets


SETS = "row long, doc_id long, size int, drop int, digest binary, tokens array<long>, bits array<long>, text binary"


def subset_sizes(n: int, below: int, percent: int = PERCENT) -> list[int]:
    """Subset sizes under which a set of size ``n`` can meet other sets smaller than ``below``."""
    least, most = -(-percent * n // 100), min(100 * n // percent, below - 1)
    return sorted({c for t in range(least, most + 1) if (c := overlap(n, t, percent)) <= min(n, t)})


def boundary(costs: list, percent: int = PERCENT) -> int:
    """Size from which scanning lists costs less than enumerating subsets:
    ``costs`` has (size, shared tokens, sets, list entries)."""
    def light(below: int) -> int:
        return sum(r["sets"] * sum(math.comb(r["shared"], c) for c in subset_sizes(r["size"], below, percent)) for r in costs if r["size"] < below)

    def heavy(from_size: int) -> int:
        return sum(r["entries"] for r in costs if r["size"] >= from_size)

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (light(x) + heavy(x), x))


def _subset_keys(below: int, percent: int):
    def keys(batches):
        for batch in batches:
            for r in rows_of(batch):
                tokens, out = sorted(r["tokens"]), []
                for c in subset_sizes(r["size"], below, percent):
                    for chosen in combinations(tokens, c):
                        out.append(xxhash.xxh3_64_intdigest(np.array([c, *chosen], np.int64).tobytes()) - 2 ** 63)
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([r["rep"]] * n, pa.int64()),
                                                  pa.array([r["size"]] * n, pa.int32())], ["list", "rep", "size"])
    return keys


def _linkable(s, t, percent: int):
    return (percent * F.greatest(s, t) <= 100 * F.least(s, t))


def _open(percent: int, of: str = "{}_b"):
    """Whether the bounds leave open that two sets link; the other's columns are named by ``of``."""
    s, t = F.col("size"), F.col(of.format("size"))
    most = F.least(s - F.col("own"), t - F.col(of.format("own")))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(of.format(c)))) for c in BITMAP), F.lit(0))
    # shared >= least <=> sets differ in at most s + t - 2 * least shingles
    least = F.ceil(percent * (s + t) / (100.0 + percent) - 1e-9)
    return _linkable(s, t, percent) & (most >= least) & (differ <= s + t - 2 * least)


def _first_pairs(lists: DataFrame, order: list[str], fits) -> DataFrame:
    """(a, b): every member of a list with the list's first by ``order``."""
    others = [c for c in lists.columns if c not in ("list", *order)]
    firsts = lists.groupBy("list").agg(F.count("*").alias("n"), F.min(F.struct(*order, *others)).alias("first")).where("n > 1")
    met = totals_of(lists, firsts, "list", ["first"], "inner").where("first.rep <> rep")
    return met.where(fits).select(F.least("first.rep", "rep").alias("a"), F.greatest("first.rep", "rep").alias("b")).distinct()


def _list_number(token):
    """32 bits of a token; tokens that agree in them have one list, which only adds pairs to rule out."""
    return (token.bitwiseAND(0xFFFFFFFF) - F.lit(1 << 31)).cast("int")


def _meetings(known: DataFrame, roots: DataFrame, below: int, percent: int) -> DataFrame:
    """(a, b): sets of different components that share a list and may link, one
    of them of size ``below`` or more.  A pair that names a list in common is one
    row, from the least such list; others are a row for every list they share."""
    numbers = F.array_sort(F.array_distinct(F.transform("listed", lambda t: _list_number(t["token"]))))
    placed = known.where(F.col("size") >= math.ceil(percent * below / 100)) \
        .join(roots, known["rep"] == roots["node"], "left") \
        .withColumn("numbers", numbers) \
        .select(F.explode("numbers").alias("list"), "rep", "size", "own", *BITMAP, F.coalesce("root", "rep").alias("root"),
                F.slice("numbers", 1, NAMED).alias("named"))
    mixed = placed.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list")
    placed = write_table(placed.join(mixed, "list"), "jaccard-placed")
    other = placed.select("list", *[F.col(c).alias(f"{c}_b") for c in placed.columns if c != "list"])
    heavy = F.greatest(F.col("size"), F.col("size_b")) >= below
    here = F.coalesce(F.array_min(F.array_intersect("named", "named_b")), F.col("list")) == F.col("list")
    return placed.join(other, "list").where((F.col("root") < F.col("root_b")) & heavy & _open(percent) & here) \
        .select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"))


def _verifier(words_per_shingle: int, percent: int):
    def verify(batches):
        of, own = None, set()
        for batch in batches:
            a, b = [], []
            for r in rows_of(batch, 64):
                if r["b"] is None:
                    of, own = r["a"], shingles(r["text"], words_per_shingle)
                    continue
                assert of == r["a"]
                other = shingles(r["text"], words_per_shingle)
                shared = len(own & other)
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    a.append(of)
                    b.append(r["b"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return verify


def verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by the shingles of both texts.

    Partners meet a's text in parts of bounded size, however many there are.
    """
    n = pairs.count()
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(max(1, -(-n // PAIRS_PER_PART)))))
    needed = write_table(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row"), "jaccard-texts")
    own = dealt.select("a", "part").distinct().join(needed.withColumnRenamed("row", "a"), "a") \
        .select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(needed.withColumnRenamed("row", "b"), "b").select("a", "part", "b", "text")
    shuffled = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return shuffled.mapInArrow(_verifier(words_per_shingle, percent), "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS,
         percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles (distinct shingles) and
    component_id, the smallest doc_id that links reach.

    Two texts link if their intersection is at least ``percent`` hundredths of
    their union.  A text that is null or without words has no shingles, is
    linked with nothing (its like included) and is its own component.  Repeated
    rows come back as often as they came in and link like any other.  A row
    without a doc_id belongs to its component, which is null if no doc_id is in
    it.  An empty table gives no rows.  ``percent`` is 51 to 100.
    """
    if not 51 <= percent <= 100:
        raise ValueError("percent must be 51 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = write_table(rows.mapInArrow(_setter(words_per_shingle, percent), SETS), "jaccard-sets", codec="zstd")
    # equal sets are one: its row is the first that has them
    reps = write_table(sets.where("digest is not null").groupBy("digest").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "jaccard-distinct")

    posted = sets.where("tokens is not null").select("row", F.explode("tokens").alias("token"))
    shared = write_table(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("df", F.col("n")), "jaccard-shared")
    # a row's shared tokens, rarest first; it lists all but the `drop` last, and drops out if that leaves none
    found = write_table(totals_of(posted, shared, "token", ["df"], "inner").groupBy("row")
                        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")), "jaccard-found", codec="zstd")
    sized = sets.where("tokens is not null").join(reps.select("digest", "rep"), "digest") \
        .select("row", "rep", "size", "drop", F.size("tokens").alias("indexed"), *[F.get("bits", F.lit(i)).alias(c) for i, c in enumerate(BITMAP)])
    known = write_table(found.join(sized, "row").where(F.size("shared") > F.col("drop")).select(
        "rep", "size", (F.col("indexed") - F.size("shared")).alias("own"), *BITMAP, F.slice("shared", F.lit(1), F.size("shared") - F.col("drop")).alias("listed"),
        F.when(F.col("size") < LARGEST_LIGHT, F.col("shared.token")).alias("tokens")).dropDuplicates(["rep"]), "jaccard-known")
    entries = F.aggregate("listed", F.lit(0).cast("long"), lambda n, t: n + t["df"])
    costs = known.where(F.col("size") < LARGEST_LIGHT).groupBy("size", F.size("tokens").alias("shared")) \
        .agg(F.count("*").alias("sets"), F.sum(entries).alias("entries")).collect()  # at most LARGEST_LIGHT squared rows
    below = boundary(costs, percent)

    subsets = write_table(known.where(F.col("size") < below).select("rep", "size", "tokens")
                          .mapInArrow(_subset_keys(below, percent), "list long, rep long, size int"), "jaccard-subsets")
    # lists by size class: sets two classes apart never link
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / percent) if percent < 100 else 1.0)).cast("int")
    lists = write_table(known.where(F.col("size") >= math.ceil(percent * below / 100))
                        .select(F.explode("listed.token").alias("token"), "rep", "size", "own", *BITMAP), "jaccard-lists")
    by_class = lists.select(F.xxhash64("token", level).alias("list"), "rep", "size", "own", *BITMAP)
    from_subsets = _first_pairs(subsets, ["size", "rep"], _linkable(F.col("size"), F.col("first.size"), percent))
    from_lists = _first_pairs(by_class, ["own", "size", "rep"], _open(percent, "first.{}"))
    first = write_table(from_subsets.unionByName(from_lists).distinct(), "jaccard-first")
    texts = sets.where("text is not null").select("row", "text")
    links = write_table(verified(first, texts, words_per_shingle, percent), "jaccard-links")
    roots = write_table(connected_components(links, "jaccard", links.count()), "jaccard-roots")

    # pairs that share a list and are not joined yet
    rest = _meetings(known, roots, below, percent).distinct()
    rest = write_table(rest.join(first, ["a", "b"], "left_anti"), "jaccard-rest")
    more = write_table(verified(rest, texts, words_per_shingle, percent), "jaccard-more")
    if not more.isEmpty():
        every = write_table(links.unionByName(more), "jaccard-every")
        roots = write_table(connected_components(every, "jaccard", every.count()), "jaccard-roots")

    rooted = write_table(reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "least", "n", F.coalesce("root", "rep").alias("root")), "jaccard-rooted")
    by_root = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    lookup = write_table(totals_of(rooted, by_root, "root", ["component_id"]).select("digest", "n", "component_id"), "jaccard-lookup")
    placed_rows = totals_of(sets.select("doc_id", "size", "digest"), lookup.where("digest is not null"), "digest", ["component_id"])
    return placed_rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"),
                              F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
