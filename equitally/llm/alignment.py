"""Alignment of two tokenizers' ids through inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A) and by a piece model (B).  Where
tokens of both end at the same byte, the two tokens are linked and a group of
tokens ends.  Links go into an inverted index: for every pair of ids, the
documents that hold it as a compressed bitmap, and how often as multiplicity
planes: plane k has the documents in whose count bit k is set.  Documents are
numbered within blocks, so a pair has one container a block and plane: a sorted
list of slots, or a bitmap if that is shorter.  A pair's document bitmap is the
OR of its planes and its popcount the document count; the popcounts of the
planes, weighted by their powers of two, make the corpus-wide link count.  The
containers are at the same time the postings through which counts return to
the documents.

No text crosses a shuffle: containers do, once by pair and once by block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equitally.llm.common import spread, utf8, write_table
from equitally.llm.tokens import byte_characters

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
# A block also ends once it holds so many links.
BLOCK_LINKS = 4_000_000
# A container with more slots than this is shorter as a bitmap.
DENSE = SLOTS // 16
B_BITS = 20
# Segments of text remembered in a worker, and their greatest length.
REMEMBERED, LONGEST = 150_000, 64
# Segments that are not remembered and go through the tokenizers in one text.
JOINED = 2_000
# Both tokenizers end a token here: before a single space or line feed between
# characters that are no white space.
SEGMENTS = re.compile(r"(?<=\S)(?=[ \n]\S)")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Tokens, groups and links of texts under the two tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of = byte_characters()
        ranks = {}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
                ranks[self.a_bytes[i]] = i
        import public_tokenizers

        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        self.b_bytes = [b""] * size
        for i in range(size):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[3:-1], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.b_bytes[i] = piece.replace("▁", " ").encode()
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        # what ``_segment`` gives; () for None
        self.known: dict[str, tuple] = {}

    def _aligned(self, whole: bytes, a: list[int], b: list[int]) -> tuple | None:
        """(links, groups as text, n_a, n_b, n_groups); None if the tokens are
        not the text's bytes.  No token is empty then, so a byte at which both
        end has one token of each: a group and its one link."""
        parts_a, parts_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole or b"" in parts_b:
            return None
        text, links, i, j = [], [], 0, 0
        at_a = at_b = from_i = from_j = 0
        while i < len(a):
            if at_a <= at_b:
                at_a += len(parts_a[i])
                i += 1
            while at_b < at_a:
                at_b += len(parts_b[j])
                j += 1
            if at_a == at_b:
                links.append(a[i - 1] << B_BITS | b[j - 1])
                text.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                from_i, from_j = i, j
        return np.array(links, "<i8").tobytes(), ";".join(text), len(a), len(b), len(links)

    def _segment(self, piece: str) -> tuple | None:
        b = self.b.encode(piece[1:] if piece[0] == " " else piece)
        if piece[0] != " ":  # the library put a space before a line feed
            if not b or b[0] != self.space:
                return None
            b = b[1:]
        return self._aligned(piece.encode(), self.a.encode_ordinary(piece), b)

    def _together(self, pieces: list[str]) -> list[tuple]:
        """As ``_segment`` for segments that begin before a break, from one call
        of each tokenizer over all of them; () for None.  Segments whose tokens
        are not their bytes are parted from the others by sixteenths."""
        if len(pieces) == 1:
            return [self._segment(pieces[0]) or ()]
        raw = [piece.encode() for piece in pieces]
        text, whole = "a" + "".join(pieces), b" a" + b"".join(raw)
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        ids_a, ids_b = np.array(a), np.array(b)
        if b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]) and self.b_size[ids_b].all():
            ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
            next_b = np.searchsorted(ends_b, ends_a)
            at_a = np.flatnonzero(ends_b[next_b] == ends_a)
            at_b, both = next_b[at_a], ends_a[at_a]
            edges = np.cumsum([2, *map(len, raw)])
            upto = np.searchsorted(both, edges)
            if (both[upto] == edges).all():
                links = (ids_a[at_a] << B_BITS | ids_b[at_b]).astype("<i8").tobytes()
                i, j, upto = (at_a + 1).tolist(), (at_b + 1).tolist(), (upto + 1).tolist()
                name_a, name_b = list(map(str, a)), list(map(str, b))
                groups = [name_a[f] + "|" + name_b[g] if t - f == 1 == u - g else ",".join(name_a[f:t]) + "|" + ",".join(name_b[g:u])
                          for f, t, g, u in zip(i, i[1:], j, j[1:])]
                return [(links[8 * f:8 * t], ";".join(groups[f - 1:t - 1]), i[t - 1] - i[f - 1], j[t - 1] - j[f - 1], t - f)
                        for f, t in zip(upto, upto[1:])]
        step = -(-len(pieces) // 16)
        return [found for at in range(0, len(pieces), step) for found in self._together(pieces[at:at + step])]

    def _unknown(self, pieces: list[str]) -> dict[str, tuple]:
        """Segments that are not remembered yet; many of them share a call."""
        joint, out = [], {}
        for piece in pieces:
            # the first and the last of a text may touch other white space
            if piece[0] in " \n" and len(piece) > 1 and not piece[1].isspace() and not piece[-1].isspace():
                joint.append(piece)
            else:
                out[piece] = self._segment(piece) or ()
        for at in range(0, len(joint), JOINED):
            some = joint[at:at + JOINED]
            out.update(zip(some, self._together(some)))
        for piece, found in out.items():
            if len(self.known) >= REMEMBERED:
                break
            if len(piece) < LONGEST:
                self.known[piece] = found
        return out

    def __call__(self, raws: list[bytes]) -> list[tuple | None]:
        """As ``_aligned`` for a space and each text; None without tokens."""
        texts: list[str | None] = []
        for raw in raws:
            try:
                texts.append(" " + raw.decode() if raw else None)
            except UnicodeDecodeError:
                texts.append(None)
        split = [SEGMENTS.split(text) if text else [] for text in texts]
        get, fresh = self.known.get, {}
        held = [list(map(get, pieces)) for pieces in split]
        missing = {p: None for pieces, parts in zip(split, held) if None in parts for p, found in zip(pieces, parts) if found is None}
        if missing:
            fresh = self._unknown(list(missing))
        out = []
        for text, pieces, parts in zip(texts, split, held):
            if None in parts:
                parts = [fresh[p] if found is None else found for p, found in zip(pieces, parts)]
            if text is None:
                out.append(None)
            elif () in parts:  # judge the text as a whole
                out.append(self._aligned(text.encode(), self.a.encode_ordinary(text), self.b.encode(text[1:])))
            else:
                links, groups, n_a, n_b, n = zip(*parts)
                out.append((b"".join(links), ";".join(groups), sum(n_a), sum(n_b), sum(n)))
        return out


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    return Aligner(a_path, b_path)


DOC = "block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, plane int, n int, n_docs int, slots binary"
_NAMES = [c.split()[0] for c in f"{DOC}, {POSTING}".split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]
          for c in f"{DOC}, {POSTING}".split(", ")]


def _record(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def containers(block: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of a block from its links, each ``pair << SLOT_BITS | slot``."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(begins, len(keys)))
    pair, slot = keys[begins] >> SLOT_BITS, (keys[begins] & (SLOTS - 1)).astype("<u2")
    firsts = np.flatnonzero(np.diff(pair, prepend=-1))
    n_docs = dict(zip(pair[firsts].tolist(), np.diff(np.append(firsts, len(pair))).tolist()))  # popcounts of the planes' OR
    for plane in range(int(times.max()).bit_length() if len(times) else 0):
        inside = np.flatnonzero(times >> plane & 1)
        own, slots = pair[inside], slot[inside]
        start = np.flatnonzero(np.diff(own, prepend=-1))
        n = np.diff(np.append(start, len(own)))
        documents = [n_docs.pop(p, 0) for p in own[start].tolist()]  # on the pair's least plane alone
        data = []
        for s, k in zip(start.tolist(), n.tolist()):
            run = slots[s:s + k]
            data.append(run.tobytes() if k <= DENSE else bitmap(run))
        yield _record(len(start), block=np.full(len(start), block), pair=own[start], plane=np.full(len(start), plane),
                      n=n, n_docs=documents, slots=data)


def bitmap(slots: np.ndarray) -> bytes:
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def slots_of(data: bytes, n: int) -> np.ndarray:
    """Slots of a container with ``n`` of them."""
    if n <= DENSE:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def _indexer(a_path: str, b_path: str):
    def index(batches):
        align = aligner(a_path, b_path)
        block, slot, held, n_held = TaskContext.get().partitionId() << 31, 0, [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                docs = []
                for doc_id, found in zip(batch.column(0).to_pylist(), align(utf8(batch.column(1)))):
                    if slot == SLOTS or n_held >= BLOCK_LINKS:
                        yield from containers(block, np.concatenate(held) if held else np.zeros(0, np.int64))
                        block, slot, held, n_held = block + 1, 0, [], 0
                    if found is None:
                        docs.append((block, slot, doc_id, 0, 0, 0, 0, ""))
                    else:
                        links, groups, n_a, n_b, n = found
                        held.append(np.frombuffer(links, "<i8") << SLOT_BITS | slot)
                        n_held += n
                        docs.append((block, slot, doc_id, n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest()))
                    slot += 1
                if docs:
                    yield _record(len(docs), **dict(zip(_NAMES, zip(*docs))))
        if held:
            yield from containers(block, np.concatenate(held))
    return index


def pair_scores(postings: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, count, best): document and link counts of
    every pair of ids, and whether none of its B id's pairs has more links."""
    counted = postings.groupBy("pair").agg(
        F.sum("n_docs").alias("n_docs"), F.expr("sum(n * shiftleft(1L, plane))").alias("count"))
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # a B id has at most as many rows here as A has ids
    return counted.withColumn("b_id", b_id).withColumn("a_id", F.shiftright("pair", B_BITS)) \
        .withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def _returner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the documents of each block, from its postings in a row."""
    block, best, total = None, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def done():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), block), pa.int64()), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])],
            ["block", "slot", "n_best", "count_sum"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("block", "plane", "n", "count", "best")]
        for i, (of, plane, n, count, is_best) in enumerate(zip(*cols)):
            if of != block:
                if block is not None:
                    yield done()
                block, best[:], total[:] = of, 0, 0
            slots = slots_of(batch.column("slots")[i].as_py(), n)
            total[slots] += count << plane
            if is_best:
                best[slots] += 1 << plane
    if block is not None:
        yield done()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
          b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): one row per document with n_a, n_b, n_groups,
    n_links, n_best, count_sum and groups_sha256, and the table of
    ``pair_scores``.

    A text that is null, empty or no valid UTF-8, or whose tokens do not spell
    it, has no tokens: zeros, and an empty groups_sha256.  A null doc_id stays
    null; repeated rows count and come back as often as they came in; an empty
    table gives no rows.  Very long texts take memory in proportion to
    themselves.  The paths must name the files wherever a task runs.
    """
    paths = default_paths()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = write_table(rows.mapInArrow(_indexer(a_path or paths[0], b_path or paths[1]), f"{DOC}, {POSTING}"), "aligned")
    postings = index.where("pair is not null").select("block", "pair", "plane", "n", "n_docs", "slots")
    pairs = write_table(pair_scores(postings.select("pair", "plane", "n", "n_docs")), "pair-scores")
    scored = postings.join(pairs.select("pair", "count", "best"), "pair").select("block", "plane", "n", "slots", "count", "best")
    back = spread(scored, "block").sortWithinPartitions("block") \
        .mapInArrow(_returner, "block long, slot int, n_best long, count_sum long")
    documents = index.where("pair is null").select(*[c.split()[0] for c in DOC.split(", ")])
    out = documents.join(back, ["block", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return out, pairs
