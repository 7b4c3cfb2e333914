"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by e = floor(share * m)
edits.  Cut into e + 1 pieces, at least one piece occurs unchanged in any such
passage.  An Aho-Corasick automaton finds every piece hit in a document in one
pass; the places that hits point to are verified with Myers' bit-parallel
distance, item by item.

Texts are compared lower-cased, white space folded to single spaces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import write_table

EDIT_SHARE = 0.05
#: Items are shipped to tasks in blocks of about this many characters; a
#: larger benchmark means more passes over the documents, never fewer items.
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one pattern, for approximate search in a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i

    def best_end(self, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the first best match that ends in ``text``, within
        the budget; ``anchored``: matches begin where the text begins."""
        m, masks = self.m, self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best = full, 0, m, None
        if score <= budget:
            best = (score, 0)
        for end, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up, down = minus | (full & ~(d0 | plus)), plus & d0
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & full
            down = (down << 1) & full
            if anchored:
                up |= 1
            plus, minus = down | (full & ~(d0 | up)), up & d0
            if score <= budget and (best is None or score < best[0]):
                best = (score, end)
                if not score:
                    break
        return best


class Items:
    """Automaton over all pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        posts: dict[str, list] = defaultdict(list)
        self.items = {}
        for number, (item_id, text) in enumerate(items):
            budget = int(share * len(text))
            self.items[number] = (item_id, text, budget, Pattern(text), Pattern(text[::-1]))
            for offset, piece in pieces(text, budget):
                posts[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in posts.items():
            self.automaton.add_word(piece, (len(piece), where))
        if posts:
            self.automaton.make_automaton()
        self.empty = not posts

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best place in a normalised text."""
        if self.empty:
            return
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                _, item, budget, *_ = self.items[number]
                at = last + 1 - length - offset
                lo, hi = max(0, at - budget), at + len(item) + budget
                spans = near[number]
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        for number, spans in near.items():
            item_id, item, budget, forward, backward = self.items[number]
            best = None
            for lo, hi in spans:
                found = forward.best_end(text[lo:hi], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                distance, end = best
                head = text[max(0, end - len(item) - budget):end][::-1]
                yield item_id, distance, end - backward.best_end(head, distance, anchored=True)[1], end


def _matcher(items: list[tuple[int, str]], share: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(items, share)
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in known.matches(normal(text))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "item_id", "distance", "start", "end"])
    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id,
    distance, and start and end of the item's best place (fewest edits, then
    first) in the normalised text.

    Null and empty documents hold nothing; null and empty items are in nothing.
    Items shorter than 1 / share characters match exactly only.  Documents with
    a null doc_id are reported under null; repeated documents and items are
    reported as often as they come.  Either table empty: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found = max(1, -(-chars // block_chars)), []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = [(r["item_id"], t) for r in own.collect() if (t := normal(r["text"]))]
        hits = rows.mapInArrow(_matcher(block, share), "doc_id long, item_id long, distance long, start long, end long")
        # of a larger benchmark the driver holds one block at a time
        found.append(hits if blocks == 1 else write_table(hits, "benchmark-hits"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
