import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from equitally.llm.packing import CapacityTree, best_fit, crc32_column, pack, padding, sequences
from equitally.llm.tokens import WordEncoder, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


def test_word_ids_equal_the_library(library, awkward, rng):
    encode = WordEncoder(default_path(), remembered=50)
    odd = ["ẞ ﬁ don't I'LL x'sy <|endoftext|> a<|endoftext|>b ÉÇé́ ΣΑΣ 12,3 naïve… q\x85z Ⅷ ªº straße İstanbul 'll. A.B ǅ ŉ ß."]
    alphabet = "aZé'sItld .,-1²İßǅ́ \x1c<|>\n中"
    odd += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(200)]
    for text in [*odd, *(t or "" for _, t, *_ in awkward if len(t or "") < 5000)]:
        assert encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_pieces_are_an_exact_round_trip(make_docs, awkward, library):
    rows = pack(make_docs(awkward), buffer_tokens=6000).withColumn("crc", crc32_column()).collect()
    assert all(r.crc == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) for r in rows)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t, *_ in awkward:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    for i, docs in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs))
        if len(docs) == 1:
            ids = b"".join(r.ids for r in sorted(by_doc[i], key=lambda r: r.start))
            assert np.frombuffer(ids, "<u4").tolist() == docs[0]
            assert {r.doc_tokens for r in by_doc[i]} == {len(docs[0])}
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_join_pieces(make_docs, awkward):
    pieces = pack(make_docs(awkward[:6]))
    assert {r.sequence_id: r.length for r in sequences(pieces).collect()} == {
        r.sequence_id: len(r.ids) // 4 for r in sequences(pieces).collect()}


def test_best_fit_takes_the_tightest_window():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 120))]
        number, offset, opened = best_fit(lengths, 64)
        room, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [c for c in room if c >= lengths[i]]
            if fits:
                room.remove(min(fits))
            left = (min(fits) if fits else 64) - lengths[i]
            room.append(left)
            want[i] = 64 - left - lengths[i]
        assert want == dict(enumerate(offset)) and opened == len(room)


def test_capacity_tree_finds_the_smallest_that_fits():
    tree = CapacityTree(10)
    for c in (3, 7, 10):
        tree.add(c, c)
    assert [tree.take(4), tree.take(4), tree.take(4), tree.take(1)] == [(7, 7), (10, 10), None, (3, 3)]


@pytest.mark.parametrize("split", [4, 211, 2000])
def test_padding_is_little_on_prose(spark, split):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(split)
    lengths = [r.n for r in pack(docs).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert padding(np.array(lengths)) < 0.01 * sum(lengths)


def test_empty_table(make_docs):
    assert pack(make_docs([])).count() == 0
