import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from equitally.llm import alignment
from equitally.llm.alignment import align
from equitally.llm.tokens import byte_characters
from texts import prose


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_tokens(models, text):
    """Ids and byte ends by the libraries, one whole text at a time."""
    if not text:
        return None
    a, b = models
    byte_of = byte_characters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return None
    ends = lambda raw: [sum(map(len, raw[:i + 1])) for i in range(len(raw))]
    return ids_a, ends(raw_a), ids_b, ends(raw_b)


def brute(models, rows):
    links, out = [], []
    for _, text, *_ in rows:
        t = brute_tokens(models, text)
        if t is None:
            links.append(([], None, 0, 0))
            continue
        ids_a, ends_a, ids_b, ends_b = t
        cut = sorted(set(ends_a) & set(ends_b))
        last, groups = 0, []
        for c in cut:
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if last < e <= c) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b) if last < e <= c))
            last = c
        own = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
        links.append((own, groups, len(ids_a), len(ids_b)))
    count = Counter(p for own, *_ in links for p in own)
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    for (doc_id, *_), (own, groups, n_a, n_b) in zip(rows, links):
        out.append((doc_id, n_a, n_b, len(groups or []), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    docs = Counter(p for own, *_ in links for p in set(own))
    return out, {p: (docs[p], n, n == best[p[1]]) for p, n in count.items()}


ODD = ["a  b", " lead", "trail ", "two\n\nlines", "tab\tx \n y", "don't 's I'LL", "x y 　z", "\x1c a", "<s> </s> <|endoftext|> <0x41>",
       "▁a ▁", "ﬁné", "日本語 テキスト", "\U0001f600 ok", "12 345,6", "\n", " ", "a\n b", "a \nb", "​q", "nul\x00l"]


def rows_of(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_alignment_equals_brute_force(make_docs, rng, models):
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (90, None), (91, ""), (None, None), (92, "word " * 700)]
    documents, pairs = align(make_docs(rows).repartition(3))
    want, want_pairs = brute(models, rows)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows_of(documents), key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): (r.n_docs, r["count"], r.best) for r in pairs.collect()} == want_pairs


def test_small_blocks_and_dense_containers_change_nothing(make_docs, rng, models, monkeypatch):
    """Blocks that end after a few links, and bitmaps instead of lists."""
    rows = [(i, prose(rng, 20)) for i in range(40)]
    want, _ = brute(models, rows)
    for name, value in (("BLOCK_LINKS", 100), ("DENSE", 0)):
        monkeypatch.setattr(alignment, name, value)
    align_one = alignment.Aligner(*alignment.default_paths())
    monkeypatch.setattr(alignment, "aligner", lambda *_: align_one)
    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    made = pa.Table.from_batches(list(alignment._indexer("", "")(iter([batch])))).to_pylist()
    postings = [r for r in made if r["pair"] is not None]
    assert len({r["block"] for r in postings}) > 3
    count = Counter()
    for r in postings:
        count[r["pair"]] += r["n"] << r["plane"]
    place = {(r["block"], r["slot"]): r["doc_id"] for r in made if r["pair"] is None}
    total = Counter()
    for r in postings:
        for s in alignment.slots_of(r["slots"], r["n"]).tolist():
            total[place[r["block"], s]] += count[r["pair"]] << r["plane"]
    assert dict(total) == {w[0]: w[6] for w in want}


def test_unknown_segments_share_calls_of_the_tokenizers(rng, models, monkeypatch):
    """Among them some that B does not spell, and all white space that may
    begin or end a text."""
    texts = [prose(rng, 40) + f" {i}q{i}\n{i}z" for i in range(300)] + ODD + [t + "x" for t in ODD] + [None, "", "ﬁ a", "b\nﬁ"]
    aligner = alignment.Aligner(*alignment.default_paths())
    calls, encode = [], aligner.b.encode
    monkeypatch.setattr(aligner, "b", type("B", (), {"encode": lambda _, text: calls.append(text) or encode(text)})())
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    raws = [(t or "").encode() for t in texts]
    found = aligner(raws[:300])
    assert len(calls) <= 4
    found += aligner(raws[300:])
    assert found + aligner(raws) == 2 * found
    for text, got in zip(texts, found):
        want = brute_tokens(models, text)
        assert (got is None) == (want is None)
        if got is not None:
            ids_a, ends_a, ids_b, ends_b = want
            links = [x << alignment.B_BITS | y for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
            assert got[0] == b"".join(x.to_bytes(8, "little") for x in links) and got[2:] == (len(ids_a), len(ids_b), len(links))
            assert [tuple(side.split(",") for side in g.split("|")) for g in got[1].split(";")][0][0][0] == str(ids_a[0])
            assert got[1].replace("|", ",").replace(";", ",").count(",") + 1 == len(ids_a) + len(ids_b)


def test_empty_table(make_docs):
    documents, pairs = align(make_docs([]))
    assert documents.collect() == [] and pairs.collect() == []
