import hashlib
from collections import Counter

import pytest

from equitally.llm.repeats import remove_repeats


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + window] for t in data for i in range(len(t) - window + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("in_task", [8000, 0])
def test_equals_brute_force(make_docs, rng, in_task):
    """``in_task`` 0 spreads every first digit window by window."""
    from texts import WORDS
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(30))
    texts = [None, "", "short", passage, passage, "ab" * 60, "a" * 100, "b" + "a" * 99, passage[:90], passage[20:120]]
    for i in range(40):
        s = " ".join(rng.choice(WORDS) + str(rng.randint(0, 10 ** 6)) for _ in range(rng.randint(1, 40)))
        at = rng.randint(0, len(s))
        cut = passage[rng.randint(0, 80):][:rng.randint(20, 160)]
        texts.append(s[:at] + cut + s[at:] + ("é" * 25 if i % 5 == 0 else ""))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, passage), (None, passage), (None, None)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in
           remove_repeats(make_docs(rows), window=40, digit=12, contexts_in_task=in_task).collect()]
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 40))]
    by = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=by) == sorted(want, key=by)


def test_production_window_on_long_repeats(make_docs, rng, awkward):
    rows = awkward + [(20, "x" + awkward[10][1][1000:60_000] + "y")]
    got = Counter((r.n_bytes, r.n_removed, r.kept_sha256) for r in remove_repeats(make_docs(rows)).collect())
    assert got == Counter((b[0], b[1], b[3]) for b in brute([t for _, t in rows], 400))


@pytest.mark.parametrize("in_task", [8000, 0])
def test_texts_with_equal_polynomial_hashes_differ(make_docs, in_task):
    """Two choices of characters by the parity of a position's one bits have
    the same polynomial hash modulo 2 ** 64 for any base."""
    def parts(x, y):
        return "".join(chr(y if i.bit_count() % 2 else x) for i in range(256))
    middle = "qwhjzbwbymrqt jqiwbgdm  dgkiylggvktngpau tcnzpgnhfnxrrrwcqradklfeszdjugxaslnyntr yzntwlxkjphl dtpjfp"
    texts = [parts(73, 88) + middle + parts(33, 78), parts(88, 73) + middle + parts(78, 33)]
    rows = list(enumerate(texts)) + [(2, "z" + texts[0][:500]), (3, texts[1][80:])]
    for some in (rows[:2], rows):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256)
               for r in remove_repeats(make_docs(some), contexts_in_task=in_task).collect()}
        assert got == dict(enumerate(brute([t for _, t in some], 400)))


def test_copies_of_a_row_bring_their_spans_once(make_docs, rng):
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    got = remove_repeats(make_docs([(1, text)] * 50 + [(2, text[:600] + "!")]))
    assert Counter((r.doc_id, r.n_removed, len(r.removed)) for r in got.collect()) == {(1, 900, 1): 50, (2, 600, 1): 1}


def test_windows_are_ordered_by_bytes_when_all_keys_agree(rng):
    import numpy as np

    from equitally.llm.repeats import repeated_windows
    for window in (3, 8, 21, 40):
        data = np.array([rng.choice(b"ab") for _ in range(400)] + [97] * 60, np.uint8)
        start = np.arange(len(data) - window + 1)
        seen = Counter(data[i:i + window].tobytes() for i in start)
        want = [seen[data[i:i + window].tobytes()] > 1 for i in start]
        assert repeated_windows(data, start, np.zeros(len(start), np.uint64), window).tolist() == want


def test_segments_of_very_long_texts(make_docs, rng, monkeypatch):
    import equitally.llm.repeats as R
    monkeypatch.setattr(R, "SEGMENT", 300)
    texts = ["".join(rng.choice("abcd") for _ in range(2000)) for _ in range(3)]
    texts.append(texts[0][150:900] + texts[1][500:1700])
    found = []
    for parts in R.segments([t.encode() for t in texts], 40):
        own, a, lo, hi, _, _ = R.places(parts, 40, 12)
        for o, p, q in zip(own, lo, hi):
            found += [(parts[o][0], parts[o][1] + i) for i in range(p, q + 1)]
    assert sorted(found) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)]


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
