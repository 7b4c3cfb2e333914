import random
import re

import pytest

from equitally.llm import jaccard
from equitally.llm.jaccard import boundary, dropped, indexed, join, overlap, prefix, subset_sizes
from texts import prose


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)])


def brute(rows):
    sets = [brute_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, *_), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return [(r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group)]


def run(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join(df).collect()), key=key)


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10 ** 6))
    return " ".join(words)


def family(rng, start, size, words, edits):
    base = " ".join("w" + str(rng.randrange(400)) for _ in range(words))
    return [(start + i, changed(rng, base, rng.randint(0, edits))) for i in range(size)]


def same(rows, make_docs, parts=5):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert run(make_docs(rows).repartition(parts)) == sorted(brute(rows), key=key)


def test_components_equal_brute_force(make_docs, awkward):
    rng = random.Random(11)
    rows = list(awkward) + [(900, "a b"), (901, "A  b"), (902, "a b c d"), (903, "a b c d a b c d")]
    for f, (words, edits) in enumerate([(10, 1), (14, 1), (25, 2), (25, 4), (40, 2), (60, 3), (130, 6), (160, 8), (300, 12), (700, 30)]):
        rows += family(rng, 1000 + 100 * f, 14, words, edits)
    passage = " ".join("p" + str(i) for i in range(60))
    rows += [(5000 + i, prose(rng, rng.randint(5, 90)) + " " + passage) for i in range(60)]
    # variants that link through their base alone
    base = ["v" + str(i) for i in range(53)]
    rows += [(6000 + i, " ".join(base[:i] + [f"y{i}"] + base[i + 1:])) for i in range(5, 45, 5)] + [(6999, " ".join(base))]
    rng.shuffle(rows)
    same(rows, make_docs)


@pytest.mark.parametrize("below", [0, 20])
def test_boundary_moves_work_not_results(make_docs, monkeypatch, below):
    rng = random.Random(12)
    monkeypatch.setattr(jaccard, "boundary", lambda *_: below)
    rows = []
    for f, words in enumerate([9, 11, 14, 16, 17, 18, 20, 22, 24]):
        rows += family(rng, 100 * f, 10, words, 2)
        rows += [(100 * f + 50 + i, t + " " + " ".join("e" + str(k) for k in range(i))) for i, (_, t) in enumerate(rows[-4:])]
    same(rows, make_docs, 3)


def test_tables_of_copies_and_of_nothing(make_docs):
    same([], make_docs)
    same([(None, None), (1, ""), (1, " \n"), (2, None)], make_docs)
    same([(i % 3, "the same few words again and again") for i in range(40)], make_docs)


def test_sizes():
    linked = lambda s, t, o: 100 * o >= 85 * (s + t - o)
    for s in range(1, 90):
        for t in range(s, 90):
            o = overlap(s, t)
            assert linked(s, t, o) and not linked(s, t, o - 1)
            if o <= s:
                assert s - o + 1 <= prefix(s) and t - o + 1 <= prefix(t)
                if t < 40:
                    assert o in subset_sizes(s, 40) and o in subset_sizes(t, 40)
    for n in [*range(1, 400), 1000, 5000, 20000]:
        assert 0 <= dropped(n) <= indexed(n) - prefix(n)
        for t in range(-(-85 * n // 100), 100 * n // 85 + 1, max(1, n // 50)):
            if max(n, t) > jaccard.FULL:
                assert dropped(n) <= indexed(t) - prefix(t)


def test_boundary_takes_the_cheaper_side():
    row = lambda size, shared, sets, entries: {"size": size, "shared": shared, "sets": sets, "entries": entries}
    assert boundary([row(10, 10, 100, 10 ** 6)]) > 10
    assert boundary([row(30, 30, 100, 300)]) <= 30


def test_near_copies_that_do_not_link_meet_once(make_docs, monkeypatch):
    """Texts of a family share hundreds of lists; meeting in each made as many rows a pair."""
    rng = random.Random(14)
    base = ["w" + str(i) for i in range(1500)]
    rows = []
    for i in range(12):  # each half of the family misses other words, by two and two, so that own shingles are few
        gone = set(random.Random(i // 2).sample(range(1500), 45))
        words = [w for k, w in enumerate(base) if k not in gone]
        words[rng.randrange(700)] = "x" + str(i)
        rows.append((i, " ".join(words)))
    made, real = [], jaccard._meetings

    def meetings(*args):
        made.append(real(*args).localCheckpoint())
        return made[-1]

    monkeypatch.setattr(jaccard, "_meetings", meetings)
    results = []
    for named in (jaccard.NAMED, 1, 0):  # with none named, a pair meets in every list it shares
        monkeypatch.setattr(jaccard, "NAMED", named)
        results.append(run(make_docs(rows).repartition(3)))
    assert results == [sorted(brute(rows))] * 3
    counts = [m.count() for m in made]
    pairs = [m.distinct().count() for m in made]
    assert pairs[0] == pairs[1] == pairs[2] > 0
    assert counts[2] > 20 * pairs[2]
    assert counts[0] <= 3 * pairs[0]


def test_lists_that_agree_in_32_bits_lose_no_pair(make_docs, monkeypatch):
    rng = random.Random(15)
    rows = [r for f in range(4) for r in family(rng, 100 * f, 10, 160, 9)]
    monkeypatch.setattr(jaccard, "_list_number", lambda t: t.bitwiseAND(15).cast("int"))
    same(rows, make_docs, 3)
