import random

from equitally.llm.decontaminate import Items, contaminated, normal, pieces


def distance_row(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row


def test_pieces_cover_the_item():
    item = "abcdefghijklmnopqrstuvw"
    assert "".join(p for _, p in pieces(item, 4)) == item and len(pieces(item, 4)) == 5
    assert all(item[o:o + len(p)] == p for o, p in pieces(item, 4))


def test_matches_equal_dynamic_programming(rng):
    r = random.Random(5)
    items = [(i, "".join(r.choice("abc de") for _ in range(r.randint(15, 90)))) for i in range(12)]
    items = [(i, normal(t)) for i, t in items if normal(t)]
    known = Items(items)
    for _ in range(150):
        i, t = r.choice(items)
        made = list(t)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(made))
            made[at:at + r.randint(0, 1)] = r.choice(["", "x", "ab"])
        text = normal("".join(r.choice("abcde f") for _ in range(40)) + "".join(made) + "".join(r.choice("abcde f") for _ in range(30)))
        got = {m[0]: m[1:] for m in known.matches(text)}
        for j, item in items:
            row = distance_row(item, text)
            best = min(row)
            if best <= int(0.05 * len(item)):
                d, start, end = got[j]
                assert (d, end) == (best, row.index(best)) and distance_row(item, text[start:end])[-1] == d
            else:
                assert j not in got


def test_table(spark, make_docs, awkward, rng):
    from texts import prose
    item = prose(rng, 40)
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, prose(rng, 50), "x"), (None, "zebra quagga okapi lion", "x"), (1, item, "x")],
                                  "item_id long, text string, doc_id string")
    edited = item.upper().replace(" ", "\n  ", 3)[:-1] + "#"
    docs = make_docs(awkward + [(50, "a b " + item + " c d"), (51, "z " + edited + " q"), (None, item), (52, item[: len(item) // 2]), (53, "a zebra quagga okapi lions")])
    for settings in ({}, {"block_chars": 150}):
        got = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, bench, **settings).collect()), key=str)
        assert got == sorted([(50, 1, 0), (50, 1, 0), (51, 1, 1), (51, 1, 1), (None, 1, 0), (None, 1, 0), (53, None, 0)], key=str)
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
