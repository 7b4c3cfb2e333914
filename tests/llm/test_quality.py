import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from equitally.llm.quality import classify, ngrams, normal, perplexities


class Brute:
    """Interpolated modified Kneser-Ney over bytes, from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.tables = order, {}
        grams = Counter()
        for t in texts:
            t = bytes(order - 1) + t
            grams.update(t[i:i + order] for i in range(len(t) - order + 1))
        self.tables[order] = grams
        for k in range(order - 1, 0, -1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, table in self.tables.items():
            n = Counter(min(c, 5) for c in table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.discounts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else i / 2, 0.05), i) for i in (1, 2, 3)]
            self.contexts[k] = defaultdict(lambda: [0, 0.0])
            for g, c in table.items():
                at = self.contexts[k][g[:-1]]
                at[0] += c
                at[1] += self.discounts[k][min(c, 3)]

    def p(self, gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        low = self.p(gram[1:])
        if gram[:-1] not in self.contexts[k]:
            return low
        s, held = self.contexts[k][gram[:-1]]
        c = self.tables[k].get(gram, 0)
        return (c - self.discounts[k][min(c, 3)] if c else 0) / s + held / s * low

    def log_p(self, text):
        padded = bytes(self.order - 1) + text
        return sum(math.log(self.p(padded[i:i + self.order])) for i in range(len(text)))


def test_ngrams_end_at_every_byte():
    got = ngrams([b"abc", b"", b"xy"], 3)
    want = [int.from_bytes(g, "big") for g in (b"\0\0a", b"\0ab", b"abc", b"\0\0x", b"\0xy")]
    assert got.tolist() == want


@pytest.mark.parametrize("block_bytes", [32_000_000, 3000])
def test_log_probabilities_equal_brute_force(spark, make_docs, rng, awkward, block_bytes):
    from texts import prose
    rows = [(100 + i, prose(rng, rng.randint(3, 60)), ["en", "fr", None][i % 3]) for i in range(120)] + \
        [r for r in awkward if len(r[1] or "") < 60_000] + [(500, "| # | # | !!" * 20, "en"), (501, "nur hier", "xx")]
    labels = spark.createDataFrame([(100 + i, 1 if i % 4 else 0, "x") for i in range(90)] + [(None, 1, "x"), (103, None, "x"), (101, 0, "x"), (9999, 1, "x")],
                                   "doc_id long, quality int, lang string")
    got = perplexities(make_docs(rows), labels, order=3, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t, *lang in rows:
        text[i, (lang[0] or "") if lang else "en"].append(normal((t or "").encode()))
    models = {lang: Brute([x for r in got if r.trusted and not r.held_out and r.lang == lang for x in text[r.id, lang]], 3)
              for lang in {r.lang for r in got}}
    assert {r.id for r in got if r.trusted} == {100 + i for i in range(90) if i % 4 and i != 1}
    for r in got:
        if len(text[r.id, r.lang]) == 1 and len(text[r.id, r.lang][0]) < 9000:
            want = models[r.lang].log_p(text[r.id, r.lang][0])
            assert abs(r.log_p - want) <= 1e-4 * max(1, abs(want)), r


def kept_shares(docs, labels):
    """(quality, toxic) -> share kept."""
    marked = labels.select("doc_id", "quality", "toxic").join(classify(docs, labels), "doc_id")
    return {(r.quality, r.toxic): r.k for r in marked.selectExpr("quality", "toxic", "cast(keep as int) k")
            .groupBy("quality", "toxic").avg("k").toDF("quality", "toxic", "k").collect()}


def test_trusted_is_never_toxic(spark, make_docs, rng):
    from texts import prose
    docs = make_docs([(i, prose(rng, 20)) for i in range(8)])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, None), (3, 1, 0), (3, 1, 1), (4, None, 1), (5, 1, 0), (5, 1, 0), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = perplexities(docs, labels, order=3).collect()
    assert len(got) == 8 and {r.id for r in got if r.trusted} == {0, 2, 5}


def test_junk_goes_and_clean_text_stays(spark):
    import os
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(os.path.join(sf, f"{t}.parquet")) for t in ("documents", "labels"))
    kept = kept_shares(docs, labels)
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.25


def test_less_junk_passes_the_larger_table(spark):
    """At 0.995 14 % of the junk passed."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = kept_shares(docs, labels)
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.08
    assert kept[1, 1] < 0.9  # clean-looking, but labelled toxic and so not trusted


def test_without_labels_or_rows(spark, make_docs, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [r for r in awkward if len(r[1] or "") < 60_000]
    got = classify(make_docs(rows), labels).collect()
    assert len(got) == len(rows)
    assert all(r.keep == bool((r.n_bytes or 0) > 0) for r in got)
    assert classify(make_docs([]), labels).count() == 0
