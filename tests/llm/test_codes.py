import hashlib
import math
import random

import numpy as np
from pyspark.sql import types as T

from equitally.llm.codes import Cells, compress

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("error", T.StringType()),
                       T.StructField("n", T.LongType()), T.StructField("code", T.LongType())])


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in kept if len(v) == d]
    w = d // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((gap(cut(v, p), e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in ints:
                own.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            new = [[sum(c) // len(own[n]) for c in zip(*own[n])] if n in own else e for n, e in enumerate(books[p])]
            books[p] = new
    out, by_label = [], {}
    for i, v, lab in ints:
        hits = [nearest(v, p) for p in range(parts)]
        error = sum(h[0] for h in hits)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, lab, "".join(f"{h[1]:02x}" for h in hits), error))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda x: x if x < 2 ** 63 else None
    done = [(i, lab, code, fits(e), fits(by_label[lab]), sha) for i, lab, code, e in out]
    odd = [(i, lab, None, None, None, sha) for i, v, lab in kept if len(v) != d]
    return done + odd


def run(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA).repartition(3)
    return [(r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress(df).collect()]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 0), (500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 2),
             (503, [float("inf")] + [0.0] * 31, 2), (504, [0.1] * 5, 1), (505, [], None), (506, [0.0] * 32, 3), (507, [0.0] * 32, 3)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_large_components_and_few_rows(spark):
    rows = [(3, [1e6 * k for k in range(16)], 1), (1, [float(k) for k in range(16)], 1), (2, [-3e38] * 16, 2), (4, [1.0] * 16, 3)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows, entries=64), key=key)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1e12, -1e9, 0.5]) for _ in range(16)], i % 2) for i in range(90)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_grid_keeps_every_nearest_entry_and_drops_some():
    rng = np.random.default_rng(5)
    book = rng.integers(-60, 60, (64, 4))
    parts = rng.integers(-90, 90, (4000, 4))
    cells = Cells(book)
    entry, far = cells.nearest(parts)
    every = ((parts[:, None] - book) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (far == every.min(1)).all()
    assert cells.near_of(parts).sum() < 0.5 * every.size
    assert len(cells.known) < len(parts)
