import re

import numpy as np
import xxhash

from equitally.llm.simhash import fingerprint, near_duplicates, verified_links, _posting_batches


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_fingerprints_and_components_equal_brute_force(make_docs, awkward):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(make_docs(awkward)).collect()]
    rows = [(i, brute_fingerprint(t)) for i, t, *_ in awkward]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = [(rows[i][0], f"{rows[i][1]:016x}", least[group[i]]) for i in range(len(rows))]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=by) == sorted(want, key=by)


def test_index_finds_every_link_up_to_four_bits():
    import pyarrow as pa

    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            f = int(c)
            for b in r.choice(64, r.integers(1, 7), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    posts = pa.Table.from_batches(_posting_batches(4)(iter([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])])))
    order = np.argsort(posts["key"].to_numpy(), kind="stable")
    a, b = verified_links(posts["key"].to_numpy()[order], posts["fp"].to_numpy()[order], 4)
    assert (np.bitwise_count((a ^ b).view(np.uint64)) <= 4).all()

    def components(pairs):
        root = {int(f): int(f) for f in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in pairs:
            x, y = find(int(x)), find(int(y))
            root[max(x, y)] = min(x, y)
        return {f: find(f) for f in root}

    signed = fps.view(np.int64)
    every = [(signed[i], signed[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4)]
    assert components(zip(a, b)) == components(every)


def test_long_text_in_slices_equals_brute_force(rng):
    text = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(70_000))
    assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_chain_of_links_is_one_component(spark):
    from equitally.llm.common import connected_components
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges, "test").collect()}
    assert roots == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
