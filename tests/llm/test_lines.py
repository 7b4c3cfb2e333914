from collections import Counter, defaultdict

import pytest

from equitally.llm.lines import drop_boilerplate


def brute(rows, ratio, min_pages):
    pages, seen = defaultdict(set), defaultdict(set)
    for _, text, _, host in rows:
        if text is not None:
            pages[host].add(text)
            for line in text.split("\n"):
                if line.strip(" "):
                    seen[host, line.strip(" ")].add(text)
    bad = {k for k, v in seen.items() if len(v) >= min_pages and len(v) / len(pages[k[0]]) > ratio}
    out = []
    for i, text, _, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x.strip(" ")) not in bad]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_equals_brute_force(spark, make_docs, rng, broadcast):
    rows = []
    for i in range(300):
        host = ["a", "b", "c", None][min(3, i % 10)] if i % 10 < 4 else "a"
        lines = [f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["All rights reserved.", " All rights reserved. ", "Cookies"]))
        rows.append((i, "\n".join(lines), "en", host))
    rows += [(900, "same\npage", "en", "a")] * 200 + [(901, None, "en", "a"), (902, "", "en", None), (None, "Cookies\n\n \nx", "en", "b"),
                                                         (903, "Cookies\n" * 3000, "en", "a"), (904, "All rights reserved.", "en", "a")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate(make_docs(rows)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == Counter(brute(rows, 0.05, 5))
    assert any(r[3] for r in got)


def test_columns_ride_along_and_empty(make_docs, awkward):
    docs = make_docs(awkward)
    assert [c for c in drop_boilerplate(docs).columns if c in docs.columns and c != "n_lines"] == [c for c in docs.columns if c != "n_lines"]
    assert drop_boilerplate(docs, counts=("p", "q")).columns == [*docs.columns, "p", "q"]
    assert drop_boilerplate(make_docs([])).count() == 0
