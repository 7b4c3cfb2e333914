from collections import Counter

import pytest

import corpus_pipeline as C
from texts import prose
from test_simhash import brute_fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rng):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = prose(rng, 30)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, item


def stage(spark, name, docs, folder, tmp_path):
    out = f"{tmp_path}/{name.replace(' ', '-')}"
    dict(C.STAGES)[name](spark, docs, folder).write.parquet(out)
    return spark.read.parquet(out)


def test_stages_follow_each_other(spark, sf_dir, make_docs, awkward, rng, tmp_path):
    folder, item = sf_dir
    rows = awkward + [(70, "x " + item + " y"), (None, item), (71, prose(rng, 90)), (72, prose(rng, 90))]
    rows += [(100 + i, "Menu of the site\n" + prose(rng, 60), "en", "hot") for i in range(12)]
    docs = make_docs(rows)
    names = [n for n, _ in C.STAGES]

    good = stage(spark, names[0], docs, folder, tmp_path)
    assert good.columns == docs.columns
    # nothing was held out, so all that has text stays
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter((r[0], r[1]) for r in rows if (r[1] or "").strip())

    lines = stage(spark, names[1], good, folder, tmp_path)
    assert lines.columns == docs.columns and lines.count() == good.count()
    assert not lines.where("source = 'hot' and text like 'Menu%'").count()
    assert lines.where("n_chars <> length(text)").count() == 0

    near = stage(spark, names[2], lines, folder, tmp_path)
    assert near.columns == docs.columns
    before, after = [[(r.doc_id, r.text) for r in d.collect()] for d in (lines, near)]
    prints = [brute_fingerprint(t) for _, t in after]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert all(any((brute_fingerprint(t) ^ p).bit_count() <= 4 for p in prints) for _, t in before)
    assert {1, 7} <= {i for i, _ in after} and not {2, 3, 13} & {i for i, _ in after}

    clean = stage(spark, names[3], near, folder, tmp_path)
    assert clean.columns == docs.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert Counter(left) == Counter((i, t) for i, t in after if " ".join(item.lower().split()) not in " ".join(t.lower().split()))
    assert len(left) < len(after)

    packed = stage(spark, names[4], clean, folder, tmp_path)
    from tokenizers import Tokenizer
    from equitally.llm.tokens import default_path
    library = Tokenizer.from_file(default_path())
    want = Counter()
    for i, t in left:
        want[i] += len(library.encode(t, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.length
    assert got == want


def test_rows_that_share_an_id_share_a_fate(spark, sf_dir, make_docs, rng, tmp_path):
    folder, item = sf_dir
    one, two = prose(rng, 80), prose(rng, 80)
    docs = make_docs([(1, one), (1, one), (1, two), (None, two), (None, two), (None, None), (2, item), (2, one)])
    near = [(r.doc_id, r.text) for r in stage(spark, "SimHash near-dedup", docs, folder, tmp_path).collect()]
    assert Counter(i for i, _ in near)[1] == 1
    clean = stage(spark, "benchmark decontamination", docs, folder, tmp_path)
    assert {r.doc_id for r in clean.collect()} == {1, None}


def test_empty_documents_table(spark, sf_dir, make_docs, tmp_path):
    docs = make_docs([])
    for name, _ in C.STAGES:
        assert stage(spark, name, docs, sf_dir[0], tmp_path).count() == 0


def test_near_copies_on_a_host_keep_their_lines(spark, sf_dir, make_docs, rng, tmp_path):
    """A fifth of a host's pages are near copies: none loses the lines they share."""
    base = prose(rng, 9000).split(" ")
    copies = [(200 + i, " ".join(w if n != 500 * i + 20 else "altered" for n, w in enumerate(base)), "en", "hot") for i in range(12)]
    prints = [brute_fingerprint(t) for _, t, *_ in copies]
    assert len({t for _, t, *_ in copies}) == 12 and all((p ^ prints[0]).bit_count() <= 4 for p in prints)
    others = [(i, "Menu of the site\n" + prose(rng, 60), "en", "hot") for i in range(48)]
    got = stage(spark, "line dedup", make_docs(copies + others), sf_dir[0], tmp_path)
    text = {r.doc_id: r.text for r in got.collect()}
    assert [text[i] for i, *_ in copies] == [t for _, t, *_ in copies]
    assert all(text[i] == t.split("\n", 1)[1] for i, t, *_ in others)
