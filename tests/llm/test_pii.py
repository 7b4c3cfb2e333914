import hashlib
import random
import re

import pytest

from equitally.llm.pii import KINDS, base_spans, find_personal_data, further_spans, train, well_formed, written


def brute(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("a.@1 2-+()9%3.0é\U0001d49c ") for _ in range(r.randint(0, 45)))
        assert written(base_spans(text)) == brute(text), repr(text)


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1" + " " * 100_000, "@" * 50_000, "1 " * 50_000])
def test_long_runs_take_linear_time(text):
    base_spans(text)


def test_table_and_awkward_rows(make_docs, awkward):
    rows = awkward + [(60, "mail a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111 or +49 (30) 1234567"), (61, "10.0.0.256 4111111111111112 +1 2")]
    got = find_personal_data(make_docs(rows)).collect()
    want = sorted((str(i), hashlib.sha256(brute(t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    (r,) = [r for r in got if r.doc_id == 60]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.startswith("email:5:13,ip:15:23,card:28:47,phone:51:67")
    assert find_personal_data(make_docs([])).count() == 0


def test_field_finds_repeats_of_known_data_and_little_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    field = train(docs.select("text"))
    text = "call +1 (458) 555-2333 now. " + "word " * 200 + "again (458) 555-2333 please, order 12 of 2024, room 7."
    base = base_spans(text)
    more = further_spans(text, base, field)
    assert [(KINDS[k], text[s:e]) for k, s, e in more] == [("phone", "(458) 555-2333")]
    assert further_spans("in 1999 there were 12 of 30, version 4.0 and page 7-8", [], field) == []
    assert further_spans("", [], field) == []


@pytest.fixture(scope="module")
def field(spark):
    return train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))


def test_links_find_masked_repeats(field):
    """Numbers that the rules find once and that come again in a form they miss."""
    from equitally.llm.pii import Field
    r = random.Random(11)
    unlinked = Field(field.weights, field.chain, field.skip * 0)
    found, total = {True: 0, False: 0}, 0
    for _ in range(150):
        area, number = r.randint(200, 999), f"{r.randint(200, 999)}-{r.randint(1000, 9999)}"
        text = f"call +1 ({area}) {number} now. " + "word " * r.randint(3, 60)
        wanted = []
        for _ in range(r.randint(1, 30)):
            text += "so "
            wanted.append((3, len(text), len(text) + len(f"({area}) {number}")))
            text += f"({area}) {number} please, room {r.randint(1, 30)} and then "
        base = base_spans(text)
        assert len(base) == 1
        total += len(wanted)
        for links, f in ((True, field), (False, unlinked)):
            found[links] += len(set(wanted) & set(further_spans(text, base, f)))
    print(found, total)
    assert found[True] > 0.95 * total and found[True] > found[False] + 0.2 * total


def test_half_a_number_is_not_added(field):
    for text in ("call (458) 555-2333 today", "458 555-2333", "at 12 555-2333 34"):
        assert all(text[s:e] == "(458) 555-2333" for _, s, e in further_spans(text, base_spans(text), field)), text


def test_messages_reach_far_and_a_long_text_ends(field):
    text = "+1 (458) 555-2333 " + " ".join(f"w (458) 555-2333 w {i}." for i in range(3000))
    assert len(further_spans(text, base_spans(text), field)) == 3000


def test_added_spans_are_well_formed():
    assert well_formed(2, "4111.1111.1111.1111") and not well_formed(2, "4111.1111.1111.1112")
    assert well_formed(1, "1.2.3.4") and not well_formed(1, "1.2.3.400")
    assert well_formed(3, "(458) 555-2333") and not well_formed(3, "12")
