"""Generated inputs: the Spark range-midpoint and numeric rules equal a plain
Python statement of the same rule on strings built from the dirty-value
alphabet (digits, signs, dots, '%', '<', '>', '-', blanks, sentinels)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equitally.functions.cleaning import range_midpoint, to_double

SENTINELS = ["Unknown", "Exempt", "8888", "9999"]


def py_number(s):
    s = s.strip()
    if not s:
        return None
    body = s[1:] if s[0] in "+-" else s
    if not body or body.count(".") > 1 or not all(c.isdigit() or c == "." for c in body) or body == ".":
        return None
    return float(s)


def py_midpoint(v):
    if v is None or v in SENTINELS:
        return None
    s = v.replace("%", "").replace("<", "").replace(">", "").strip()
    if "-" in s:
        parts = s.split("-")
        if len(parts) != 2:
            return None
        lo, hi = py_number(parts[0]), py_number(parts[1])
        return None if lo is None or hi is None else (lo + hi) / 2
    return py_number(s)


pieces = st.sampled_from(["0", "1", "2", "5", "9", "12", "30", "36", "149", ".", "-", "%", "<", ">", " ", "+"])
values = st.one_of(st.lists(pieces, min_size=0, max_size=6).map("".join), st.sampled_from(SENTINELS))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, min_size=50, max_size=120))
def test_range_midpoint_matches_rule(spark, batch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(batch)], "i int, x string")
    got = {r["i"]: r["m"] for r in df.select("i", range_midpoint("x").alias("m")).collect()}
    for i, v in enumerate(batch):
        want = py_midpoint(v)
        assert got[i] == want, (v, got[i], want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pieces, min_size=0, max_size=6).map("".join), min_size=50, max_size=120))
def test_numeric_cast_matches_rule(spark, batch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(batch)], "i int, x string")
    got = {r["i"]: r["d"] for r in df.select("i", to_double("x").alias("d")).collect()}
    for i, v in enumerate(batch):
        assert got[i] == py_number(v), (v, got[i])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=5, max_value=400), st.integers(min_value=0, max_value=100), st.integers(0, 10 ** 6))
def test_split_sizes_are_exact(spark, n, pct_pos, salt):
    import math

    from equitally.operators.sampling import largest_remainder, stratified_split
    pos = n * pct_pos // 100
    data = [(salt * 1000 + i, 1 if i < pos else 0) for i in range(n)]
    sp = stratified_split(spark.createDataFrame(data, "app_id long, target int")).collect()
    test = [r for r in sp if r["split"] == "test"]
    assert len(sp) == n and len(test) == math.ceil(0.2 * n)
    counts = {c: sum(1 for _, t in data if t == c) for c in {t for _, t in data}}
    train_alloc = largest_remainder(counts, n - math.ceil(0.2 * n))
    for c, k in counts.items():
        assert sum(1 for r in test if r["target"] == c) == k - train_alloc[c]
