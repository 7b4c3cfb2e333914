"""Exact order statistics without a single-task value map.

Spark's exact ``percentile`` aggregate keeps a value→count map per group and
merges all of it in one task; on a continuous column of a very large table
that map does not fit.  ``exact_medians`` selects the exact middle values by
histogram refinement instead: every pass is one partial+final aggregation of
``(column, bin) → count, min, max`` (at most ``bins`` rows per column reach the
driver), narrowing each column's value interval until the ranks are pinned or
at most ``collect_limit`` values remain, whose distinct (value, count) pairs
are then read directly — a constant bound, independent of the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.functions.sqltext import ident


def _long_form(df: DataFrame, cols: dict[int, str], bounds: dict[int, tuple[float, float]] | None) -> DataFrame:
    items = [F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in cols.items()]
    long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.k", "kv.v")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    if bounds:
        cond = None
        for i, (lo, hi) in bounds.items():
            c = (F.col("k") == i) & F.col("v").between(F.lit(lo), F.lit(hi))
            cond = c if cond is None else cond | c
        long = long.where(cond)
    return long


def _valid(c: str):
    return F.expr(f"CASE WHEN NOT isnan(CAST({ident(c)} AS DOUBLE)) THEN CAST({ident(c)} AS DOUBLE) END")


NEAR = 1e-3  # half-width, in quantiles, of the interval first looked at


def _finite(c: str):
    x = f"CAST({ident(c)} AS DOUBLE)"
    return F.expr(f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('Infinity') THEN {x} END")


def exact_medians(df: DataFrame, columns: list[str], bins: int = 4096, collect_limit: int = 100_000,
                  near: float = NEAR) -> dict[str, float | None]:
    """Exact interpolated median of each column (NULL/NaN ignored).

    Equals pandas ``Series.median`` / SQL ``median``: the mean of the two
    middle values for an even count.  An all-null column gives ``None``.
    Infinite values count by their rank; they are no bin edges.

    The first pass counts and takes approximate quantiles close to the middle,
    the second counts exactly what lies below and inside that interval; where
    few enough values lie inside, the third reads them.  An interval that
    misses the middle is replaced by the whole range.  Every histogram pass
    separates an interval's smallest from its largest value, so it ends.
    """
    if not columns:
        return {}
    probes = F.array(F.lit(0.5 - near), F.lit(0.5 + near))
    first = df.agg(*[F.struct(
        F.count(_finite(c)).alias("n"), F.min(_finite(c)).alias("lo"), F.max(_finite(c)).alias("hi"),
        F.count(F.when(F.col(c).cast("double") == float("-inf"), 1)).alias("neg"),
        F.count(F.when(F.col(c).cast("double") == float("inf"), 1)).alias("pos"),
        F.percentile_approx(_finite(c), probes, 10_000).alias("q")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    seeds = {i: first[f"s{i}"]["q"] for i in range(len(columns)) if first[f"s{i}"]["n"]}
    second = df.agg(*[F.struct(
        F.count(F.when(_finite(columns[i]) < q[0], 1)).alias("below"),
        F.count(F.when(_finite(columns[i]).between(q[0], q[1]), 1)).alias("inside")).alias(f"s{i}")
        for i, q in seeds.items()]).first() if seeds else None

    result: dict[str, float | None] = {}
    state: dict[int, dict] = {}
    for i, c in enumerate(columns):
        s = first[f"s{i}"]
        n = s["neg"] + s["n"] + s["pos"]
        if n == 0:
            result[c] = None
            continue
        # ranks among the finite values; infinite ones are known already
        ranks = sorted({(n - 1) // 2 - s["neg"], n // 2 - s["neg"]})
        known = {r: float("-inf") if r < 0 else float("inf") for r in ranks if not 0 <= r < s["n"]}
        state[i] = {"lo": s["lo"], "hi": s["hi"], "below": 0, "inside": s["n"], "ranks": ranks, "values": known}
        if i in seeds and len(known) < len(ranks):
            below, inside = second[f"s{i}"]["below"], second[f"s{i}"]["inside"]
            if all(below <= r < below + inside for r in ranks if r not in known):
                state[i] |= {"lo": seeds[i][0], "hi": seeds[i][1], "below": below, "inside": inside}

    while state:
        done = []
        # Intervals holding one value, or few enough values to read directly.
        small = {i: st for i, st in state.items() if st["lo"] == st["hi"] or st["inside"] <= collect_limit
                 or all(r in st["values"] for r in st["ranks"])}
        if small:
            to_collect = {i: columns[i] for i, st in small.items()
                          if st["lo"] != st["hi"] and not all(r in st["values"] for r in st["ranks"])}
            if to_collect:
                rows = (_long_form(df, to_collect, {i: (small[i]["lo"], small[i]["hi"]) for i in to_collect})
                        .groupBy("k", "v").count().collect())
                per: dict[int, list] = {}
                for r in rows:
                    per.setdefault(r["k"], []).append((r["v"], r["count"]))
            for i, st in small.items():
                for r in st["ranks"]:
                    if r in st["values"]:
                        continue
                    if st["lo"] == st["hi"]:
                        st["values"][r] = st["lo"]
                        continue
                    pos = r - st["below"]
                    for v, cnt in sorted(per.get(i, [])):
                        if pos < cnt:
                            st["values"][r] = v
                            break
                        pos -= cnt
                done.append(i)
        pending = {i: st for i, st in state.items() if i not in small}
        if pending:
            cases = None
            for i, st in pending.items():
                width = st["hi"] / bins - st["lo"] / bins
                b = F.least(F.lit(bins - 1), F.greatest(F.lit(0),
                            F.floor(F.least(F.lit(float(bins)), F.col("v") / F.lit(width) - F.lit(st["lo"] / width))).cast("int")))
                # the ends always part, whatever rounding does to the middle
                b = F.when(F.col("v") <= F.lit(st["lo"]), 0).when(F.col("v") >= F.lit(st["hi"]), bins - 1).otherwise(b)
                cases = F.when(F.col("k") == i, b) if cases is None else cases.when(F.col("k") == i, b)
            hist = (_long_form(df, {i: columns[i] for i in pending},
                               {i: (st["lo"], st["hi"]) for i, st in pending.items()})
                    .withColumn("b", cases)
                    .groupBy("k", "b")
                    .agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                    .collect())
            per_bins: dict[int, list] = {}
            for r in hist:
                per_bins.setdefault(r["k"], []).append((r["b"], r["cnt"], r["mn"], r["mx"]))
            for i, st in pending.items():
                cum = st["below"]
                target = None
                for _, cnt, mn, mx in sorted(per_bins.get(i, [])):
                    for r in st["ranks"]:
                        if r in st["values"] or not (cum <= r < cum + cnt):
                            continue
                        if mn == mx or r == cum:
                            st["values"][r] = mn
                        elif r == cum + cnt - 1:
                            st["values"][r] = mx
                        else:
                            target = (mn, mx, cum, cnt)
                    cum += cnt
                if target is not None:
                    st["lo"], st["hi"], st["below"], st["inside"] = target
                elif all(r in st["values"] for r in st["ranks"]):
                    done.append(i)
        for i in done:
            st = state.pop(i)
            vals = [st["values"][r] for r in st["ranks"]]
            result[columns[i]] = sum(vals) / len(vals) if len(vals) == 2 else vals[0]
    return result


def median_fill_values(df: DataFrame, columns: list[str], exact: bool = True,
                       accuracy: int = 100000) -> dict[str, float | None]:
    """P10 statistics: exact medians, or ``approx_percentile`` when ``exact=False``."""
    if exact:
        return exact_medians(df, columns)
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"m{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}
