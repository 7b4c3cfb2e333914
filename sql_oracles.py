"""Oracle SQL (DuckDB dialect) for the registered queries.

Each query is rebuilt from the raw tables ``orders`` and ``customer`` through
the same application view text the Spark side uses, then through plain SQL
versions of the cleaning rules, labels and metrics.  Doubles are rounded to
nine places on both sides; integer sums are cast to BIGINT.
"""

from __future__ import annotations

from equitally.functions.cleaning import NUMBER_PATTERN
from equitally.functions.thresholds import uniform_edges
from equitally.sources.fixtures import application_sql
from equitally.sources.schema import (
    AGE_CODES,
    AGE_LABELS,
    COUNTY_LABELS,
    GENDER_LABELS,
    GROUP_ORDER,
    NA_TOKENS,
    RACE_LABELS,
    RANGE_SENTINELS,
)

R = 9  # rounding places


def q(name: str) -> str:
    return '"' + name + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else repr(v) for v in values) + ")"


def rnd(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {R})"


def na(c: str) -> str:
    return f"CASE WHEN {q(c)} IN {in_list(NA_TOKENS)} THEN NULL ELSE {q(c)} END"


def td(x: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({x}), '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


def age_code(x: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {float(v)!r}" for k, v in AGE_CODES.items())
    return f"CAST(CASE {x} {whens} END AS DOUBLE)"


def midpoint(x: str) -> str:
    st = f"trim(regexp_replace({x}, '[%<>]', '', 'g'))"
    parts = f"string_split({st}, '-')"
    return (f"CASE WHEN {x} IS NULL OR {x} IN {in_list(RANGE_SENTINELS)} THEN NULL "
            f"WHEN strpos({st}, '-') > 0 THEN CASE WHEN len({parts}) = 2 THEN "
            f"({td(parts + '[1]')} + {td(parts + '[2]')}) / 2.0 END "
            f"ELSE {td(st)} END")


def race(x: str, include_other: bool = True) -> str:
    items = [(k, v) for k, v in RACE_LABELS.items() if include_other or v != "Other"]
    return "CASE " + " ".join(f"WHEN {x} = {lit(k)} THEN {lit(v)}" for k, v in items) + " END"


def gender(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {lit(k)} THEN {lit(v)}" for k, v in GENDER_LABELS.items()) + " END"


def age_label(x: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in AGE_LABELS.items())
    return f"CASE CAST(trunc({x}) AS BIGINT) {whens} END"


def county(x: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in COUNTY_LABELS.items())
    return f"CASE CAST({x} AS BIGINT) {whens} END"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


STRING_VIEW_COLS = ["derived_race", "derived_sex", "applicant_age", "co-applicant_age",
                    "debt_to_income_ratio", "total_units", "income", "property_value", "loan_term",
                    "conforming_loan_limit", "derived_ethnicity", "lei", "state_code", "denial_reason-1",
                    "interest_rate"]
PLAIN_VIEW_COLS = ["app_id", "action_taken", "county_code", "loan_amount", "loan_purpose", "y_prob",
                   "y_prob_blind"]
IMPUTED = ["applicant_age", "co-applicant_age", "debt_to_income_ratio", "total_units", "income",
           "loan_amount", "property_value", "loan_term"]
CLEAN_STRINGS = ["derived_race", "derived_sex", "conforming_loan_limit", "derived_ethnicity"]


def ctes_clean() -> str:
    """raw → na → dec (filtered, coded, parsed) → med → clean."""
    na_cols = ", ".join([q(c) for c in PLAIN_VIEW_COLS] + [f"{na(c)} AS {q(c)}" for c in STRING_VIEW_COLS])
    dec_cols = ", ".join([
        "app_id", "CAST(CASE WHEN action_taken = 1 THEN 1 ELSE 0 END AS INTEGER) AS target",
        "county_code", "loan_purpose", "y_prob", "y_prob_blind",
        *[q(c) for c in CLEAN_STRINGS],
        f"{age_code(q('applicant_age'))} AS applicant_age",
        f"{age_code(q('co-applicant_age'))} AS {q('co-applicant_age')}",
        f"{midpoint('debt_to_income_ratio')} AS debt_to_income_ratio",
        f"{midpoint('total_units')} AS total_units",
        f"{td('income')} AS income",
        "CASE WHEN isnan(loan_amount) THEN NULL ELSE CAST(loan_amount AS DOUBLE) END AS loan_amount",
        f"{td('property_value')} AS property_value",
        f"{td('loan_term')} AS loan_term",
    ])
    med_cols = ", ".join(f"median({q(c)}) AS {q('m_' + c)}" for c in IMPUTED)
    clean_cols = ", ".join([
        "app_id", "target", "county_code", "loan_purpose", "y_prob", "y_prob_blind",
        *[f"COALESCE({q(c)}, 'Unknown') AS {q(c)}" for c in CLEAN_STRINGS],
        *[f"COALESCE({q(c)}, {q('m_' + c)}) AS {q(c)}" for c in IMPUTED],
    ])
    return (f"raw AS ({application_sql()}),\n"
            f"na AS (SELECT {na_cols} FROM raw),\n"
            f"dec AS (SELECT {dec_cols} FROM na WHERE action_taken IN (1, 3)),\n"
            f"med AS (SELECT {med_cols} FROM dec),\n"
            f"clean AS (SELECT {clean_cols} FROM dec CROSS JOIN med)")


def ctes_scored(models: dict[str, str] | None = None, threshold: float = 0.5) -> str:
    """clean → scored rows (model, y, p, yhat, race, gender, age, county)."""
    models = models or {"model": "y_prob"}
    parts = []
    for m, c in models.items():
        parts.append(
            f"SELECT app_id, {lit(m)} AS model, target AS y, {c} AS p, "
            f"CASE WHEN {c} >= {threshold!r} THEN 1 ELSE 0 END AS yhat, "
            f"{race('derived_race')} AS race, {gender('derived_sex')} AS gender, "
            f"{age_label('applicant_age')} AS age, {county('county_code')} AS county FROM clean")
    return ctes_clean() + ",\nscored AS (" + " UNION ALL ".join(parts) + ")"


ATTRS = [("Race", "race"), ("Gender", "gender"), ("Age", "age"), ("County", "county")]


def stacked_cte(attrs=ATTRS, extra: str = "") -> str:
    sel = " UNION ALL ".join(
        f"SELECT model, {lit(a)} AS attribute, {c} AS group_label, y, p, yhat{extra} FROM scored "
        f"WHERE {c} IS NOT NULL" for a, c in attrs)
    return f"stacked AS ({sel})"


def dims_cte(attrs=ATTRS) -> str:
    rows = ", ".join(f"({lit(a)}, {lit(g)}, {i})" for a, _ in attrs for i, g in enumerate(GROUP_ORDER[a], 1))
    return f"dims AS (SELECT * FROM (VALUES {rows}) d(attribute, group_label, group_order))"


def measures(prefix: str = "") -> str:
    return (f"COUNT(*) AS {prefix}n, {isum('y')} AS {prefix}n_pos, {isum('y * yhat')} AS {prefix}tp, "
            f"{isum('(1 - y) * yhat')} AS {prefix}fp, SUM(p) AS {prefix}sum_p, "
            f"SUM((p - y) * (p - y)) AS {prefix}sum_sq")


def rates(n="n", n_pos="n_pos", tp="tp", fp="fp") -> dict[str, str]:
    return {
        "accuracy": ratio(f"{tp} + ({n} - {n_pos} - {fp})", n),
        "selection_rate": ratio(f"{tp} + {fp}", n),
        "tpr": ratio(tp, n_pos),
        "fpr": ratio(fp, f"{n} - {n_pos}"),
    }


def ece_bin(p: str, n_bins: int = 10) -> str:
    e = uniform_edges(n_bins)
    whens = " ".join(f"WHEN {p} >= {e[i]!r}E0 AND {p} < {e[i + 1]!r}E0 THEN {i}" for i in range(n_bins))
    return f"CASE {whens} END"


def curve_bin(p: str, n_bins: int = 5) -> str:
    inner = uniform_edges(n_bins)[1:-1]
    return "CASE WHEN " + p + " IS NULL THEN NULL ELSE (" + " + ".join(
        f"CAST({p} > {e!r}E0 AS INTEGER)" for e in inner) + ") END"


# --------------------------------------------------------------------------- #
# C: group fairness
# --------------------------------------------------------------------------- #

def _group_m(extra_keys: str = "") -> str:
    k = f"{extra_keys}, " if extra_keys else ""
    return (f"m AS (SELECT {k}attribute, group_label, COUNT(*) AS n, {isum('y')} AS n_pos, "
            f"{isum('y * yhat')} AS tp, {isum('(1 - y) * yhat')} AS fp FROM stacked "
            f"GROUP BY {k}attribute, group_label)")


TWO = {"full": "y_prob", "blind": "y_prob_blind"}


def _metric_frame(cols: str, ctes: str) -> str:
    return (f"WITH {ctes},\n{stacked_cte()},\n{dims_cte()},\n{_group_m('model')},\n"
            f"md AS (SELECT DISTINCT model FROM scored)\n"
            f"SELECT md.model, d.attribute, d.group_label, d.group_order, {cols} "
            f"FROM md CROSS JOIN dims d LEFT JOIN m ON d.attribute = m.attribute AND d.group_label = m.group_label "
            f"AND md.model = m.model")


def c5_metric_frame(metrics=("accuracy", "selection_rate", "tpr", "fpr"), ctes: str | None = None) -> str:
    r = rates("m.n", "m.n_pos", "m.tp", "m.fp")
    cols = ", ".join(f"{rnd(r[k])} AS {k}" for k in metrics)
    return _metric_frame(f"CAST(COALESCE(m.n, 0) AS BIGINT) AS n, {cols}", ctes or ctes_scored(TWO))


def c_metric_only(metric: str) -> str:
    r = rates("m.n", "m.n_pos", "m.tp", "m.fp")
    return _metric_frame(f"{rnd(r[metric])} AS {metric}", ctes_scored(TWO))


def c8_fairness_summary(ctes: str | None = None) -> str:
    r = rates()
    return (f"WITH {ctes or ctes_scored(TWO)},\n{stacked_cte()},\n{_group_m('model')},\n"
            f"g AS (SELECT model, attribute, group_label, {r['selection_rate']} AS sr, {r['tpr']} AS tpr, "
            f"{r['fpr']} AS fpr FROM m)\n"
            f"SELECT model, attribute, {rnd('max(sr) - min(sr)')} AS dp_diff, "
            f"{rnd('greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))')} AS eo_diff, "
            f"{rnd('CASE WHEN max(sr) = 0 THEN NULL ELSE min(sr) / max(sr) END')} AS four_fifths_ratio, "
            f"min({{'s': sr, 'g': group_label}}).g AS min_group, "
            f"max({{'s': sr, 'g': group_label}}).g AS max_group, "
            f"(CASE WHEN max(sr) = 0 THEN NULL ELSE min(sr) / max(sr) END) >= 0.8 AS passes_four_fifths "
            f"FROM g GROUP BY model, attribute")


def c10_model_comparison() -> str:
    r = rates()
    wide = []
    for m in ("full", "blind"):
        for k in ("accuracy", "selection_rate", "tpr", "fpr"):
            wide.append(f"max(CASE WHEN model = {lit(m)} THEN {r[k]} END) AS {m}_{k}")
    deltas = ", ".join(f"{rnd(f'w.blind_{k} - w.full_{k}')} AS delta_{k}"
                       for k in ("accuracy", "selection_rate", "tpr", "fpr"))
    fulls = ", ".join(f"{rnd(f'w.{m}_{k}')} AS {m}_{k}" for m in ("full", "blind")
                      for k in ("accuracy", "selection_rate", "tpr", "fpr"))
    return (f"WITH {ctes_scored(TWO)},\n{stacked_cte()},\n{dims_cte()},\n{_group_m('model')},\n"
            f"w AS (SELECT attribute, group_label, {', '.join(wide)} FROM m GROUP BY attribute, group_label)\n"
            f"SELECT d.attribute, d.group_label, d.group_order, {fulls}, {deltas} "
            f"FROM dims d LEFT JOIN w ON d.attribute = w.attribute AND d.group_label = w.group_label")


def c11_pair_gap(first="White", second="Black") -> str:
    r = rates()
    return (f"WITH {ctes_scored(TWO)},\n"
            f"m AS (SELECT model, race, COUNT(*) AS n, {isum('y')} AS n_pos, {isum('y * yhat')} AS tp, "
            f"{isum('(1 - y) * yhat')} AS fp FROM scored WHERE race IN ({lit(first)}, {lit(second)}) "
            f"GROUP BY model, race),\n"
            f"w AS (SELECT model, max(CASE WHEN race = {lit(first)} THEN {r['selection_rate']} END) AS a, "
            f"max(CASE WHEN race = {lit(second)} THEN {r['selection_rate']} END) AS b FROM m GROUP BY model)\n"
            f"SELECT model, {lit(first)} AS first_group, {lit(second)} AS second_group, "
            f"{rnd('a')} AS first_value, {rnd('b')} AS second_value, {rnd('a - b')} AS gap FROM w")


def _inter_cte(parts) -> str:
    exprs = []
    for p in parts:
        exprs.append("(CASE WHEN race <> 'Other' THEN race END)" if p == "race" else p)
    label = " || ' ' || ".join(exprs)
    return f"inter AS (SELECT model, {label} AS intersection, y, yhat FROM scored)"


def _inter_m(parts, ctes: str | None) -> str:
    return (f"WITH {ctes or ctes_scored(TWO)},\n{_inter_cte(parts)},\n"
            f"m AS (SELECT model, intersection, COUNT(*) AS n, {isum('y')} AS n_pos, {isum('y * yhat')} AS tp, "
            f"{isum('(1 - y) * yhat')} AS fp FROM inter WHERE intersection IS NOT NULL GROUP BY model, intersection)")


def c12_intersection(parts, ctes: str | None = None) -> str:
    r = rates()
    return (f"{_inter_m(parts, ctes)}\n"
            f"SELECT model, intersection, n AS count, {rnd(r['accuracy'])} AS accuracy, "
            f"{rnd(r['selection_rate'])} AS selection_rate, {rnd(r['tpr'])} AS tpr, {rnd(r['fpr'])} AS fpr, "
            f"CAST(tp + fp AS BIGINT) AS approved, CAST(n - tp - fp AS BIGINT) AS denied FROM m WHERE n >= 10")


def c15_intersection_gap(parts=("race", "age"), ctes: str | None = None) -> str:
    r = rates()
    return (f"{_inter_m(parts, ctes)},\n"
            f"s AS (SELECT model, intersection, {r['selection_rate']} AS sr FROM m WHERE n >= 10)\n"
            f"SELECT model, min({{'s': sr, 'g': intersection}}).g AS min_group, {rnd('min(sr)')} AS min_selection_rate, "
            f"max({{'s': sr, 'g': intersection}}).g AS max_group, {rnd('max(sr)')} AS max_selection_rate, "
            f"{rnd('max(sr) - min(sr)')} AS gap FROM s GROUP BY model")


# --------------------------------------------------------------------------- #
# D: calibration
# --------------------------------------------------------------------------- #

CAL_ATTRS = [("Race", "race"), ("Age", "age"), ("Gender", "gender"), ("County", "county")]


def _cal_ctes(models=None, ctes: str | None = None) -> str:
    return (f"WITH {ctes or ctes_scored(models)},\n"
            f"{stacked_cte(CAL_ATTRS, extra=', ' + ece_bin('p') + ' AS eb, ' + curve_bin('p') + ' AS cb')}")


def d5_calibration_table(ctes: str | None = None) -> str:
    return (f"{_cal_ctes(ctes=ctes)},\n"
            f"g AS (SELECT model, attribute, group_label, COUNT(*) AS n, SUM(y) AS n_pos, SUM(p) AS sum_p, "
            f"SUM((p - y) * (p - y)) AS sum_sq FROM stacked GROUP BY model, attribute, group_label),\n"
            f"b AS (SELECT model, attribute, group_label, eb, COUNT(*) AS bn, SUM(y) AS bp, SUM(p) AS bs "
            f"FROM stacked WHERE eb IS NOT NULL GROUP BY model, attribute, group_label, eb),\n"
            f"e AS (SELECT b.model, b.attribute, b.group_label, "
            f"SUM(abs(CAST(bp AS DOUBLE) / bn - bs / bn) * bn / g.n) AS ece FROM b JOIN g "
            f"ON b.model = g.model AND b.attribute = g.attribute AND b.group_label = g.group_label "
            f"GROUP BY b.model, b.attribute, b.group_label)\n"
            f"SELECT g.model, g.attribute, g.group_label, g.n AS sample_size, "
            f"{rnd('CAST(g.n_pos AS DOUBLE) / g.n')} AS actual_approval_rate, "
            f"{rnd('g.sum_p / g.n')} AS mean_predicted_probability, "
            f"{rnd('abs(CAST(g.n_pos AS DOUBLE) / g.n - g.sum_p / g.n)')} AS calibration_gap, "
            f"{rnd('COALESCE(e.ece, 0.0)')} AS ece, {rnd('g.sum_sq / g.n')} AS brier_score "
            f"FROM g LEFT JOIN e ON g.model = e.model AND g.attribute = e.attribute "
            f"AND g.group_label = e.group_label WHERE g.n >= 10")


def d2_calibration_bins() -> str:
    edges = uniform_edges(10)
    centres = "[" + ", ".join(f"{(edges[i] + edges[i + 1]) / 2!r}E0" for i in range(10)) + "]"
    return (f"{_cal_ctes()}\n"
            f"SELECT model, attribute, group_label, eb AS ece_bin, {rnd(centres + '[eb + 1]')} AS bin_center, "
            f"COUNT(*) AS bin_n, {rnd('CAST(SUM(y) AS DOUBLE) / COUNT(*)')} AS bin_accuracy, "
            f"{rnd('SUM(p) / COUNT(*)')} AS bin_confidence FROM stacked WHERE eb IS NOT NULL "
            f"GROUP BY model, attribute, group_label, eb")


def d6_reliability_curve() -> str:
    return (f"{_cal_ctes()},\n"
            f"g AS (SELECT model, attribute, group_label, COUNT(*) AS gn FROM stacked "
            f"GROUP BY model, attribute, group_label)\n"
            f"SELECT s.model, s.attribute, s.group_label, s.cb AS curve_bin, COUNT(*) AS bin_n, "
            f"{rnd('SUM(s.p) / COUNT(*)')} AS prob_pred, {rnd('CAST(SUM(s.y) AS DOUBLE) / COUNT(*)')} AS prob_true "
            f"FROM stacked s JOIN g ON s.model = g.model AND s.attribute = g.attribute "
            f"AND s.group_label = g.group_label WHERE g.gn >= 10 "
            f"GROUP BY s.model, s.attribute, s.group_label, s.cb")


def d1_overall_calibration() -> str:
    return (f"WITH {ctes_scored(TWO)},\n"
            f"s AS (SELECT model, y, p, {ece_bin('p')} AS eb FROM scored),\n"
            f"g AS (SELECT model, COUNT(*) AS n, SUM(y) AS n_pos, SUM(p) AS sum_p, "
            f"SUM((p - y) * (p - y)) AS sum_sq FROM s GROUP BY model),\n"
            f"b AS (SELECT model, eb, COUNT(*) AS bn, SUM(y) AS bp, SUM(p) AS bs FROM s "
            f"WHERE eb IS NOT NULL GROUP BY model, eb),\n"
            f"e AS (SELECT b.model, SUM(abs(CAST(bp AS DOUBLE) / bn - bs / bn) * bn / g.n) AS ece "
            f"FROM b JOIN g ON b.model = g.model GROUP BY b.model)\n"
            f"SELECT g.model, g.n AS sample_size, {rnd('CAST(g.n_pos AS DOUBLE) / g.n')} AS actual_approval_rate, "
            f"{rnd('g.sum_p / g.n')} AS mean_predicted_probability, "
            f"{rnd('abs(CAST(g.n_pos AS DOUBLE) / g.n - g.sum_p / g.n)')} AS calibration_gap, "
            f"{rnd('COALESCE(e.ece, 0.0)')} AS ece, {rnd('g.sum_sq / g.n')} AS brier_score "
            f"FROM g LEFT JOIN e ON g.model = e.model")


# --------------------------------------------------------------------------- #
# B: classification metrics
# --------------------------------------------------------------------------- #

def _counts() -> str:
    return (f"WITH {ctes_scored(TWO)},\n"
            f"c AS (SELECT model, COUNT(*) AS n, {isum('y * yhat')} AS tp, {isum('(1 - y) * yhat')} AS fp, "
            f"{isum('(1 - y) * (1 - yhat)')} AS tn, {isum('y * (1 - yhat)')} AS fn, {isum('y')} AS n_pos "
            f"FROM scored GROUP BY model)")


def b1_confusion_matrix() -> str:
    parts = [f"SELECT model, {a} AS actual, {p} AS predicted, {k} AS count FROM c"
             for a, p, k in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return _counts() + "\n" + " UNION ALL ".join(parts)


def _tm() -> dict[str, str]:
    return {"accuracy": ratio("tp + tn", "n"), "precision": ratio("tp", "tp + fp"),
            "recall": ratio("tp", "tp + fn"), "f1_score": ratio("2 * tp", "2 * tp + fp + fn")}


def b2_classification_metrics() -> str:
    cols = ", ".join(f"{rnd(v)} AS {k}" for k, v in _tm().items())
    return (_counts() + f"\nSELECT model, {cols}, n AS n_test, {rnd(ratio('n_pos', 'n'))} AS positive_rate FROM c")


def b3_classification_report() -> str:
    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    s1, s0, acc = "CAST(tp + fn AS DOUBLE)", "CAST(tn + fp AS DOUBLE)", ratio("tp + tn", "n")
    nd = "CAST(n AS DOUBLE)"
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1), ("accuracy", acc, acc, acc, nd),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", nd),
            ("weighted avg", f"(({p0}) * {s0} + ({p1}) * {s1}) / {nd}", f"(({r0}) * {s0} + ({r1}) * {s1}) / {nd}",
             f"(({f0}) * {s0} + ({f1}) * {s1}) / {nd}", nd)]
    sel = " UNION ALL ".join(
        f"SELECT model, {lit(lab)} AS label, {rnd(p)} AS precision, {rnd(r)} AS recall, {rnd(f)} AS f1_score, "
        f"{rnd(su)} AS support FROM c" for lab, p, r, f, su in rows)
    return _counts() + "\n" + sel


def _steps() -> str:
    return (f"WITH {ctes_scored(TWO)},\n"
            f"g AS (SELECT model, p AS score, {isum('y')} AS tp, {isum('1 - y')} AS fp FROM scored GROUP BY model, p),\n"
            f"s AS (SELECT model, score, tp, fp, ROW_NUMBER() OVER w AS pos, SUM(tp) OVER w AS cum_tp, "
            f"SUM(fp) OVER w AS cum_fp, LEAD(tp) OVER w2 AS next_tp, LEAD(fp) OVER w2 AS next_fp FROM g "
            f"WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"w2 AS (PARTITION BY model ORDER BY score DESC)),\n"
            f"t AS (SELECT model, SUM(tp) AS P, SUM(fp) AS N FROM g GROUP BY model),\n"
            f"st AS (SELECT s.*, t.P, t.N FROM s JOIN t ON s.model = t.model)")


def _rank_sel() -> str:
    return ("r AS (SELECT model, SUM(fp * (cum_tp - tp / 2.0)) / (ANY_VALUE(P) * ANY_VALUE(N)) AS roc_auc, "
            "SUM(tp * cum_tp / CAST(cum_tp + cum_fp AS DOUBLE)) / ANY_VALUE(P) AS average_precision "
            "FROM st GROUP BY model)")


def b5_ranking() -> str:
    return (_steps() + ",\n" + _rank_sel() +
            f"\nSELECT model, {rnd('roc_auc')} AS roc_auc, {rnd('average_precision')} AS average_precision FROM r")


def _kept_points() -> str:
    """Points that stay after dropping steps equal to the next, numbered anew from 0."""
    return (f"kp AS (SELECT model, ROW_NUMBER() OVER (PARTITION BY model ORDER BY pos) AS pos, {ratio('cum_fp', 'N')} AS fpr, "
            f"{ratio('cum_tp', 'P')} AS tpr, score FROM st "
            f"WHERE pos = 1 OR next_tp IS NULL OR next_tp <> tp OR next_fp <> fp "
            f"UNION ALL SELECT model, 0, 0.0, 0.0, CAST('inf' AS DOUBLE) FROM t)")


def b7_roc_curve() -> str:
    return (_steps() + ",\n" + _kept_points() + f"\nSELECT model, CAST(pos AS BIGINT) AS pos, {rnd('fpr')} AS fpr, "
            f"{rnd('tpr')} AS tpr, CASE WHEN pos = 0 THEN score ELSE {rnd('score')} END AS threshold FROM kp")


def b8_pr_curve() -> str:
    return (_steps() + "\n"
            f"SELECT model, CAST(pos AS BIGINT) AS pos, {rnd(ratio('cum_tp', 'cum_tp + cum_fp'))} AS precision, "
            f"{rnd(ratio('cum_tp', 'P'))} AS recall, {rnd('score')} AS threshold FROM st "
            f"UNION ALL SELECT model, CAST(0 AS BIGINT), 1.0, 0.0, CAST(NULL AS DOUBLE) FROM t")


def b9_curve_area() -> str:
    return (_steps() + ",\n" + _kept_points() + ",\n"
            f"seg AS (SELECT model, (fpr - LAG(fpr) OVER w) * (tpr + LAG(tpr) OVER w) / 2.0 AS a FROM kp "
            f"WINDOW w AS (PARTITION BY model ORDER BY pos))\n"
            f"SELECT model, {rnd('SUM(a)')} AS area FROM seg GROUP BY model")


def b10_leaderboard() -> str:
    cols = ", ".join(f"{rnd(v)} AS {k}" for k, v in _tm().items())
    return (_steps() + ",\n" + _rank_sel() + ",\n"
            f"c AS (SELECT model, COUNT(*) AS n, {isum('y * yhat')} AS tp, {isum('(1 - y) * yhat')} AS fp, "
            f"{isum('(1 - y) * (1 - yhat)')} AS tn, {isum('y * (1 - yhat)')} AS fn FROM scored GROUP BY model)\n"
            f"SELECT c.model, {cols}, {rnd('r.roc_auc')} AS roc_auc, {rnd('r.average_precision')} AS average_precision "
            f"FROM c JOIN r ON c.model = r.model")


# --------------------------------------------------------------------------- #
# P: cleaning rules
# --------------------------------------------------------------------------- #

def _with_clean(body: str) -> str:
    return f"WITH {ctes_clean()}\n{body}"


def p1_decision_filter() -> str:
    return _with_clean("SELECT app_id, action_taken FROM na WHERE action_taken IN (1, 3)")


def p2_binary_target() -> str:
    return _with_clean("SELECT app_id, target FROM dec")


def _view_names():
    from equitally.sources.fixtures import APPLICATION_VIEW
    return [n for n, _ in APPLICATION_VIEW]


def p3_drop_leakage() -> str:
    from equitally.sources.schema import LEAKAGE_COLUMNS
    doubles = {"loan_amount", "y_prob", "y_prob_blind"}
    keep = [n for n in _view_names() if n not in LEAKAGE_COLUMNS]
    cols = ", ".join(f"{rnd(q(n))} AS {q(n)}" if n in doubles else q(n) for n in keep)
    return f"WITH raw AS ({application_sql()})\nSELECT {cols} FROM raw"


def p7_ordinal_age() -> str:
    return _with_clean(f"SELECT app_id, {age_code(q('applicant_age'))} AS applicant_age, "
                       f"{age_code(q('co-applicant_age'))} AS {q('co-applicant_age')} FROM na")


def p8_range_midpoint() -> str:
    return _with_clean(f"SELECT app_id, {rnd(midpoint('debt_to_income_ratio'))} AS debt_to_income_ratio, "
                       f"{rnd(midpoint('total_units'))} AS total_units FROM na")


def p9_numeric_coercion() -> str:
    return _with_clean(f"SELECT app_id, {rnd(td('income'))} AS income, {rnd(td('property_value'))} AS property_value, "
                       f"{rnd(td('loan_term'))} AS loan_term, "
                       f"{rnd('CASE WHEN isnan(loan_amount) THEN NULL ELSE loan_amount END')} AS loan_amount FROM na")


def p10_medians() -> str:
    return _with_clean("SELECT " + ", ".join(f"{rnd(q('m_' + c))} AS {q(c)}" for c in IMPUTED) + " FROM med")


def p11_clean_table() -> str:
    doubles = set(IMPUTED) | {"y_prob", "y_prob_blind"}
    cols = ["app_id", "target", "county_code", "loan_purpose", "y_prob", "y_prob_blind", *CLEAN_STRINGS, *IMPUTED]
    sel = ", ".join(f"{rnd(q(c))} AS {q(c)}" if c in doubles else q(c) for c in cols)
    return _with_clean(f"SELECT {sel} FROM clean")


def p12_na_tokens() -> str:
    return _with_clean("SELECT app_id, " + ", ".join(q(c) for c in STRING_VIEW_COLS) + " FROM na")


def p13_p18_audit_labels() -> str:
    r3 = race("derived_race", include_other=False)
    g = gender("derived_sex")
    a = age_label("applicant_age")
    return _with_clean(
        f"SELECT app_id, {a} AS age, {county('county_code')} AS county, {race('derived_race')} AS race, "
        f"{r3} AS race3, {g} AS gender, ({r3}) || ' ' || ({g}) AS race_gender, "
        f"({r3}) || ' ' || ({a}) AS race_age FROM clean")


def p20_threshold() -> str:
    return _with_clean("SELECT app_id, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS yhat FROM clean")


def p23_shape_report() -> str:
    from equitally.sources.schema import LEAKAGE_COLUMNS
    names = _view_names()
    n_raw = len(names)
    n_clean = len([n for n in names if n not in LEAKAGE_COLUMNS]) + 1
    return (f"WITH raw AS ({application_sql()})\n"
            f"SELECT 'raw' AS stage, COUNT(*) AS n_rows, {n_raw} AS n_columns FROM raw UNION ALL "
            f"SELECT 'clean', COUNT(*) FILTER (WHERE action_taken IN (1, 3)), {n_clean} FROM raw")


# --------------------------------------------------------------------------- #
# S: sources
# --------------------------------------------------------------------------- #

def s4_payload_rejection() -> str:
    return ("SELECT page_id, regexp_matches(html, '(?i)^\\s*<(!doctype html|html)') AS rejected, "
            "(starts_with(html, '<!doctype html>') OR strpos(left(html, 100), '<html>') > 0) AS rejected_strict "
            "FROM pages")


def s5_rows_per_county() -> str:
    return (f"WITH raw AS ({application_sql(['county_code'])})\n"
            "SELECT county_code, COUNT(*) AS count FROM raw WHERE county_code IS NOT NULL GROUP BY county_code")


# --------------------------------------------------------------------------- #
# F, J: split, samples, category domains
# --------------------------------------------------------------------------- #

def _alloc_ctes(k_expr: str, name: str) -> str:
    """Largest-remainder allocation of k draws over target classes → name(target, n_c, k_c)."""
    return (f"{name}_cc AS (SELECT target, COUNT(*) AS n_c FROM clean GROUP BY target),\n"
            f"{name}_tot AS (SELECT SUM(n_c) AS n, {k_expr} AS k FROM {name}_cc),\n"
            f"{name}_fl AS (SELECT target, n_c, CAST(n_c * k AS DOUBLE) / n AS cont, "
            f"FLOOR(CAST(n_c * k AS DOUBLE) / n) AS fl FROM {name}_cc, {name}_tot),\n"
            f"{name} AS (SELECT target, n_c, CAST(fl + CASE WHEN ROW_NUMBER() OVER (ORDER BY cont - fl DESC, target) "
            f"<= (SELECT k FROM {name}_tot) - (SELECT SUM(fl) FROM {name}_fl) THEN 1 ELSE 0 END AS BIGINT) AS k_c "
            f"FROM {name}_fl)")


HASH = "md5(CAST(app_id AS VARCHAR) || '-42')"


def _split_ctes() -> str:
    k = "SUM(n_c) - CAST(CEIL(CAST(0.2 AS DOUBLE) * SUM(n_c)) AS BIGINT)"
    return (f"{ctes_clean()},\n{_alloc_ctes(k, 'tr')},\n"
            f"ranked AS (SELECT app_id, target, ROW_NUMBER() OVER (PARTITION BY target ORDER BY {HASH}, app_id) AS rn "
            f"FROM clean),\n"
            f"split AS (SELECT r.app_id, r.target, CASE WHEN r.rn <= tr.n_c - tr.k_c THEN 'test' ELSE 'train' END "
            f"AS split FROM ranked r JOIN tr ON r.target = tr.target)")


def f1_stratified_split() -> str:
    return f"WITH {_split_ctes()}\nSELECT app_id, target, split FROM split"


def f2_split_report() -> str:
    return (f"WITH {_split_ctes()},\nc AS (SELECT split, target, COUNT(*) AS count FROM split GROUP BY split, target)\n"
            f"SELECT split, target, count, {rnd('CAST(count AS DOUBLE) / SUM(count) OVER (PARTITION BY split)')} AS ratio "
            f"FROM c")


def f3_stratified_sample(size: int = 1000) -> str:
    return (f"WITH {ctes_clean()},\n{_alloc_ctes(str(size), 'al')},\n"
            f"ranked AS (SELECT app_id, target, ROW_NUMBER() OVER (PARTITION BY target ORDER BY {HASH}, app_id) AS rn "
            f"FROM clean)\n"
            f"SELECT r.app_id, r.target FROM ranked r JOIN al ON r.target = al.target WHERE r.rn <= al.k_c")


def f4_uniform_sample(size: int = 300) -> str:
    return _with_clean(f"SELECT app_id, target FROM clean ORDER BY {HASH}, app_id LIMIT {size}")


def j4_category_domain() -> str:
    return _with_clean("SELECT DISTINCT conforming_loan_limit FROM clean")


def j5_label_codes() -> str:
    return _with_clean("SELECT derived_race AS level, CAST(DENSE_RANK() OVER (ORDER BY derived_race) - 1 AS INTEGER) "
                       "AS code FROM (SELECT DISTINCT derived_race FROM clean WHERE derived_race IS NOT NULL)")


def j5_first_seen_codes() -> str:
    return (f"WITH {_split_ctes()},\nf AS (SELECT c.derived_race AS level, MIN({{'part': CASE WHEN s.split = 'train' THEN 0 ELSE 1 END, 'row': c.app_id}}) AS spot "
            "FROM clean c JOIN split s ON s.app_id = c.app_id WHERE c.derived_race IS NOT NULL GROUP BY c.derived_race)\n"
            "SELECT level, CAST(ROW_NUMBER() OVER (ORDER BY spot, level) - 1 AS INTEGER) AS code, spot.row AS first_seen FROM f")


# --------------------------------------------------------------------------- #
# Features fitted on the train split
# --------------------------------------------------------------------------- #

NUMERIC_FEATURES = ["county_code", "loan_purpose", "applicant_age", "co-applicant_age", "debt_to_income_ratio",
                    "total_units", "income", "loan_amount", "property_value", "loan_term"]


def _with_split(body: str, extra_ctes: str = "") -> str:
    """clean → split → sp (clean rows with their split) → train, plus extra CTEs."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return (f"WITH {_split_ctes()},\n"
            f"sp AS (SELECT clean.*, split.split FROM clean JOIN split ON clean.app_id = split.app_id),\n"
            f"train AS (SELECT * FROM sp WHERE split = 'train'){extra}\n{body}")


def f5_standard_scaling() -> str:
    def x(c):
        return f"CAST({q(c)} AS DOUBLE)"

    stats = ", ".join(f"AVG({x(c)}) AS {q('m_' + c)}, "
                      f"CASE WHEN STDDEV_POP({x(c)}) = 0 OR STDDEV_POP({x(c)}) IS NULL THEN 1.0 "
                      f"ELSE STDDEV_POP({x(c)}) END AS {q('s_' + c)}" for c in NUMERIC_FEATURES)
    cols = ", ".join(f"{rnd('(' + x(c) + ' - ' + q('m_' + c) + ') / ' + q('s_' + c))} AS {q(c)}"
                     for c in NUMERIC_FEATURES)
    return _with_split(f"SELECT app_id, {cols} FROM sp, st", f"st AS (SELECT {stats} FROM train)")


def _codes(col: str) -> str:
    return (f"SELECT {col} AS lvl, CAST(DENSE_RANK() OVER (ORDER BY {col}) - 1 AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT {col} FROM train WHERE {col} IS NOT NULL)")


def f6_one_hot() -> str:
    body = ("SELECT sp.app_id, c1.code AS conforming_loan_limit__ohe_hot, "
            "(SELECT CAST(COUNT(*) AS INTEGER) FROM c1) AS conforming_loan_limit__ohe_size, "
            "c2.code AS derived_race__ohe_hot, (SELECT CAST(COUNT(*) AS INTEGER) FROM c2) AS derived_race__ohe_size "
            "FROM sp LEFT JOIN c1 ON sp.conforming_loan_limit = c1.lvl LEFT JOIN c2 ON sp.derived_race = c2.lvl")
    return _with_split(body, f"c1 AS ({_codes('conforming_loan_limit')}), c2 AS ({_codes('derived_race')})")


def f7_ordinal_codes() -> str:
    body = ("SELECT sp.app_id, CAST(COALESCE(c1.code, -1) AS DOUBLE) AS conforming_loan_limit_code "
            "FROM sp LEFT JOIN c1 ON sp.conforming_loan_limit = c1.lvl")
    return _with_split(body, f"c1 AS ({_codes('conforming_loan_limit')})")


def f9_balanced_weights() -> str:
    body = (f"SELECT t.app_id, t.target, {rnd('CAST(tt.n AS DOUBLE) / (tt.k * cc.n_c)')} AS weight "
            "FROM train t JOIN cc ON t.target = cc.target, tt")
    return _with_split(body, "cc AS (SELECT target, COUNT(*) AS n_c FROM train GROUP BY target), "
                             "tt AS (SELECT SUM(n_c) AS n, COUNT(*) AS k FROM cc)")


def f10_positive_weight() -> str:
    body = (f"SELECT t.app_id, t.target, "
            f"{rnd('CASE WHEN t.target = 1 THEN CAST(cc.neg AS DOUBLE) / cc.pos ELSE 1.0 END')} AS weight "
            "FROM train t, cc")
    return _with_split(body, "cc AS (SELECT SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos, "
                             "SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS neg FROM train)")


def m4_validation_indicator() -> str:
    h = "substr(md5(CAST(app_id AS VARCHAR) || '-42-validation'), 1, 8)"
    return _with_split(f"SELECT app_id, {h} < '1999999a' AS is_validation FROM train")


# --------------------------------------------------------------------------- #
# Fitted models as tables: the query leaves its nodes or coefficients in
# Parquet, and SQL scores the rows of the driver tables with them
# --------------------------------------------------------------------------- #

MODEL_NUMBERS = ["applicant_age", "co-applicant_age", "county_code", "debt_to_income_ratio", "total_units", "income",
                 "loan_amount", "property_value", "loan_term", "loan_purpose"]
MODEL_LEVELS = ["derived_race", "derived_sex", "conforming_loan_limit", "derived_ethnicity"]


def _model_table(kind: str) -> str:
    from equitally.session import model_tables
    return f"read_parquet('{model_tables().removeprefix('file:')}/{kind}/*.parquet')"


def _level_codes() -> str:
    return ", ".join(f"k_{c} AS ({_codes(c)})" for c in MODEL_LEVELS)


def _walk(kind: str, where: str) -> str:
    """leaf_<kind>: the leaf of every tree that every row reaches."""
    coded = "ord" if kind == "forest" else "idx"
    levels = [c for c in MODEL_LEVELS if kind != "blind" or c not in ("derived_race", "derived_sex")]
    values = [f"COALESCE(CAST({q(c)} AS DOUBLE), -1e12)" for c in MODEL_NUMBERS]
    values += [f"CAST(COALESCE(k_{c}.code, {'-1' if coded == 'ord' else f'(SELECT COUNT(*) FROM k_{c})'}) AS DOUBLE)" for c in levels]
    names = ", ".join(lit(f"{c}__num") for c in MODEL_NUMBERS) + ", " + ", ".join(lit(f"{c}__{coded}") for c in levels)
    joins = " ".join(f"LEFT JOIN k_{c} ON k_{c}.lvl = sp.{c}" for c in levels)
    return f"""
x_{kind} AS MATERIALIZED (SELECT sp.app_id, sp.target, [{', '.join(values)}] AS x FROM sp {joins} WHERE {where}),
nodes_{kind} AS MATERIALIZED (SELECT *, list_position([{names}], input) AS at FROM {_model_table(kind)}),
walk_{kind}(app_id, tree, node) AS (
  SELECT app_id, tree, 0 FROM x_{kind}, (SELECT DISTINCT tree FROM nodes_{kind})
  UNION ALL
  SELECT w.app_id, w.tree, CASE WHEN CASE WHEN n.levels IS NULL THEN r.x[n.at] <= n.threshold ELSE list_contains(n.levels, r.x[n.at]) END
    THEN n.left_child ELSE n.right_child END
  FROM walk_{kind} w JOIN nodes_{kind} n ON n.tree = w.tree AND n.node = w.node JOIN x_{kind} r ON r.app_id = w.app_id WHERE n.left_child >= 0),
leaf_{kind} AS (
  SELECT w.app_id, w.tree, w.node, n.value, n.weight, CAST(round(n.weight * n.value * 1e9) AS BIGINT) AS units, r.target
  FROM walk_{kind} w JOIN nodes_{kind} n ON n.tree = w.tree AND n.node = w.node JOIN x_{kind} r ON r.app_id = w.app_id WHERE n.left_child < 0)"""


def _tree_scores(kind: str) -> str:
    p = "AVG(value)" if kind == "forest" else "1 / (1 + exp(-2 * SUM(weight * value)))"
    return (f"{_walk(kind, chr(39).join(['split = ', 'test', '']))},\n"
            f"p_{kind} AS (SELECT app_id, {lit(kind)} AS model, ANY_VALUE(target) AS y, {p} AS p FROM leaf_{kind} GROUP BY app_id)")


def _recursive(body: str, ctes: str) -> str:
    return _with_split(body, f"{_level_codes()}, {ctes}").replace("WITH ", "WITH RECURSIVE ", 1)


def _score_columns() -> str:
    return f"app_id, model, y, {rnd('p')} AS p, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS yhat"


def m_tree_scores(kind: str) -> str:
    return _recursive(f"SELECT {_score_columns()} FROM p_{kind}", _tree_scores(kind))


def _logistic(where: str) -> str:
    """z_log: features in long form, coefficients and scores by the coefficient table."""
    stats = ", ".join(f"AVG(CAST({q(c)} AS DOUBLE)) AS {q('m_' + c)}, CASE WHEN STDDEV_POP(CAST({q(c)} AS DOUBLE)) = 0 OR "
                      f"STDDEV_POP(CAST({q(c)} AS DOUBLE)) IS NULL THEN 1.0 ELSE STDDEV_POP(CAST({q(c)} AS DOUBLE)) END AS {q('s_' + c)}"
                      for c in MODEL_NUMBERS)
    parts = [f"SELECT app_id, target, {lit('num__' + c)} AS feature, COALESCE((CAST({q(c)} AS DOUBLE) - {q('m_' + c)}) / {q('s_' + c)}, 0) AS v FROM sp, scaling WHERE {where}"
             for c in MODEL_NUMBERS]
    parts += [f"SELECT app_id, target, {lit('cat__' + c + '_')} || {c}, 1.0 FROM sp WHERE {where}" for c in MODEL_LEVELS]
    parts += [f"SELECT app_id, target, 'intercept', 1.0 FROM sp WHERE {where}"]
    return (f"scaling AS (SELECT {stats} FROM train),\ncoef AS (SELECT * FROM {_model_table('logistic')}),\n"
            f"long AS ({' UNION ALL '.join(parts)}),\n"
            "z_log AS (SELECT app_id, ANY_VALUE(target) AS y, SUM(v * coefficient) AS z FROM long JOIN coef ON long.feature = coef.feature GROUP BY app_id),\n"
            "p_logistic AS (SELECT app_id, 'logistic' AS model, y, 1 / (1 + exp(-z)) AS p FROM z_log)")


def m1_logistic_scores() -> str:
    return _with_split(f"SELECT {_score_columns()} FROM p_logistic", _logistic("split = 'test'"))


def m7_logistic(name: str) -> str:
    return _with_split(f"SELECT {_score_columns().replace('model', f'{lit(name)} AS model')} FROM p_logistic", _logistic("split = 'test'"))


def m1_optimum() -> str:
    return _with_split(
        f"SELECT c.feature, {rnd('c.coefficient')} AS coefficient, ABS(g.g + CASE WHEN c.feature = 'intercept' THEN 0 ELSE c.coefficient END) / n.n < 1e-4 AS at_optimum\n"
        "FROM coef c JOIN (SELECT l.feature, SUM(w.n / (w.k * w.n_c) * (p.p - l.target) * l.v) AS g FROM long l JOIN p_logistic p ON p.app_id = l.app_id "
        "JOIN cw w ON w.target = l.target GROUP BY l.feature) g ON g.feature = c.feature, (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM train) n",
        _logistic("split = 'train'") + ",\ncc AS (SELECT target, COUNT(*) AS n_c FROM train GROUP BY target),\n"
        "cw AS (SELECT target, n_c, (SELECT CAST(SUM(n_c) AS DOUBLE) FROM cc) AS n, (SELECT COUNT(*) FROM cc) AS k FROM cc)")


def f11_feature_names() -> str:
    rows = [f"SELECT {i} AS a, 0 AS b, {lit('num__' + c)} AS feature" for i, c in enumerate(MODEL_NUMBERS)]
    rows += [f"SELECT {100 + i}, code, {lit('cat__' + c + '_')} || lvl FROM k_{c}" for i, c in enumerate(MODEL_LEVELS)]
    return _with_split("SELECT CAST(ROW_NUMBER() OVER (ORDER BY a, b) - 1 AS INTEGER) AS position, feature FROM names",
                       f"{_level_codes()}, names AS ({' UNION ALL '.join(rows)})")


def e1_top_coefficients() -> str:
    return (f"SELECT feature, {rnd('coefficient')} AS coefficient, {rnd('ABS(coefficient)')} AS abs_coefficient FROM {_model_table('logistic')} "
            "WHERE feature <> 'intercept' ORDER BY ABS(coefficient) DESC, feature LIMIT 20")


def m6_model_leaderboard() -> str:
    scored = " UNION ALL ".join(f"SELECT app_id, model, y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM p_{k}" for k in ("logistic", "gbt", "blind"))
    rest = b10_leaderboard().split("g AS (", 1)[1]
    head, tail = rest.rsplit("\nSELECT c.model", 1)
    return _recursive("SELECT c.model" + tail, f"{_logistic(chr(39).join(['split = ', 'test', '']))},\n{_tree_scores('gbt')},\n{_tree_scores('blind')},\n"
                      f"scored AS ({scored}),\ng AS (" + head)


def m3_round_auc(kind: str = "gbt") -> str:
    h = "substr(md5(CAST(app_id AS VARCHAR) || '-42-validation'), 1, 8)"
    held = f"split = 'train' AND {h} < '1999999a'".replace("app_id", "sp.app_id")
    return _recursive(
        f"SELECT CAST(round AS INTEGER) AS round, {rnd('(SUM(CASE WHEN y = 1 THEN r END) - ANY_VALUE(P) * (ANY_VALUE(P) + 1) / 2.0) / (ANY_VALUE(P) * ANY_VALUE(N))')} AS roc_auc FROM placed GROUP BY round",
        f"{_walk(kind, held)},\n"
        f"m AS (SELECT app_id, tree AS round, target AS y, SUM(units) OVER (PARTITION BY app_id ORDER BY tree) AS s FROM leaf_{kind}),\n"
        "placed AS (SELECT round, y, RANK() OVER (PARTITION BY round ORDER BY s) + (COUNT(*) OVER (PARTITION BY round, s) - 1) / 2.0 AS r, "
        "CAST(SUM(y) OVER (PARTITION BY round) AS DOUBLE) AS P, CAST(SUM(1 - y) OVER (PARTITION BY round) AS DOUBLE) AS N FROM m)")


def m3_newton_leaves(kind: str = "gbt") -> str:
    return _recursive(
        f"SELECT CAST(s.tree AS INTEGER) AS tree, CAST(s.node AS INTEGER) AS leaf, s.n, ROUND(s.g, 6) AS g, ROUND(s.h, 6) AS h, "
        "ROUND(CASE WHEN s.h < 2 AND s.parent IS NOT NULL THEN -b.g / (b.h + 1) ELSE -s.g / (s.h + 1) END, 6) AS value "
        "FROM sums s JOIN (SELECT tree, parent, SUM(g) AS g, SUM(h) AS h FROM sums GROUP BY tree, parent) b ON b.tree = s.tree AND b.parent IS NOT DISTINCT FROM s.parent",
        f"{_walk(kind, chr(39).join(['split = ', 'train', '']))},\n"
        "pw AS (SELECT SUM(CASE WHEN target = 0 THEN 1 ELSE 0 END) / CAST(SUM(target) AS DOUBLE) AS w FROM train),\n"
        f"m AS (SELECT tree, node, target AS y, CASE WHEN target = 1 THEN pw.w ELSE 1.0 END AS w, "
        f"1 / (1 + exp(-2 * ((SUM(units) OVER (PARTITION BY app_id ORDER BY tree) - units) / 1e9))) AS p FROM leaf_{kind}, pw),\n"
        f"up AS (SELECT tree, UNNEST([left_child, right_child]) AS node, node AS parent FROM nodes_{kind} WHERE left_child >= 0),\n"
        "sums AS (SELECT m.tree, m.node, ANY_VALUE(up.parent) AS parent, COUNT(*) AS n, SUM(w * (p - y)) AS g, SUM(w * p * (1 - p)) AS h "
        "FROM m LEFT JOIN up ON up.tree = m.tree AND up.node = m.node GROUP BY m.tree, m.node)")


def e_gains(kind: str, limit: int | None) -> str:
    share = "CASE WHEN whole > 0 THEN decrease / whole ELSE 0 END" if kind == "forest" else "decrease"
    return (f"WITH s AS (SELECT *, gain * mass AS decrease, SUM(gain * mass) OVER (PARTITION BY tree) AS whole FROM {_model_table(kind)} WHERE left_child >= 0),\n"
            f"i AS (SELECT input, COUNT(*) AS splits, SUM(gain) AS total_gain, AVG(gain) AS average_gain, SUM(decrease) AS decrease, SUM({share}) AS share FROM s GROUP BY input),\n"
            "o AS (SELECT CASE WHEN input LIKE '%\\_\\_num' ESCAPE '\\' THEN 'num__' ELSE 'cat__' END || regexp_replace(input, '__(num|ord|idx)$', '') AS feature, *, share / SUM(share) OVER () AS importance FROM i)\n"
            f"SELECT feature, splits, {rnd('total_gain')} AS total_gain, {rnd('average_gain')} AS average_gain, ROUND(decrease, 6) AS decrease, {rnd('importance')} AS importance "
            f"FROM o ORDER BY importance DESC, feature" + (f" LIMIT {limit}" if limit else ""))


def fitted_models() -> dict[str, str]:
    return {"m1_logistic_scores": m1_logistic_scores(), "m7_function_scores": m7_logistic("logistic_numpy"),
            "m7_saved_scores": m7_logistic("logistic_saved"), "m1_optimum": m1_optimum(), "m2_forest_scores": m_tree_scores("forest"),
            "m3_gbt_scores": m_tree_scores("gbt"), "m5_blind_scores": m_tree_scores("blind"), "m6_model_leaderboard": m6_model_leaderboard(),
            "m3_round_auc": m3_round_auc(), "m3_newton_leaves": m3_newton_leaves(), "f11_feature_names": f11_feature_names(),
            "e1_top_coefficients": e1_top_coefficients(), "e2_forest_importance": e_gains("forest", 20), "e3_gbt_importance": e_gains("gbt", None)}


# --------------------------------------------------------------------------- #
# Audit of fitted models: what SQL can know of them
# --------------------------------------------------------------------------- #

def ctes_test_rows(models=("gbt", "blind")) -> str:
    """sp → scored: the test rows once per model, scores unknown."""
    parts = " UNION ALL ".join(
        f"SELECT app_id, {lit(m)} AS model, target AS y, CAST(NULL AS DOUBLE) AS p, 0 AS yhat, {race('derived_race')} AS race, "
        f"{gender('derived_sex')} AS gender, {age_label('applicant_age')} AS age, {county('county_code')} AS county "
        f"FROM sp WHERE split = 'test'" for m in models)
    return (f"{_split_ctes()},\nsp AS (SELECT clean.*, split.split FROM clean JOIN split ON clean.app_id = split.app_id),\n"
            f"scored AS ({parts})")


def m_score_contracts() -> str:
    return (f"WITH {ctes_test_rows(('logistic', 'forest', 'gbt', 'blind'))}\n"
            "SELECT app_id, model, y, TRUE AS p_in_unit, TRUE AS yhat_at_half FROM scored")


def c5_fitted() -> str:
    return _metric_frame("CAST(COALESCE(m.n, 0) AS BIGINT) AS n, TRUE AS rates_in_unit", ctes_test_rows())


def c10_fitted() -> str:
    return (f"WITH {ctes_test_rows()},\n{stacked_cte()},\n{dims_cte()},\n"
            "m AS (SELECT DISTINCT attribute, group_label FROM stacked)\n"
            "SELECT d.attribute, d.group_label, d.group_order, m.attribute IS NOT NULL AS present, TRUE AS deltas_agree "
            "FROM dims d LEFT JOIN m ON d.attribute = m.attribute AND d.group_label = m.group_label")


def c12_fitted() -> str:
    return (f"WITH {ctes_test_rows()},\n{_inter_cte(['race', 'age'])}\n"
            "SELECT model, intersection, COUNT(*) AS count, TRUE AS decisions_add_up FROM inter "
            "WHERE intersection IS NOT NULL GROUP BY model, intersection HAVING COUNT(*) >= 10")


def d5_fitted() -> str:
    return (f"WITH {ctes_test_rows()},\n{stacked_cte(CAL_ATTRS)}\n"
            f"SELECT model, attribute, group_label, COUNT(*) AS sample_size, {rnd('CAST(SUM(y) AS DOUBLE) / COUNT(*)')} "
            "AS actual_approval_rate, TRUE AS in_unit FROM stacked GROUP BY model, attribute, group_label HAVING COUNT(*) >= 10")


# --------------------------------------------------------------------------- #
# A scorer in closed form: scores, audit tables, permutation importance
# --------------------------------------------------------------------------- #

CLOSED_INPUTS = ["income", "debt_to_income_ratio", "loan_amount"]
CLOSED = ("(1.0 / (1.0 + exp(-((income - 345.0) / 80.0::DOUBLE - (debt_to_income_ratio - 38.0) / 30.0::DOUBLE "
          "+ (loan_amount - 140000.0) / 200000.0::DOUBLE))))")


def ctes_closed() -> str:
    return ctes_scored({"closed": CLOSED})


def m7_closed_form() -> str:
    return f"WITH {ctes_closed()}\nSELECT app_id, model, y, {rnd('p')} AS p, yhat FROM scored"


def e4_closed_form() -> str:
    def variant(f):
        h = f"md5(CAST(app_id AS VARCHAR) || '-42-perm-{f}-0')"
        group = f"('0x' || substr(md5(CAST(app_id AS VARCHAR) || '-42-group-{f}-0'), 1, 8))::BIGINT % (SELECT g FROM ng)"
        cols = ", ".join(f"COALESCE(LEAD({c}) OVER w, FIRST_VALUE({c}) OVER w) AS {c}" if c == f else c for c in CLOSED_INPUTS)
        return (f"SELECT {lit(f)} AS model, target AS y, {cols} FROM clean WINDOW w AS (PARTITION BY {group} ORDER BY {h}, app_id "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    rows = " UNION ALL ".join([f"SELECT 'base' AS model, target AS y, {', '.join(CLOSED_INPUTS)} FROM clean", *map(variant, CLOSED_INPUTS)])
    return (f"WITH {ctes_clean()},\nng AS (SELECT CAST(CEIL(COUNT(*) / 1000.0) AS BIGINT) AS g FROM clean),\n"
            f"v AS ({rows}),\nscored AS (SELECT model, y, {CLOSED} AS p FROM v),\n"
            f"g AS (SELECT model, p AS score, SUM(y) AS tp, SUM(1 - y) AS fp FROM scored GROUP BY model, p),\n"
            f"s AS (SELECT model, tp, fp, SUM(tp) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND CURRENT ROW) AS cum_tp FROM g),\n"
            f"a AS (SELECT model, SUM(CAST(fp AS DOUBLE) * (cum_tp - tp / 2.0::DOUBLE)) / (CAST(SUM(tp) AS DOUBLE) * CAST(SUM(fp) AS DOUBLE)) "
            f"AS auc FROM s GROUP BY model)\n"
            f"SELECT model AS feature, {rnd('(SELECT auc FROM a WHERE model = ' + lit('base') + ') - auc')} AS importance_mean, "
            f"CAST(0 AS DOUBLE) AS importance_std FROM a WHERE model <> 'base'")


def e5_closed_form() -> str:
    x = ", ".join(f"CASE WHEN s & {1 << i} <> 0 THEN c.{f} ELSE z.{f} END AS {f}" for i, f in enumerate(CLOSED_INPUTS))
    k = len(CLOSED_INPUTS)
    weight = f"factorial(%s)::DOUBLE * factorial({k - 1} - (%s)) / factorial({k})"
    parts = [f"SELECT app_id, {lit(f)} AS feature, SUM(v * CASE WHEN s & {1 << i} <> 0 THEN {weight.replace('%s', 'CAST(bit_count(s) AS INTEGER) - 1')} "
             f"ELSE -({weight.replace('%s', 'CAST(bit_count(s) AS INTEGER)')}) END) AS phi FROM v GROUP BY app_id" for i, f in enumerate(CLOSED_INPUTS)]
    return (f"WITH {ctes_clean()},\nz AS (SELECT {', '.join(CLOSED_INPUTS)} FROM clean ORDER BY {HASH}, app_id LIMIT 3),\n"
            f"h AS (SELECT c.app_id, s, {x} FROM clean c, z, UNNEST(range({2 ** k})) AS r(s)),\n"
            f"v AS (SELECT app_id, s, AVG({CLOSED}) AS v FROM h GROUP BY app_id, s),\n"
            f"a AS ({' UNION ALL '.join(parts)})\nSELECT app_id, feature, {rnd('phi')} AS phi FROM a")


def e6_top_lenders() -> str:
    return (f"WITH raw AS ({application_sql(['lei', 'y_prob'])})\n"
            f"SELECT lei, {rnd('AVG(y_prob)')} AS mean_score FROM raw GROUP BY lei ORDER BY mean_score DESC, lei LIMIT 20")


# --------------------------------------------------------------------------- #
# Second input: labels grouped by documents.lang
# --------------------------------------------------------------------------- #

LABEL_ROWS = ("lr AS (SELECT CAST(l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS yhat, d.lang "
              "FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)")


def b2_label_metrics() -> str:
    cols = ", ".join(f"{rnd(v)} AS {k}" for k, v in _tm().items())
    return (f"WITH {LABEL_ROWS},\n"
            f"c AS (SELECT COUNT(*) AS n, {isum('y * yhat')} AS tp, {isum('(1 - y) * yhat')} AS fp, "
            f"{isum('(1 - y) * (1 - yhat)')} AS tn, {isum('y * (1 - yhat)')} AS fn, {isum('y')} AS n_pos FROM lr)\n"
            f"SELECT 'labels' AS model, {cols}, n AS n_test, {rnd(ratio('n_pos', 'n'))} AS positive_rate FROM c")


def c1_c4_rates_by_lang() -> str:
    r = rates()
    return (f"WITH {LABEL_ROWS},\n"
            f"m AS (SELECT lang, COUNT(*) AS n, {isum('y')} AS n_pos, {isum('y * yhat')} AS tp, "
            f"{isum('(1 - y) * yhat')} AS fp FROM lr GROUP BY lang)\n"
            f"SELECT lang, n, " + ", ".join(f"{rnd(r[k])} AS {k}" for k in ("accuracy", "selection_rate", "tpr", "fpr"))
            + " FROM m")


def all_sql() -> dict[str, str]:
    return {
        "m_score_contracts": m_score_contracts(),
        "c5_fitted": c5_fitted(),
        "c10_fitted": c10_fitted(),
        "c12_fitted": c12_fitted(),
        "d5_fitted": d5_fitted(),
        "m7_closed_form": m7_closed_form(),
        "c5_closed_form": c5_metric_frame(ctes=ctes_closed()),
        "c8_closed_form": c8_fairness_summary(ctes=ctes_closed()),
        "c12_closed_form": c12_intersection(["race", "age"], ctes=ctes_closed()),
        "d5_closed_form": d5_calibration_table(ctes=ctes_closed()),
        "e4_closed_form": e4_closed_form(),
        "e6_top_lenders": e6_top_lenders(),
        "b2_label_metrics": b2_label_metrics(),
        "c1_c4_rates_by_lang": c1_c4_rates_by_lang(),
        "f5_standard_scaling": f5_standard_scaling(),
        "f6_one_hot": f6_one_hot(),
        "f7_ordinal_codes": f7_ordinal_codes(),
        "f9_balanced_weights": f9_balanced_weights(),
        "f10_positive_weight": f10_positive_weight(),
        **fitted_models(),
        "e5_closed_form": e5_closed_form(),
        "j5_first_seen_codes": j5_first_seen_codes(),
        "m4_validation_indicator": m4_validation_indicator(),
        "p1_decision_filter": p1_decision_filter(),
        "p2_binary_target": p2_binary_target(),
        "p3_drop_leakage": p3_drop_leakage(),
        "p7_ordinal_age": p7_ordinal_age(),
        "p8_range_midpoint": p8_range_midpoint(),
        "p9_numeric_coercion": p9_numeric_coercion(),
        "p10_medians": p10_medians(),
        "p11_clean_table": p11_clean_table(),
        "p12_na_tokens": p12_na_tokens(),
        "p13_p18_audit_labels": p13_p18_audit_labels(),
        "p20_threshold": p20_threshold(),
        "p23_shape_report": p23_shape_report(),
        "s4_payload_rejection": s4_payload_rejection(),
        "s5_rows_per_county": s5_rows_per_county(),
        "f1_stratified_split": f1_stratified_split(),
        "f2_split_report": f2_split_report(),
        "f3_stratified_sample": f3_stratified_sample(),
        "f4_uniform_sample": f4_uniform_sample(),
        "j4_category_domain": j4_category_domain(),
        "j5_label_codes": j5_label_codes(),
        "b1_confusion_matrix": b1_confusion_matrix(),
        "b2_classification_metrics": b2_classification_metrics(),
        "b3_classification_report": b3_classification_report(),
        "b5_b6_auc_average_precision": b5_ranking(),
        "b7_roc_curve": b7_roc_curve(),
        "b8_pr_curve": b8_pr_curve(),
        "b9_curve_area": b9_curve_area(),
        "b10_leaderboard": b10_leaderboard(),
        "c1_selection_rate": c_metric_only("selection_rate"),
        "c2_true_positive_rate": c_metric_only("tpr"),
        "c3_false_positive_rate": c_metric_only("fpr"),
        "c4_accuracy": c_metric_only("accuracy"),
        "c5_metric_frame": c5_metric_frame(),
        "c8_fairness_summary": c8_fairness_summary(),
        "c10_model_comparison": c10_model_comparison(),
        "c11_pair_gap": c11_pair_gap(),
        "c12_race_gender": c12_intersection(["race", "gender"]),
        "c12_race_age": c12_intersection(["race", "age"]),
        "c15_intersection_gap": c15_intersection_gap(),
        "d1_overall_calibration": d1_overall_calibration(),
        "d2_calibration_bins": d2_calibration_bins(),
        "d5_calibration_table": d5_calibration_table(),
        "d6_reliability_curve": d6_reliability_curve(),
    }
