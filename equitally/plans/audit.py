"""Audit plan: cleaned, scored applications → cells → every audit table.

The scored rows are scanned once into the cell table; the group, summary,
comparison, intersectional and calibration tables are all roll-ups of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from equitally.operators.calibration import calibration_bins, calibration_table, reliability_curve
from equitally.operators.cells import audit_cells, audit_rows, scored_audit_rows
from equitally.operators.clean import clean_applications
from equitally.operators.fairness import (
    fairness_summary,
    group_metrics,
    intersectional_gap,
    intersectional_metrics,
    model_comparison,
    pair_gap,
)
from equitally.session import checkpoint_dir
from equitally.sources.fixtures import application_view
from equitally.sources.schema import THRESHOLD

STANDIN_SCORES = {"full": "y_prob", "blind": "y_prob_blind"}


_CLEANED: dict = {}


def cleaned_applications(spark: SparkSession, sf_dir: str, exact_median: bool = True,
                         reuse: bool = True) -> DataFrame:
    """Stand-in raw applications of ``sf_dir`` through the cleaning operators.

    Cleaned once per session and table folder (the cleaned rows live as
    Parquet in the checkpoint folder), then reused by every audit, split and
    model step — clean once, audit many.  ``reuse=False`` recleans.
    """
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, exact_median)
    if reuse and key in _CLEANED:
        return _CLEANED[key]
    cleaned = clean_applications(application_view(spark, sf_dir), exact_median=exact_median)
    _CLEANED[key] = cleaned
    return cleaned


def cells_for(cleaned: DataFrame, scores: str | dict[str, str] = "y_prob",
              threshold: float = THRESHOLD) -> DataFrame:
    """Cell table of a cleaned, scored table (one shuffle of row data)."""
    return audit_cells(audit_rows(cleaned, scores, threshold=threshold))


@dataclass
class AuditReport:
    cells: DataFrame
    group_metrics: DataFrame
    summary: DataFrame
    comparison: DataFrame | None
    race_gender: DataFrame
    race_age: DataFrame
    calibration: DataFrame
    calibration_bins: DataFrame
    reliability: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if v is not None}


def audit_report(scored: DataFrame, scores: str | dict[str, str] | None = "y_prob", champion: str | None = None,
                 blind: str | None = None, threshold: float = THRESHOLD) -> AuditReport:
    """Every audit table for ``scored``; the cell table is computed once and
    checkpointed to the shared folder (it is bounded by the label domains),
    so the roll-ups never rescan or re-plan the scored rows.

    ``scores`` names probability columns; ``None`` takes the long output of
    ``models.score`` (with ``LABEL_SOURCES`` kept) as it is, whatever its models.
    """
    checkpoint_dir(scored.sparkSession)
    cells = audit_cells(scored_audit_rows(scored)) if scores is None else cells_for(scored, scores, threshold)
    cells = cells.checkpoint(eager=True)
    model = champion if champion is not None else (next(iter(scores)) if isinstance(scores, dict) else None)
    comparison = None
    if blind is not None and model is not None:
        comparison = model_comparison(cells, full=model, blind=blind)
    return AuditReport(
        cells=cells,
        group_metrics=group_metrics(cells, model=model),
        summary=fairness_summary(cells, model=model),
        comparison=comparison,
        race_gender=intersectional_metrics(cells, ["race", "gender"], model=model),
        race_age=intersectional_metrics(cells, ["race", "age"], model=model),
        calibration=calibration_table(cells, model=model),
        calibration_bins=calibration_bins(cells, model=model),
        reliability=reliability_curve(cells, model=model),
    )


__all__ = ["STANDIN_SCORES", "cleaned_applications", "cells_for", "AuditReport", "audit_report",
           "pair_gap", "intersectional_gap"]


def write_audit_reports(report: AuditReport, out_dir: str, include_cells: bool = True) -> list[str]:
    """Write every audit table under ``out_dir``.

    Report tables are bounded by the label domains, so each goes out as one
    header CSV file; the cell table, from which every
    report can be recomputed or merged with other runs, goes out as Parquet.
    """
    from equitally.sources.sinks import write_parquet, write_report_csv

    written = []
    for name, table in report.tables().items():
        path = f"{out_dir.rstrip('/')}/{name}"
        if name == "cells":
            if include_cells:
                write_parquet(table, path)
                written.append(path)
            continue
        write_report_csv(table, path, single_file=True)
        written.append(path)
    return written
