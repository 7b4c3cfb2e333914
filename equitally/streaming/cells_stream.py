"""Incremental audit over a stream of scored decisions.

The audit cells are additive, so Structured Streaming can keep them as
aggregation state: each micro-batch of newly scored rows updates the cell
counts, and every audit table is a roll-up of the current cells.  The state
is bounded by the label domains times the bins (a few thousand cells), not by
the number of rows that have streamed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from equitally.operators.cells import audit_cells, audit_rows
from equitally.session import checkpoint_dir
from equitally.sources.schema import THRESHOLD


def scored_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 16) -> DataFrame:
    """Scored rows arriving as Parquet files in ``path`` (file source)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def streaming_cells(stream: DataFrame, scores: str | dict[str, str] = "y_prob",
                    threshold: float = THRESHOLD) -> DataFrame:
    """The audit-cell aggregation applied to a streaming DataFrame."""
    return audit_cells(audit_rows(stream, scores, threshold=threshold))


def start_cells_query(cells: DataFrame, checkpoint_location: str, sink: str = "memory",
                      query_name: str = "audit_cells", path: str | None = None,
                      foreach_batch=None, trigger_seconds: int | None = None) -> StreamingQuery:
    """Run the cell aggregation in ``complete`` mode.

    ``checkpoint_location`` keeps offsets and state in a shared folder so the
    query restarts where it stopped after a failure.  With ``foreach_batch``
    each epoch's full cell table is handed to a function (for example one
    that writes the audit roll-ups); otherwise the cells go to ``sink``.
    """
    w = cells.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_location)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    if sink == "memory":
        return w.format("memory").queryName(query_name).start()
    return w.format(sink).option("path", path).start()


def rollup_writer(out_dir: str, champion: str | None = None, blind: str | None = None):
    """A ``foreachBatch`` function that rewrites every audit roll-up from the
    epoch's complete cell table (bounded size), so the reports under
    ``out_dir`` always reflect all rows streamed so far."""
    from equitally.plans.audit import AuditReport, write_audit_reports
    from equitally.operators.calibration import calibration_bins, calibration_table, reliability_curve
    from equitally.operators.fairness import (
        fairness_summary,
        group_metrics,
        intersectional_metrics,
        model_comparison,
    )

    def write(cells: DataFrame, epoch_id: int) -> None:
        checkpoint_dir(cells.sparkSession)
        cells = cells.repartition(1).checkpoint(eager=True)
        report = AuditReport(
            cells=cells,
            group_metrics=group_metrics(cells, model=champion),
            summary=fairness_summary(cells, model=champion),
            comparison=model_comparison(cells, full=champion, blind=blind) if (champion and blind) else None,
            race_gender=intersectional_metrics(cells, ["race", "gender"], model=champion),
            race_age=intersectional_metrics(cells, ["race", "age"], model=champion),
            calibration=calibration_table(cells, model=champion),
            calibration_bins=calibration_bins(cells, model=champion),
            reliability=reliability_curve(cells, model=champion),
        )
        write_audit_reports(report, f"{out_dir.rstrip('/')}/latest")

    return write
