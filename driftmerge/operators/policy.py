"""Row-level gate: what a policy rejects takes its whole transaction with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated(changes: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) changes. allowed is judged on each; one refused or unknown change refuses all of its site and version.

    The verdicts are counted by transaction, with partial sums, and joined back, so no transaction is gathered in a task.
    """
    verdict = changes.groupBy(F.col("site_id").alias("_site"), F.col("db_version").alias("_version")).agg(F.min(F.coalesce(allowed, F.lit(False))).alias("_ok"))
    judged = changes.join(verdict, F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("db_version") == F.col("_version")))
    keep = lambda ok: judged.where(F.col("_ok") == ok).select(*changes.columns)
    return keep(True), keep(False)
