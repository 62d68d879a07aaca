"""Reports and gates over rule results; only the rows of one report reach the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from netsluice.session import stored

# --- fixed values: the keys of an exported rule result -------------------------------
EXPORTED = ["rule_name", "category", "passed", "message", "details", "severity"]


class QualityReport:
    """The rule rows of one stage, in the rules' order, with the time at which they were judged.

    A failed rule of severity ``warning`` does not fail the report.
    """

    def __init__(self, rows: Iterable[Row], judged: datetime | None = None):
        self.results = tuple(sorted(rows, key=lambda r: r["position"]))
        self.stage = self.results[0]["stage"] if self.results else ""
        self.timestamp = (judged or datetime.now(timezone.utc)).isoformat()
        failed = [r for r in self.results if not r["passed"]]
        self.total_rules, self.failed_rules = len(self.results), len(failed)
        self.passed_rules = self.total_rules - self.failed_rules
        self.passed = not any(r["severity"] == "error" for r in failed)

    def failures(self) -> list[str]:
        return [r["rule_name"] for r in self.results if not r["passed"]]

    def summary(self) -> str:
        """Status, time and counts, then a line per rule."""
        lines = [f"Quality of {self.stage}: {'PASSED' if self.passed else 'FAILED'}"]
        lines.append(f"at {self.timestamp}, {self.passed_rules}/{self.total_rules} rules passed")
        for r in self.results:
            mark = "ok" if r["passed"] else "warn" if r["severity"] == "warning" else "FAIL"
            lines.append(f"  {mark:4} {r['category']}/{r['rule_name']}: {r['message']}")
        return "\n".join(lines)

    def to_dict(self) -> dict:
        counts = {k: getattr(self, k) for k in ("stage", "timestamp", "passed", "total_rules", "passed_rules", "failed_rules")}
        return counts | {"results": [{k: r[k] for k in EXPORTED} | {"details": dict(r["details"] or {})} for r in self.results]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


class DataQualityError(Exception):
    """A gate found error-severity failures; carries the report."""

    def __init__(self, report: QualityReport):
        self.report = report
        super().__init__(report.summary())


def report_rows(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summary of rule results as a table: totals and the overall verdict per stage."""
    hard = ~F.col("passed") & (F.col("severity") == "error")
    return results.groupBy(*by, "stage").agg(
        (F.count(F.when(hard, 1)) == 0).alias("passed"),
        F.count(F.lit(1)).cast("int").alias("total_rules"),
        F.count(F.when(F.col("passed"), 1)).cast("int").alias("passed_rules"),
        F.count(F.when(~F.col("passed"), 1)).cast("int").alias("failed_rules"),
    )


def collect_report(results: DataFrame) -> QualityReport:
    """Run the rules and bring their verdicts, one row per rule, to the driver."""
    return QualityReport(results.collect())


def gate(results: DataFrame) -> QualityReport:
    """Run the rules; raise with the report if an error-severity rule failed."""
    report = collect_report(results)
    if not report.passed:
        raise DataQualityError(report)
    return report


def gate_each(results: DataFrame, by: str) -> DataFrame:
    """Gate every group of a grouped run, such as one per file; the first failing one in order raises.

    The verdicts stay in a table, which is returned; only the failing group's rows are fetched.
    """
    judged = stored(results, "verdicts")
    first = judged.where(~F.col("passed") & (F.col("severity") == "error")).agg(F.min(by)).first()[0]
    if first is not None:
        raise DataQualityError(collect_report(judged.where(F.col(by) == first)))
    return judged
