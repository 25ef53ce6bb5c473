"""One object for what a user asks of an evidence folder: months, logs, tree, report, verdicts, settings, progress.

Every method returns DataFrames or small values and runs the plans of
palisade.plans; state lives in versioned tables below the state folder, every
change is audited, and reads see the old or the new version, never part of one.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.lineage import cut
from palisade.operators import checklist, explore, paths
from palisade.plans import inventory, report
from palisade.sources import evidence, listing, state
from palisade.sources.workbook import WorkbookSource
from palisade.streaming.jobs import ScanJobs

VERDICTS = "path string, content_sha256 string, verdict string, reviewer string, reason string, at timestamp"
SETTINGS = "engine string, value string, at timestamp"
NO_CHECKLIST = "No valid checklist workbook was found for this month."
MOST_REVIEWER, MOST_REASON = 128, 1000


class Workspace:
    def __init__(self, spark: SparkSession, root: str, state_dir: str):
        self.spark, self.root, self.state_dir = spark, root.rstrip("/"), state_dir.rstrip("/")
        spark.dataSource.register(WorkbookSource)
        self.jobs = ScanJobs(spark, state_dir)

    # state: append-only logs, latest row wins

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.state_dir}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, row: tuple, event: str, actor: str, **details: str) -> None:
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        self.spark.createDataFrame([(*row, now)], schema).write.mode("append").parquet(f"{self.state_dir}/{name}")
        self._audited(event, actor, **details)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state_dir}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _audited(self, event: str, actor: str, **details: str) -> None:
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        state.append_audit(self.spark.createDataFrame([(now, event, actor, details)], "ts timestamp, event string, actor string, details map<string,string>"), f"{self.state_dir}/audit")

    def thresholds(self) -> dict[str, float | str]:
        stored = {r.engine: r.value for r in state.latest(self._log("settings", SETTINGS), "engine", "at").collect()}  # one row a setting
        return state.DEFAULT_THRESHOLDS | {"ocr_strictness": "high"} | {k: v if k == "ocr_strictness" else float(v) for k, v in stored.items()}

    def set_threshold(self, engine: str, value, actor: str = "operator") -> None:
        one = self.spark.createDataFrame([(engine, str(value))], "e string, v string")
        if not one.select(state.valid_threshold(F.col("e"), F.col("v")).alias("ok")).first().ok:
            raise ValueError(f"Invalid {engine} threshold.")
        before = self.thresholds().get(engine)
        self._append("settings", SETTINGS, (engine, str(value)), "thresholds.updated", actor, engine=engine, before=str(before), after=str(value))

    def verify(self, path: str, verdict: str, reviewer: str, reason: str = "") -> None:
        """safe, unsafe or clear; bound to the bytes the file has now."""
        if verdict not in ("safe", "unsafe", "clear") or len(reviewer) > MOST_REVIEWER or len(reason) > MOST_REASON:
            raise ValueError("Invalid verdict.")
        found = self.files(path.split("/", 1)[0]).where(F.col("path") == path).select(F.sha2("content", 256).alias("h")).first()
        if found is None:
            raise FileNotFoundError(path)
        self._append("verdicts", VERDICTS, (path, found.h, verdict, reviewer, reason), "verification.changed", reviewer, path=path, verdict=verdict)

    def verdicts(self) -> DataFrame:
        return state.latest(self._log("verdicts", VERDICTS), "path", "at", F.col("verdict") == "clear")

    def audit(self) -> DataFrame:
        return state.read_audit(self.spark, f"{self.state_dir}/audit")

    # evidence

    def files(self, month: str) -> DataFrame:
        return evidence.evidence_files(self.spark, self.root, months=[month]).where(F.startswith("path", F.lit(f"{month}/")))

    def months(self) -> list[str]:
        """Month folders with evidence, newest first."""
        return [r.month for r in paths.months(listing.listed(self.spark, self.root).where("length > 0")).collect()]  # one row a month

    def checklist(self, month: str) -> tuple[DataFrame | None, str]:
        """Cells of the month's workbook, never of another month's, and why there are none.

        A workbook is parsed once: its cells, or the reason that it can't be read, are kept under the hash of its bytes.
        """
        found = self.files(month).where(F.rlike("path", F.lit(r"(?i)\.xls[xm]$"))).select("path", F.sha2("content", 256).alias("hash"), F.lit(0).alias("mtime"), F.lit(0).alias("length"))
        books, reason = cut(found), NO_CHECKLIST
        while (best := checklist.workbook_choice(books).first()) is not None:  # one month, so one row; the next best where a book can't be read
            digest = books.where(F.col("path") == best.path).first().hash
            cells = self._cells(best.path, digest)
            error = cells.where("error is not null").select("error").first()
            if error is None:
                return cells.select("sheet", "sheet_pos", "row", "cells"), ""
            reason, books = error.error, books.where(F.col("path") != best.path)
        return None, reason

    def _cells(self, path: str, digest: str) -> DataFrame:
        folder = f"{self.state_dir}/checklists/{digest}"
        if state.current(self.spark, folder) is None:
            state.replaced(self.spark.read.format("workbook").load(f"{self.root}/{path}").drop("path"), folder)
        return self.spark.read.parquet(state.current(self.spark, folder))

    def cells(self, month: str) -> DataFrame | None:
        return self.checklist(month)[0]

    def system_tree(self, month: str) -> DataFrame:
        cells, reason = self.checklist(month)
        if cells is None:
            raise ValueError(reason)
        return checklist.expected_tree(checklist.checklist_rows(cells))

    def logs(self, month: str, **tables: DataFrame) -> dict[str, DataFrame]:
        """The month's payload as tables; tables may hold pages and tokens from extractors."""
        settings = self.thresholds()
        strictness = settings.pop("ocr_strictness")
        return inventory.monthly(self.files(month), self.cells(month), self.verdicts(), thresholds=settings, strictness=strictness, **tables)

    def scan(self, month: str, **tables: DataFrame) -> str:
        """Make the month's entries current below state/entries: one scan at a time, and cancel_scan() leaves the entries of the last."""

        def work(step) -> DataFrame:
            step()
            return self.logs(month, **tables)["entries"].drop("pdf_names")

        return self.jobs.run(month, work, f"{self.state_dir}/entries/{month}")

    def cancel_scan(self) -> bool:
        return self.jobs.cancel()

    def scanned(self, month: str) -> DataFrame | None:
        """The entries of the month's last whole scan."""
        version = state.current(self.spark, f"{self.state_dir}/entries/{month}")
        return None if version is None else self.spark.read.parquet(version)

    def clear_caches(self, actor: str = "operator") -> None:
        """Forget parsed workbooks; audited."""
        self._remove("checklists")
        self._audited("cache.cleared", actor)

    def report(self, month: str, **tables: DataFrame) -> str:
        found, settings = self.logs(month, **tables), self.thresholds()
        rows = self.spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "engine string, value string")
        shown = report.report_tables(found["entries"], found["missing"], found["reconciliation"], rows)
        return report.monthly_html(month, found["summary"], shown, zero_confidence=float(settings["zero_threat_confidence"]), checklist_error=self.checklist(month)[1])

    def summary_of(self, path: str) -> str:
        """The text of one file, cut for display."""
        one = self.files(path.split("/", 1)[0]).where((F.col("path") == path) & paths.accepted(F.col("path")))
        found = evidence.decoded_text(one.select(F.col("path").alias("source_id"), "content")).first()
        if found is None:
            raise FileNotFoundError(path)
        return report.text_summary(found.text)

    def review_queue(self, month: str) -> DataFrame:
        return explore.ai_review_queue(self.logs(month)["entries"])
