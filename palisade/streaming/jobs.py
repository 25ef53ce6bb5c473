"""One scan at a time, and one that can be stopped: a lease file, job tags, and results that are published whole.

A job's claim is a file made by one atomic step in the state folder, so a second start
is refused wherever it comes from. Its Spark jobs carry the job's tag, by which another
thread or session of the application interrupts them. What the job computes becomes current only
at its end (state.replaced), so a stopped or failed job leaves the old state readable.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.sources import state

RUNNING, COMPLETED, CANCELLED, FAILED = "running", "completed", "cancelled", "failed"


class ScanRunning(RuntimeError):
    """Another job holds the lease."""


class ScanCancelled(RuntimeError):
    """The job was asked to stop."""


class ScanJobs:
    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark, self.dir = spark, f"{state_dir.rstrip('/')}/jobs"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was made here; False where it is there already."""
        store, path = self._path(name)
        store.mkdirs(path.getParent())
        jvm = self.spark._jvm
        try:
            if store.getScheme() == "file":  # the local store checks and creates in two steps
                jvm.java.nio.file.Files.write(jvm.java.nio.file.Paths.get(path.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), bytearray(text.encode()), self._new_only())
            else:
                out = store.create(path, False)
                out.write(bytearray(text.encode()))
                out.close()
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def _new_only(self):
        options = self.spark._jvm.java.nio.file.StandardOpenOption
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.nio.file.OpenOption, 2)
        array[0], array[1] = options.CREATE_NEW, options.WRITE
        return array

    def _read(self, name: str) -> dict | None:
        store, path = self._path(name)
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text else {}

    def _write(self, name: str, value: dict) -> None:
        state.put_text(self.spark, f"{self.dir}/{name}", json.dumps(value))

    def _delete(self, name: str) -> None:
        store, path = self._path(name)
        store.delete(path, False)

    def active(self) -> dict | None:
        """The job that holds the lease."""
        return self._read("lease")

    def progress(self) -> dict:
        """job_id, month, status, started_at, finished_at, error of the last job that began."""
        return self._read("progress") or {"status": "idle"}

    def cancel(self) -> bool:
        """Ask the active job to stop and interrupt what it runs; False without one."""
        job = self.active()
        if not job:
            return False
        self._create(f"cancel-{job['job_id']}", "")
        self.spark.sparkContext.cancelJobsWithTag(job["job_id"])
        return True

    def cancel_requested(self, job_id: str) -> bool:
        store, path = self._path(f"cancel-{job_id}")
        return store.exists(path)

    def release_stale(self, older_than_seconds: float) -> bool:
        """Free the lease of a job that died with its driver: one that began so long ago."""
        job = self.active()
        if job is None or time.time() - job.get("began", 0) < older_than_seconds:
            return False
        self._delete("lease")
        return True

    def run(self, month: str, work: Callable[[Callable[[], None]], DataFrame], target: str) -> str:
        """The version of target that holds work's result. work gets a function to call between steps, which raises once a stop is asked for.

        Raises ScanRunning where a job is active, ScanCancelled where this one was stopped.
        """
        job_id = f"scan-{uuid.uuid4().hex}"
        now = lambda: datetime.datetime.now(datetime.UTC).isoformat()
        if not self._create("lease", json.dumps({"job_id": job_id, "month": month, "began": time.time()})):
            raise ScanRunning("A scan is already running.")
        told = {"job_id": job_id, "month": month, "started_at": now(), "finished_at": "", "error": ""}

        def step() -> None:
            if self.cancel_requested(job_id):
                raise ScanCancelled(job_id)

        self.spark.sparkContext.addJobTag(job_id)
        try:
            self._write("progress", told | {"status": RUNNING})
            result = work(step)
            step()
            version = state.replaced(result, target, before_swap=step)
            told |= {"status": COMPLETED}
            return version
        except Exception as error:
            stopped = self.cancel_requested(job_id)
            told |= {"status": CANCELLED if stopped else FAILED, "error": "" if stopped else str(error)[:500]}
            if stopped and not isinstance(error, ScanCancelled):
                raise ScanCancelled(job_id) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(job_id)
            self._write("progress", told | {"finished_at": now()})
            self._delete("lease")
            store, path = self._path(f"cancel-{job_id}")
            store.delete(path, False)
