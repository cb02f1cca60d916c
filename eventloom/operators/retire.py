"""Retention as a job: rotated segments beyond the newest ones are deleted under a journal.

A sink folder holds ``target=…/segment=<number>/`` folders. The journal is two Parquet tables, ``planned`` and ``done``;
what is planned and not done yet is deleted by the next call, so a job that stops half-way is finished later, and
deleting a folder that is gone changes nothing.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from eventloom.operators.rotation import DEFAULT_MAX_FILES, retention
from eventloom.sources.paths import located

PLANNED = "run string, target string, segment bigint, path string"
DONE = f"{PLANNED}, outcome string"
_SEGMENT = r"^(.*/target=([^/]*)/segment=(\d+))/[^/]+$"
#: Segment folders that one task deletes, about.
FOLDERS_A_TASK = 500


def list_segments(spark, folder: str) -> DataFrame:
    """Segments below ``folder``: target (as its folder is named), segment, path, files, bytes. File contents are not read.

    Other files, hidden ones and segments that aren't named by a number are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    part = [F.regexp_extract("path", _SEGMENT, i) for i in (1, 2, 3)]
    return found.filter(F.col("path").rlike(_SEGMENT)) \
        .select(part[0].alias("path"), part[1].alias("target"), F.expr(f"try_cast({_sql(3)} as bigint)").alias("segment"), "length") \
        .filter(F.col("segment").isNotNull()) \
        .groupBy("target", "segment", "path").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _sql(group: int) -> str:
    return f"regexp_extract(path, r'{_SEGMENT}', {group})"


def _journal(spark, journal: str, name: str, schema: str) -> str:
    path = f"{journal.rstrip('/')}/{name}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return path


def plan_retirement(spark, folder: str, journal: str, max_files: int = DEFAULT_MAX_FILES) -> str:
    """Write down the segments that retention marks for deletion, those of open plans left out; the run's name."""
    planned = _journal(spark, journal, "planned", PLANNED)
    run = uuid.uuid4().hex
    marked = retention(list_segments(spark, folder), "target", ["segment", "path"], max_files).filter("action = 'delete'")
    marked.join(pending(spark, journal).select("path"), "path", "left_anti") \
        .select(F.lit(run).alias("run"), "target", "segment", "path").write.mode("append").parquet(planned)
    return run


def pending(spark, journal: str) -> DataFrame:
    """Planned deletions that no finished job has reported."""
    planned = spark.read.schema(PLANNED).parquet(_journal(spark, journal, "planned", PLANNED))
    done = spark.read.schema(DONE).parquet(_journal(spark, journal, "done", DONE))
    return planned.join(done.select("run", "path"), ["run", "path"], "left_anti").select("run", "target", "segment", "path")


def apply_pending(spark, journal: str) -> None:
    """Delete the folders of all pending rows, in parallel, and report each as ``deleted`` or ``absent``."""
    def delete(batches):
        for pdf in batches:
            outcomes = []
            for path in pdf["path"]:
                files, name = located(path)
                there = files.get_file_info(name).type == fs.FileType.Directory
                if there:
                    try:
                        files.delete_dir(name)
                    except FileNotFoundError:                    # another try of this task was faster
                        there = False
                outcomes.append("deleted" if there else "absent")
            yield pd.DataFrame({**{c: pdf[c] for c in ("run", "target", "segment", "path")}, "outcome": outcomes})

    rows = pending(spark, journal)
    tasks = max(1, -(-rows.count() // FOLDERS_A_TASK))
    rows.repartition(tasks, "path").mapInPandas(delete, DONE).write.mode("append").parquet(_journal(spark, journal, "done", DONE))


def retire(spark, folder: str, journal: str, max_files: int = DEFAULT_MAX_FILES) -> DataFrame:
    """Finish open plans, then delete all but the newest ``max_files - 1`` segments of every target.

    Returns the rows of this run's plan: run, target, segment, path, outcome. Segment numbers must grow: a number that
    was deleted is not used again while its plan is open. One job at a time works on a journal, which lies outside the folder.
    """
    apply_pending(spark, journal)
    run = plan_retirement(spark, folder, journal, max_files)
    apply_pending(spark, journal)
    return spark.read.schema(DONE).parquet(f"{journal.rstrip('/')}/done").filter(F.col("run") == run)
