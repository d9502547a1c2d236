"""A queue of trials as a stream: files of trials come in, results are appended.

The one place where several workers share work; a file source keeps which files were seen in its checkpoint, so a restarted worker goes
on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

TRIAL = "exp_key string, trial_id long, params map<string,double>"
RESULT = "exp_key string, trial_id long, status string, loss double, message string"
LOG = "exp_key string, trial_id long, event string, message string"


def watch(spark: SparkSession, folder: str, results: str, checkpoint: str, handle: Callable[[dict], float], seconds: int = 1, once: bool = False, log: str | None = None) -> StreamingQuery:
    """Handle each trial that appears as JSON in ``folder``; append its loss, or why it failed, to ``results``.

    ``log``: a folder to which a row is appended when a trial starts, and one when it ends.

    A batch is one file of trials, and trials are few; each starts jobs of its own, so they run on the driver in turn.
    """
    trials = spark.readStream.schema(TRIAL).option("maxFilesPerTrigger", 1).json(folder)

    def run(batch: DataFrame, _: int) -> None:
        out = []

        def note(row, event: str, message: str | None = None) -> None:
            if log:
                batch.sparkSession.createDataFrame([(row.exp_key, row.trial_id, event, message)], LOG).coalesce(1).write.mode("append").json(log)

        for row in batch.toLocalIterator():
            note(row, "start")
            try:
                out.append((row.exp_key, row.trial_id, "ok", float(handle(dict(row.params))), None))
            except Exception as e:  # a failed trial is a result; the queue goes on
                out.append((row.exp_key, row.trial_id, "fail", None, f"{type(e).__name__}: {e}"))
            note(row, out[-1][2], out[-1][4])
        if out:
            batch.sparkSession.createDataFrame(out, RESULT).coalesce(1).write.mode("append").json(results)

    writer = trials.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
