"""Written intermediate tables in the folder that driver and executors share, and the code that executors need."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.shared import new_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of the written files, not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, which nothing may read any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_shipped: set[str] = set()


#: Rows of a batch that goes to a Python worker, where the session has Spark's default of 10000: texts are long.
BATCH_ROWS = "2000"
#: Bytes of such a batch.
BATCH_BYTES = str(16 << 20)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and keep batches of texts small.

    Spark reads the sizes of batches when a plan runs, which is after the operator has returned it. So they stay set
    in the session; a session that sets another ``maxRecordsPerBatch`` than Spark's default keeps its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    work = Path(tempfile.mkdtemp(prefix="trivane-code-"))
    shutil.copytree(package, work / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(work / "trivane_code"), "zip", work / "code")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def bucket_count(docs: DataFrame, column: str = "text", each: int = 16 << 20) -> int:
    """How many buckets a hash exchange of the words of ``column`` needs.

    About one for each ``each`` bytes of text, so that a bucket's arrays fit in a task at any size of input,
    and at least twice the shuffle partitions, so that the tasks are even.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return max(2 * partitions, total // each + 1)


#: Stands for a null id inside packed arrays; no document may have it.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as (id, tag, text), where rows of the same id and tag have the same text.

    ``id`` is ``doc_id`` as long, NO_ID for null. ``tag`` is 0 where no doc_id repeats, else a hash of the text.
    """
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    repeats = held.groupBy("id").count().filter("count > 1").limit(1).count()
    return held.select("id", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("tag"), "text")
