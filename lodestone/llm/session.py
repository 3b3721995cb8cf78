"""Session settings the Arrow-batched operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes, so that worker memory doesn't depend on text lengths, and sets a checkpoint folder only where none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    return prepare(spark).sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df.checkpoint() in fewer files than a shuffle has partitions, where that leaves four tasks a core at least."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-shuffle_partitions(df.sparkSession) // 8))).checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """kept(df), planned from then on without the size estimates that led to it: those multiply at every join, and square each time in a loop."""
    done, session = kept(df), df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), session)


def free(name: str, columns: list[str]) -> str:
    """name, lengthened until no column bears it (names are told apart without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the hash of a row's file and its place there, each row's own and the same in every scan.

    What isn't a plain scan of files, perhaps projected or filtered, is written to the shared folder first.
    """
    plan, plain = docs._jdf.queryExecution().analyzed(), True
    while plain and plan.children().size():
        plain = plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1 and plan.deterministic()
        plan = plan.children().apply(0)
    if not plain or not plan.getClass().getSimpleName().startswith("LogicalRelation") or not plan.metadataOutput().size():
        folder = f"{shared_folder(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
        docs.write.parquet(folder)
        docs = docs.sparkSession.read.parquet(folder)
    file, at = free("__file", docs.columns), free("__at", docs.columns)
    return docs.select(*[f"`{c}`" for c in docs.columns], F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)), file, at


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
