"""Rules over a stream: each micro-batch joins the facts so far, and the program runs again to its fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def evaluate_stream(stream: DataFrame, name: str, program: str, store: str, sink: Callable[[dict[str, DataFrame], int], None], tables: dict[str, DataFrame] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that appends each batch to ``store`` (Parquet, one folder a batch, so a repeated batch replaces itself) and hands the outputs to sink."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        engine = Engine(spark)
        for table, df in (tables or {}).items():
            engine.register(table, df)
        engine.register(name, spark.read.schema(stream.schema).parquet(f"{store}/batch=*"))
        sink(engine.run(program), number)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
