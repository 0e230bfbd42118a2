"""Files that arrive in a landing folder, extracted and put into the graph micro-batch by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcloom.extract.sources import extract
from srcloom.operators.dedup import last_wins
from srcloom.sources.files import parser_of
from srcloom.sources.graph_store import GraphStore

LANDING = "path string, content string, version long"


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON rows (path, content, version) from ``folder``; a null content says that the file has gone."""
    return spark.readStream.schema(LANDING).json(folder)


def ingest(files: DataFrame, store: str, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Keeps the graph at ``store``, a ``GraphStore``.

    Of each file the highest version counts, in a batch and over batches.  What a new version no longer declares goes,
    and all of a file that has gone.  A batch rewrites the buckets that it touches, so nothing piles up but older
    generations, which ``compact`` deletes after each batch; a batch that is replayed leaves the same rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        latest = last_wins(batch.where("path IS NOT NULL").withColumn("version", F.coalesce("version", F.lit(0))), ["path"], ["version", "content"]).persist()
        try:
            own = GraphStore(batch.sparkSession, store)
            needed = [r[0] for r in latest.select(parser_of(F.col("path"))).distinct().collect() if r[0]]  # one of each language at most
            own.replace_files(latest.select("path", "version"), *extract(latest.select("path", "content"), needed))
            if compact:
                own.vacuum()
        finally:
            latest.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).queryName(f"ingest-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The graph's nodes or rels as they are now."""
    return getattr(GraphStore(spark, store), name).read()
