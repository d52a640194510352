"""Documents that arrive as files in a landing folder (Structured Streaming): appended chunks, or an index kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as tx
from lexmill.operators import chunking
from lexmill.operators.chunking import ChunkConfig
from lexmill.plans.app import STREAM, Lexmill

#: What a landing folder of changes holds; ``deleted`` ends a document, a higher ``version`` replaces a lower one.
CHANGES = "rel_path string, language string, text string, deleted boolean, version long"


def chunk_stream(documents: DataFrame, key: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of a stream of documents (key, text, language): a map, so it needs no state."""
    cut = chunking.chunk_documents(documents, key, config)
    return cut.withColumn("search_text", tx.search_text(F.col("symbol"), F.col("text")))


def index_landing(spark: SparkSession, landing: str, schema: str, key: str, chunks_path: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Append the chunks of every new Parquet file of ``landing``, exactly once, then stop when
    all that is there has been taken."""
    stream = spark.readStream.schema(schema).parquet(landing)
    return chunk_stream(stream, key, config).writeStream.format("parquet").option("path", chunks_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_index(app: Lexmill, landing: str, root_id: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Keep the documents of ``root_id`` in the index as the changes (``CHANGES``) in a landing folder say.

    Each micro-batch is one segment, and the number of the batch is committed with it in one step: a batch that is
    run again after a failure, whether before or after its commit, changes nothing twice.  Batches are of bounded
    size and come in the order of their files; inside a batch the highest version counts."""
    spark, key = app.spark, f"{STREAM}{root_id}"

    def upsert(batch: DataFrame, number: int) -> None:
        if number > int(app.store.current().meta.get(key, "-1")):
            app.ingest(batch, root_id, {key: str(number)})

    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_at_once).parquet(landing)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
