"""The endless question loop as a Structured Streaming query.

Each utterance is answered on its own (no state, no watermark): every
micro-batch runs the batch retriever chat in ``foreachBatch``.  Ranking per utterance is not allowed inside a streaming
plan, hence ``foreachBatch``.  The search side (answers and stored vectors) is opened once, before the stream
starts; a micro-batch encodes its utterances only.

A micro-batch writes its replies to a folder of its own and then a manifest row that names it.  Only what a complete
manifest names counts, so a batch that is replayed after a loss is either known already (and skipped) or answered
anew; a sink without any manifest reads as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chat import Served, chat_retriever, serve
from ..session import materialise, shared_dir
from ..sources.stores import complete_folders
from ..sources.tables import turn_id

UTTERANCE_SCHEMA = "conv_id long, turn long, role string, text string"
# Input files of a micro-batch, in bytes: a micro-batch reads the whole search side, so many small files are answered at once.
TRIGGER_BYTES = 256 << 20
REPLY_SCHEMA = "utt_id long, pid long, score double, reply string"


def utterance_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """S6 as a stream: user turns of conversation Parquet files arriving in ``source_dir``.

    A micro-batch takes ``max_files_per_trigger`` files; if ``max_bytes_per_trigger`` is given, files of so many bytes in all
    (one at least) instead.
    """
    bound = ("maxBytesPerTrigger", max_bytes_per_trigger) if max_bytes_per_trigger else ("maxFilesPerTrigger", max_files_per_trigger)
    raw = spark.readStream.schema(UTTERANCE_SCHEMA).option(*bound).parquet(source_dir)
    return raw.where(F.col("role") == "user").select(
        turn_id().alias("utt_id"), "text")


def run_chat_stream(spark: SparkSession, stream: DataFrame, pairs: DataFrame | Served, encoder, name: str,
                    sink: str | None = None, processing_time: str | None = None):
    """Answer the utterances of a stream.

    Default: everything available now, then stop, and return the sink path.
    With ``processing_time`` (e.g. ``"10 seconds"``) the query keeps running
    and the ``StreamingQuery`` is returned instead.
    """
    sink = sink or shared_dir(spark, "streams", name, "replies")
    checkpoint = shared_dir(spark, "streams", name, "checkpoint")

    side = pairs if isinstance(pairs, Served) else serve(materialise(pairs, "answers"), encoder)

    def answer(batch: DataFrame, batch_id: int) -> None:
        manifest = f"{sink}/manifest/{batch_id:010d}"
        if manifest in complete_folders(spark, f"{sink}/manifest"):
            return  # a replay of a batch whose replies are there
        folder = f"{batch_id:010d}-{uuid.uuid4().hex}"
        chat_retriever(batch, side, encoder).write.parquet(f"{sink}/replies/{folder}")
        # an incomplete manifest of a lost attempt is not read by anybody
        batch.sparkSession.createDataFrame([(batch_id, folder)], "batch long, folder string").coalesce(1).write.mode("overwrite").parquet(manifest)

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return sink


def read_replies(spark: SparkSession, sink: str) -> DataFrame:
    """Replies of all complete micro-batches; none yet: an empty table."""
    manifests = complete_folders(spark, f"{sink}/manifest")
    if not manifests:
        return spark.createDataFrame([], REPLY_SCHEMA)
    named = spark.read.schema("batch long, folder string").parquet(*manifests).collect()  # a row a micro-batch
    return spark.read.schema(REPLY_SCHEMA).parquet(*[f"{sink}/replies/{r['folder']}" for r in named])
