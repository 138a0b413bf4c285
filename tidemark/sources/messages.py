"""Message sources: JSON values from Kafka, or from files in the same shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timefns import as_utc_ntz
from tidemark.spec import SEQ, WRITE_TS

#: The text of a message as it came, and its partition.
RAW, PARTITION = "_raw", "partition"


#: How often a source that counts messages is asked whether it has enough of them.
POLL = "100 milliseconds"


@dataclass(frozen=True)
class Bounds:
    """How much a micro-batch holds, and how long messages wait for it.

    ``rows`` and ``delay`` start a batch: at so many waiting messages, or when the oldest
    has waited so long. ``most_rows`` (Kafka), ``most_bytes`` and ``most_files`` (files)
    bound what one batch takes.
    """

    rows: int | None = None
    delay: str = "5 seconds"
    most_rows: int | None = None
    most_bytes: int | None = None
    most_files: int | None = None

    @property
    def interval(self) -> str:
        """How often the source is asked: it decides itself if it counts messages."""
        return self.delay if self.rows is None else POLL

    def kafka_options(self) -> dict[str, str]:
        options = {"maxOffsetsPerTrigger": self.most_rows}
        if self.rows is not None:
            options |= {"minOffsetsPerTrigger": self.rows, "maxTriggerDelay": self.delay.replace(" ", "")}
        return {k: str(v) for k, v in options.items() if v is not None}

    def file_options(self) -> dict[str, str]:
        """Files know their bytes, not their rows; Spark takes one of the two bounds."""
        if self.most_bytes is not None and self.most_files is not None:
            raise ValueError("bound a batch of files by bytes or by files, not by both")
        options = {"maxBytesPerTrigger": self.most_bytes, "maxFilesPerTrigger": self.most_files}
        return {k: str(v) for k, v in options.items() if v is not None}


def read_kafka(
    spark: SparkSession,
    options: dict[str, str],
    schema: T.StructType,
    stream: bool = True,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Messages of a topic as (msg, ``_seq``, ``_write_ts``, raw text, partition).

    ``_seq`` is the offset, which orders the writes of one partition at one time;
    before it, writes are ordered by the broker's time. Needs Spark's Kafka package;
    a stream's ``bounds`` become the source's options.
    """
    reader = spark.readStream if stream else spark.read
    if stream and bounds is not None:
        options = bounds.kafka_options() | options
    raw = reader.format("kafka").options(**options).load()
    return parse_messages(
        raw,
        schema,
        seq=F.col("offset"),
        write_ts=as_utc_ntz(F.col("timestamp"), T.TimestampType()),
        keep=[PARTITION],
    )


#: Columns of messages that were landed as files.
LANDED = "value string, partition int, offset long, timestamp timestamp_ntz"


def land_messages(rows: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Append messages (``LANDED``) as files of at most ``file_rows`` messages, each from one
    partition, in the order of their offsets."""
    ordered = rows.select("value", "partition", "offset", "timestamp").repartition("partition").sortWithinPartitions("partition", "offset")
    ordered.write.mode("append").option("maxRecordsPerFile", file_rows).partitionBy("partition").parquet(path)


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType, stream: bool = True, bounds: Bounds | None = None
) -> DataFrame:
    """Landed messages in the form of ``read_kafka``. A file is never split between batches:
    with ``land_messages``' bound on rows, ``most_files`` is a bound on a batch's rows."""
    reader = spark.readStream if stream else spark.read
    if stream and bounds is not None:
        reader = reader.options(**bounds.file_options())
    raw = reader.schema(LANDED).parquet(path)
    return parse_messages(raw, schema, seq=F.col("offset"), write_ts=F.col("timestamp"), keep=[PARTITION])


def parse_messages(
    raw: DataFrame,
    schema: T.StructType,
    seq: Column,
    write_ts: Column,
    value: str = "value",
    keep: list[str] | None = None,
) -> DataFrame:
    """Parse a JSON ``value`` column; malformed text gives a null ``msg``. The text is kept
    as ``_raw``, for messages that turn out to be errors."""
    text = F.col(value).cast("string")
    corrupt = T.StructField("_corrupt", T.StringType())
    with_corrupt = T.StructType([*schema.fields, corrupt])
    parsed = F.from_json(
        text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = raw.select(
        parsed.alias("__parsed"),
        seq.cast("bigint").alias(SEQ),
        write_ts.alias(WRITE_TS),
        text.alias(RAW),
        *(keep or []),
    )
    fields = F.struct(*[F.col("__parsed")[f.name].alias(f.name) for f in schema.fields])
    return rows.select(
        F.when(F.col("__parsed").isNotNull() & F.col("__parsed._corrupt").isNull(), fields).alias(
            "msg"
        ),
        SEQ,
        WRITE_TS,
        RAW,
        *(keep or []),
    )
