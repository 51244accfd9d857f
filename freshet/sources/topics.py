"""Topics: Kafka where its connector is there, and folders of files with the same columns where it isn't."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatementError
from ..functions import rowwise
from ..types import conform

COLUMNS = {"offset": "bigint", "event_time": "timestamp", "key": "binary", "hdrs": "binary", "val": "binary"}
FILE_SCHEMA = "partition int, offset bigint, event_time timestamp, key binary, hdrs binary, val binary"


def as_topic(df: DataFrame) -> DataFrame:
    """The topic columns of a DataFrame that has at least ``val``; what is missing is null, except event times."""
    if "val" not in df.columns:
        raise StatementError("a topic has a column 'val'")
    extra = [c for c in ("partition", "producer_id", "seq") if c in df.columns]
    if not df.isStreaming and "offset" not in df.columns:
        df = df.withColumn("offset", F.monotonically_increasing_id())
    cast = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in COLUMNS.items()}
    if "event_time" not in df.columns:
        cast["event_time"] = F.current_timestamp()
    if "hdrs" in df.columns and df.schema["hdrs"].dataType.simpleString() == "string":
        cast["hdrs"] = F.encode("hdrs", "UTF-8")
    return conform(df.select(*[c.alias(n) for n, c in cast.items()], *extra))


def file_topic(spark: SparkSession, path: str, files_per_trigger: int | None = 1, fmt: str = "parquet") -> DataFrame:
    """A streaming topic over a folder of files: each new file is a batch of records."""
    reader = spark.readStream.schema(FILE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def kafka_options(topic: str, props: dict[str, str], max_messages: int | None = None) -> dict[str, str]:
    """Reader options: client properties get Kafka's prefix, reader settings stay as they are."""
    out = {"subscribe": topic, "includeHeaders": "true", "startingOffsets": "earliest" if props.get("auto.offset.reset") == "earliest" else "latest"}
    if max_messages:
        out["maxOffsetsPerTrigger"] = str(max_messages)
    return out | {f"kafka.{k}": v for k, v in props.items() if k != "auto.offset.reset"}


@F.udf(T.BinaryType(), useArrow=True)
def _packed(headers):
    return None if headers is None else rowwise.encode_headers([(h["key"], h["value"]) for h in headers])


def kafka_source(spark: SparkSession, topic: str, props: dict[str, str], max_messages: int | None = None) -> DataFrame:
    if "bootstrap.servers" not in props:
        raise StatementError(f"unknown topic {topic!r}: bind it to a DataFrame, or give 'bootstrap.servers' in props")
    reader = spark.readStream.format("kafka").options(**kafka_options(topic, props, max_messages))
    return reader.load().select("offset", F.col("timestamp").alias("event_time"), "key", _packed("headers").alias("hdrs"), F.col("value").alias("val"))


def sink_options(topic: str, args: dict) -> dict[str, str]:
    """Writer options of ``bridge to``: delays of retries and timeouts become client settings."""
    names = {"initial_retry_delay": "retry.backoff.ms", "max_retry_delay": "retry.backoff.max.ms", "connect_timeout": "socket.connection.setup.timeout.ms", "send_timeout": "delivery.timeout.ms"}
    out = {"topic": topic, "kafka.retry.backoff.ms": "5000", "kafka.retry.backoff.max.ms": "30000"}
    out |= {f"kafka.{k}": v for k, v in args.get("props", {}).items()}
    return out | {f"kafka.{n}": str(args[a]) for a, n in names.items() if a in args}


def send(rows: DataFrame, options: dict[str, str]) -> None:
    """The rows of a batch as records of a topic, with their headers."""
    records = rows.select("key", F.col("val").alias("value"), rowwise.header_list("hdrs").alias("headers"))
    records.write.format("kafka").options(**options).option("includeHeaders", "true").save()


def sent(send, rows: DataFrame, options: dict[str, str], delay: int, longest: int, tries: int = 10) -> None:
    """Sends until it succeeds, waiting ``delay`` ms and a quarter more each time; the last failure is raised, and ends the
    query, whose checkpoint has the batch sent once more when it starts again."""
    for left in range(tries - 1, -1, -1):
        try:
            return send(rows, options)
        except Exception:
            if not left:
                raise
            time.sleep(min(delay, longest) / 1000)
            delay *= 1.25


def check_topic_schema(df: DataFrame) -> None:
    found = {f.name: f.dataType.simpleString() for f in df.schema if f.name in COLUMNS}
    if [c for c in df.columns if c != "offset"] != ["event_time", "key", "hdrs", "val"] or any(found[c] != COLUMNS[c] for c in found):
        raise StatementError("a topic's columns are event_time, key: bytes, hdrs: bytes, val: bytes")


def normal_values(df: DataFrame) -> DataFrame:
    """An empty value is null."""
    return df.withColumn("val", F.when(F.octet_length("val") > 0, F.col("val")))


def without_resent(df: DataFrame) -> DataFrame:
    """One record of each producer and sequence number, where producers give them."""
    if not {"producer_id", "seq"} <= set(df.columns):
        return df.drop("partition", "producer_id", "seq")
    if df.isStreaming:
        once = df.withWatermark("event_time", "1 minute").dropDuplicatesWithinWatermark(["producer_id", "seq"])
    else:
        once = df.dropDuplicates(["producer_id", "seq"])
    return once.drop("partition", "producer_id", "seq")


def headers_text(text: str | None) -> bytes | None:
    """"h1:v1,h2:v2" as encoded headers; "nil" and nothing are none."""
    if not text or re.fullmatch(r"\s*nil\s*", text):
        return None
    return rowwise.encode_headers([tuple(x.split(":", 1)) for x in text.split(",")])
