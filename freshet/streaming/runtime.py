"""Running deployed streams: appended rows, keyed tables in layers, topics.

What a micro-batch stores lies in a folder of its own number, and a manifest written after it makes it count; so readers see
whole batches only, and a batch that runs again writes the same folder again.

A keyed table is a list of layers, oldest first, each with one row a key; a batch adds a layer of its own rows and a read
takes each key's row from the newest layer.  Layers of like size are merged, as in a log-structured tree: their number
grows with the logarithm of the table, and a row is rewritten about as often.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import HIDDEN, Engine, Stream
from ..errors import StatementError
from ..operators import joins, tables
from ..sources import topics

#: Layers are merged when so many of the newest are each no larger than all newer ones of them together.
FAN = 4


class Folder:
    """Paths through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def hadoop(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self.hadoop(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def is_folder(self) -> bool:
        return self._fs.getFileStatus(self.hadoop()).isDirectory()

    def write(self, text: str, *parts: str) -> None:
        """In one step: written aside, then renamed."""
        aside, target = self.hadoop(*parts[:-1], f".{parts[-1]}.tmp"), self.hadoop(*parts)
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(target, False)
        if not self._fs.rename(aside, target):
            raise OSError(f"{target} can't be written")

    def read(self, *parts: str) -> str:
        at = self.hadoop(*parts)
        stream = self._fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, *parts: str) -> None:
        self._fs.delete(self.hadoop(*parts), True)


class _Versions:
    """A folder of ``data/version=N`` and of manifests by N."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        self.folder = Folder(spark, path)

    def _manifests(self) -> list[str]:
        return [n for n in self.folder.names("manifests") if n.isdigit()]

    def manifest(self) -> dict:
        names = self._manifests()
        return json.loads(self.folder.read("manifests", names[-1])) if names else dict(self.NOTHING)

    def _at(self, version: int) -> str:
        return f"{self.path}/data/version={version}"

    @staticmethod
    def _passed(batch: DataFrame) -> None:
        """A batch that is stored already: the state behind it is still to be written."""
        batch.write.format("noop").mode("overwrite").save()

    def _commit(self, manifest: dict) -> None:
        self.folder.write(json.dumps(manifest), "manifests", f"{manifest['version']:020d}")


class StoredRows(_Versions):
    """Appended rows; those without an ``offset`` get one, gapless from 0."""

    NOTHING = {"version": -1, "next": 0}

    def append(self, batch: DataFrame, version: int, retention: int | None = None) -> None:
        now = self.manifest()
        if now["version"] >= version:
            return self._passed(batch)
        tables.with_offset(batch, first=now["next"]).write.mode("overwrite").parquet(self._at(version))
        count = self.spark.read.schema(self.schema).parquet(self._at(version)).count()
        self._commit({"version": version, "next": now["next"] + count, "written": int(time.time() * 1000)})
        if retention:
            self._expire(retention)

    def _expire(self, retention: int) -> None:
        """Batches written ``retention`` ms ago or longer go, from the oldest on; the newest manifest stays."""
        for name in self._manifests()[:-1]:
            if json.loads(self.folder.read("manifests", name))["written"] + retention > time.time() * 1000:
                break
            self.folder.delete("data", f"version={int(name)}")
            self.folder.delete("manifests", name)

    def read(self) -> DataFrame:
        last = self.manifest()["version"]
        if last < 0:
            return self.spark.createDataFrame([], self.schema)
        if "version" in self.schema.names:  # the folders' name would hide the column
            return self.spark.read.schema(self.schema).parquet(*[self._at(int(n)) for n in self._manifests()])
        rows = self.spark.read.schema(T.StructType([*self.schema, T.StructField("version", T.LongType())])).option("basePath", f"{self.path}/data")
        return rows.parquet(f"{self.path}/data").where(F.col("version") <= last).drop("version")


class KeyedTable(_Versions):
    NOTHING = {"version": -1, "layers": []}

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, retention: int | None = None):
        super().__init__(spark, path, schema)
        self.keys, self.retention = keys, retention

    def _load(self, layers: list[dict]) -> DataFrame:
        """The newest row of each key; of one layer as it lies."""
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        each = [self.spark.read.schema(self.schema).parquet(self._at(x["version"])).withColumn("__layer", F.lit(k)) for k, x in enumerate(layers)]
        rows = each[0]
        for more in each[1:]:
            rows = rows.unionByName(more)
        newest = rows if len(each) == 1 else tables.latest_by_key(rows, self.keys, ["__layer"])
        timed = self.retention and "event_time" in self.schema.names
        return (tables.retained(newest, self.retention) if timed else newest).drop("__layer")

    def read(self) -> DataFrame:
        return self._load(self.manifest()["layers"])

    def upsert(self, batch: DataFrame, version: int, arrival: list | None = None) -> None:
        """The last row of each key stays; the batch's rows come after all before."""
        now = self.manifest()
        if now["version"] >= version:
            return self._passed(batch)
        new = tables.latest_by_key(batch.drop("offset"), self.keys, arrival)
        new.select(*self.schema.names).write.mode("overwrite").parquet(self._at(version))
        layers = now["layers"] + [{"version": version, "rows": self.spark.read.schema(self.schema).parquet(self._at(version)).count()}]
        layers = [x for x in layers if x["rows"]]
        merged = self._mergeable(layers)
        if merged:
            # beside the batch's own number, so that the layer of this batch can be read while it is merged
            whole = f"{version}.5"
            self._load(merged).write.mode("overwrite").parquet(self._at(whole))
            rows = self.spark.read.schema(self.schema).parquet(self._at(whole)).count()
            layers = layers[: -len(merged)] + [{"version": whole, "rows": rows}]
        used = lambda found: {str(x["version"]) for x in found}
        self._commit({"version": version, "layers": layers, "gone": sorted(used(now["layers"] + merged) - used(layers))})
        for old in set(now.get("gone", [])) - used(layers):
            self.folder.delete("data", f"version={old}")  # those just replaced stay for readers on their way

    @staticmethod
    def _mergeable(layers: list[dict]) -> list[dict]:
        total, n = 0, 0
        for x in reversed(layers):
            if n and x["rows"] > total:
                break
            total, n = total + x["rows"], n + 1
        return layers[-n:] if n >= FAN else []


class Runtime:
    """Deployed streams with streaming inputs, run to the end of what is there, or on and on.

    ``broker`` (client properties) is where ``kafka out`` publishes; without one its stored rows are the topic.  ``send``
    takes (rows of a batch, writer options).
    """

    def __init__(self, engine: Engine, root: str, broker: dict[str, str] | None = None, send: Callable[[DataFrame, dict], None] = topics.send):
        self.engine, self.root, self.spark = engine, root.rstrip("/"), engine.spark
        self.broker, self.send = broker, send
        self.queries: dict[str, object] = {}
        engine.deleted.append(self._forget)

    def _at(self, stream: Stream) -> str:
        return f"{self.root}/{stream.name}"

    def _forget(self, name: str) -> None:
        """A deleted stream's query ends and what it stored goes."""
        query = self.queries.pop(name, None)
        if query is not None:
            query.stop()
        if self.engine.stream(name).plan.isStreaming:
            Folder(self.spark, self.root).delete(name)

    def table(self, name: str) -> KeyedTable:
        stream = self.engine.stream(name)
        return KeyedTable(self.spark, f"{self._at(stream)}/table", stream.key, stream.plan.drop("offset").schema, stream.retention)

    def rows(self, name: str) -> StoredRows:
        stream = self.engine.stream(name)
        schema = stream.plan.schema
        if "offset" not in schema.names:
            schema = T.StructType([T.StructField("offset", T.LongType()), *schema])
        return StoredRows(self.spark, f"{self._at(stream)}/rows", schema)

    def start(self, name: str, once: bool = True):
        """The running query of a stored stream."""
        stream = self.engine.stream(name)
        if not stream.plan.isStreaming:
            raise StatementError(f"{name!r} has no streaming input")
        if stream.stored is None:
            raise StatementError(f"{name!r} stores nothing")
        if stream.is_table:
            table = self.table(name)
            order = ["event_time"] if "event_time" in stream.plan.columns else None
            mode, each = "update" if stream.aggregated else "append", lambda batch, n: table.upsert(batch, n, order)
        else:
            mode, each = "append", self._appending(stream)
        writer = stream.plan.writeStream.option("checkpointLocation", f"{self._at(stream)}/checkpoint").queryName(name)
        if once:
            writer = writer.trigger(availableNow=True)
        self.queries[name] = writer.outputMode(mode).foreachBatch(each).start()
        return self.queries[name]

    def _appending(self, stream: Stream):
        """Stores each batch, and sends what it stored; a batch that runs again is sent again."""
        rows, options, waits = self.rows(stream.name), None, (0, 0)
        if stream.sink:
            kind, topic, args = stream.sink
            props = args.get("props", {}) if kind == "bridge to" else self.broker
            if kind == "bridge to" and "bootstrap.servers" not in props:
                raise StatementError(f"'bridge to' {topic!r} needs 'bootstrap.servers' in its props")
            options = props and topics.sink_options(topic, args | {"props": props})
            waits = args.get("initial_retry_delay", 5000), args.get("max_retry_delay", 30_000)

        def each(batch: DataFrame, number: int) -> None:
            rows.append(batch, number, stream.retention)
            if options:
                topics.sent(self.send, self.spark.read.schema(rows.schema).parquet(rows._at(number)), options, *waits)

        return each

    def run(self, *names: str) -> None:
        for query in [self.start(n) for n in names]:
            query.awaitTermination()

    def read(self, name: str) -> DataFrame:
        """What is stored now; nothing before the first run."""
        stream = self.engine.stream(name)
        if stream.is_table:
            return self.table(name).read().drop(HIDDEN)
        rows = self.rows(name).read()
        return tables.retained(rows, stream.retention) if "event_time" in rows.columns else rows

    def snapshot(self) -> Engine:
        """An engine over what is stored, for queries."""
        out = Engine(self.spark, identity_nulls=self.engine.identity_nulls)
        out.modules, out.prepared = self.engine.modules, self.engine.prepared
        for s in self.engine.streams.values():
            if s.stored:
                out.streams[s.name] = Stream(s.name, s.text, self.read(s.name) if s.plan.isStreaming else s.df, s.stored, s.keys, s.parents)
        return out


def join_current(stream: DataFrame, table: KeyedTable, keys: list[tuple[str, str]], how: str, sink) -> object:
    """Each micro-batch of a stream with the table's rows as they are then; ``sink`` takes (rows, batch id).

    Later changes of the table don't touch rows that went out before.
    """

    def each(batch: DataFrame, number: int) -> None:
        current = joins.broadcast_if_small(table.read())
        sink(joins.table_join(batch, current, keys, "right", how, table.keys), number)

    return stream.writeStream.foreachBatch(each)
