"""The engine: statements in, DataFrames out.

A stream is a lazy DataFrame built from its operators, over static topics or streaming ones alike; what it stores is
the same plan (appended rows, the latest row of each key, or groups).  ``execute`` takes one statement and returns a
DataFrame for queries, ``list`` and ``show``.

Numbering the rows of a static stored stream needs them materialised, so it waits until a statement names ``offset`` or a
query gives all columns; until then the column is a place holder and the stream ``pending``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StatementError
from .functions.modules import Modules
from .operators import aggregate, joins, rows, tables
from .plans import ast as A
from .plans import placement
from .plans.lexer import tokens
from .plans.parser import RESERVED, parse
from .sources import topics
from .types import conform, kind_of

WATERMARK_LATENESS = 1000


#: The window's start where a streaming aggregate needs it to tell its rows apart but doesn't give it.
HIDDEN = "__ws"


@dataclass
class Stream:
    name: str
    text: str
    plan: DataFrame
    stored: str | None = None  # "stream" or "table"
    keys: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    lateness: int = WATERMARK_LATENESS
    #: (operator, topic, options) where the last operator sends its rows on
    sink: tuple[str, str, dict] | None = None
    retention: int | None = None
    aggregated: bool = False
    #: How far (ms of event time) the stream may fall behind the other side of a join before that goes on without it.
    idle: int | None = None
    pending: bool = False
    #: The plan with offsets in place of the place holder.
    number: Callable[[], DataFrame] | None = None

    @property
    def df(self) -> DataFrame:
        """All rows, with their offsets."""
        if self.pending:
            self.plan, self.pending = self.number(), False
        return self.plan

    @property
    def key(self) -> list[str]:
        """What tells the rows of the stored table apart."""
        return [c for c in (HIDDEN,) if c in self.plan.columns] + self.keys

    @property
    def is_table(self) -> bool:
        return self.stored == "table"


class Engine:
    def __init__(self, spark: SparkSession, final_watermark: int | None = None, identity_nulls: bool = False):
        """``final_watermark`` (ms): static windowed aggregates give only what a stream would have closed by then."""
        self.spark, self.final_watermark, self.identity_nulls = spark, final_watermark, identity_nulls
        self.streams: dict[str, Stream] = {}
        self.prepared: dict[str, A.Query] = {}
        self.topics: dict[str, DataFrame] = {}
        self.modules = Modules()
        self.settings: dict[str, int] = {}
        #: Called with the name of each stream that is deleted.
        self.deleted: list[Callable[[str], None]] = []
        self._exact = True

    # ------------------------------------------------------------ catalog

    def bind_topic(self, name: str, df: DataFrame) -> None:
        """Rows of an outside topic, or of what is produced to a ``kafka in`` of this name: static or streaming."""
        self.topics[name] = topics.as_topic(df)

    def register_table(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """A DataFrame as a stored stream, or with keys as a stored table that holds one row a key."""
        self._new(name)
        self.streams[name] = Stream(name, f"{name} := (registered)", conform(df), "stream" if keys is None else "table", keys or [])

    def register_module(self, module: str, functions: dict) -> None:
        self.modules.register(module, functions)

    def unregister_module(self, module: str) -> None:
        self.modules.unregister(module)

    def stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise StatementError(f"unknown stream or table {name!r}")
        return self.streams[name]

    def _new(self, name: str) -> None:
        if name in RESERVED:
            raise StatementError(f"{name!r} is reserved and can't name a stream")
        if name in self.streams:
            raise StatementError(f"stream {name!r} exists already")

    def catalog(self) -> DataFrame:
        """sys.streams: name, statement, kind, key and columns of every stream."""
        rows_ = [(s.name, s.text, s.stored or "", ",".join(s.keys), ", ".join(f"{f.name}: {kind_of(f.dataType)}" for f in s.plan.schema if f.name != HIDDEN)) for s in self.streams.values()]
        return self.spark.createDataFrame(rows_, "stream_name string, stream_def string, stored_as string, key_columns string, out_schema string")

    # ------------------------------------------------------------ statements

    def execute(self, text: str, args: dict | None = None) -> DataFrame | None:
        return self.run(parse(text), args)

    def script(self, text: str) -> list[DataFrame]:
        """All statements of a text, in order; the results of those that have one."""
        found = [self.execute(s) for s in split_statements(text)]
        return [df for df in found if df is not None]

    def run(self, statement, args: dict | None = None) -> DataFrame | None:
        if isinstance(statement, A.CreateStream):
            self.deploy(statement)
        elif isinstance(statement, A.Query):
            return self.query(statement, args)
        elif isinstance(statement, A.Delete):
            self.delete(statement.name)
        elif isinstance(statement, A.Prepare):
            if statement.name in self.prepared:
                raise StatementError(f"query {statement.name!r} is prepared already")
            self.query(statement.query)  # types are checked now, with nulls for the parameters
            self.prepared[statement.name] = statement.query
        elif isinstance(statement, A.DeleteQuery):
            if self.prepared.pop(statement.name, None) is None:
                raise StatementError(f"unknown prepared query {statement.name!r}")
        elif isinstance(statement, A.ListStreams):
            names = self.catalog().select("stream_name")
            return (names if statement.pattern is None else names.where(F.col("stream_name").rlike(statement.pattern))).orderBy("stream_name")
        elif isinstance(statement, A.Show):
            self.stream(statement.name)
            return self.catalog().where(F.col("stream_name") == statement.name)
        return None

    def execute_prepared(self, name: str, args: dict | None = None) -> DataFrame:
        if name not in self.prepared:
            raise StatementError(f"unknown prepared query {name!r}")
        return self.query(self.prepared[name], args or {})

    def delete(self, name: str) -> None:
        self.stream(name)
        children = [s.name for s in self.streams.values() if name in s.parents]
        if children:
            raise StatementError(f"stream {name!r} has children: {', '.join(children)}")
        for told in self.deleted:
            told(name)
        del self.streams[name]

    # ------------------------------------------------------------ streams

    def deploy(self, statement: A.CreateStream) -> Stream:
        self._new(statement.name)
        placement.check(statement)
        ops = statement.operators
        if ops[0].name == "topic":
            args = dict(ops[0].args)
            retention = {"retention": args.pop("retention")} if "retention" in args else {}
            ops = (A.Operator("kafka in", args, ops[0].at), A.Operator("kafka out", retention, ops[0].at))
        stream = self._built(A.CreateStream(statement.name, ops, statement.text), names_offset(statement.text))
        self.streams[stream.name] = stream
        return stream

    def _built(self, statement: A.CreateStream, exact: bool) -> Stream:
        """The stream of a statement, over parents with offsets if ``exact`` and with place holders otherwise."""
        stream = Stream(statement.name, statement.text, None)
        before, self._exact = self._exact, exact
        try:
            for op in statement.operators:
                getattr(self, "_op_" + op.name.replace(" ", "_"))(stream, op, statement.text)
        finally:
            self._exact = before
        stream.pending = stream.pending and "offset" in stream.plan.columns
        stream.number = lambda: self._built(statement, True).plan
        return stream

    def _input(self, parent: Stream) -> DataFrame:
        return (parent.df if self._exact else parent.plan).drop(HIDDEN)

    def _numbered(self, stream: Stream) -> None:
        if "offset" not in stream.plan.columns:
            stream.pending = not self._exact
            stream.plan = tables.with_offset(stream.plan) if self._exact else stream.plan.select(F.lit(None).cast("bigint").alias("offset"), "*")

    def _source(self, stream, op, topic):
        stream.lateness = op.args.get("watermark_lateness", WATERMARK_LATENESS)
        if topic in self.topics:
            df = self.topics[topic]
        else:
            df = topics.kafka_source(self.spark, topic, op.args.get("props", {}), op.args.get("max_poll_messages"))
        stream.idle = op.args.get("watermark_idle_timeout")
        if op.args.get("watermark_type") == "processing_time":
            if stream.idle is not None:
                raise StatementError("a watermark of processing time has no idle timeout")
            df = df.withColumn("event_time", F.current_timestamp())
        stream.plan = df

    def _op_bridge_from(self, stream, op, text):
        self._source(stream, op, op.args["topic"])

    def _op_kafka_in(self, stream, op, text):
        self._source(stream, op, stream.name)
        stream.plan = topics.normal_values(topics.without_resent(stream.plan))

    def _op_continuation(self, stream, op, text):
        parent = self.stream(op.args["parent"])
        stream.parents, stream.lateness, stream.idle = [parent.name], parent.lateness, parent.idle
        stream.plan, stream.pending = self._input(parent), parent.pending and not self._exact

    def _op_backfill(self, stream, op, text):
        if self.stream(stream.parents[0]).stored != "stream":
            raise StatementError(f"'backfill' needs a stored stream; {stream.parents[0]!r} is none", text, op.at)
        # the parent's plan starts at the first row; a checkpoint remembers how far a run came

    def _op_filter(self, stream, op, text):
        stream.plan = rows.filter_rows(stream.plan, op.args["expr"], self.modules, text)

    def _op_project(self, stream, op, text):
        stream.plan = rows.project(stream.plan, op.args["items"], True, self.modules, text)

    def _op_partition(self, stream, op, text):
        stream.plan = rows.partition(stream.plan, op.args["by"], op.args.get("partitions"), op.args.get("const", False))

    def _op_union(self, stream, op, text):
        inputs = [self.stream(n) for n in op.args["inputs"]]
        stream.parents, stream.lateness = [s.name for s in inputs], max(s.lateness for s in inputs)
        if all(s.idle is not None for s in inputs):
            stream.idle = max(s.idle for s in inputs)
        stream.plan = rows.union([self._input(s) for s in inputs])

    def _op_join(self, stream, op, text):
        a = op.args
        left, right = self.stream(a["left"]), self.stream(a["right"])
        stream.parents = [left.name, right.name]
        stream.lateness = max(left.lateness, right.lateness)
        for side, s in (("left", left), ("right", right)):
            if a[f"{side}_table"] and not s.is_table:
                raise StatementError(f"{s.name!r} is not a table", text, op.at)
        if a["left_table"] and a["right_table"]:
            raise StatementError("two tables can't be joined", text, op.at)
        if a["left_table"] or a["right_table"]:
            if "within" in a or "retention" in a:
                raise StatementError("a join with a table takes neither 'within' nor 'retention'", text, op.at)
            table = left if a["left_table"] else right
            stream.plan = joins.table_join(self._input(left), self._input(right), a["keys"], "left" if a["left_table"] else "right", a["how"], table.keys)
            return
        if "within" not in a:
            raise StatementError("a join of two streams needs 'within'", text, op.at)
        l_df, r_df = self._input(left), self._input(right)
        if l_df.isStreaming and r_df.isStreaming:
            l_df, r_df = (joins.watermarked(df, s.lateness, s.idle, other) for df, s, other in ((l_df, left, r_df), (r_df, right, l_df)))
        stream.plan = joins.stream_join(l_df, r_df, a["keys"], a["within"], a["how"])

    def _op_aggregate(self, stream, op, text):
        a = op.args
        df, lateness = stream.plan, a.get("lateness", 0)
        windowed = "size" in a
        if df.isStreaming and windowed:
            df = df.withWatermark("event_time", f"{stream.lateness + lateness} milliseconds")
        shown = a.get("window_cols", False)
        hidden = HIDDEN if df.isStreaming and not shown else None
        stream.plan = aggregate.aggregate(
            df, a["items"], a["by"], a.get("size"), a.get("hop"), lateness, shown, self.final_watermark, self.identity_nulls, self.modules, text, hidden
        )
        stream.aggregated = not windowed
        if a.get("store", True):
            stream.stored, stream.keys, stream.retention = "table", aggregate.key_names(a["by"]), a.get("retention")
            if windowed:
                stream.keys = [*(["ws", "we"] if a.get("window_cols") else []), *stream.keys]

    def _op_store_stream(self, stream, op, text):
        stream.stored, stream.retention = "stream", op.args.get("retention")
        if not stream.plan.isStreaming:
            stream.plan = tables.retained(stream.plan, stream.retention)
            if "event_time" in stream.plan.columns:
                self._numbered(stream)

    def _op_store_table(self, stream, op, text):
        stream.stored, stream.keys, stream.retention = "table", op.args["by"], op.args.get("retention")
        missing = [k for k in stream.keys if k not in stream.plan.columns]
        if missing:
            raise StatementError(f"unknown key column {missing[0]!r}", text, op.at)
        if stream.plan.isStreaming:
            stream.plan = stream.plan.drop("offset")
        else:
            plan = stream.plan.drop("offset") if stream.pending else stream.plan
            stream.plan = tables.latest_by_key(tables.retained(plan, stream.retention), stream.keys)

    def _op_kafka_out(self, stream, op, text):
        topics.check_topic_schema(stream.plan)
        stream.stored, stream.retention, stream.sink = "stream", op.args.get("retention"), ("kafka out", stream.name, {})
        if not stream.plan.isStreaming:
            stream.plan = tables.retained(stream.plan, stream.retention)
            self._numbered(stream)

    def _op_bridge_to(self, stream, op, text):
        stream.plan = stream.plan.drop("partition", "producer_id", "seq")
        topics.check_topic_schema(stream.plan)
        stream.stored, stream.retention, stream.sink = "stream", op.args.get("retention"), ("bridge to", op.args["topic"], dict(op.args))

    # ------------------------------------------------------------ queries

    def query(self, query: A.Query, args: dict | None = None) -> DataFrame:
        df = None
        exact = names_offset(query.text) or not any(op.name == "project" for op in query.operators)
        for op in query.operators:
            a = op.args
            if op.name in ("get", "scan"):
                df, keys = self._stored(a["from"], query.text, op.at, exact)
                values = lambda exprs, df=df: [rows.analyzer(df, self.modules, query.text, args or {}).typed(x) for x in exprs]
                if op.name == "get":
                    df = tables.get(df, keys, values(a["keys"]))
                elif not a["all"] and (a["low"] or a["high"]):
                    df = tables.scan_range(df, keys, a["low"] and values(a["low"]), a["high"] and values(a["high"]), a["low_incl"], a["high_incl"])
            elif op.name == "filter":
                df = rows.filter_rows(df, a["expr"], self.modules, query.text, args or {})
            elif op.name == "project":
                df = rows.project(df, a["items"], False, self.modules, query.text, args or {})
            else:
                df = rows.sort(df, a["items"], self.modules, query.text, args or {})
        return df

    def _stored(self, name: str, text: str, at: int, exact: bool = True) -> tuple[DataFrame, list[str]]:
        if name == "sys.streams":
            return self.catalog(), ["stream_name"]
        stream = self.streams.get(name)
        if stream is None or stream.stored is None:
            raise StatementError(f"{name!r} is no stored stream or table", text, at)
        return (stream.df if exact else stream.plan), stream.keys


def names_offset(text: str) -> bool:
    return any(t.kind == "name" and t.text == "offset" for t in tokens(text))


def split_statements(text: str) -> list[str]:
    """The statements of a script, between semicolons."""
    out, start = [], 0
    for token in tokens(re.sub(r"(?m)^\s*--[^\n]*$", lambda m: " " * len(m[0]), text)):
        if token.text == ";" and token.kind == "sign":
            if text[start : token.at].strip():
                out.append(text[start : token.at])
            start = token.end
    rest = re.sub(r"(?m)--[^\n]*$", "", text[start:]).strip()
    return [*out, text[start:]] if rest else out
