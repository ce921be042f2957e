"""Span batches to an exporter: OTLP-shaped JSON lines in a folder, or the console of the executors.

A Python data source whose tasks write on the executors. A batch appears when its
manifest is written, after all of its files; a batch that is replayed writes new
files and replaces the manifest, so it is never there twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "larkspur_spans"
#: The variable that chooses a collector, and the name of the service.
ENDPOINT, SERVICE = "OTEL_EXPORTER_OTLP_ENDPOINT", "larkspur"
#: Spans of one request.
REQUEST = 512


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    file: str | None
    spans: int


def chosen(environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The exporter that the environment asks for, as options: the endpoint's folder if there is one, else the console."""
    endpoint = (os.environ if environment is None else environment).get(ENDPOINT)
    return {"exporter": "otlp", "path": endpoint} if endpoint else {"exporter": "console"}


def _attribute(key: str, value: object) -> dict:
    kind = "boolValue" if isinstance(value, bool) else "intValue" if isinstance(value, int) else "doubleValue" if isinstance(value, float) else "stringValue"
    return {"key": key, "value": {kind: str(value) if kind in ("intValue", "stringValue") else value}}


def request(rows: list[Row]) -> str:
    """One OTLP request: traceId, spanId, name, start and end of each span, and its other columns that are not null as attributes."""
    own = ("trace_id", "span_id", "name", "start", "end")
    spans = []
    for r in rows:
        values = r.asDict()
        span = {"traceId": values.get("trace_id"), "spanId": values.get("span_id"), "name": values.get("name")}
        span |= {f"{edge}TimeUnixNano": str(values[edge]) for edge in ("start", "end") if values.get(edge) is not None}
        span["attributes"] = [_attribute(k, v) for k, v in values.items() if k not in own and v is not None]
        spans.append(span)
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [_attribute("service.name", SERVICE)]}, "scopeSpans": [{"spans": spans}]}]}, ensure_ascii=False)


class SpanSource(DataSource):
    """``writeStream.format(NAME)`` with the options ``exporter`` (otlp or console) and ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        kind = self.options.get("exporter", "console")
        if kind not in ("otlp", "console"):
            raise ValueError(f"no exporter is called {kind}")
        return _Folder(self.options["path"]) if kind == "otlp" else _Console()


class _Folder(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Runs in a task: one file of requests."""
        fs, root = self._open()
        fs.create_dir(f"{root}/spans", recursive=True)
        name, held, n, out = f"{uuid.uuid4().hex}.jsonl", [], 0, None
        for row in iterator:
            held.append(row)
            n += 1
            if len(held) == REQUEST:
                out = out or fs.open_output_stream(f"{root}/spans/{name}")
                out.write((request(held) + "\n").encode())
                held = []
        if held:
            out = out or fs.open_output_stream(f"{root}/spans/{name}")
            out.write((request(held) + "\n").encode())
        if out:
            out.close()
        return Written(name if out else None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """The batch's manifest names its files; an earlier one of a replayed batch is replaced."""
        fs, root = self._open()
        fs.create_dir(f"{root}/batches", recursive=True)
        draft = f"{root}/batches/.{uuid.uuid4().hex}"
        files = [m.file for m in messages if m is not None and m.file]
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": files}).encode())
        fs.move(draft, f"{root}/batches/{batchId}.json")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = self._open()
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/spans/{m.file}")


class _Console(DataSourceStreamWriter):
    def write(self, iterator: Iterator[Row]) -> Written:
        n = 0
        for row in iterator:
            print(request([row]), flush=True)
            n += 1
        return Written(None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        print(f"batch {batchId}: {sum(m.spans for m in messages if m is not None)} spans", flush=True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        print(f"batch {batchId} was given up", flush=True)


def export_spans(spans: DataFrame, checkpoint: str, options: Mapping[str, str] | None = None):
    """A writer that hands a stream of spans to the chosen exporter; start it with the trigger that is wanted."""
    spans.sparkSession.dataSource.register(SpanSource)
    return spans.writeStream.format(NAME).options(**(chosen() if options is None else options)).option("checkpointLocation", checkpoint).outputMode("append")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The spans of the batches that were committed: batch, trace_id, span_id, name, start, end, attributes (a map of texts)."""
    named = spark.read.schema("batch long, files array<string>").json(f"{path}/batches/*.json").select("batch", F.explode("files").alias("_file"))
    span = "struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>"
    lines = spark.read.schema(f"resourceSpans array<struct<scopeSpans:array<struct<spans:array<{span}>>>>>").json(f"{path}/spans").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    found = lines.join(named, "_file").select("batch", F.explode(F.flatten(F.flatten(F.transform("resourceSpans", lambda r: F.transform(r["scopeSpans"], lambda s: s["spans"]))))).alias("s"))
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    attributes = F.map_from_entries(F.transform("s.attributes", lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value"))))
    return found.select("batch", F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), "s.name", F.col("s.startTimeUnixNano").cast("long").alias("start"), F.col("s.endTimeUnixNano").cast("long").alias("end"), attributes.alias("attributes"))
