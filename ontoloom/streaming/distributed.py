"""Edges written by tasks, and read back by byte ranges: Python data sources with a two-phase commit.

Every attempt of a task writes what it has to a place of its own and returns a receipt; only the receipts of the attempts
that the job settled on are committed, by one record that names them. So a task that is run again, or twice at the same
time, counts once, and a job that fails leaves nothing that a reader would see.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import IncompatibleSource
from .sinks import EDGE_NAMES, record

#: Bytes of records after which a block ends; a block is what one task reads.
BLOCK_BYTES = 4 << 20
MANIFEST = "_manifest.json"
PARTS_SCHEMA = "ontoloom-edge-parts-1"


@dataclass
class Receipt(WriterCommitMessage):
    """What one attempt has written."""

    part: int
    edges: int
    payload: object


def attempt() -> tuple[int, str]:
    """The task's partition, and a name that no other attempt has."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return part, f"{part:06d}-{context.attemptNumber() if context else 0}-{uuid.uuid4().hex}"


def to_tasks(edges: DataFrame, sink, size: int = 10_000) -> int:
    """Hands each partition's edges to a writer of ``sink`` in the task itself, ``size`` at a time; returns how many the
    sink committed.

    A sink has protocol_version 1, ``open(part, name)``, which gives a writer with write_batch(batch) and close() (its
    receipt), ``commit(receipts)`` and ``abort(receipts)``; receipts come in the order of partitions. Sink and receipts
    travel between driver and tasks, so both can be pickled."""
    if getattr(sink, "protocol_version", None) != 1:
        raise IncompatibleSource("the sink's protocol_version is not 1")
    if size < 1:
        raise ValueError("a batch has one edge at least")
    name = f"ontoloom-sink-{uuid.uuid4().hex}"
    spark = edges.sparkSession

    class Writer(DataSourceWriter):
        def write(self, rows: Iterator) -> Receipt:
            part, own = attempt()
            writer, held, n = sink.open(part, own), [], 0
            for row in rows:
                held.append(tuple(row))
                if len(held) == size:
                    writer.write_batch(held)
                    n += size
                    held = []
            if held:
                writer.write_batch(held)
            return Receipt(part, n + len(held), writer.close())

        def commit(self, messages) -> None:
            got = sorted((m for m in messages if m is not None), key=lambda m: m.part)
            sink.commit([m.payload for m in got])

        def abort(self, messages) -> None:
            sink.abort([m.payload for m in messages if m is not None])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return Writer()

    spark.dataSource.register(Source)
    edges.select(*EDGE_NAMES).write.format(name).mode("append").save()
    return sink.committed()


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path; both may be shared storage."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FolderSink:
    """JSON records in a folder: a part for each task, cut into blocks that each have their own digest, and a manifest,
    which is written last and names the parts that count."""

    protocol_version = 1

    def __init__(self, path: str, metadata: dict | None = None):
        self.path, self.metadata = path, metadata or {}
        system, where = place(path)
        system.create_dir(where, recursive=True)

    class Part:
        def __init__(self, path: str, name: str):
            self.name = f"part-{name}.jsonl"
            system, where = place(join(path, self.name))
            self.out = system.open_output_stream(where)
            self.blocks: list[tuple[int, int, int, str]] = []
            self.held, self.edges, self.at = [], 0, 0
            self.size = 0

        def write_batch(self, batch) -> None:
            for s, r, d in batch:
                line = json.dumps({"source": s, "relation": r, "destination": d}, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
                self.held.append(line)
                self.size += len(line)
                if self.size >= BLOCK_BYTES:
                    self.end()

        def end(self) -> None:
            raw = b"".join(self.held)
            if raw:
                self.out.write(raw)
                self.blocks.append((self.at, len(raw), len(self.held), hashlib.sha256(raw).hexdigest()))
                self.at += len(raw)
                self.edges += len(self.held)
            self.held, self.size = [], 0

        def close(self) -> dict:
            self.end()
            self.out.close()
            return {"name": self.name, "edges": self.edges, "blocks": self.blocks}

    def open(self, part: int, name: str) -> Part:
        return self.Part(self.path, name)

    def commit(self, receipts: list[dict]) -> None:
        parts = [r for r in receipts if r["edges"]]
        digest = hashlib.sha256("".join(b[3] for p in parts for b in p["blocks"]).encode()).hexdigest()
        head = {**self.metadata, "parts_schema": PARTS_SCHEMA, "edge_count": sum(p["edges"] for p in parts), "parts": parts, "blocks_sha256": digest}
        head["artifact_sha256"] = hashlib.sha256(record(head)).hexdigest()
        system, where = place(join(self.path, f".{uuid.uuid4().hex}"))
        with system.open_output_stream(where) as out:
            out.write(record(head))
        system.move(where, place(join(self.path, MANIFEST))[1])

    def abort(self, receipts: list[dict]) -> None:
        for r in receipts:
            system, where = place(join(self.path, r["name"]))
            system.delete_file(where)

    def committed(self) -> int:
        return manifest(self.path)["edge_count"]


def manifest(path: str) -> dict:
    """What a folder says of its edges; an error if it is not whole or was changed."""
    system, where = place(join(path, MANIFEST))
    with system.open_input_stream(where) as f:
        head = json.loads(f.read())
    bare = {k: v for k, v in head.items() if k != "artifact_sha256"}
    if head.get("parts_schema") != PARTS_SCHEMA or hashlib.sha256(record(bare)).hexdigest() != head["artifact_sha256"]:
        raise IncompatibleSource(f"{path} is no folder of edges, or its manifest was changed")
    return head


@dataclass
class Range(InputPartition):
    name: str
    at: int
    size: int
    edges: int
    sha256: str


class EdgeFolder(DataSource):
    """``spark.read.format("ontoloom_edges").load(folder)``: a task for each block, whose digest is compared before any of
    its edges is given on."""

    @classmethod
    def name(cls) -> str:
        return "ontoloom_edges"

    def schema(self) -> str:
        return "source string, relation string, destination string"

    def reader(self, schema) -> DataSourceReader:
        return EdgeReader(self.options["path"])


class EdgeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        found = [Range(p["name"], at, size, n, digest) for p in manifest(self.path)["parts"] for at, size, n, digest in p["blocks"]]
        return found or [Range("", 0, 0, 0, "")]

    def read(self, part: Range):
        if not part.size:
            return
        system, where = place(join(self.path, part.name))
        with system.open_input_file(where) as f:
            raw = f.read_at(part.size, part.at)
        if hashlib.sha256(raw).hexdigest() != part.sha256:
            raise IncompatibleSource(f"{part.name}, bytes from {part.at} on, are not those that were written")
        for line in raw.splitlines():
            edge = json.loads(line)
            yield edge["source"], edge["relation"], edge["destination"]


def write_parts(edges: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """Writes ``edges``, in their order, as a folder; returns its manifest. No edge passes the driver."""
    to_tasks(edges, FolderSink(path, metadata))
    return manifest(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(EdgeFolder)
    return spark.read.format("ontoloom_edges").load(path)

