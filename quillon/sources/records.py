"""Files of records as a data source of Spark, for tables and for streams: ``spark.read.format("quillon_records").load(folder)``.

A row is one record: the file, the byte at which it starts, its kind, its content and, where it cannot be read, an error. Nothing is
dropped: what is no text or no JSON stands beside the rest with its error.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, at long, kind string, content string, error string"
ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("content", pa.string()), ("error", pa.string())])
KINDS = ("jsonl", "json", "txt")
SPLIT, BATCH = 64 << 20, 4 << 20


@dataclass
class Split(InputPartition):
    """The lines of a file that start from ``start`` on and before ``end``; nothing from byte ``size`` on is read."""

    path: str
    name: str
    kind: str
    start: int
    end: int
    size: int

    @property
    def nothing(self) -> bool:
        return not self.size

    @property
    def packed(self) -> bool:
        return self.path.endswith(".gz")


#: Spark asks for one part at least.
NOTHING = Split("", "", "txt", 0, 0, 0)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if urlsplit(path).scheme else f"file://{path}")


def _kind(name: str, forced: str | None) -> str | None:
    """By the first part of the path that ends as a kind does, so that a folder of parts has the kind of its name."""
    ends = [part.removesuffix(".gz").rpartition(".")[2] for part in name.split("/")]
    return next((e for e in ends if e in KINDS), None) if forced is None else forced


def listed(folder: str, forced: str | None = None) -> list[dict]:
    """Path, name below the folder, kind, size and time of each file of a known kind, by time and name. Names that start with a dot or
    an underscore are someone's work in progress."""
    at, base = _opened(folder)
    base = base.rstrip("/")
    out = []
    for f in at.get_file_info(fs.FileSelector(base, recursive=True)):
        name = f.path[len(base) :].strip("/")
        if f.type != fs.FileType.File or any(part[0] in "._" for part in name.split("/")):
            continue
        if kind := _kind(name, forced):
            out.append({"path": f.path, "name": name, "kind": kind, "size": f.size, "time": f.mtime_ns or 0})
    return sorted(out, key=lambda f: (f["time"], f["name"]))


def splits(files: list[dict], most: int) -> list[Split]:
    """Files in parts of at most ``most`` bytes; JSON documents and packed files are one part each."""
    out = []
    for f in files:
        one = f["kind"] == "json" or f["path"].endswith(".gz")
        step = max(f["size"], 1) if one else most
        out += [Split(f["path"], f["name"], f["kind"], s, min(s + step, f["size"]), f["size"]) for s in range(0, f["size"], step)]
    return out


def _lines(at: fs.FileSystem, part: Split) -> Iterator[tuple[int, bytes]]:
    if part.packed:
        with io.BufferedReader(at.open_input_stream(part.path, compression="gzip"), 1 << 20) as f:
            place = 0
            for line in f:
                yield place, line
                place += len(line)
        return
    with io.BufferedReader(at.open_input_file(part.path), 1 << 20) as f:
        place = part.start
        if place:  # a line that starts before is the part's before: go on after its end
            f.seek(place - 1)
            place += len(f.readline()) - 1
        while place < part.end:
            line = f.readline()[: part.size - place]
            if not line:
                return
            yield place, line
            place += len(line)


def _text(raw: bytes) -> tuple[str, str | None]:
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError as e:
        return raw.decode("utf-8", "replace"), f"no UTF-8 at byte {e.start}"


def _document(raw: bytes) -> Iterator[tuple[int, str, str | None]]:
    """A JSON document: the members of its array, numbered, or itself."""
    text, error = _text(raw)
    try:
        whole = json.loads(text) if error is None else None
    except ValueError:
        whole, error = None, "no JSON"
    if isinstance(whole, list):
        yield from ((i, json.dumps(x, ensure_ascii=False), None) for i, x in enumerate(whole))
    else:
        yield 0, text, error


def _found(at: fs.FileSystem, part: Split) -> Iterator[tuple[int, str, str | None]]:
    if part.kind == "json":
        yield from _document(b"".join(line for _, line in _lines(at, part)))
        return
    for place, line in _lines(at, part):
        line = line.rstrip(b"\r\n")
        if line.strip():
            yield place, *_text(line)


def _batches(folder: str, part: Split) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    at, _ = _opened(folder)
    rows, held = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
    for place, content, error in _found(at, part):
        rows.append((part.name, place, part.kind, content, error))
        held += len(content) + 64
        if held >= BATCH:
            yield pack()
            rows, held = [], 0
    if rows:
        yield pack()


class _Options:
    def __init__(self, options: dict):
        self.folder, self.forced = options["path"].rstrip("/"), options.get("kind")
        self.most, self.files = int(options.get("splitBytes", SPLIT)), int(options.get("filesPerBatch", 1000))
        self.log = options.get("log")
        if self.forced not in (None, *KINDS):
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.nothing else _batches(self.folder, partition)


class Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Split]:
        return splits(listed(self.folder, self.forced), self.most) or [NOTHING]


class StreamReader(_Options, DataSourceStreamReader):
    """Each file once, by a log in a shared folder: entry n names the files that came with it and their sizes then, and n is the
    offset. A file is new if no entry names it, whatever its time; an entry is there whole or not at all, so after a restart the
    entries past the checkpoint's offset are read again as they were."""

    def __init__(self, options: dict):
        super().__init__(options)
        if not self.log:
            raise ValueError("a stream needs the option log: a shared folder that belongs to this stream alone")
        self.at, self.base = _opened(self.log)
        self.at.create_dir(self.base, recursive=True)
        self.seen, self.last = set(), 0
        while (entry := self._entry(self.last + 1)) is not None:
            self.seen |= {f["name"] for f in entry}
            self.last += 1

    def _entry(self, n: int) -> list[dict] | None:
        path = f"{self.base}/{n}.json"
        if self.at.get_file_info(path).type != fs.FileType.File:
            return None
        with self.at.open_input_stream(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        new = [f for f in listed(self.folder, self.forced) if f["name"] not in self.seen][: self.files]
        if new:
            path = f"{self.base}/{self.last + 1}.json"
            with self.at.open_output_stream(f"{path}.part") as f:
                f.write(json.dumps(new).encode())
            self.at.move(f"{path}.part", path)
            self.seen |= {f["name"] for f in new}
            self.last += 1
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(n)]
        return splits(files, self.most) or [NOTHING]

    def commit(self, end: dict) -> None:
        """Entries stay: they say which files were read."""


class Records(DataSource):
    """Options: ``path``, a folder that driver and executors can open (file, hdfs, s3 or gs address); ``kind``, for files whose names
    do not end in one; ``splitBytes``, the most bytes of a file one task reads; for streams ``log`` and ``filesPerBatch``.

    Kinds: jsonl and txt, a record a line (blank lines are none); json, a record for each member of the document's array, or one.
    Names may end in .gz. Cases: other endings are not read; empty folders and files give no rows; bytes that are no UTF-8 come with
    replacement characters and an error; a last line without an end counts; a file that grew after a stream listed it is read as it
    was listed."""

    @classmethod
    def name(cls) -> str:
        return "quillon_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Records)
    return spark


def checked(df: DataFrame, schema: StructType | str) -> DataFrame:
    """(file, at, content, record, error): contents as objects of ``schema``, parsed by Spark. What is no object, or has a value of
    another type, has no record and an error, and keeps its content; fields that an object lacks are null."""
    given = F.from_json("content", _with_corrupt(df.sparkSession, schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = df.withColumn("_r", given)
    names = [f.name for f in _with_corrupt(df.sparkSession, schema).fields if f.name != "_corrupt"]
    error = F.coalesce("error", F.when(~F.col("content").rlike("^\\s*\\{"), "no object"), F.when(F.try_parse_json("content").isNull(), "no JSON"), F.when(F.col("_r._corrupt").isNotNull(), "another type"))
    record = F.when(error.isNull(), F.struct(*[F.col("_r")[n].alias(n) for n in names]))
    return rows.select("file", "at", "content", record.alias("record"), error.alias("error"))


def _with_corrupt(spark: SparkSession, schema: StructType | str) -> StructType:
    own = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return StructType(own.fields).add("_corrupt", "string")
