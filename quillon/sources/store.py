"""A table store on Parquet: create, append, upsert, update, delete, scan, and JSON lines in and out."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources.scratch import shared_dir


class Store:
    """Tables of one database, each a folder of Parquet parts and a log of versions.

    A version is a small file that names the schema and the parts of the table; it is written aside and renamed once the parts
    are there. A job that fails leaves the version before, readers of an older version keep their parts, and of two writers one
    gets an error. Appends add a part; changes write the table anew.
    """

    def __init__(self, spark: SparkSession, database: str = "default", root: str | None = None) -> None:
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/quillon/store/{database}").rstrip("/")

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        log = self._path(f"{self.root}/{name}/_log")
        if not self._fs().exists(log):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs().listStatus(log) if f.getPath().getName().endswith(".json"))

    def _version(self, name: str) -> tuple[StructType, list[str], int]:
        known = self._versions(name)
        if not known:
            raise ValueError(f"no table {name}")
        stream = self._fs().open(self._path(f"{self.root}/{name}/_log/{known[-1]:012d}.json"))
        try:
            about = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return StructType.fromJson(about["schema"]), about["parts"], known[-1]

    def _commit(self, name: str, schema: StructType, parts: list[str], after: int) -> None:
        fs, log = self._fs(), f"{self.root}/{name}/_log"
        aside = self._path(f"{log}/{uuid.uuid4().hex}.new")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "parts": parts}).encode()))
        finally:
            out.close()
        target = self._path(f"{log}/{after + 1:012d}.json")
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"{name} was changed by another writer")

    def _part(self, name: str, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def create(self, name: str, schema: StructType | str, drop_if_exists: bool = False) -> None:
        """An empty table; one that is there stays as it is unless it is to be dropped."""
        if drop_if_exists:
            self.drop(name)
        if not self._versions(name):
            fields = self.spark.createDataFrame([], schema).schema
            self._commit(name, fields, [], 0)

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{name}"), True)

    def tables(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path(self.root)):
            return []
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(self._path(self.root))) if self._versions(n))

    def columns(self, name: str) -> list[str]:
        return self._version(name)[0].names

    def all(self, name: str, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self.query(name, order_by=order_by, limit=limit)

    def _rows(self, name: str) -> DataFrame:
        schema, parts, _ = self._version(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def _fitted(self, name: str, schema: StructType, rows: DataFrame) -> DataFrame:
        if extra := set(rows.columns) - set(schema.names):
            raise ValueError(f"{name} has no {sorted(extra)}")
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def insert(self, name: str, rows: DataFrame | dict) -> int:
        """Appends, and says how many rows there are now; columns that rows lack are null, columns that the table lacks are an error."""
        schema, parts, at = self._version(name)
        if isinstance(rows, dict):
            rows = self.spark.createDataFrame([tuple(rows.values())], StructType([schema[c] for c in rows]))
        self._commit(name, schema, [*parts, self._part(name, self._fitted(name, schema, rows))], at)
        return self.count(name)

    def _replace(self, name: str, rows: DataFrame) -> None:
        schema, _, at = self._version(name)
        self._commit(name, schema, [self._part(name, rows.select(*schema.names))], at)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """Rows replace those with the same key. Of rows that share a key the greatest stays, by the other columns in order."""
        schema = self._version(name)[0]
        rows = self._fitted(name, schema, rows)
        others = [c for c in schema.names if c not in key]
        if others:
            rows = rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("_x")).select(*key, "_x.*").select(*schema.names)
        else:
            rows = rows.distinct()
        self._replace(name, self._rows(name).join(rows.select(*key), key, "left_anti").select(*schema.names).unionAll(rows))

    def update(self, name: str, sets: dict[str, Any], where: str) -> int:
        """Sets columns, to values or expressions, of the rows for which the predicate is true; says how many."""
        schema, rows, hit = self._version(name)[0], self._rows(name), F.coalesce(F.expr(where), F.lit(False))
        n = rows.where(hit).count()
        if n:
            self._replace(name, rows.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(schema[c].dataType) for c, v in sets.items()}))
        return n

    def delete(self, name: str, where: str) -> int:
        """Takes away the rows for which the predicate is true, and says how many; those for which it is null stay."""
        rows, hit = self._rows(name), F.coalesce(F.expr(where), F.lit(False))
        n = rows.where(hit).count()
        if n:
            self._replace(name, rows.where(~hit))
        return n

    def query(self, name: str, columns: list[str] | None = None, where: str | None = None, args: dict[str, Any] | None = None, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """A scan; ``where`` may hold :names from ``args``, ``order_by`` names with or without a following desc."""
        rows = self._rows(name)
        if where:
            rows = self.spark.sql(f"select * from {{rows}} where {where}", args=args or {}, rows=rows)
        if order_by:
            rows = rows.orderBy(*[F.desc(o[:-5].strip()) if o.lower().endswith(" desc") else F.asc(o) for o in order_by])
        if limit is not None:
            rows = rows.limit(int(limit))
        return rows.select(*columns) if columns else rows

    def get(self, name: str, where: str, args: dict[str, Any] | None = None) -> dict | None:
        row = self.query(name, where=where, args=args, limit=1).first()
        return row.asDict(True) if row else None

    def count(self, name: str, where: str | None = None, args: dict[str, Any] | None = None) -> int:
        return self.query(name, where=where, args=args).count()

    def export_json(self, name: str, path: str) -> int:
        """The table as JSON lines; says how many."""
        self._rows(name).write.mode("overwrite").json(path)
        return self.count(name)

    def import_json(self, name: str, path: str, schema: StructType | str | None = None, drop_if_exists: bool = True) -> int:
        """JSON lines as a table. With a schema for anything large; without one Spark reads the files twice to find it."""
        rows = (self.spark.read.schema(schema) if schema else self.spark.read).json(path)
        self.create(name, rows.schema, drop_if_exists)
        return self.insert(name, rows)

    #: A fixture is JSON lines like any other.
    load_fixture = import_json

    def export_all(self, path: str) -> dict[str, int]:
        return {name: self.export_json(name, f"{path}/{name}") for name in self.tables()}

    def import_all(self, path: str, schemas: dict[str, StructType | str]) -> dict[str, int]:
        return {name: self.import_json(name, f"{path}/{name}", schema) for name, schema in schemas.items()}


def kind_of(text: Column) -> Column:
    """The column type that a value written as text or JSON asks for."""
    bare = F.trim(text)
    kinds = F.when(bare.rlike("^[-+]?[0-9]+$"), "INTEGER").when(bare.rlike("^(?i:true|false)$"), "INTEGER").when(bare.try_cast("double").isNotNull(), "REAL")
    return F.when(text.isNull(), "TEXT").otherwise(kinds.when(bare.rlike("^[\\[{].*[\\]}]$"), "JSON").when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+)?$"), "DATETIME").otherwise("TEXT"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, limit: int = 0) -> DataFrame:
    """JSON lines, at most ``limit`` of them if that is set."""
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit > 0 else rows


def folder(spark: SparkSession, path: str, schemas: dict[str, StructType | str], limit: int = 100) -> dict[str, DataFrame]:
    """The inputs of one analytic from a folder, by what each entry is: JSON lines, JSON or text; at most ``limit`` rows of each (0:
    all). ``schemas`` says of which names JSON is to be read; text has one column, value."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for f in sorted(fs.listStatus(fs_path), key=lambda f: f.getPath().getName()):
        name, _, kind = f.getPath().getName().rpartition(".")
        at = f.getPath().toString()
        if kind in ("jsonl", "json") and name in schemas:
            rows = spark.read.schema(schemas[name]).option("multiLine", kind == "json").json(at)
        elif kind == "txt":
            rows = spark.read.text(at)
        else:
            continue
        out[name] = rows.limit(limit) if limit else rows
    return out
