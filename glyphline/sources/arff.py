"""ARFF files as a data source: a schema from the header's attributes, rows read in byte ranges.

A file of plain attributes gives a column for each. A file with a relational attribute (the archives of series) gives a row for
each value of a series, with the other attributes as columns. Every row has its file (its place among the paths) and the byte its line begins at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ordering import with_index
from ..storage import prepare

ATTRIBUTE = re.compile(r"""@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.*)""", re.IGNORECASE)
#: A value of a line: quoted, or up to the next comma.
VALUE = re.compile(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.|"")*"|[^,]*?)\s*(,|$)""")
WRITTEN = {"double": "numeric", "float": "numeric", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "string": "string"}
KINDS = {"numeric": "double", "real": "double", "integer": "long"}
ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
BATCH = 1 << 16
ESCAPED = {"n": "\n", "r": "\r", "t": "\t"}


def _open(path: str) -> pa.NativeFile:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(path)
    return system.open_input_file(path)


def _lines(f: pa.NativeFile, at: int, block: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(place, line) from ``at`` on."""
    rest, size = b"", f.size()
    end = at
    while end < size or rest:
        data = f.read_at(min(block, size - end), end) if end < size else b""
        end += len(data)
        parts = (rest + data).split(b"\n")
        rest = parts.pop() if end < size else b""
        for line in parts:
            yield at, line.decode().rstrip("\r")
            at += len(line) + 1


def _bare(value: str) -> str:
    """A value without its quotes and escapes."""
    if len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]:
        return re.sub(r"\\(.)|\"\"", lambda m: ESCAPED.get(m[1], m[1] or '"'), value[1:-1]) if "\\" in value or '""' in value else value[1:-1]
    return value


def header(f: pa.NativeFile) -> tuple[list[tuple[str, str]], int]:
    """(name, kind) of the attributes, a relational one being of kind "relational", and where the data begins."""
    found, inside = [], False
    for at, line in _lines(f, 0, 1 << 16):
        low = line.strip().lower()
        if low.startswith("@data"):
            return found, at + len(line.encode()) + 1
        if low.startswith("@end"):
            inside = False
        elif low.startswith("@attribute") and not inside:
            m = ATTRIBUTE.match(line.strip())
            kind = m[2].strip().lower().split()[0] if m else ""
            if not m or not (kind in KINDS or kind in ("string", "date", "relational") or kind.startswith("{")):
                raise ValueError(f"no attribute at byte {at}: {line[:80]}")
            inside = kind == "relational"
            found.append((_bare(m[1]), kind if inside else KINDS.get(kind, "string")))
    raise ValueError("the file has no @data")


class Range(InputPartition):
    def __init__(self, file: int, path: str, begin: int, start: int, end: int):
        self.file, self.path, self.begin, self.start, self.end = file, path, begin, start, end


class ArffReader(DataSourceReader):
    def __init__(self, paths: list[str], attributes: list[tuple[str, str]], fields: list[tuple[str, str]], split: int):
        self.paths, self.attributes, self.fields, self.split = paths, attributes, fields, split

    def partitions(self) -> list[Range]:
        out = []
        for i, path in enumerate(self.paths):
            with _open(path) as f:
                attributes, begin = header(f)
                if attributes != self.attributes:
                    raise ValueError(f"{path} has other attributes than {self.paths[0]}")
                out += [Range(i, path, begin, at, min(at + self.split, f.size())) for at in range(begin, f.size(), self.split)]
        return out or [Range(0, self.paths[0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range: its first bytes belong to the line before unless that ends right there."""
        schema = pa.schema([(n, ARROW[k]) for n, k in self.fields])
        columns: list[list] = [[] for _ in self.fields]
        with _open(partition.path) as f:
            here = partition.start > partition.begin
            lines = _lines(f, partition.start - 1 if here else partition.start, max(min(self.split, 1 << 20), 1 << 12))
            if here:
                next(lines, None)  # the rest of a line, or nothing but its end
            for at, line in lines:
                if at >= partition.end:
                    break
                if not line.strip() or line.lstrip().startswith("%"):
                    continue
                try:
                    self._row(partition.file, at, line, columns)
                except ValueError as e:
                    raise ValueError(f"{partition.path}, byte {at}: {e}") from e
                if len(columns[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)
                    columns = [[] for _ in self.fields]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

    def _row(self, file: int, at: int, line: str, columns: list[list]) -> None:
        if line.lstrip().startswith("{"):
            raise ValueError("sparse rows are not read")
        values, pos = [], 0
        while True:
            m = VALUE.match(line, pos)
            if not m:
                raise ValueError(f"a value that does not end: {line[pos : pos + 40]}")
            values.append(m[1])
            pos = m.end()
            if m[2] == "":
                break
        if len(values) != len(self.attributes):
            raise ValueError(f"{len(values)} values for {len(self.attributes)} attributes")
        plain, series = [], None
        for value, (_, kind) in zip(values, self.attributes, strict=True):
            if kind == "relational":
                series = [[_number(v, float) for v in channel.split(",")] for channel in value.strip("'\"").replace("\\n", "\n").split("\n")]
            else:
                plain.append(None if value == "?" else _number(value, float if kind == "double" else int) if kind != "string" else _bare(value))
        if series is None:
            for c, v in zip(columns, (file, at, *plain), strict=True):
                c.append(v)
            return
        for d, channel in enumerate(series):
            n = len(channel)
            for c, v in zip(columns, ([file] * n, [at] * n, [d] * n, range(n), channel, *([v] * n for v in plain)), strict=True):
                c.extend(v)


def _number(value: str, kind: type) -> float | int | None:
    value = value.strip()
    return None if value == "?" else kind(value)


class ArffSource(DataSource):
    """Options: ``paths``, a JSON list of files of the same attributes; ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def _known(self) -> tuple[list[str], list[tuple[str, str]], list[tuple[str, str]]]:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        with _open(paths[0]) as f:
            attributes, _ = header(f)
        if sum(k == "relational" for _, k in attributes) > 1:
            raise ValueError("a file has one relational attribute at most")
        plain = [(n, k) for n, k in attributes if k != "relational"]
        series = [("dim_id", "int"), ("t", "long"), ("value", "double")] if len(plain) < len(attributes) else []
        return paths, attributes, [("file", "int"), ("at", "long"), *series, *plain]

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in self._known()[2])

    def reader(self, schema) -> ArffReader:
        return ArffReader(*self._known(), int(self.options.get("splitBytes", 16 << 20)))


def load(spark: SparkSession, *paths: str, split_bytes: int = 16 << 20) -> DataFrame:
    """file, at (byte of the row's line), and a column for each attribute; of relational files dim_id, t, value and the other attributes.

    A missing value (?) is null. Paths must be ones that ``pyarrow.fs`` opens on driver and executors; rows that are not
    as the header says are an error that names file and byte. A file without rows gives none.
    """
    if not paths:
        raise ValueError("at least one path is needed")
    prepare(spark)
    spark.dataSource.register(ArffSource)
    return spark.read.format("arff").option("paths", json.dumps(paths)).option("splitBytes", split_bytes).load()


def samples(spark: SparkSession, *paths: str, split_bytes: int = 16 << 20) -> DataFrame:
    """sample_id, dim_id, t, value and the other attributes of relational files, one file after the other; a missing value is 0."""
    rows = load(spark, *paths, split_bytes=split_bytes)
    first = rows.where("dim_id = 0 AND t = 0").select("file", "at")
    numbered = with_index(first, "file", "at", name="sample_id")
    rest = [f"`{c.replace('`', '``')}`" for c in rows.columns if c not in ("file", "at", "dim_id", "t", "value")]
    return rows.join(numbered, ["file", "at"]).select("sample_id", "dim_id", "t", F.coalesce("value", F.lit(0.0)).alias("value"), *rest)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write(rows: DataFrame, folder: str, relation: str = "rows") -> None:
    """Numbers and strings as ARFF files in a new ``folder``: each part is a file of its own, with the header. Nulls are missing values.

    ``load`` reads them back. Columns of other kinds, and numbers that are not finite, are an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if wrong := [c for c, k in kinds.items() if k not in WRITTEN]:
        raise ValueError(f"columns that are no numbers or strings: {wrong}")
    head = [f"@relation {_quoted(relation)}", *(f"@attribute {_quoted(c)} {WRITTEN[k]}" for c, k in kinds.items()), "@data"]

    def value(name: str, kind: str):
        c = F.col(f"`{name.replace('`', '``')}`")
        if kind == "string":
            for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                c = F.replace(c, F.lit(plain), F.lit(escaped))
            return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("?"))
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{name} is not finite"))).otherwise(c)
        return F.coalesce(c.cast("string"), F.lit("?"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
        yield from (pa.RecordBatch.from_arrays(batch.columns, ["value"]) for batch in batches)

    rows.select(F.concat_ws(",", *(value(c, k) for c, k in kinds.items())).alias("value")).mapInArrow(headed, "value string").write.text(folder)
    if _parts(rows.sparkSession, folder).isEmpty():  # no partitions, no header
        rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(folder)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path")


def load_folder(spark: SparkSession, folder: str, split_bytes: int = 16 << 20) -> DataFrame:
    """``load`` of all files that ``write`` left in ``folder``, by name."""
    paths = _parts(spark, folder).orderBy("path").collect()  # a row for each file
    return load(spark, *(r["path"] for r in paths), split_bytes=split_bytes)
