"""CSV files as tables, without losing rows and with a count of what could not be read.

Files are parsed as text fields.  A pass over the rows of each split then drops the ``#`` lines before a file's header and the
header itself, which must be the same in all files; later rows may begin with ``#``.  Types come from a schema or from one
more pass, and values that do not fit become null; another pass counts them where that is asked for.  Files
are split among tasks unless a quoted value holds a line break, which one pass over the lines finds out.
"""

from __future__ import annotations

import csv as csv_format
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE, _BLOCK, _POSITION, _BROKEN = "_file", "_block", "_position", "_broken"


class Files:
    """What to read: a path, several, or all files below a folder whose name matches a pattern."""

    def __init__(self, spark: SparkSession, path: str | list[str], pattern: str | None = None, comment: str = "#"):
        self.spark, self.path, self.comment = spark, path, comment
        self.options = {"pathGlobFilter": pattern, "recursiveFileLookup": True} if pattern else {}

    def lines(self) -> DataFrame:
        return self.spark.read.options(**self.options).text(self.path)

    def header(self) -> list[str] | None:
        """The names in the first line that is no comment, of whichever file Spark reads first."""
        line = self.lines().where(~F.startswith("value", F.lit(self.comment)) & (F.trim("value") != "")).first()
        return next(csv_format.reader([line.value.removeprefix("﻿")])) if line else None

    def broken_quotes(self) -> bool:
        """Whether a quoted value goes on in the next line: then a line has an odd number of quotes."""
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        return not self.lines().where(quotes % 2 == 1).isEmpty()

    def fields(self, names: list[str], multiline: bool) -> DataFrame:
        """All rows below the headers as text, with ``_broken`` (another number of fields) and their file, split and place in it."""
        fields = [f"c{i}" for i in range(len(names))]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*fields, _BROKEN]])
        raw = (
            self.spark.read.options(**self.options).schema(schema).option("escape", '"').option("multiLine", multiline)
            .option("columnNameOfCorruptRecord", _BROKEN).csv(self.path)
            .select(*fields, F.col(_BROKEN).isNotNull().alias(_BROKEN), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))
        )
        comment = self.comment

        def below_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split, position, looking = None, 0, False
            for batch in batches:
                file, block = (batch.column(c).to_pylist() for c in (_FILE, _BLOCK))
                kept, places = [], []
                for i, here in enumerate(zip(file, block, strict=True)):
                    if here != split:
                        split, position, looking = here, 0, here[1] == 0
                    if looking:
                        values = [batch.column(c)[i].as_py() for c in range(len(names))]
                        if (values[0] or "").removeprefix("﻿").startswith(comment):
                            continue
                        values[0] = (values[0] or "").removeprefix("﻿")
                        if [v or "" for v in values] != names or batch.column(_BROKEN)[i].as_py():
                            raise ValueError(f"the header of {here[0]} is {values}, not {names}")
                        looking = False
                        continue
                    kept.append(i)
                    places.append(position)
                    position += 1
                part = batch.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.int64())], [*part.schema.names, _POSITION])

        return raw.mapInArrow(below_headers, T.StructType([*raw.schema, T.StructField(_POSITION, T.LongType())]))


def _fits(field: Column, kind: str) -> Column:
    """Whether a text is a value of a type."""
    shape = {"date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", "boolean": "(?i)^(true|false)$"}.get(kind)
    fits = field.try_cast(kind).isNotNull()
    return fits & field.rlike(shape) if shape else fits


def _inferred(rows: DataFrame, names: list[str]) -> T.StructType:
    """For each column the first type that all its values fit; text where none does."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    given = [F.trim(f"c{i}") for i in range(len(names))]
    fitting = [
        F.array(*[F.coalesce(F.bool_and(F.when(value != "", _fits(value, kind))), F.lit(False)) for kind in kinds]).alias(f"c{i}")
        for i, value in enumerate(given)
    ]
    found = rows.agg(*fitting).first()
    first = lambda fits: next((t for t, ok in zip(kinds.values(), fits, strict=True) if ok), T.StringType())
    return T.StructType([T.StructField(name, first(found[i])) for i, name in enumerate(names)])


def _with_ordinal(rows: DataFrame) -> DataFrame:
    """``ordinal``: dense numbers in the order of file names, splits and rows; one small row for each split is held."""
    splits = rows.groupBy(_FILE, _BLOCK).agg(F.count("*").alias("n")).orderBy(_FILE, _BLOCK).collect()
    starts, total = [], 0
    for s in splits:
        starts.append((s[_FILE], s[_BLOCK], total))
        total += s.n
    before = rows.sparkSession.createDataFrame(starts, f"{_FILE} string, {_BLOCK} long, _start long")
    return rows.join(before, [_FILE, _BLOCK]).withColumn("ordinal", F.col("_start") + F.col(_POSITION))


def read(files: Files, types: dict[str, T.DataType] | None, ordinal: bool = False, multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of some files, typed by column name, and one row that counts what could not be read.

    Columns without a type stay text, without ``types`` all are inferred.  ``multiline`` says whether quoted values hold line
    breaks, by default one pass finds out.  The counts are ``broken`` rows with too few or too many fields, and the values of each
    column that are not of its type, under its name; they are computed only if they are asked for.
    """
    names = files.header()
    if names is None:
        raise ValueError(f"no header in {files.path}")
    rows = files.fields(names, files.broken_quotes() if multiline is None else multiline)
    if types is None:
        types = {f.name: f.dataType for f in _inferred(rows, names)}
    typed, bad = [], [F.count_if(F.col(_BROKEN)).alias("broken")]
    for i, name in enumerate(names):
        field, kind = F.col(f"c{i}"), types.get(name, T.StringType())
        value = field if isinstance(kind, T.StringType) else F.trim(field).try_cast(kind)
        typed.append(value.alias(name))
        bad.append(F.count_if((F.trim(field) != "") & value.isNull()).alias(f"bad_{i}"))
    counts = rows.agg(*bad).toDF("broken", *[f"values in {name}" for name in names])
    return (_with_ordinal(rows) if ordinal else rows).select(*typed, *["ordinal"] * ordinal), counts


def unread(counts: DataFrame) -> str:
    """What could not be read, in words; empty if nothing."""
    found = counts.first()
    parts = [f"{n} unreadable {name}" for name, n in zip(counts.columns[1:], found[1:], strict=True) if n]
    return "; ".join(parts + [f"{found[0]} rows with another number of fields"] * (found[0] > 0))
