"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.sources import delimited

FILE_ROWS = 1_000_000
SPLIT_BYTES = 128 * 1024 * 1024


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, empty if there is none."""
    if not exists(spark, path):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(at)]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    ordinal: bool = False,
    comment: str = "#",
    multiline: bool | None = None,
    counts: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """CSV with a header.  Without a schema one more pass infers types.

    ``#`` lines before the header are skipped in each file, later ones are rows.  The header must name the schema's columns in
    their order, in every file.  Quoted values may hold line breaks; then a file is read by one task, else it is split.
    ``ordinal`` numbers the rows in the order of file names and rows.  With ``counts`` a row that counts what could not be read
    (``delimited.read``) comes as well.
    """
    some = delimited.Files(spark, path, comment=comment)
    if schema:
        _expect(some, schema.fieldNames())
    read = delimited.read(some, {f.name: f.dataType for f in schema} if schema else None, ordinal, multiline)
    return read if counts else read[0]


def _expect(some: delimited.Files, names: list[str]) -> None:
    header = some.header()
    if header != names:
        raise ValueError(f"the header of {some.path} is {header}, not {names}")


def read_declared_csv(
    spark: SparkSession, path: str, declared: T.StructType, optional: set[str] = frozenset(), ordinal: bool = False, counts: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """A CSV file of a known table: declared types by column name, in the file's own column order.

    Columns beyond the declared ones are kept as text; a missing one is an error unless optional.
    """
    some = delimited.Files(spark, path)
    header = some.header() or []
    missing = [f.name for f in declared if f.name not in header and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {header}")
    read = delimited.read(some, {f.name: f.dataType for f in declared}, ordinal)
    return read if counts else read[0]


def read_csv_matching(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType | None = None, counts: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """All CSV files below ``folder`` whose name matches a glob such as ``*employees*{csv,csv.gz}``.

    A header with other names than the schema's, or in another order, is an error.  ``#`` lines before a file's header are
    skipped, later ones are rows.
    """
    some = delimited.Files(spark, folder, pattern)
    if schema:
        _expect(some, schema.fieldNames())
    read = delimited.read(some, {f.name: f.dataType for f in schema} if schema else None)
    return read if counts else read[0]


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, spread: bool = False
) -> DataFrame:
    """A parquet table.

    ``spread=True`` is for text and vectors: their work is bound by the processor, and a small table in a few
    files may be a single row group, which keeps one core busy however it is split.  The rows of
    such a table, with fewer files than cores and less than ``SPLIT_BYTES`` per core, are dealt to
    all cores; any other table is read as it is.
    """
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if not spread:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = len(df._jdf.inputFiles()) < cores and size < cores * SPLIT_BYTES
    return df.repartition(cores) if few else df


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.txt", extract=None) -> DataFrame:
    """(doc_id, source, title, text) of the files of one folder; files without text are left out.

    Text files are read whole.  For another format ``extract`` maps the bytes of one file to its
    text and runs in the tasks, file by file.
    """
    if extract is None:
        files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        # the metadata path is percent-encoded, with "+" standing for itself
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        docs = files.select(path.alias("source"), F.col("value").alias("text"))
    else:

        def texts(batches):
            import pandas as pd

            for batch in batches:
                yield pd.DataFrame({"source": batch["path"], "text": [extract(bytes(b)) for b in batch["content"]]})

        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        docs = files.select("path", "content").mapInPandas(texts, "source string, text string")
    title = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    return docs.where(F.length("text") > 0).select(
        F.xxhash64("source").alias("doc_id"), "source", title.alias("title"), "text"
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create or replace a table by path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """CSV with header, in files of at most ``file_rows`` rows; adaptive execution merges small parts, so a small result is one file."""
    df.hint("rebalance").write.mode("overwrite").option("header", True).option("maxRecordsPerFile", file_rows).csv(path)


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON object per row."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
