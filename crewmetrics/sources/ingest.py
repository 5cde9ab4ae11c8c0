"""One ingest run: known CSV files to masked tables, with a status row per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics import reference as ref
from crewmetrics import schemas
from crewmetrics.functions.masking import mask_columns, pii_columns
from crewmetrics.sources.delimited import unread
from crewmetrics.sources.files import exists, read_csv, read_declared_csv, write_parquet

STATUS = "file string, table string, status string, message string"


def ingest(
    spark: SparkSession,
    folder: str,
    target: str,
    salt: str,
    files: dict[str, str] | None = None,
    compat: bool = False,
    mask: bool = True,
) -> DataFrame:
    """Read, mask and write each known file to ``target/<table>`` as parquet.

    A missing file is skipped and a bad one does not stop the others.  The run succeeded if at
    least one status is ``created`` (see ``succeeded``).  Values that are not of their column's type become null; how many, and
    how many rows have another number of fields, stands in the message.
    """
    status = []
    for name, table in (files or ref.INGEST_FILES).items():
        path = f"{folder.rstrip('/')}/{name}"
        if not exists(spark, path):
            status.append((name, table, "skipped", "file not found"))
            continue
        try:
            schema = schemas.TABLES.get(table)
            # the order of catalog, skill and employee rows decides between equal candidates
            ordered = table in ("ld_catalog", "skills", "employees")
            if schema is None:
                df, counts = read_csv(spark, path, ordinal=ordered, counts=True)
            else:
                df, counts = read_declared_csv(spark, path, schema, schemas.OPTIONAL.get(table, set()), ordered, counts=True)
            if mask:
                df = mask_columns(df, pii_columns(df, compat), salt)
            write_parquet(df, f"{target.rstrip('/')}/{table}")
            status.append((name, table, "created", unread(counts)))
        except Exception as error:  # noqa: BLE001 - reported in the status row
            status.append((name, table, "failed", str(error).splitlines()[0][:500]))
    return spark.createDataFrame(status, STATUS)


def succeeded(status: DataFrame) -> bool:
    return not status.where(F.col("status") == "created").isEmpty()
