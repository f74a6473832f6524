"""Reading and writing the row tables as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.specs import SUBJECT, keys_of

TABLES = {
    "source_documents": schemas.SOURCE_DOCUMENTS,
    "observations": schemas.OBSERVATIONS,
    "problems": schemas.PROBLEMS,
    "medications": schemas.MEDICATIONS,
    "narrative_texts": schemas.NARRATIVE_TEXTS,
    "source_day_state": schemas.SOURCE_DAY_STATE,
    "source_state": schemas.SOURCE_STATE,
    "notification_state": schemas.NOTIFICATION_STATE,
    "notification_log": schemas.NOTIFICATION_LOG,
}


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write one table.

    Observations are partitioned by code, which every query filters on, and
    sorted by subject and start inside a file. The range partitioning splits a
    code that holds most of the rows over many tasks.
    """
    writer = df
    if name == "observations":
        layout = ["coding_code", "subject_id", "effective_start"]
        writer = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
    out = writer.write.mode(mode).option("partitionOverwriteMode", "static")
    if name == "observations":
        out = out.partitionBy("coding_code")
    out.parquet(f"{root}/{name}")


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        write_table(df, root, name, mode)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def _of_document(rows: DataFrame, archive_key, keys: Sequence[str] | None, *order: str) -> DataFrame:
    """Rows of one document, each subject's that has it by themselves."""
    return rows.where(F.col("archive_key") == archive_key).orderBy(*keys_of(rows, keys), *order)


def observations_of_document(obs: DataFrame, archive_key: str, keys: Sequence[str] | None = None) -> DataFrame:
    return _of_document(obs, archive_key, keys, "effective_start", "seq")


def problems_of_document(problems: DataFrame, archive_key: str, keys: Sequence[str] | None = None) -> DataFrame:
    return _of_document(problems, archive_key, keys, "onset_date", "seq")


def medications_of_document(medications: DataFrame, archive_key: str, keys: Sequence[str] | None = None) -> DataFrame:
    return _of_document(medications, archive_key, keys, "start_date", "seq")


def day_state_list(day_states: DataFrame, source: str, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """The day states of one source, each subject's in the order of their dates."""
    return day_states.where(F.col("source_name") == source).orderBy(*keys, "date")
