"""Tables of the catalogue as Parquet: first and last row per key, full refresh, integrity and schema reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables that must be there and countable.
REFERENCE_TABLES = ("specialites", "medicaments", "medicament_summary", "generique_groups", "group_members", "laboratories")
VIEW_TABLES = ("ui_group_details", "ui_explorer_list")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder where that is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}"


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back, for steps that must see the same rows in the same places."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key (S8, M1); a partial top-1 per key runs before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str], keep_first_position: str | None = None) -> DataFrame:
    """The last row's values of each key (M2, A18), with the position of its first row if asked for."""
    values = [c for c in rows.columns if c not in keys and c != keep_first_position]
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("__row")
    extra = [F.min(keep_first_position).alias(keep_first_position)] if keep_first_position else []
    return rows.groupBy(*keys).agg(latest, *extra).select(*keys, "__row.*", *([keep_first_position] if keep_first_position else [])).select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with each changed key's last change in place of its row (M2)."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(last_per_key(changes, keys, order).select(*table.columns))


def refresh(rows: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> int:
    """Full refresh of a materialised table (M13, S14): a new version beside the old ones, committed by one rename.

    Readers of ``current`` see the old rows or the new ones, never a part, also if the job dies on its way. Of older
    versions ``keep`` - 1 stay for readers that have begun. Returns the version.
    """
    spark, folder, version = rows.sparkSession, f"rows-{uuid.uuid4().hex}", _last_version(rows.sparkSession, path) + 1
    writer = rows.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    files, hadoop = _files(spark, path)
    draft, final = hadoop(f"{path}/versions/_{uuid.uuid4().hex}"), hadoop(f"{path}/versions/{version:012d}")
    stream = files.create(draft, False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"version {version} of {path} was committed by another writer")
    for old in range(version - keep, 0, -1):
        if not files.exists(hadoop(f"{path}/versions/{old:012d}")):
            break
        files.delete(hadoop(f"{path}/{_folder(spark, path, old)}"), True)
        files.delete(hadoop(f"{path}/versions/{old:012d}"), False)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last committed version of a table that ``refresh`` wrote."""
    version = _last_version(spark, path)
    if not version:
        raise ValueError(f"{path} has no version")
    return spark.read.parquet(f"{path}/{_folder(spark, path, version)}")


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _last_version(spark: SparkSession, path: str) -> int:
    files, hadoop = _files(spark, path)
    if not files.exists(hadoop(f"{path}/versions")):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(hadoop(f"{path}/versions"))]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _folder(spark: SparkSession, path: str, version: int) -> str:
    files, hadoop = _files(spark, path)
    stream = files.open(hadoop(f"{path}/versions/{version:012d}"))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(rows: DataFrame, path: str) -> None:
    """S10."""
    rows.write.mode("overwrite").json(path)


def run_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL over named DataFrames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def opened(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame | None]:
    """Tables of a folder by name, None for those that aren't there or have no schema."""
    found: dict[str, DataFrame | None] = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            found[name] = None
    return found


def row_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """table_name and n of each table, counted in one job; n is null for a table that isn't there."""
    there = {name: df for name, df in tables.items() if df is not None}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in there.items()]
    absent = [name for name in tables if name not in there]
    if absent:
        spark = SparkSession.active()
        counts.append(spark.createDataFrame([(name, None) for name in absent], "table_name string, n long"))
    return reduce(DataFrame.unionByName, counts)


def missing_tables(tables: dict[str, DataFrame | None]) -> list[str]:
    """Which of the tables that must be there are not."""
    return [name for name in (*REFERENCE_TABLES, *VIEW_TABLES) if tables.get(name) is None]


def check_integrity(tables: dict[str, DataFrame | None]) -> DataFrame:
    """table_name, n and state of each table: missing, empty or ready, by its counted rows."""
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("ready")
    return row_counts(tables).withColumn("state", state)


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, position, sql_type, app_type, nullable and filled (values that aren't null) of every column."""

    def columns(name: str, df: DataFrame) -> DataFrame:
        fixed = lambda i, f: {"table_name": name, "column_name": f.name, "position": i, "sql_type": f.dataType.simpleString(), "app_type": app_type(f.dataType), "nullable": f.nullable}
        quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
        cells = [F.struct(*(F.lit(v).alias(k) for k, v in fixed(i, f).items()), F.count(quoted(f)).alias("filled")) for i, f in enumerate(df.schema)]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))

    return reduce(DataFrame.unionByName, (columns(name, df) for name, df in tables.items()))


def app_type(kind: T.DataType) -> str:
    """The client's type of a column."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.FractionalType):
        return "double"
    if isinstance(kind, T.BinaryType):
        return "Uint8List"
    if isinstance(kind, T.ArrayType):
        return f"List<{app_type(kind.elementType)}>"
    return "String"


# Constraints, as queries of what breaks them


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def broken_references(rows: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference isn't null and has no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def assertion(name: str, broken: DataFrame) -> DataFrame:
    """check_name and the number of rows that break it."""
    return broken.agg(F.count("*").alias("broken")).select(F.lit(name).alias("check_name"), "broken")


def update_available(versions: DataFrame, local: str, remote: str) -> DataFrame:
    """Versions with available: whether the remote one is newer by date, or else only another text."""
    date = lambda c: F.substring(F.replace(F.col(c), F.lit("db-"), F.lit("")), 1, 10).try_cast("date")
    newer = F.coalesce(date(remote) > date(local), F.col(remote) != F.coalesce(local, F.lit("")))
    return versions.withColumn("available", F.col(remote).isNotNull() & newer)
