"""Stored evidence tables: versions of captures behind one switch, pruned scans, and JSON documents.

A store is a folder::

    <table>/write=<id>/capture_id=<c>/   rows of one replacement, never changed afterwards
    replaced/write=<id>/                 (table_name, capture_id) it replaces, those without rows too
    commits/<version>.json               version, write id and schemas; creating this file is the switch

Readers take, for every capture, the rows of the last committed write that replaced
it. A job that dies before its commit leaves rows nobody reads, so all tables and all
emptied captures of an analysis change together or not at all. Two writers cannot
create the same version; the later one takes the next, and its rows stand.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "rows"
SPREAD = 16  # tasks that write one capture
PRUNING_ROWS = 10_000  # selections up to this size become a filter on folders; larger ones are joined
_COMMIT = "version bigint, write string, schemas map<string, string>"
_REPLACED = "table_name string, capture_id string, write string"


def scan(spark: SparkSession, path: str, captures: list[str] | DataFrame | None = None, table: str = ROWS) -> DataFrame:
    """A stored table as of its last commit.

    ``captures``, names or a frame with ``capture_id``, limits what is read: up to
    ``PRUNING_ROWS`` of them, only the folders of their current versions are opened.
    """
    commits = _commits(spark, path)
    named = commits.where(F.col("schemas").getItem(table).isNotNull())
    last = named.orderBy(F.desc("version")).limit(1).select(F.col("schemas").getItem(table)).first()
    if last is None:
        raise ValueError(f"no committed table {table} in {path}")
    live = current_versions(spark, path).where(F.col("table_name") == table).select("write", "capture_id")
    if isinstance(captures, list):
        live = live.where(F.col("capture_id").isin(*captures))
    elif captures is not None:
        live = live.join(captures.select("capture_id").distinct(), "capture_id", "left_semi").select("write", "capture_id")
    folders = F.lit(True)
    if captures is not None:
        chosen = live.limit(PRUNING_ROWS + 1).collect()
        if len(chosen) <= PRUNING_ROWS:
            live = F.broadcast(spark.createDataFrame(chosen, "write string, capture_id string"))
            folders = F.concat_ws("/", "write", "capture_id").isin([f"{r.write}/{r.capture_id}" for r in chosen])
    rows = T.StructType.fromJson(json.loads(last[0]))
    stored = spark.read.schema(_with_folders(rows)).parquet(f"{path}/{table}").where(folders)
    return stored.join(live, ["write", "capture_id"], "left_semi").select(*rows.names)


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, capture_id, write): the write that holds a capture's rows now."""
    replaced = spark.read.schema(_REPLACED).parquet(f"{path}/replaced").join(_commits(spark, path).select("write", "version"), "write")
    return replaced.groupBy("table_name", "capture_id").agg(F.max_by("write", "version").alias("write"))


def replace_captures(rows: DataFrame, path: str, captures: DataFrame | None = None) -> None:
    """Replace the rows of ``captures`` (capture_id), and of those present in ``rows``; re-running leaves the same table."""
    replace_tables({ROWS: rows}, path, captures)


def replace_tables(tables: dict[str, DataFrame], path: str, captures: DataFrame | None = None) -> int:
    """Replace captures in several tables by one switch and return the version.

    Every row needs a capture_id: one without stops the job before the switch. Rows
    are spread within a capture by hash, so one very large capture is written by many
    tasks. Which captures have rows is read from what was written: ``rows`` is
    evaluated once.
    """
    spark = next(iter(tables.values())).sparkSession
    write = uuid.uuid4().hex
    named = None
    for table, rows in tables.items():
        target = f"{path}/{table}/write={write}"
        known = rows.withColumn("capture_id", F.coalesce("capture_id", F.raise_error(F.lit(f"{table}: row without capture_id"))))
        spread = known.repartition("capture_id", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "capture_id"][:1]), F.lit(SPREAD)))
        spread.write.partitionBy("capture_id").parquet(target)
        present = spark.read.schema(_with_folders(rows.schema)).option("basePath", f"{path}/{table}").parquet(target).select("capture_id")
        present = (present if captures is None else present.union(captures.select("capture_id"))).distinct().select(F.lit(table).alias("table_name"), "capture_id")
        named = present if named is None else named.union(present)
    named.write.parquet(f"{path}/replaced/write={write}")
    return _commit(spark, path, write, {table: rows.schema.json() for table, rows in tables.items()})


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders of captures that a later commit replaced, and return how many. Readers that
    began before that commit must have ended; writes that are not committed are left alone."""
    replaced = spark.read.schema(_REPLACED).parquet(f"{path}/replaced").join(_commits(spark, path).select("write"), "write", "left_semi")
    stale = replaced.join(current_versions(spark, path), ["table_name", "capture_id", "write"], "left_anti")
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName  # as the writer names partitions
    files, gone = _files(spark, path), 0
    for row in stale.toLocalIterator():
        gone += bool(files.delete(_folder(spark, f"{path}/{row.table_name}/write={row.write}/capture_id={escaped(row.capture_id)}"), True))
    return gone


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COMMIT).json(f"{path}/commits").where(F.col("write").isNotNull())


def _commit(spark: SparkSession, path: str, write: str, schemas: dict[str, str]) -> int:
    """Create the file of the next version; whoever finds it taken goes on to the one after."""
    files, folder = _files(spark, path), _folder(spark, f"{path}/commits")
    files.mkdirs(folder)
    version = max((int(s.getPath().getName().split(".")[0]) for s in files.listStatus(folder)), default=0) + 1
    while True:
        try:
            out = files.create(_folder(spark, f"{path}/commits/{version:019d}.json"), False)
        except Exception as problem:  # noqa: BLE001 - the class lives in the JVM
            if "FileAlreadyExists" not in str(problem):
                raise
            version += 1
            continue
        out.write(bytearray(json.dumps({"version": version, "write": write, "schemas": schemas}).encode()))
        out.close()
        return version


def _with_folders(rows: T.StructType) -> T.StructType:
    """The rows' own columns, then those of the folder names, as texts."""
    own = [f for f in rows.fields if f.name not in ("write", "capture_id")]
    return T.StructType([*own, T.StructField("write", T.StringType()), T.StructField("capture_id", T.StringType())])


def _files(spark: SparkSession, path: str):
    return _folder(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def json_documents(rows: DataFrame) -> DataFrame:
    """One deterministic JSON text per row: keys in alphabetical order, NULL kept."""
    ordered = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    return rows.select(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("value"))


def write_json_documents(rows: DataFrame, path: str) -> None:
    json_documents(rows).write.mode("overwrite").text(path)
