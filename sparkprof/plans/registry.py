"""Datasets and training runs as append-only tables.

Every change is one more row with an ``op`` (put, delete or clear) and the time
it was made; the current state is the latest row per id.  Writers never rewrite
files, so concurrent appends and lost executors cannot damage what is stored.
Snapshots beside the log spare readers its history.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.operators.profile import profile
from sparkprof.plans.profiles import refresh, table_profile

RUN_SCHEMA = (
    "id string, name string, model_type string, algorithm string, features array<string>, "
    "target string, params map<string,string>, metrics map<string,double>, "
    "confusion_matrix array<array<bigint>>, feature_importance map<string,double>, "
    "dataset_id string, train_size bigint, test_size bigint, created_at timestamp_ntz, "
    "model_path string"
)
DATASET_SCHEMA = (
    "id string, filename string, path string, created_at timestamp_ntz, row_count bigint, "
    "column_count int, columns array<struct<name:string,type:string,spark_type:string,"
    "nullable:boolean,null_count:bigint,non_null_count:bigint>>"
)
PUT, DELETE, CLEAR = "put", "delete", "clear"
CHANGE = ("op", "updated_at")
# Folders in those of a registry and a dataset; readers pass over names that begin so.
SNAPSHOTS, STATES = "_snapshots", "_states"
# The cells of a run's confusion matrix, in the folder of its model.
CONFUSION = "confusion"
# Places of a bitmap, as many as bitmap_construct_agg has.
PLACES = 32_768


def changes(rows: DataFrame, op: str = PUT, at=None) -> DataFrame:
    """Registry rows that record the same change for each of the given rows."""
    moment = F.lit(at or now()).cast("timestamp_ntz")
    return rows.withColumns({"op": F.lit(op), "updated_at": moment})


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def open_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The changes that decide the current state: all, or the latest snapshot and what came after it."""
    scan = spark.read.schema(f"{schema}, op string, updated_at timestamp_ntz")
    snapshot = _latest_snapshot(spark, path)
    if snapshot is None:
        return scan.parquet(path)
    held = {r["file"] for r in spark.read.parquet(f"{snapshot}/files").collect()}
    later = sorted(set(scan.parquet(path).inputFiles()) - held)
    changes = scan.parquet(f"{snapshot}/changes")
    return changes.unionByName(scan.parquet(*map(unquote, later))) if later else changes


def take_snapshot(spark: SparkSession, path: str, schema: str, key: str = "id") -> str:
    """Writes the changes that still decide the current state, and the names of the files they stand for.

    A change decides if it is of its id's latest moment since the latest clear; deletes and that clear are
    kept too, so that changes which arrive late with an earlier moment stay without effect.
    The snapshot counts once its mark of success is there, which a store writes whole or not at all;
    readers take the latest such.  Log files are left as they are, so readers at work are not
    disturbed, and snapshots that are taken side by side are all right.
    """
    files = sorted(set(spark.read.schema(f"{schema}, op string, updated_at timestamp_ntz").parquet(path).inputFiles()))
    place = f"{path.rstrip('/')}/{SNAPSHOTS}/{int(now().timestamp() * 1e6):020d}-{uuid.uuid4().hex[:8]}"
    log = open_registry(spark, path, schema)
    cleared = log.filter(F.col("op") == CLEAR).agg(F.max("updated_at").alias("updated_at"))
    clears = log.filter(F.col("op") == CLEAR).join(F.broadcast(cleared), "updated_at", "left_semi")
    live, last = _latest(log, key)
    decisive = live.join(last, [key, "_moment"], "left_semi").drop("_moment")
    kept = decisive.unionByName(clears.limit(1)).select(*log.columns)
    kept.write.parquet(f"{place}/changes")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{place}/files")
    return place


def _latest_snapshot(spark: SparkSession, path: str) -> str | None:
    """The last snapshot whose list of files is complete, which is written after its changes."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{SNAPSHOTS}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    whole = [
        s.getPath().toString() for s in store.listStatus(folder)
        if store.exists(jvm.org.apache.hadoop.fs.Path(f"{s.getPath().toString()}/files/_SUCCESS"))
    ]
    return max(whole, default=None)


def _latest(registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The changes since the latest clear with their moment, and the last moment of every id.

    Moments are numbers, even for a put, odd for a delete, which comes after a put of the same time.
    """
    cleared = registry.filter(F.col("op") == CLEAR).agg(F.max("updated_at")).scalar()
    since = F.coalesce(F.col("updated_at") > cleared, F.lit(True))
    gone = (F.col("op") == DELETE).cast("bigint")
    micros = F.unix_micros(F.col("updated_at").cast("timestamp"))
    live = registry.filter((F.col("op") != CLEAR) & since).withColumn("_moment", micros * 2 + gone)
    return live, live.groupBy(key).agg(F.max("_moment").alias("_moment"))


def current(registry: DataFrame, key: str = "id") -> DataFrame:
    """The latest row of every id that was not deleted or cleared since.

    The moments of an id are reduced to one number before the shuffle, a hash aggregate
    however many changes there are; the rows of that moment are then read by a join.  At
    the same moment a delete wins over a put, and of several puts the one whose fields
    have the larger hash; whole rows are shuffled only where a bitmap of the ties has their place.
    """
    fields = [c for c in registry.columns if c not in (key, *CHANGE)]
    live, last = _latest(registry, key)
    puts = live.filter(F.col("op") == PUT)
    # How often a moment occurs is counted with the moments, so that only ties are told apart by their fields.
    times = puts.groupBy(key, "_moment").agg(F.count(F.lit(1)).alias("_times"))
    last = last.join(times, [key, "_moment"])
    # A put of the last moment is there only if no delete is: their moments differ by one.
    found = puts.join(last, [key, "_moment"])
    ties = last.filter("_times > 1")
    place = F.pmod(F.xxhash64(key, "_moment"), F.lit(PLACES))
    marked = ties.agg(F.bitmap_construct_agg(place)).scalar()
    byte = F.conv(F.hex(F.substring(marked, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = puts.filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1)
    tied = maybe.join(ties, [key, "_moment"]).withColumn("_mark", _mark(registry, fields))
    marks = tied.groupBy(key, "_moment").agg(F.max("_mark").alias("_mark"))
    tied = tied.join(marks, [key, "_moment", "_mark"]).dropDuplicates([key])
    chosen = [key, *fields, "updated_at"]
    return found.filter("_times = 1").select(*chosen).unionByName(tied.select(*chosen))


def _mark(registry: DataFrame, fields: list[str]):
    """A number that tells different puts of one moment apart."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f))) for f in fields]) if fields else F.lit(0)


def updated(current_rows: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The current rows named in ``changed`` with its columns put in, NULL included.

    Ids that are not in the registry give nothing, as an update of them would.  Of several
    changes of an id the one whose fields have the larger hash is taken.
    """
    new = [c for c in changed.columns if c != key]
    kept = [c for c in current_rows.columns if c not in (key, *CHANGE)]
    marked = changed.withColumn("_mark", _mark(changed, new))
    last = marked.groupBy(key).agg(F.max("_mark").alias("_mark"))
    once = marked.join(last, [key, "_mark"]).dropDuplicates([key])
    pairs = current_rows.alias("c").join(once.alias("n"), key)
    value = lambda f: F.col(f"n.{f}") if f in new else F.col(f"c.{f}")
    return pairs.select(key, *[value(f).alias(f) for f in kept])


def deleted(ids: DataFrame, registry: DataFrame, key: str = "id", at=None) -> DataFrame:
    """Delete rows for the ids (all other fields NULL)."""
    fields = [f for f in registry.schema if f.name not in (key, *CHANGE)]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return changes(ids.select(key, *empty), DELETE, at)


def lookup(ids: DataFrame, current_rows: DataFrame, key: str = "id") -> DataFrame:
    """Each asked id once, with whether it exists."""
    known = current_rows.select(key, F.lit(True).alias("found"))
    return (
        ids.select(key)
        .distinct()
        .join(known, key, "left")
        .select(key, F.coalesce("found", F.lit(False)).alias("found"))
    )


def existing(ids: DataFrame, current_rows: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(current_rows.select(key), key, "left_semi")


def missing(ids: DataFrame, current_rows: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(current_rows.select(key), key, "left_anti")


def get(current_rows: DataFrame, identifier: str, key: str = "id") -> DataFrame:
    """The one row with this id; unknown ids are an error."""
    row = current_rows.filter(F.col(key) == identifier)
    if row.isEmpty():
        raise LookupError(f"nothing registered under {identifier!r}")
    return row


def run_list(runs: DataFrame) -> DataFrame:
    """All that is known of each run but where its model lies."""
    return runs.select(
        F.col("id").alias("model_id"),
        "name",
        "model_type",
        "algorithm",
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        "target",
        F.coalesce("params", F.create_map().cast("map<string,string>")).alias("params"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        "created_at",
        "dataset_id",
        F.coalesce("train_size", F.lit(0)).alias("train_size"),
        F.coalesce("test_size", F.lit(0)).alias("test_size"),
    )


def run_summaries(runs: DataFrame) -> DataFrame:
    """The short form of the run list."""
    return run_list(runs).select(
        F.col("model_id").alias("id"), "model_type", "algorithm", "features", "target",
        "created_at", "metrics",
    )


def dataset_list(datasets: DataFrame) -> DataFrame:
    return datasets.select("id", "filename", "path", "created_at", "row_count", "column_count")


def dataset_columns(datasets: DataFrame) -> DataFrame:
    """One row per dataset and column."""
    return datasets.select("id", F.inline("columns"))


def dataset_entry(df: DataFrame, identifier: str, filename: str, path: str | None) -> DataFrame:
    """The registry row of a table, with its profile: one row, one scan."""
    return _entry(profile(df), identifier, filename, path)


def _entry(described: DataFrame, identifier: str, filename: str, path: str | None, created=None) -> DataFrame:
    """The registry row that holds a profile of one row per column."""
    entry = F.struct(
        F.col("column").alias("name"), "type", "spark_type", "nullable", "null_count",
        "non_null_count",
    )
    placed = F.struct("position", entry.alias("entry"))
    whole = described.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).cast("int").alias("column_count"),
        # One element per column of the table.
        F.transform(F.sort_array(F.collect_list(placed)), lambda c: c["entry"]).alias("columns"),
    )
    return whole.select(
        F.lit(identifier).alias("id"),
        F.lit(filename).alias("filename"),
        F.lit(path).cast("string").alias("path"),
        F.lit(created or now()).cast("timestamp_ntz").alias("created_at"),
        "row_count",
        "column_count",
        "columns",
    )


def _stored_entry(spark: SparkSession, schema, path: str, *entry) -> DataFrame:
    """The registry row of stored files, from the states that are kept of each beside them."""
    stored = spark.read.schema(schema).parquet(path)
    states = f"{path}/{STATES}"
    refresh(stored, states)
    described = table_profile(stored, states)
    # Files without rows have no state.
    return _entry(profile(stored) if described.isEmpty() else described, *entry)


def register_dataset(
    df: DataFrame, filename: str, folder: str, registry_path: str, identifier: str | None = None
) -> str:
    """Stores the rows as Parquet, profiles what was stored and registers it.

    The mergeable profile of each file is kept beside the rows (``dataset_profile``).
    """
    identifier = identifier or str(uuid.uuid4())
    path = f"{folder.rstrip('/')}/{identifier}"
    df.write.parquet(path)
    entry = _stored_entry(df.sparkSession, df.schema, path, identifier, filename, path)
    append(changes(entry), registry_path)
    return identifier


def append_to_dataset(df: DataFrame, current_rows: DataFrame, identifier: str, registry_path: str) -> None:
    """Adds rows to a registered table and puts its new profile; only the added files are scanned.

    The rows must have the columns and types of the table.
    """
    known = get(current_rows, identifier).select("path", "filename", "created_at", "columns").first()
    kept = [(c["name"], c["spark_type"]) for c in known["columns"]]
    given = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if kept != given:
        raise ValueError(f"columns {given} do not fit {kept}")
    path = known["path"]
    df.write.mode("append").parquet(path)
    entry = _stored_entry(df.sparkSession, df.schema, path, identifier, known["filename"], path, known["created_at"])
    append(changes(entry), registry_path)


def dataset_profile(current_rows: DataFrame, identifier: str) -> DataFrame:
    """The full profile of a registered table from the states of its files."""
    path = get(current_rows, identifier).first()["path"]
    return table_profile(current_rows.sparkSession.read.parquet(path), f"{path}/{STATES}")


def read_dataset(current_rows: DataFrame, identifier: str) -> DataFrame:
    """The stored rows of a registered table."""
    path = get(current_rows, identifier).first()["path"]
    return current_rows.sparkSession.read.parquet(path)


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
