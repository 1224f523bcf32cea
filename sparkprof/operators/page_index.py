"""Pages of a table from a stored order: no page after the first has to sort again."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprof.columns import qcol, require_columns
from sparkprof.operators.paging import DEFAULT_ROWS, check_page, row_order

ROWS_PER_FILE = 1_000_000
# Added to the stored rows: consecutive within a file, rising from file to file.
_PLACE = "_page_place"


def build_page_index(df: DataFrame, key: str, path: str, rows_per_file: int = ROWS_PER_FILE) -> PageIndex:
    """Stores the rows in the order of a key (NULL first, equal keys by the other columns) with an index.

    The rows are range-partitioned and sorted once, and written in files of at most
    ``rows_per_file`` rows.  The index has a row per file: its first and last key, its number of
    rows and the rows before it.
    """
    require_columns(df, [key])
    spark = df.sparkSession
    ordered = df.orderBy(*row_order(df, key)).withColumn(_PLACE, F.monotonically_increasing_id())
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    stored = spark.read.schema(ordered.schema).parquet(f"{path}/rows")
    files = stored.select(F.input_file_name().alias("file"), qcol(key).alias("key"), _PLACE).groupBy("file").agg(
        F.min(_PLACE).alias("place"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("key").isNull()).alias("nulls"),
        F.min("key").alias("least"), F.max("key").alias("most"),
    )
    # A row per file.
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    files.select("*", before).coalesce(1).write.parquet(f"{path}/files")
    return PageIndex(spark, key, path)


class PageIndex:
    """Reads pages and ranks from rows stored by ``build_page_index``."""

    def __init__(self, spark: SparkSession, key: str, path: str) -> None:
        self.spark, self.key, self.path = spark, key, path
        self._schema = spark.read.parquet(f"{path}/rows").schema
        self._files = spark.read.parquet(f"{path}/files")

    def total(self) -> int:
        return self._files.agg(F.sum("n")).first()[0] or 0

    def page(self, limit: int = DEFAULT_ROWS, offset: int = 0) -> DataFrame:
        """Rows ``[offset, offset + limit)``: only the files that hold them are read, and of these the places."""
        check_page(limit, offset)
        held = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
        # Every file has a row at least, so there are no more of them than rows.
        files = self._files.filter(held).orderBy("before").collect()
        rows = self._read([f["file"] for f in files])
        wanted = F.lit(False)
        for f in files:
            first = f["place"] + max(0, offset - f["before"])
            last = f["place"] + min(f["n"], offset + limit - f["before"]) - 1
            wanted |= F.col(_PLACE).between(first, last)
        return rows.filter(wanted).orderBy(_PLACE).drop(_PLACE)

    def rank(self, value) -> int:
        """How many rows come before the first with this key or a larger one; NULL comes first."""
        if value is None:
            return 0
        key = F.lit(value)
        # All rows of a file are before the key, or it reaches it: that is one file, or none.
        whole = self._files.filter(F.col("most").isNull() | (F.col("most") < key)).agg(F.sum("n")).first()[0] or 0
        reached = self._files.filter((F.col("most") >= key) & ((F.col("least") < key) | (F.col("nulls") > 0)))
        rows = self._read([r["file"] for r in reached.select("file").collect()])
        return whole + rows.filter(qcol(self.key).isNull() | (qcol(self.key) < key)).count()

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*map(unquote, files))
