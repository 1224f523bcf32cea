"""CSV with a header row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import qcol
from sparkprof.sources.json_records import MOMENTS

# The dialect that is read and written.
DIALECT = {"header": True, "encoding": "UTF-8", "sep": ",", "quote": '"', "escape": '"'}

# Types from narrow to wide, and how their values are written.
KINDS = {
    "boolean": r"^(?i:true|false)$",
    "bigint": r"^[+-]?\d{1,19}$",
    "double": r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|[+-]?(?:Infinity|Inf))$",
    "date": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "timestamp_ntz": r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)?$",
}
LINE = "_line"
# About the bytes of a file that has to be read whole.
FILE_BYTES = 32_000_000


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    quoted_newlines: bool = False,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """A table from one or many CSV files.

    Without a schema the types are inferred, which reads the files once more.
    Spark splits large files.  Only with ``quoted_newlines=True`` may a quoted field hold
    line breaks; every file is then read by one task (``write_csv`` makes such files small).
    """
    reader = spark.read.options(**DIALECT, multiLine=quoted_newlines)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.options(inferSchema=True, samplingRatio=sampling_ratio).csv(path)


def write_csv(df: DataFrame, path: str, quoted_newlines: bool = False) -> None:
    """Writes what ``read_csv`` reads back unchanged, surrounding blanks included.

    With ``quoted_newlines=True``, for texts with line breaks, whose files cannot be split, a first
    scan measures the texts, so that files hold no more rows than make some ``FILE_BYTES``.
    """
    writer = df.write.options(
        **DIALECT, **MOMENTS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    if quoted_newlines:
        writer = writer.option("maxRecordsPerFile", _rows_per_file(df))
    writer.csv(path)


def _rows_per_file(df: DataFrame) -> int:
    """By the length of the row that a byte lies in on average: long rows may lie side by side."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    size = F.lit(float(20 * len(df.columns)))
    for name in texts:
        size = size + F.coalesce(F.octet_length(qcol(name)), F.lit(0))
    sums = df.select(size.alias("size")).agg(F.sum(F.col("size") * F.col("size")), F.sum("size")).first()
    return max(1, int(FILE_BYTES * sums[1] / sums[0])) if sums[0] else FILE_BYTES


def infer_types(raw: DataFrame, fit: float = 1.0) -> dict[str, str]:
    """The narrowest type of each text column that at least the share ``fit`` of its values has.

    All columns are decided by one aggregate over one scan: per column and type, the number of
    values that have it.  Of the types of ``KINDS`` the first that fits is taken, else string; so is a
    column without values.
    """
    if not 0 < fit <= 1:
        raise ValueError("fit must be above 0 and at most 1")
    if not raw.columns:
        return {}
    counts = [
        F.count_if(_fits(qcol(name), kind)).alias(f"c{i}_{kind}") for i, name in enumerate(raw.columns) for kind in KINDS
    ]
    found = raw.agg(*counts, *[F.count(qcol(name)).alias(f"n{i}") for i, name in enumerate(raw.columns)]).first()
    types = {}
    for i, name in enumerate(raw.columns):
        n = found[f"n{i}"]
        types[name] = next((k for k in KINDS if n and found[f"c{i}_{k}"] >= fit * n), "string")
    return types


def _fits(value: Column, kind: str) -> Column:
    return value.rlike(KINDS[kind]) & value.try_cast(kind).isNotNull()


def typed(raw: DataFrame, types: dict[str, str], corrupt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the given types, and the rows of which a value does not have its type.

    The rejects keep every value as it was read and name the columns at fault (``rejected``);
    lines with too many or too few fields, which the column ``corrupt`` holds whole, are rejects
    with no column at fault.  Both are filters of one plan over the same scan; no value becomes
    NULL in silence.
    """
    names = [c for c in raw.columns if c != corrupt]
    of = {name: types.get(name, "string") for name in names}
    wrong = [
        F.when(qcol(name).isNotNull() & ~_fits(qcol(name), kind), F.lit(name)) for name, kind in of.items() if kind != "string"
    ]
    rejected = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    # Readers refuse plans that need nothing but broken lines, so another column is always read.
    whole = qcol(corrupt).isNull() & (F.length(F.coalesce(qcol(names[0]), F.lit(""))) >= 0) if corrupt else F.lit(True)
    good = whole & (F.size(rejected) == 0)
    rows = raw.filter(good).select(*[
        (qcol(n) if k == "string" else qcol(n).try_cast(k)).alias(n) for n, k in of.items()
    ])
    return rows, raw.filter(~good).withColumn("rejected", rejected)


def read_typed_csv(
    spark: SparkSession, path: str | list[str], types: dict[str, str] | None = None, fit: float = 1.0,
    quoted_newlines: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A table from CSV files and the rows that do not fit it (``typed``).

    Without ``types`` they are inferred from all values (``infer_types``): with a ``fit`` below 1
    a few stray values are rejected instead of turning their column into text.  The broken lines
    are in the rejects' column ``_line``.
    """
    reader = spark.read.options(**DIALECT, multiLine=quoted_newlines)
    header = reader.csv(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in header] + [T.StructField(LINE, T.StringType())])
    # Without pruning, a line is broken or not whatever columns are asked for.
    reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, columnPruning=False)
    raw = reader.schema(schema).csv(path)
    if types is None:
        types = infer_types(raw.filter(qcol(LINE).isNull()).select(*[qcol(f.name) for f in header]), fit)
    return typed(raw, types, LINE)
