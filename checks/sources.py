"""Readers and writers: each query writes a whole table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import table
from sparkprof.scratch import new_path
from sparkprof.sources import admission, delimited, json_records, workbooks


def csv_roundtrip(spark, folder):
    """Texts with quotes, separators and line breaks, types inferred."""
    path = new_path(spark, "csv")
    delimited.write_csv(table(spark, folder, "documents"), path, quoted_newlines=True)
    rows = delimited.read_csv(spark, path, quoted_newlines=True)
    return rows.select(
        F.col("doc_id").cast("bigint"), "text", "lang", "source", F.col("n_chars").cast("bigint")
    )


_csv_roundtrip = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def csv_splittable(spark, folder):
    """A declared schema and no quoted line breaks: files are split, none is read twice."""
    path = new_path(spark, "csv")
    orders = table(spark, folder, "orders")
    delimited.write_csv(orders, path)
    rows = delimited.read_csv(spark, path, schema=orders.schema)
    return rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_STRAY = """SELECT o_orderkey, o_custkey % 2 = 0 AS even, o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 97 = 5 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR(40)) END AS price,
  CASE WHEN o_orderkey % 89 = 7 THEN '12 May' ELSE substring(CAST(o_orderdate AS VARCHAR(40)), 1, 10) END AS day"""


def _stray(spark, folder):
    """The types and the rejects of orders of which some values are written otherwise."""
    table(spark, folder, "orders").createOrReplaceTempView("_stray_orders")
    rows = spark.sql(f"{_STRAY} FROM _stray_orders").drop("o_totalprice", "o_orderdate")
    path = new_path(spark, "csv")
    delimited.write_csv(rows, path)
    return delimited.read_typed_csv(spark, path, fit=0.95)


def csv_typed(spark, folder):
    """Types by one aggregate; a few stray values do not make a column text."""
    rows, _ = _stray(spark, folder)
    return rows.withColumn("types", F.lit(",".join(f.dataType.simpleString() for f in rows.schema)))


_csv_typed = f"""WITH stray AS ({_STRAY} FROM orders)
SELECT o_orderkey, even, o_totalprice AS price, CAST(day AS DATE) AS day,
  'bigint,boolean,double,date' AS types FROM stray WHERE price <> 'n/a' AND day <> '12 May'"""


def csv_rejects(spark, folder):
    """The rows that do not fit, as they were written, with the columns at fault."""
    _, rejects = _stray(spark, folder)
    return rejects.select("o_orderkey", "even", "price", "day", F.array_join("rejected", ",").alias("rejected"))


_csv_rejects = f"""WITH stray AS ({_STRAY} FROM orders)
SELECT o_orderkey::VARCHAR AS o_orderkey, even::VARCHAR AS even, price, day,
  concat_ws(',', CASE WHEN price = 'n/a' THEN 'price' END, CASE WHEN day = '12 May' THEN 'day' END) AS rejected
FROM stray WHERE price = 'n/a' OR day = '12 May'"""


_csv_splittable = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""


def _documents(rows: DataFrame, path: str) -> None:
    """Writes one JSON document per batch of rows, as a client would send them."""

    def pack(batches):
        import json

        import pandas

        for batch in batches:
            records = [json.loads(r) for r in batch["record"]]
            document = {"name": "events", "data": records}
            yield pandas.DataFrame({"value": [json.dumps(document)]})

    record = json_records.json_record(rows).alias("record")
    packed = rows.select(record).mapInPandas(pack, "value string")
    # One document per file is what the reader expects.
    packed.write.option("maxRecordsPerFile", 1).text(path)


def json_records_in(spark, folder):
    path = new_path(spark, "json")
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value",
        F.expr("nullif(props, '{\"k\": 1}')").alias("props"),
    )
    _documents(events, path)
    return json_records.read_json_records(spark, path)


_json_records_in = """SELECT 'events' AS dataset_name, event_id,
  regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '[.]?0*$', '') AS ts, user_id, event_type, value,
  nullif(props, '{"k": 1}') AS props FROM events"""


def json_records_out(spark, folder):
    """Written as JSON lines, NaN as null, and read back with a schema."""
    path = new_path(spark, "lines")
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "props",
        F.expr("if(user_id % 5 = 0, double('NaN'), value)").alias("value"),
    )
    json_records.write_json_records(events, path)
    rows = json_records.read_json_lines(spark, path, events.schema)
    return rows.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


_json_records_out = """SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, props,
  CASE WHEN user_id % 5 <> 0 THEN value END AS value FROM events"""

_NAMES = """concat(source, CASE doc_id % 5 WHEN 0 THEN '/a.csv' WHEN 1 THEN '/b.XLSX'
  WHEN 2 THEN '/c.parquet' WHEN 3 THEN '/no_dot' ELSE '/d.xls' END)"""


def file_admission(spark, folder):
    """Every document as a listed file whose size spans the limit."""
    files = table(spark, folder, "documents").select(
        "doc_id", F.expr(_NAMES).alias("path"), F.expr("n_chars * 50000").alias("length")
    )
    return admission.admit(files)


_file_admission = f"""WITH files AS (
  SELECT doc_id, {_NAMES} AS path, n_chars * 50000 AS length FROM documents),
known AS (SELECT *, regexp_matches(lower(path), '\\.(csv|xlsx|xls)$') AS k FROM files)
SELECT doc_id, path, length, k AND length <= 104857600 AS accepted,
  CASE WHEN NOT k THEN 'extension' WHEN length > 104857600 THEN 'size' END AS reason FROM known"""


def listed_files(spark, folder):
    """Real files, found and admitted: a folder of one CSV file for each nation."""
    path = new_path(spark, "files")
    customers = table(spark, folder, "customer").repartition("c_nationkey")
    customers.write.partitionBy("c_nationkey").option("header", True).csv(path)
    found = admission.admit(admission.list_files(spark, path))
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)/[^/]*$", 1).cast("int")
    return found.groupBy(nation.alias("nation"), "accepted", "reason").agg(
        F.count(F.lit(1)).alias("files"), (F.min("length") > 0).alias("filled")
    )


_listed_files = """SELECT c_nationkey AS nation, true AS accepted, NULL::VARCHAR AS reason,
  1::BIGINT AS files, true AS filled FROM customer GROUP BY c_nationkey"""


def _workbooks(rows: DataFrame) -> DataFrame:
    """(path, content): one workbook per batch of rows, text inline."""
    names = rows.columns

    def pack(batches):
        import io
        import uuid
        import zipfile
        from xml.sax.saxutils import escape

        import pandas

        space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        book = (f'<workbook xmlns="{space}" xmlns:r="{links}"><sheets>'
                '<sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        relations = (f'<Relationships xmlns="{package}"><Relationship Id="rId1" '
                     f'Type="{links}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')

        def cell(value):
            if isinstance(value, str):
                return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
            return f"<c><v>{value!r}</v></c>"

        for batch in batches:
            lines = ["".join(cell(n) for n in names)]
            columns = [batch[n].tolist() for n in names]
            lines += ["".join(map(cell, row)) for row in zip(*columns)]
            data = "".join(f'<row r="{i}">{line}</row>' for i, line in enumerate(lines, 1))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("xl/workbook.xml", book)
                archive.writestr("xl/_rels/workbook.xml.rels", relations)
                archive.writestr(
                    "xl/worksheets/sheet1.xml",
                    f'<worksheet xmlns="{space}"><sheetData>{data}</sheetData></worksheet>',
                )
            name = f"{uuid.uuid4().hex}.xlsx"
            yield pandas.DataFrame({"path": [name], "content": [buffer.getvalue()]})

    return rows.mapInPandas(pack, "path string, content binary")


def xlsx_ingest(spark, folder):
    """Every customer, packed into workbooks and read from them."""
    customers = table(spark, folder, "customer")
    rows = workbooks.read_workbooks(_workbooks(customers), customers.schema)
    return rows.drop("path", "row_number")


_xlsx_ingest = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


QUERIES = {
    "csv_roundtrip": (csv_roundtrip, _csv_roundtrip),
    "csv_typed": (csv_typed, _csv_typed),
    "csv_rejects": (csv_rejects, _csv_rejects),
    "csv_splittable": (csv_splittable, _csv_splittable),
    "json_records": (json_records_in, _json_records_in),
    "json_records_out": (json_records_out, _json_records_out),
    "file_admission": (file_admission, _file_admission),
    "listed_files": (listed_files, _listed_files),
    "xlsx_ingest": (xlsx_ingest, _xlsx_ingest),
}
