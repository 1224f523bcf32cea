import json
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprof.sources import admission, delimited, json_records, local, sinks, workbooks

NAN = float("nan")
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text,score\n1,"a ""b"", c\nd",1.5\n2,,\n3," x ",-2\n', encoding="utf-8")
    rows = delimited.read_csv(spark, str(path), quoted_newlines=True).orderBy("id")
    assert [f.dataType.simpleString() for f in rows.schema] == ["int", "string", "double"]
    assert [tuple(r) for r in rows.collect()] == [
        (1, 'a "b", c\nd', 1.5), (2, None, None), (3, " x ", -2.0)]
    back = str(tmp_path / "out")
    delimited.write_csv(rows, back)
    again = delimited.read_csv(spark, back, schema=rows.schema, quoted_newlines=True).orderBy("id")
    assert again.collect() == rows.collect()


def test_csv_splits_without_quoted_newlines(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id\n" + "\n".join(map(str, range(50_000))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        whole = delimited.read_csv(spark, str(path), "id int", quoted_newlines=True)
        split = delimited.read_csv(spark, str(path), "id int")
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 1
        assert whole.count() == split.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_documents(spark, tmp_path):
    documents = {
        "a": {"name": "first", "data": [{"x": 1, "y": "u"}, {"x": 2}]},
        "b": {"data": [{"z": 1.5}]},
        "c": {"name": "none", "data": []},
    }
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=1))
    rows = json_records.read_json_records(spark, str(tmp_path))
    assert rows.columns == ["dataset_name", "x", "y", "z"]
    found = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert found[:2] == [("dataset_" + found[0][0][8:], None, None, 1.5), ("first", 1, "u", None)]
    assert len(found[0][0]) == 16 and len(found) == 3
    named = json_records.read_json_records(spark, str(tmp_path), "x int", name="mine")
    assert sorted(((r[0], r[1]) for r in named.collect()), key=repr) == [
        ("mine", 1), ("mine", 2), ("mine", None)]
    empty = json_records.empty_documents(json_records.read_documents(spark, str(tmp_path)))
    assert [r["name"] for r in empty.collect()] == ["none"]


def test_tables_from_the_driver(spark):
    frame = pd.DataFrame({"x": [1.0, None], "s": ["a", None], "n": [1, 2]})
    assert [tuple(r) for r in local.from_pandas(spark, frame).collect()] == [(1.0, "a", 1), (None, None, 2)]
    name, table = local.from_document(spark, {"name": "n", "data": [{"a": 1, "b": "x"}, {"a": 2, "c": 1.5}]})
    assert name == "n" and table.columns == ["a", "b", "c"]
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, "x", None), (2, None, 1.5)]
    assert local.from_document(spark, {"data": [{"a": 1}]})[0].startswith("dataset_")
    for bad in ({}, {"data": []}, {"data": "x"}):
        with pytest.raises(ValueError):
            local.from_document(spark, bad)


def test_json_without_records_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": []}')
    with pytest.raises(ValueError):
        json_records.read_json_records(spark, str(tmp_path))


def test_json_records_out(spark, tmp_path):
    df = spark.createDataFrame([(1, NAN, None), (2, 0.5, "x")], "a int, b double, c string")
    found = [json.loads(r[0]) for r in json_records.json_records(df).collect()]
    assert found == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": 0.5, "c": "x"}]
    assert json_records.json_records(df, limit=1).count() == 1


def test_admission_reads_only_the_listing(spark, tmp_path):
    for name, size in (("a.csv", 10), ("b.XLS", 10), ("c.txt", 10), ("d.csv", 2_000), ("e", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = admission.admit(admission.list_files(spark, str(tmp_path)), max_bytes=1_000)
    found = {r["path"].rsplit("/", 1)[1]: (r["accepted"], r["reason"]) for r in files.collect()}
    assert found == {
        "a.csv": (True, None), "b.XLS": (True, None), "c.txt": (False, "extension"),
        "d.csv": (False, "size"), "e": (False, "extension"),
    }
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def write_workbook(path, rows, shared=()):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="7" r:id="rId9"/>'
            '<sheet name="T" sheetId="1" r:id="rId1"/></sheets></workbook>')
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId9" Target="/xl/worksheets/other.xml"/></Relationships>')
        strings = "".join(shared)
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        archive.writestr(
            "xl/worksheets/other.xml",
            f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    shared = ["<si><t>id</t></si>", "<si><r><t>na</t></r><r><t>me</t></r><rPh><t>!</t></rPh></si>",
              "<si><t>day</t></si>", "<si><t xml:space='preserve'> é &amp; </t></si>"]
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
        '<c r="D1" t="s"><v>2</v></c><c r="E1" t="str"><v>ok</v></c></row>'
        '<row r="2"><c r="A2"><v>1.0</v></c><c r="B2" t="s"><v>3</v></c>'
        '<c r="D2"><v>45292.5</v></c><c r="E2" t="b"><v>1</v></c></row>'
        '<row r="5"><c r="A5"><v>2.5</v></c><c r="C5"><v>9</v></c><c r="D5" t="e"><v>#N/A</v></c>'
        '<c r="E5" t="b"><v>0</v></c></row>'
    )
    write_workbook(tmp_path / "a.xlsx", rows, shared)
    (tmp_path / "b.csv").write_text("not a workbook")
    files = workbooks.workbook_files(spark, str(tmp_path))
    table = workbooks.read_workbooks(
        files, "id int, name string, day timestamp_ntz, ok boolean, gone double")
    found = [tuple(r)[1:] for r in table.orderBy("row_number").collect()]
    assert found == [
        (2, 1, " é & ", datetime(2024, 1, 1, 12), True, None),
        (5, None, None, None, False, None),
    ]


def test_views_are_written_apart(spark, tmp_path):
    view = spark.createDataFrame([(1, "a")], "n int, s string")
    for format, read in (("csv", lambda p: delimited.read_csv(spark, p)),
                         ("json", spark.read.json), ("parquet", spark.read.parquet)):
        folders = sinks.write_views({"one": view, "two": view}, str(tmp_path / format), format)
        assert sorted(folders) == ["one", "two"]
        assert read(folders["two"]).first()["s"] == "a"
    with pytest.raises(ValueError):
        sinks.write_views({}, str(tmp_path), "xml")


def test_files_that_cannot_be_split_are_small(spark, tmp_path, monkeypatch):
    """However many rows a task writes, and however uneven they are, a file holds a bounded number of bytes."""
    monkeypatch.setattr(delimited, "FILE_BYTES", 100_000, raising=False)
    long = F.when(F.col("id") < 50, F.repeat(F.lit("long\n"), 2_000)).otherwise(F.repeat(F.lit("short\n"), 10))
    rows = spark.range(4_000).coalesce(1).select("id", F.concat(long, F.col("id")).alias("text"))
    delimited.write_csv(rows, str(tmp_path / "out"), quoted_newlines=True)
    sizes = [f.stat().st_size for f in (tmp_path / "out").glob("*.csv")]
    assert sum(sizes) > 500_000 and max(sizes) < 300_000 and len(sizes) < 800
    again = delimited.read_csv(spark, str(tmp_path / "out"), rows.schema, quoted_newlines=True)
    assert again.exceptAll(rows).isEmpty() and again.count() == 4_000
    delimited.write_csv(rows.limit(0), str(tmp_path / "none"), quoted_newlines=True)
    delimited.write_csv(rows.drop("text"), str(tmp_path / "numbers"), quoted_newlines=True)
    assert delimited.read_csv(spark, str(tmp_path / "numbers"), "id bigint", quoted_newlines=True).count() == 4_000
