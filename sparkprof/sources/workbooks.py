"""Spreadsheet workbooks (.xlsx), one task row per file.

A workbook is a zip archive of XML parts.  Spark lists and distributes the
files; each is parsed whole in the task that holds it, which the admission
limit on file size keeps bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.functions.missing import normalize_nulls
from sparkprof.sources.admission import admit

_ROW = "path string, row_number bigint, cells map<string,string>"


def workbook_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of the admitted .xlsx files below a path.

    Size and name are checked on the listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    accepted = admit(files, extensions=("xlsx",)).filter("accepted")
    return accepted.select("path", "content")


def read_workbooks(files: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The first sheet of every workbook as one table, header names matched to the schema.

    ``files`` has the columns path and content.  The result carries the path
    and the sheet row of each record; a cell that does not fit its column's
    type is NULL, as is a cell that is not there.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = files.select("path", "content").mapInPandas(_sheet_rows(), _ROW)
    typed = [_typed(f).alias(f.name) for f in fields]
    return normalize_nulls(rows.select("path", "row_number", *typed))


def _typed(field: T.StructField):
    text = F.try_element_at("cells", F.lit(field.name))
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # Day numbers count from 1899-12-30; text dates are cast as they are.
        days = text.try_cast("double")
        micros = F.timestamp_micros((days * 86_400_000_000).cast("bigint"))
        shifted = micros - F.expr("INTERVAL 25569 DAYS")
        return F.coalesce(shifted.cast(field.dataType), text.try_cast(field.dataType))
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # Spreadsheets store 3 and 3.0 alike.
        number = text.try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast(field.dataType))
    return text.try_cast(field.dataType)


def _sheet_rows():
    """The function that turns batches of workbooks into rows of named cells.

    It is self-contained, so that workers need not import this package.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import posixpath
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas

        def local(tag: str) -> str:
            return tag.rpartition("}")[2]

        def parts_of(archive, name):
            return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None

        def plain_text(item):
            # Phonetic hints (rPh) are not part of the text.
            if local(item.tag) == "rPh":
                return ""
            own = (item.text or "") if local(item.tag) == "t" else ""
            return own + "".join(plain_text(child) for child in item)

        def first_sheet(archive):
            book = parts_of(archive, "xl/workbook.xml")
            links = parts_of(archive, "xl/_rels/workbook.xml.rels")
            targets = {link.get("Id"): link.get("Target") for link in links}
            for element in book.iter():
                if local(element.tag) == "sheet":
                    link = next(v for k, v in element.attrib.items() if local(k) == "id")
                    return posixpath.normpath(posixpath.join("/xl", targets[link])).lstrip("/")
            raise ValueError("workbook without sheets")

        def place(reference, following):
            letters = re.match(r"[A-Z]+", reference or "")
            if not letters:
                return following
            number = 0
            for letter in letters.group():
                number = number * 26 + ord(letter) - 64
            return number - 1

        def cell_value(cell, shared):
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                return plain_text(cell)
            value = next((c.text for c in cell if local(c.tag) == "v"), None)
            if value is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(value)]
            if kind == "b":
                return "true" if value == "1" else "false"
            return value

        def rows_of(content):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                strings = parts_of(archive, "xl/sharedStrings.xml")
                shared = [] if strings is None else [plain_text(s) for s in strings]
                header = None
                with archive.open(first_sheet(archive)) as sheet:
                    number = 0
                    for _, element in ElementTree.iterparse(sheet):
                        if local(element.tag) != "row":
                            continue
                        number = int(element.get("r", number + 1))
                        cells, at = {}, 0
                        for cell in element:
                            at = place(cell.get("r"), at)
                            cells[at] = cell_value(cell, shared)
                            at += 1
                        element.clear()
                        if header is None:
                            header = {i: str(v) for i, v in cells.items() if v is not None}
                        else:
                            named = {header[i]: v for i, v in cells.items() if i in header}
                            yield number, {k: v for k, v in named.items() if v is not None}

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                chunk = []
                for number, cells in rows_of(content):
                    chunk.append((path, number, cells))
                    if len(chunk) == 10_000:
                        yield pandas.DataFrame(chunk, columns=["path", "row_number", "cells"])
                        chunk = []
                if chunk:
                    yield pandas.DataFrame(chunk, columns=["path", "row_number", "cells"])

    return parse

