"""Types of CSV columns by one aggregate, and the rows that do not fit them."""

import pytest

from sparkprof.sources import delimited

VALUES = {
    "flag": (["true", "FALSE", None], "boolean"), "whole": (["1", "-20", "+3"], "bigint"), "digits": (["0", "1", "1"], "bigint"),
    "long": (["99999999999999999999", "1", "2"], "double"), "real": (["1", "2.5", "-1e3"], "double"),
    "nan": (["NaN", "Infinity", "0.5"], "double"), "suffix": (["1d", "2f", "3"], "string"),
    "day": (["2024-01-31", "2024-2-1", None], "date"), "no_day": (["2024-01-31", "2024-02-31", None], "string"),
    "time": (["2024-01-31 10:00", "2024-01-31T10:00:01.5", "2024-01-31"], "timestamp_ntz"),
    "mixed": (["1", "true", "2024-01-01"], "string"), "none": ([None, None, None], "string"), "text": (["a", " ", "1 "], "string"),
}


def test_the_narrowest_type_that_fits(spark):
    rows = list(zip(*(v for v, _ in VALUES.values())))
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in VALUES))
    assert delimited.infer_types(raw) == {c: kind for c, (_, kind) in VALUES.items()}
    assert set(delimited.infer_types(raw.limit(0)).values()) == {"string"}
    # One scan and one aggregate, whatever the columns.
    assert delimited.infer_types(raw.select("mixed"), fit=0.3) == {"mixed": "boolean"}
    for fit in (0, 1.1):
        with pytest.raises(ValueError):
            delimited.infer_types(raw, fit)


def test_no_value_is_lost_in_silence(spark, tmp_path):
    """Stray values, broken lines and names to be quoted: every line is a row or a reject."""
    path = tmp_path / "t.csv"
    lines = ["a.b,day,note"] + [f"{i},2024-01-{i % 28 + 1:02d},n{i}" for i in range(50)]
    lines += ["x,2024-01-01,stray", "7,soon,\"a, b\"", "y,z,both", "1,2024-01-01,n,more", "2", ",,"]
    path.write_text("\n".join(lines) + "\n")
    rows, rejects = delimited.read_typed_csv(spark, str(path), fit=0.9)
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "date", "string"]
    good = rows.collect()
    assert len(good) == 51 and sum(r["a.b"] is None for r in good) == 1
    bad = {r["_line"] or r["note"]: (r["a.b"], r["day"], r["rejected"]) for r in rejects.collect()}
    assert bad["stray"] == ("x", "2024-01-01", ["a.b"]) and bad["a, b"] == ("7", "soon", ["day"])
    assert bad["both"][2] == ["a.b", "day"] and {"1,2024-01-01,n,more", "2"} < set(bad) and len(bad) == 5
    # Without tolerance the columns are text and nothing but broken lines is refused.
    rows, rejects = delimited.read_typed_csv(spark, str(path))
    assert {f.dataType.simpleString() for f in rows.schema} == {"string"} and rejects.count() == 2
    rows, rejects = delimited.read_typed_csv(spark, str(path), types={"a.b": "bigint"})
    assert rows.count() == 52 and rejects.count() == 4


def test_what_is_written_is_read_back(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "id", "id % 2 = 0 AS flag", "id / 7 AS real", "date_add(date'2024-01-01', cast(id as int)) AS day",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 8.0) AS moment", "concat('t,', id) AS text",
    )
    delimited.write_csv(rows, str(tmp_path / "out"))
    again, rejects = delimited.read_typed_csv(spark, str(tmp_path / "out"))
    assert again.dtypes == [(n, k) for n, k in rows.dtypes] and rejects.count() == 0
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
