import os

import pytest
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns
from tablescour.errors import CleanError
from tablescour.operators.preview import records
from tablescour.sinks.export import export, guard
from tablescour.sources.header import normalize_header
from tablescour.sources.ingest import ingest_many, ingested, load_csv, load_table
from tablescour.sources.inventory import inventory
from tablescour.sources.snapshots import read_parquet, read_snapshot


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in files"
    folder.mkdir()
    return folder


@pytest.mark.parametrize(
    "raw, names",
    [
        (["a", "a"], ["a", "a_2"]),
        (["", "b"], ["column_1", "b"]),
        ([" a ", "a", "a"], ["a", "a_2", "a_2_2"]),
        (["Unnamed: 3", "x"], ["column_1", "x"]),
        (["a", "a", "a"], ["a", "a_2", "a_3"]),
    ],
)
def test_headers(raw, names):
    assert normalize_header(raw) == names


def test_cells_stay_as_written(spark, files):
    path = put(files, "z.csv", 'zip,flag,note\n00121,true,\n7,"","a ""b"", c"\n')
    df = load_csv(spark, path)
    assert records(df) == [
        {"zip": "00121", "flag": "true", "note": ""},
        {"zip": "7", "flag": "", "note": 'a "b", c'},
    ]
    assert [r[ROW] for r in df.orderBy(ROW).collect()] == [0, 1]


@pytest.mark.parametrize(
    "content, names",
    [
        ("name;age\nJo;3\n", ["name", "age"]),
        ("name\tage\nJo\t3\n", ["name", "age"]),
        ("name|age\nJo|3\n", ["name", "age"]),
        ("a,a\n1,2\n", ["a", "a_2"]),
        (b"\xef\xbb\xbfna\xc3\xafve,age\nJo,3\n", ["naïve", "age"]),
        (b"caf\xe9,age\nJo,3\n", ["café", "age"]),
        ("only,header\n", ["only", "header"]),
    ],
)
def test_layouts(spark, files, content, names):
    df = load_csv(spark, put(files, "f.csv", content))
    assert data_columns(df) == names
    assert df.count() == (0 if b"header" in (content if isinstance(content, bytes) else content.encode()) else 1)


def test_quoted_line_breaks(spark, files):
    df = load_csv(spark, put(files, "m.csv", 'a,b\n"x\ny",1\nz,2\n'))
    assert records(df) == [{"a": "x\ny", "b": "1"}, {"a": "z", "b": "2"}]


def test_windows_1252_cells(spark, files):
    df = load_csv(spark, put(files, "w.csv", b"a,b\ncaf\xe9,\x80\n"))
    assert records(df) == [{"a": "café", "b": "€"}]


@pytest.mark.parametrize(
    "name, content, code",
    [
        ("r.csv", "a,b,c\n1,2,3\n4,5\n", "malformed_csv"),
        ("r.csv", "a,b\n1,2\n3,4,5\n", "malformed_csv"),
        ("e.csv", "", "empty_file"),
        ("e.csv", "  \n \n", "empty_file"),
        ("n.csv", b"a,b\n1,\x00\n", "invalid_encoding"),
        ("u.csv", b"a,b\n1,\x81\n", "invalid_encoding"),
        ("p.csv", b"PK\x03\x04rest", "content_type_mismatch"),
        ("x.xlsx", "a,b\n", "content_type_mismatch"),
        ("x.parquet", "a,b\n", "unsupported_file_type"),
    ],
)
def test_rejected_files(spark, files, name, content, code):
    with pytest.raises(CleanError) as error:
        load_csv(spark, put(files, name, content))
    assert error.value.code == code


def test_ragged_rows_can_be_quarantined(spark, files, tmp_path):
    path = put(files, "q.csv", "a,b\n1,2\n3\n4,5\n6,7,8\n")
    df = load_csv(spark, path, str(tmp_path / "t"), on_ragged="quarantine")
    assert [r["a"] for r in records(df)] == ["1", "4"]
    bad = spark.read.parquet(str(tmp_path / "t" / "quarantine"))
    assert sorted(r.record for r in bad.collect()) == ["3", "6,7,8"]


def test_labels_follow_the_file_over_many_tasks(spark, files):
    lines = "".join(f"{i},{'x' * (i % 17)}\n" for i in range(20000))
    path = put(files, "big.csv", "n,t\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        df = load_csv(spark, path)
        assert df.filter(F.col(ROW) != F.col("n").cast("bigint")).count() == 0
        assert df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inventory_and_batch(spark, files, tmp_path):
    put(files, "a.csv", "x,y\n1,2\n3,4\n")
    put(files, "b.csv", "x,y\n5,6\n")
    put(files, "c.csv", "x;y;z\n1;2;3\n")
    put(files, "bad.csv", "x,y\n1\n")
    put(files, "no.txt", "x")
    put(files, "zip.csv", b"PK\x03\x04")
    listed = {r.filename: r for r in inventory(spark, str(files), max_bytes=1000).collect()}
    assert listed["a.csv"].status == "accepted" and listed["c.csv"].delimiter == ";"
    assert listed["no.txt"].error_code == "unsupported_file_type"
    small = {r.filename: r.error_code for r in inventory(spark, str(files), max_bytes=9).collect()}
    assert small["a.csv"] == "file_too_large" and small["zip.csv"] == "content_type_mismatch"

    done = {r.filename: r for r in ingest_many(spark, str(files), str(tmp_path / "root")).collect()}
    assert {n: (r.status, r.row_count, r.column_count, r.error_code) for n, r in done.items()} == {
        "a.csv": ("uploaded", 2, 2, None),
        "b.csv": ("uploaded", 1, 2, None),
        "c.csv": ("uploaded", 1, 3, None),
        "bad.csv": ("failed", None, None, "malformed_csv"),
        "no.txt": ("failed", None, None, "unsupported_file_type"),
        "zip.csv": ("failed", None, None, "content_type_mismatch"),
    }
    one = ingested(spark, done["a.csv"].dataset, done["a.csv"].path)
    assert records(one) == [{"x": "1", "y": "2"}, {"x": "3", "y": "4"}]


def test_typed_tables_are_labelled_along_their_order(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 3 AS third")
    loaded = load_table(df, str(tmp_path / "t"), order_by=["third", "k"])
    rows = loaded.orderBy(ROW).collect()
    assert [r[ROW] for r in rows] == list(range(1000))
    keys = [(int(r["third"]), int(r["k"])) for r in rows]
    assert keys == sorted(keys)


def test_parquet_labels_come_from_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 100, 1, 5).write.parquet(path)
    df = read_parquet(spark, path)
    assert sorted(r[ROW] for r in df.collect()) == list(range(100))


def test_missing_snapshot(spark, tmp_path):
    with pytest.raises(CleanError) as error:
        read_snapshot(spark, str(tmp_path / "none"))
    assert error.value.code == "dataset_missing"


def test_csv_export_keeps_cells_and_guards_formulas(spark, table, tmp_path):
    df = table(
        name=["Ann", None, " pad ", 'q"t,\n'],
        text=["=SUM(A1:A2)", "+CMD|x", "-5", "+3.5"],
        tail=["@x", "\tx", "", "plain"],
    )
    path = str(tmp_path / "out")
    stats = export(df, "csv", path, ordered=True)
    assert (stats["rows"], stats["columns"], stats["formula_cells_sanitized"]) == (4, 3, 4)
    assert stats["size_bytes"] > 0
    parts = sorted(p for p in os.listdir(path) if p.endswith(".csv"))
    body = "".join(open(os.path.join(path, p), newline="").read().split("\n", 1)[1] for p in parts)
    assert body == (
        "Ann,'=SUM(A1:A2),'@x\n,'+CMD|x,'\tx\n pad ,-5,\n\"q\"\"t,\n\",+3.5,plain\n"
    )
    assert export(df, "csv", path, guard_formulas=False)["formula_cells_sanitized"] == 0
    assert guard(df).filter(F.col("text").startswith("'")).count() == 2


def test_marks_in_texts_are_no_delimiters(spark, files, table, tmp_path):
    texts = [f"wort | wort\nein | zwei, {i}" for i in range(40)] + ["x | y | z", "", "a;b"]
    path = str(tmp_path / "one")
    export(table(text=texts).repartition(1), "csv", path, guard_formulas=False)
    assert sorted(r.text for r in load_csv(spark, f"{path}/*.csv").collect()) == sorted(texts)
    path = str(tmp_path / "two")
    export(table(lang=["de"] * len(texts), text=texts).repartition(1), "csv", path, guard_formulas=False)
    back = load_csv(spark, f"{path}/*.csv")
    assert data_columns(back) == ["lang", "text"] and sorted(r.text for r in back.collect()) == sorted(texts)
    # where the mark splits most records, it is the delimiter, and the header is short
    with pytest.raises(CleanError) as error:
        load_csv(spark, put(files, "short.csv", "name\n" + "1;2\n" * 40))
    assert error.value.code == "malformed_csv"


def test_json_export_keeps_nulls(spark, table, tmp_path):
    df = table(a=["x", None, ""], b=["=1", "2", "3"])
    path = str(tmp_path / "out")
    assert export(df, "json", path)["formula_cells_sanitized"] == 0
    back = spark.read.schema("a string, b string").json(path)
    assert sorted(map(tuple, back.collect()), key=str) == [("", "3"), ("x", "=1"), (None, "2")]


def test_unknown_export_format(table, tmp_path):
    with pytest.raises(CleanError) as error:
        export(table(a=["x"]), "xlsx", str(tmp_path / "o"))
    assert error.value.code == "unsupported_export_format"
