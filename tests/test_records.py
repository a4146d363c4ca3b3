import csv
import random
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescour.columns import ROW
from tablescour.operators.merge import MergeInput, merge
from tablescour.sources import records
from tablescour.sources.ingest import ingest_many, ingested, load_csv, load_table
from tablescour.sources.snapshots import read_snapshot


@contextmanager
def split_size(spark, size):
    """Files are cut into blocks of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _rows(seed, n=40):
    rng = random.Random(seed)
    bits = ["a", "é", "x y", "\n", "\r\n", "\n\n", '"', ",", ";", "", '",', ',"', "'", "\n,\n", "long " * 9]
    cell = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
    return [("k", "one", "two")] + [(f"k{i}", cell(), cell()) for i in range(n)]


def _text(rows, ending="\n", delimiter=","):
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set('",;\n\r') else c
    return "".join(delimiter.join(map(quoted, r)) + ending for r in rows)


def _records(spark, path, size, delimiter=","):
    with split_size(spark, size):
        rows = records.spanning_records(spark, [str(path)], delimiter)
        return [r for r in rows.orderBy("block", "place").collect()]


@pytest.mark.parametrize("size, ending", [(61, "\n"), (150, "\r\n"), (1 << 20, "\n")])
def test_records_cross_blocks(spark, tmp_path, size, ending):
    """Quoted line ends, quotes and delimiters, in a file cut at any byte."""
    rows = _rows(len(ending))
    (tmp_path / "f.csv").write_bytes(_text(rows, ending).encode())
    got = _records(spark, tmp_path / "f.csv", size)
    assert [bytes(r.record).decode() + ending for r in got] == [_text([r], ending) for r in rows[1:]]
    assert len({r.block for r in got}) > 1 or size == 1 << 20


def test_files_follow_each_other(spark, tmp_path):
    files = [_rows(3), _rows(4)]
    for i, rows in enumerate(files):
        (tmp_path / f"f{i}.csv").write_bytes(_text(rows).encode())
    with split_size(spark, 900):
        df = load_csv(spark, [str(tmp_path / "f0.csv"), str(tmp_path / "f1.csv")])
    got = df.orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(80))
    assert [tuple(r)[1:] for r in got] == files[0][1:] + files[1][1:]


def test_stray_quotes_open_no_cell(spark, tmp_path):
    lines = ["size,note", '12" ruler,plain', 'a"b"c,"x\ny"', '"5""",a"', ' "p,q', '"open ""cell""\r\nhere",z']
    (tmp_path / "s.csv").write_bytes(("\n".join(lines) + "\n").encode())
    want = list(csv.reader(("\n".join(lines) + "\n").splitlines(keepends=True)))
    assert len(want) == 6
    got = load_csv(spark, str(tmp_path / "s.csv")).orderBy(ROW).collect()
    assert [list(r)[1:] for r in got] == want[1:]
    assert [bytes(r.record).decode() for r in _records(spark, tmp_path / "s.csv", 7)] == lines[1:]


def test_other_layouts(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("naïve;b\n\"café\nx\";€\n\n  \n1;2\n".encode("cp1252"))
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbfa\tb\r\"1\r2\"\t3\r4\t5")
    one = load_csv(spark, str(tmp_path / "w.csv")).orderBy(ROW).collect()
    two = load_csv(spark, str(tmp_path / "u.csv"))
    assert [tuple(r)[1:] for r in one] == [("café\nx", "€"), ("1", "2")]
    assert two.columns[1:] == ["a", "b"]
    assert [tuple(r)[1:] for r in two.orderBy(ROW).collect()] == [("1\r2", "3"), ("4", "5")]
    assert [bytes(r.record) for r in _records(spark, tmp_path / "u.csv", 9, "\t")] == [b'"1\r2"\t3', b"4\t5"]


def test_the_header_has_the_encoding_of_the_rows(spark, tmp_path):
    """The first byte that is no UTF-8 comes long after the part that the layout is read from."""
    (tmp_path / "late.csv").write_bytes("naïve,b\n".encode() + b"x,1\n" * 40_000 + b"caf\xe9,2\n")
    df = load_csv(spark, str(tmp_path / "late.csv"))
    assert df.columns == [ROW, "naÃ¯ve", "b"]
    assert df.filter("b = '2'").first()[1] == "café"


def test_ragged_records_that_span_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n"x\ny",1\n"p\nq",2,3\nz\n5,6\n')
    df = load_csv(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), on_ragged="quarantine")
    assert [tuple(r) for r in df.orderBy(ROW).collect()] == [(0, "x\ny", "1"), (3, "5", "6")]
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert sorted(r.record for r in bad.collect()) == ['"p\nq",2,3', "z"]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n")
    load_csv(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "quarantine").exists()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(_text(_rows(5, 800)).encode())
    with split_size(spark, 2048):
        rows = records.spanning_records(spark, [str(tmp_path / "m.csv")], ",")
        assert rows.count() == 800
        assert rows.select("block").distinct().count() > 10


def test_many_blocks_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_BROADCAST_BLOCKS", 3)
    rows = _rows(6)
    (tmp_path / "j.csv").write_bytes(_text(rows).encode())
    with split_size(spark, 200):
        got = load_csv(spark, str(tmp_path / "j.csv")).orderBy(ROW).collect()
    assert [tuple(r)[1:] for r in got] == rows[1:]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Join")


def test_snapshots_are_read_without_a_join(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"{i},x\n" for i in range(50)))
    load_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"))
    typed = spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("w").alias("v"))
    load_table(typed, str(tmp_path / "u"), order_by=["k"])
    one, two = read_snapshot(spark, str(tmp_path / "t")), read_snapshot(spark, str(tmp_path / "u"))
    assert _exchanges(one) == _exchanges(two) == (0, 0)
    merged = merge([MergeInput("one", one), MergeInput("two", two)])
    assert _exchanges(merged) == (0, 0)
    got = merged.orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(150))
    assert [r.k for r in got] == [str(i) for i in [*range(50), *range(100)]]
    gaps = merge([MergeInput("one", one.filter("k % 3 = 1")), MergeInput("two", two), MergeInput("none", one.limit(0))])
    got = gaps.orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(117)) and got[0].k == "1" and got[17].k == "0"


def _jobs(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_headers(spark, tmp_path):
    counts = {}
    for n in (2, 12):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"key{i},Value{i}\n{i},a\n{i},b\n")
        files, counts[n] = _jobs(spark, lambda: ingest_many(spark, str(folder), str(tmp_path / f"out{n}")).collect())  # noqa: B023
        assert [f.status for f in files] == ["uploaded"] * n and {f.row_count for f in files} == {2}
        for f in files:
            i = f.filename[1:-4]
            one = ingested(spark, f.dataset, f.path)
            assert one.columns == [ROW, f"key{i}", f"Value{i}"]
            assert sorted(map(tuple, one.collect())) == [(0, i, "a"), (1, i, "b")]
    assert counts[2] == counts[12]


def test_lines_inside_a_cell_are_taken_in_one_piece(monkeypatch):
    words = [b"w%d\r" % i if i % 97 == 0 else b"" if i % 89 == 0 else b"w%d" % i for i in range(6_000)]
    lines = [b"a,b", b'1,"x', *words, b'y"', b"2,z", b"", b"3,q\r4,r", b'5,"open', b"end", b'"']
    columns = [[7] * len(lines), ["f"] * len(lines), [0] * len(lines), lines, [False] * len(lines), [True] * len(lines)]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "path", "block", "value", "inside", "header"])
    cut, asked = records._parts, []
    monkeypatch.setattr(records, "_parts", lambda line: asked.append(line) or cut(line))
    out = [r for b in records._cut(b",")(iter([batch.slice(0, 2_500), batch.slice(2_500)])) for r in b.to_pylist()]
    assert [r["record"] for r in out] == [
        b"a,b", b"\n".join([b'1,"x', *words, b'y"']), b"2,z", b"3,q", b"4,r", b'5,"open\nend\n"',
    ]
    assert [r["place"] for r in out] == [-1, 0, 1, 2, 3, 4] and len(asked) < 20
