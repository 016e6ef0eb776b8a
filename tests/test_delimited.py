"""The delimited reader against the usual CSV parser, with files cut into many small parts."""

import csv
import io
import random

import pytest

from lanegrid.sources import delimited, files


@pytest.fixture
def small_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def parsed(data: bytes, separator: str):
    data = data.removeprefix(delimited.MARK)
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    lines = io.StringIO(text, newline=None).read().split("\n")
    if lines[-1] == "":
        lines.pop()
    reader, out, at = csv.reader([x + "\n" for x in lines], delimiter=separator), [], 0
    for cells in reader:
        out.append((at, cells))
        at = reader.line_num
    return out


def random_file(rng, separator):
    """Quotes in every place, doubled, stray or left open; line breaks and separators inside fields; blank rows."""
    pick = ['"', '""', separator, "\n", "a", "é", "b c", f'"{separator}', f'{separator}"', '"\n', "\r\n", " ", "12.0"]
    return "".join(rng.choice(pick) for _ in range(rng.randint(0, 160)))


def test_equals_a_csv_parser(spark, tmp_path, small_parts):
    rng = random.Random(3)
    expected = {}
    for i in range(60):
        name = f"f{i}.{'tsv' if i % 3 == 0 else 'csv'}"
        text = random_file(rng, "\t" if i % 3 == 0 else ",")
        data = text.encode("latin-1" if i % 4 == 1 else "utf-8")
        data = delimited.MARK + data if i % 5 == 0 else data
        (tmp_path / name).write_bytes(data)
        expected[name] = parsed(data, "\t" if i % 3 == 0 else ",")
    rows = delimited.read_records(spark, str(tmp_path)).collect()
    got = {name: [] for name in expected}
    for r in rows:
        got[r["file"].rsplit("/", 1)[1]].append((r["row_idx"], r["cells"]))
    for name, records in expected.items():
        assert sorted(got[name]) == records, name


def test_one_file_in_many_tasks(spark, tmp_path, small_parts):
    """A record that is longer than several parts, between plain ones."""
    long = "\n".join(f'line {i}, "" and more' for i in range(40))
    text = "x,y\n" * 30 + f'1,"{long}",2\n' + "z,w\n" * 30 + '"never closed\n' * 3
    (tmp_path / "one.csv").write_text(text)
    read = delimited.read_records(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted((r["row_idx"], r["cells"]) for r in read.collect()) == parsed(text.encode(), ",")


def test_large_tables_of_parts(spark, tmp_path, small_parts, monkeypatch):
    """The way without a broadcast gives the same."""
    monkeypatch.setattr(delimited, "small_enough", lambda *_: False)
    text = 'a,"b\nc",d\n' * 60
    (tmp_path / "one.csv").write_text(text)
    read = delimited.read_records(spark, str(tmp_path)).collect()
    assert sorted((r["row_idx"], r["cells"]) for r in read) == parsed(text.encode(), ",")


def test_grid(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('"Pune, Mumbai", 12.0\n , \n\n"two\nlines",x'.encode())
    (tmp_path / "b.csv").write_bytes("caf\xe9;1".encode("latin-1"))
    rows = {(r["file"].rsplit("/", 1)[1], r["row_idx"]): r["cells"] for r in files.read_grid(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", 0): ["Pune, Mumbai", "12"], ("a.csv", 3): ["two\nlines", "x"], ("b.csv", 0): ["café;1"]}
    assert files.read_grid(spark, str(tmp_path / "b.csv"), ";").collect()[0]["cells"] == ["café", "1"]
