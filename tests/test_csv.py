"""CSV files against Python's reader."""

import csv
import random

from ledgerlake.sources import files


def write(path, rows, **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding=kw.pop("encoding", "utf-8")) as f:
        csv.writer(f, lineterminator="\n", **kw).writerows(rows)


def test_cells_equal_the_reader(spark, tmp_path):
    rng = random.Random(4)
    bits = ["a", 'say "hi"', "x,y", "line\nbreak", "\n", '""', "", " lead", "ünï", "two\n\nblank", "end\"", "1,234.5"]
    rows = [["id", " Name ", "note"]] + [[str(i), "".join(rng.choices(bits, k=3)), rng.choice(bits)] for i in range(400)]
    write(tmp_path / "one" / "t.csv", rows)
    write(tmp_path / "two" / "t.csv", rows[:5])
    write(tmp_path / "two" / "u.csv", rows[:9])
    for size in ("128m", "700"):  # 700 bytes a split: quoted line breaks and doubled quotes across splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {}
            for r in files.read_csv_cells(spark, f"{tmp_path}/*/*.csv").collect():
                got.setdefault(r.document_id, {})[r.row_number, r.column_number] = (r.column_name, r.value)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == 3 and "u.csv" in got  # two files of one name stay apart
        for name, cells in got.items():
            path = tmp_path / "two" / name if name == "u.csv" else "/" + name.split(":", 1)[1].lstrip("/")
            with open(path, newline="") as f:
                want = list(csv.reader(f))
            assert cells == {(i + 1, j + 1): (want[0][j].strip(), v) for i, row in enumerate(want) if i for j, v in enumerate(row)}


def test_separators_encodings_and_blank_lines(spark, tmp_path):
    write(tmp_path / "s.csv", [["a", "b"], ["x;y", "ü"], ["p", "q"]], delimiter=";", encoding="latin1")
    rows = files.read_csv_cells(spark, str(tmp_path / "s.csv"), ";", "latin1").orderBy("row_number", "column_number").collect()
    assert [(r.row_number, r.column_name, r.value) for r in rows] == [(2, "a", "x;y"), (2, "b", "ü"), (3, "a", "p"), (3, "b", "q")]
    (tmp_path / "b.csv").write_bytes("﻿a\tb\r\n\r\n1\t\"2\r\n3\"\r\n \n4\t5".encode())
    rows = files.read_csv_cells(spark, str(tmp_path / "b.csv"), "\t").orderBy("row_number", "column_number").collect()
    assert [(r.row_number, r.column_name, r.value) for r in rows] == [(2, "a", "1"), (2, "b", "2\r\n3"), (3, "a", "4"), (3, "b", "5")]
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv_cells(spark, str(tmp_path / "e.csv")).count() == 0
