"""Damaged, mixed and large CSV files."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest

from fernweave.session import work_folder
from fernweave.sources.files import read_csv_tolerant


def written(spark, **files: bytes | str) -> str:
    folder = work_folder(spark, "csv")
    os.makedirs(folder)
    for name, content in files.items():
        with open(f"{folder}/{name}.csv", "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())
    return folder


def rows(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("head", ["", "\n", "\n  \n\n", "﻿", "﻿\n\n"])
def test_the_first_filled_line_is_the_header(spark, head):
    good, bad = read_csv_tolerant(spark, written(spark, a=f"{head}name,age\nDoe,4\n\nRoe,5\n"))
    assert good.columns == ["name", "age"] and rows(good) == [("Doe", "4"), ("Roe", "5")] and bad.isEmpty()


def test_a_quoted_separator_in_the_header(spark):
    good, bad = read_csv_tolerant(spark, written(spark, a='"last, first",age,"say ""x"""\n"Doe, J",4,1\n"Roe, K",5,2\n'))
    assert good.columns == ["last, first", "age", 'say "x"'] and bad.isEmpty()
    assert rows(good) == [("Doe, J", "4", "1"), ("Roe, K", "5", "2")]


def test_files_with_one_header_have_separators_of_their_own(spark):
    """A header of one column says nothing; each file's own lines do."""
    folder = written(spark, a="k;v\n1;a,b\n2;c,d\n", b="k|v\n3|e;f\n", c="k,v\n4,g\n", d="k,v\n5,h;i\n")
    good, bad = read_csv_tolerant(spark, folder)
    assert rows(good) == [("1", "a,b"), ("2", "c,d"), ("3", "e;f"), ("4", "g"), ("5", "h;i")] and bad.isEmpty()


def test_a_given_header_and_separator(spark):
    good, bad = read_csv_tolerant(spark, written(spark, a="﻿1;a\n2;b;c\n3\n"), separator=";", header="k;v")
    assert rows(good) == [("1", "a"), ("3", None)] and [r[0] for r in bad.collect()] == ["2;b;c"]


def _plans(spark, frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_separators_are_those_of_the_plain_vote(spark):
    from pyspark.sql import functions as F

    from fernweave.sources.files import _separators, vote_separator

    draw = random.Random(8)
    files = {f"f{i}": [draw.choice([",", ";", "|", "\t"]).join("abcd"[: draw.randint(1, 4)]) for _ in range(draw.randint(1, 30))] for i in range(12)}
    lines = spark.createDataFrame([(f, 0, n, v) for f, values in files.items() for n, v in enumerate(values)], "file string, start bigint, place bigint, value string")
    assert {r["file"]: r["sep"] for r in _separators(lines.withColumn("value", F.col("value"))).collect()} == {f: vote_separator(v[:20]) for f, v in files.items()}


def test_one_large_quoted_file_is_read_by_several_tasks(spark):
    """Line breaks and separators inside quotes anywhere, also across the borders of blocks."""
    draw, out = random.Random(3), io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    table = [[str(i), "".join(draw.choices(["x", "\n", ",", " ", '"', "word"], k=draw.randint(0, 40))), str(i % 7)] for i in range(6000)]
    table = [[k, v.replace('"', "''").strip() or "-", n] for k, v, n in table]
    table = [[k, "\n".join(p.strip() or "." for p in v.split("\n")), n] for k, v, n in table]
    writer.writerow(["k", "v", "n"])
    writer.writerows(table)
    folder = written(spark, a=out.getvalue())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        good, bad = read_csv_tolerant(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() >= 8
        assert rows(good) == sorted(map(tuple, table), key=repr) and bad.isEmpty()
        stitched = _plans(spark, good)
        assert "windowspecdefinition(file" in stitched and "start#" in stitched.split("windowspecdefinition(file", 1)[1][:40]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_a_stray_quote_spoils_its_own_line_only(spark):
    good, bad = read_csv_tolerant(spark, written(spark, a='k,v\n1,"a\n2,b\n3,"c\nd"\n4,e"\n5,f\n'))
    assert {r["k"] for r in good.collect()} == {"1", "2", "3", "4", "5"} and bad.isEmpty()
    assert {r["k"]: r["v"] for r in good.collect()}["3"] == "c\nd"
