import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsense.sources import csv as CSV
from tabsense.sources import quoted as Q


def python_rows(text, sep):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('ab",;\n\r ', max_size=6), min_size=2, max_size=3), min_size=1, max_size=5),
       st.sampled_from([",", ";"]))
def test_states_of_lines(rows, sep):
    """Written by Python's csv module: a line leaves the reader outside exactly where a
    record ends."""
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    text = out.getvalue().encode()
    ends = set()
    at = io.StringIO(newline="")
    for r in rows:
        csv.writer(at, delimiter=sep, lineterminator="\n").writerow(r)
        ends.add(len(at.getvalue().encode()))
    rules, state, place = Q.Lines(sep), Q.OUTSIDE, 0
    for line in text.split(b"\n")[:-1]:
        state = rules.after(line, state)
        place += len(line) + 1
        assert (state == Q.OUTSIDE) == (place in ends)


def test_quotes_that_open_nothing():
    rules = Q.Lines(",")
    for line, before, after in [(b'5" pipe,3', 0, 0), (b'a,"b', 0, 1), (b'b",c', 1, 0), (b'x""y', 1, 1),
                                (b'"a"b",c', 0, 0), (b'""', 0, 0), (b'"""', 0, 1), (b'x",",', 1, 1),
                                (b'"a,b",,"', 0, 1), (b'"', 1, 0), (b"", 1, 1)]:
        assert rules.after(line, before) == after, line


def split_rows(spark, path, **options):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = CSV.read_csv_auto(spark, path, infer=False, **options)
        ranges = Q._lines(spark, path).select("file", "start").distinct().count()
        return [tuple(r) for r in df.collect()], df.columns, ranges
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_ranges(spark, tmp_path, end):
    rng = random.Random(3)
    rows = [["id", "a note"]] + [
        [str(k), rng.choice(["plain", 'say "hi"', "two\nlines", "l1\n\nl3;,", "x" * 500 + "\n" * 300 + "y",
                             "", "é\nü", '"', ",\n\","])] for k in range(150)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end).writerows(rows)
    p = tmp_path / "one.csv"
    p.write_bytes(text.getvalue().encode())
    got, names, ranges = split_rows(spark, str(p))
    assert names == rows[0] and ranges > 100
    # an empty field without quotes is missing, as in Spark's reader
    assert sorted((k, v or "") for k, v in got) == sorted(tuple(r) for r in rows[1:])


def test_many_files_bad_bytes_and_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,t\n1,"a\nb"\n\n2,5" pipe\n3,"\xff\n."\n')
    (tmp_path / "b.csv").write_bytes(b'id,t\n4,"never\nclosed\n')
    (tmp_path / "c.csv").write_bytes(b'id,t\n')
    got, names, _ = split_rows(spark, str(tmp_path), delimiter=",")
    assert names[1] == "t"
    assert sorted(got) == [("1", "a\nb"), ("2", '5" pipe'), ("3", "�\n."), ("4", "never\nclosed")]
    (tmp_path / "d.csv").write_bytes(b'id,t\n5,"x\ny",z\n')
    with pytest.raises(ValueError):
        CSV.read_csv_auto(spark, str(tmp_path), delimiter=",")


def test_types_are_inferred(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('n,t,f\n1,"a\nb",1.5\n2,c,NA\n')
    df = CSV.read_csv_auto(spark, str(p))
    assert dict(df.dtypes) == {"n": "bigint", "t": "string", "f": "double"}
    assert df.agg(F.sum("n"), F.max("f")).first() == (3, 1.5)
