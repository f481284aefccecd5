"""Reading dirty files, header and label rules, lenient parsing."""

import math
from urllib.parse import unquote

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowstream.functions import columns as C
from flowstream.operators.windowing import drop_bad_times
from flowstream.sources import flows as S
from flowstream.sources.records import file_facts, lines_of


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_csv_keeps_short_lines_and_skips_long_ones(spark, tmp_path):
    a = write(tmp_path / "a.csv", b" Flow ID, Bytes , Label\nf1,10, BENIGN\nf2,20\nf3,1,x,extra\nf\xff4,Infinity,\"a,b\"\n")
    df = S.read_flows(spark, [a, str(tmp_path / "missing.csv")])
    rows = {r["Flow ID"]: r for r in df.collect()}
    assert df.columns == ["Flow ID", "Bytes", "Label", "source_file"]
    assert set(rows) == {"f1", "f2", "f4"}
    assert rows["f2"]["Label"] is None and rows["f2"]["Bytes"] == 20
    assert rows["f4"]["Bytes"] == math.inf and rows["f4"]["Label"] == "a,b"
    assert rows["f1"]["source_file"] == "a.csv"


def test_long_lines_are_skipped_under_any_projection(spark, tmp_path):
    a = write(tmp_path / "b.csv", b"x;y\n1;2\n1;2;3\n4;5\n")
    df = S.read_flows(spark, a, sep=";", types={"x": "bigint", "y": "double"})
    assert df.count() == 2
    assert sorted(r[0] for r in df.select("y").collect()) == [2.0, 5.0]


def test_files_of_different_headers_unite_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", b"x,y\n1,2\n\n")
    write(tmp_path / "b.csv", b" y ,z\n3,4\n")
    got = S.read_flows(spark, str(tmp_path / "*.csv")).orderBy("source_file").select("x", "y", "z").collect()
    assert [tuple(r) for r in got] == [(1, 2, None), (None, 3, 4)]


def test_glob_and_no_file(spark, tmp_path):
    write(tmp_path / "1.csv", b"v\n1\n")
    write(tmp_path / "2.csv", b"v\n2\n")
    assert S.read_flows(spark, str(tmp_path / "*.csv")).count() == 2
    with pytest.raises(FileNotFoundError):
        S.read_flows(spark, str(tmp_path / "no*.csv"))


def test_write_keeps_order_and_materialize_once(spark, tmp_path):
    df = spark.range(100).withColumn("k", (F.lit(100) - F.col("id")))
    S.write_table(df, str(tmp_path / "t"), "csv", order_by=["k"])
    parts = sorted((tmp_path / "t").glob("part-*"))
    text = [int(row.split(",")[1]) for p in parts for row in p.read_text().splitlines()[1:]]
    assert text == sorted(text) and len(text) == 100
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert S.materialize_once(spark, str(tmp_path / "once"), build).count() == 100
    assert calls == [1]


def test_header_collision(spark):
    with pytest.raises(ValueError):
        C.normalize_columns(spark.createDataFrame([(1, 2)], ["a", " a "]))


def test_find_column_order():
    names = ["Protocol", "Start Time", "Timestamp", "Destination Port"]
    assert C.find_column(names, C.TIME_FRAGMENTS) == "Start Time"
    assert C.find_column(names, C.STRATIFY_FRAGMENTS, by_fragment=True) == "Destination Port"
    assert C.find_column(["x"], ["label"]) is None


def test_labels(spark):
    df = spark.createDataFrame([(" BENIGN",), ("benign\t",), ("Syn ",), (None,), ("NORMAL",)], "Label string")
    got = df.select(C.clean_label(F.col("Label")), C.encode_binary(F.col("Label")), C.is_benign(F.col("Label"))).collect()
    assert [tuple(r) for r in got] == [("BENIGN", 0, True), ("benign", 0, True), ("Syn", 1, False), ("UNKNOWN", 1, False), ("NORMAL", 1, False)]
    assert df.filter(C.is_class(F.col("Label"), "Syn")).count() == 1


def test_infinity_and_nan(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (1.0,)], "x double")
    got = [r[0] for r in C.clamp_infinity(df, ["x"]).collect()]
    assert got == [C.FLOAT32_MAX, -C.FLOAT32_MAX, None, None, 1.0]
    assert [r[0] for r in df.select(C.without_nan(df, "x")).collect()][2:] == [None, None, 1.0]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("02/01/2024 03:04",), ("x",), (None,)], "t string")
    got = df.select(C.parse_time(F.col("t"), "dd/MM/yyyy HH:mm").alias("t"))
    obs = Observation("bad")
    kept = drop_bad_times(got, "t", obs)
    assert kept.count() == 2 and obs.get["dropped"] == 2


def test_whitelist_ids_and_suffix(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "`Flow ID` int, Bytes double, Label string, flag boolean")
    assert C.drop_identifiers(df, "flag").columns == ["Bytes", "Label"]
    assert C.keep_features(df, ["nope", "Bytes"], "Label").columns == ["Bytes", "Label"]
    assert C.numeric_columns(df) == ["Flow ID", "Bytes"]
    assert C.suffix_entropy(df.select("Label", "Bytes"), ["Bytes"]).columns == ["Bytes_Entropy", "Label"]


def test_prediction_helpers(spark):
    df = spark.createDataFrame([(0.5, None), (0.50001, 0), (None, 3)], "s double, p int")
    got = df.select(C.discretize(F.col("s"), 0.5), C.collapse_prediction(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (0, 1)]


def test_intermediate_tables_go_to_the_named_folder():
    from types import SimpleNamespace

    from flowstream.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "hdfs://nn/shared/"}.get(key, default))
    assert shared_dir(SimpleNamespace(conf=conf)) == "hdfs://nn/shared"
    bare = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(getConf=lambda: bare, master="yarn"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_missing_words_become_null(spark, tmp_path):
    a = write(tmp_path / "m.csv", b"Rate,Name,Label\n3,x,a\nN/A,NaN,a\nNaN,,b\n2.5,null,b\nInfinity,y,b\n")
    df = S.read_flows(spark, a)
    assert dict(df.dtypes)["Rate"] == "double"
    assert sorted(((r["Rate"] is not None) and r["Rate"] or 0) for r in df.collect()) == [0, 0, 2.5, 3.0, math.inf]
    assert sum(r["Name"] is None for r in df.collect()) == 3


def dirty(n, sep=";", seed=1):
    """(rows, text) of a table whose cells hold separators, quotes, breaks of every kind and stray quotes."""
    import csv
    import io
    import random

    rng = random.Random(seed)
    cells = ["plain", "", 'he said "hi"', "two\nlines", f"a{sep}b", "\n\n", 'ends "\n', '"', f'x{sep}"\n"{sep}y', "long " * 30 + "\n" + "z" * 90]
    rows = [(str(i), rng.choice(cells), rng.choice(cells)) for i in range(n)]
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerows([("k", "a", "b"), *rows])
    return rows, out.getvalue().replace("plain", '5" pipe') if sep != "|" else out.getvalue()


@pytest.mark.parametrize("split", ["128m", "700b", "64b"])
def test_records_over_several_lines_and_splits(spark, tmp_path, split):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = {}
    for name, sep, seed in (("one file.csv", ";", 1), ("zwei ü.csv", ",", 2), ("t.csv", "\t", 3), ("p.csv", "|", 4)):
        rows, text = dirty(120, sep, seed)
        write(tmp_path / name, text.encode())
        want[name] = sorted((k, a.replace("plain", '5" pipe') if sep != "|" else a, b.replace("plain", '5" pipe') if sep != "|" else b) for k, a, b in rows)
    write(tmp_path / "flat.csv", b'k,a,b\n1,5" pipe,"x"\n2,"open,y\n3,z,w\n')  # its quotes don't balance
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split != "128m" else "4m")
    try:
        df = S.read_flows(spark, str(tmp_path / "*.csv"), sep=None, types={"k": "string", "a": "string", "b": "string"})
        got = {}
        for r in df.collect():
            got.setdefault(r["source_file"], []).append((r["k"], r["a"] or "", r["b"] or ""))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [k for k, _, _ in sorted(got.pop("flat.csv"))] == ["1", "2", "3"]
    blank = lambda v: "" if v.strip() == "" else v  # noqa: E731, a cell of white space is missing
    got = {unquote(k): sorted((a, blank(b), blank(c)) for a, b, c in v) for k, v in got.items()}
    assert got == {k: sorted((a, blank(b), blank(c)) for a, b, c in v) for k, v in want.items()}


def test_separator_vote(spark, tmp_path):
    write(tmp_path / "a.csv", b"x;y\n1,5;2\n3,25;4\n5;6;7\n")  # decimal commas
    write(tmp_path / "b.csv", b"x\n1\n2\n")  # one column
    write(tmp_path / "c.csv", b'"x,1"|y\n"1,2,3"|2\n')
    write(tmp_path / "d.csv", b"x,y\n")  # a header only
    facts = {unquote(f).rsplit("/", 1)[1]: (h, s, b) for f, h, s, b in file_facts(lines_of(spark, [str(tmp_path)]), None)}
    assert facts == {"a.csv": ("x;y", ";", False), "b.csv": ("x", ",", False), "c.csv": ('"x,1"|y', "|", False), "d.csv": ("x,y", ",", False)}
    got = S.read_flows(spark, str(tmp_path / "a.csv"), sep=None).orderBy("y").collect()
    assert [(r["x"], r["y"]) for r in got] == [("1,5", 2), ("3,25", 4)]


def test_written_csv_reads_back(spark, tmp_path):
    rows = [(1, 'a "b"'), (2, "c,d"), (3, "e\nf"), (4, '{"k": 1}')]
    S.write_table(spark.createDataFrame(rows, "k long, v string").coalesce(1), str(tmp_path / "t"), "csv")
    assert sorted((r["k"], r["v"]) for r in S.read_flows(spark, str(tmp_path / "t" / "*.csv")).collect()) == rows
