"""Readers and writers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanlab.sources import cases, files, intervals_csv
from spanlab.streaming.incremental import append_new, remaining


def test_case_folders(spark, tmp_path):
    head_a = "install_case_part,install_case_time,uninstall_case_part,uninstall_case_time,arm,commercial_toolname,groundtruth_toolname,case\n"
    head_b = "index,start_part,start_time,stop_part,stop_time,duration,taskname,groundtruth_taskname,matched_description,case\n"
    case = tmp_path / "case_1"
    case.mkdir()
    row = '1,00:00:01.5,1.0,00:00:04.0,USM1,Big Driver,Needle Driver ,case_1\n'
    (case / "tools.csv").write_text(head_a + row + row + "1,bad,1,00:00:02,USM1,x,needle driver,case_1\n" + '1,00:00:09,2,00:00:10,USM1,x,needle driver,case_1\n' + "1,00:00:01,1,00:00:05,USM2,x,nan(camera),case_1\n")
    (case / "tasks.csv").write_text(head_b + "0,1,1.0,1,5.0,4,suturing,Suturing,,case_1\n0,1,1.0,1,5.0,4,suturing,Suturing,,case_1\n1,1,7,1,3,4,x,Suturing,,case_1\n")
    tools, tasks = intervals_csv.read_cases(spark, str(tmp_path))
    got = intervals_csv.clean_tools(tools, ["needle driver"]).collect()
    assert [(r.case, r.part, r.start, r.stop, r.cls) for r in got] == [("case_1", "1.0", 1.5, 4.0, "needle driver")]
    assert [(r.part, r.start, r.stop, r.cls, r.description) for r in intervals_csv.clean_tasks(tasks, ["suturing"]).collect()] == [("1.0", 1.0, 5.0, "suturing", None)]
    (tmp_path / "case_2").mkdir()
    (tmp_path / "case_2" / "tools.csv").write_text(head_a)
    with pytest.raises(Exception, match="case_2"):
        intervals_csv.read_cases(spark, str(tmp_path))


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"k": 1, "v": "a"}\n\n{broken\n{"k": 2, "v": null}\n')
    assert {r.k for r in files.read_jsonl(spark, str(p), "k long, v string", tolerant=True).collect()} == {1, 2}
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(p), "k long, v string").collect()
    df = spark.createDataFrame([(1, float("nan"))], "k int, x double")
    with pytest.raises(ValueError, match="NaN"):
        files.write_jsonl(df, str(tmp_path / "out"))
    files.write_jsonl(df.withColumn("x", F.lit(1.0)), str(tmp_path / "out"))
    assert [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()] == [{"k": 1, "x": 1.0}]


def test_zip_annotations_and_digests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("VID01/3.txt", "what tool|hook\nwhere|there\n")
        z.writestr("readme", "no")
    rows = files.read_zip_text(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.member, r.line_no, r.line) for r in rows if r.member.endswith("txt")] == [("VID01/3.txt", 0, "what tool|hook"), ("VID01/3.txt", 1, "where|there")]
    assert len(files.digests(spark, str(tmp_path / "a.zip")).first().sha256) == 64


def test_duplicate_stems_and_responses(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "clip.mp4").write_bytes(b"x")
    with pytest.raises(ValueError, match="clip"):
        files.listed(spark, str(tmp_path), "*.mp4", unique_stems=True)
    df = spark.createDataFrame([('"ok"',), ('""',), ("{",), ("3",), (None,)], "raw string")
    assert [r.p for r in df.select(files.response_problem(F.col("raw")).alias("p")).collect()] == [None, "empty", "not JSON", "not a string", "missing"]
    log = spark.createDataFrame([(1, "timings a=1.5 b=2"), (2, "x"), (3, "timings a=2.5 c=1")], "n int, line string")
    assert files.last_timings(log, "n", "line").first().stages == {"a": 2.5, "c": 1.0}


def test_incremental(spark, tmp_path):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in remaining(a, b, ["k"]).collect()] == [1]
    a.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("k int").parquet(str(tmp_path / "in"))
        append_new(stream, str(tmp_path / "sink"), ["k"], str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [1, 2]


def test_nan_inside_arrays_and_structs_is_refused(spark, tmp_path):
    from spanlab.sources import files

    nan = float("nan")
    for kind, value in (("array<double>", [1.0, nan]), ("struct<a:int,b:array<float>>", (1, [nan])), ("map<string,double>", {"k": nan})):
        with pytest.raises(ValueError, match="NaN"):
            files.write_jsonl(spark.createDataFrame([(value,)], f"x {kind}"), str(tmp_path / "bad"))
    files.write_jsonl(spark.createDataFrame([([1.0], None)], "x array<double>, y struct<b:double>"), str(tmp_path / "good"))


def test_sample_cases(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "c1.json").write_text('["a \\"b\\"", "c"]')
    (tmp_path / "c1" / "c1_question.json").write_text('"what, then?"\n')
    (tmp_path / "c2.json").write_text('[\n"d"]')
    (tmp_path / "c2_question.json").write_text('"why"')
    (tmp_path / "c9_question.json").write_text('"no case"')
    got = {r.case: (r.question, r.references) for r in cases.read_sample_cases(spark, str(tmp_path)).collect()}
    assert got == {"c1": ("what, then?", ['a "b"', "c"]), "c2": ("why", ["d"])}
    (tmp_path / "c3.json").write_text('["x"]')
    with pytest.raises(Exception, match="case c3: no question"):
        cases.read_sample_cases(spark, str(tmp_path)).collect()
    (tmp_path / "c3_question.json").write_text('"x"')
    (tmp_path / "c3.json").write_text("[]")
    with pytest.raises(Exception, match="case c3: no references"):
        cases.read_sample_cases(spark, str(tmp_path)).collect()


def test_lines_and_responses(spark, tmp_path):
    df = spark.createDataFrame([("k2", ' say "hi"\n now '), ("k1", None), ("k3", " ")], "case string, answer string")
    cases.write_lines(df, str(tmp_path / "lines"), "case", "case")
    assert "".join(f.read_text() for f in sorted((tmp_path / "lines").glob("part-*"))).split() == ["k1", "k2", "k3"]
    cases.write_responses(df, str(tmp_path / "out"), "Unknown.")
    got = {d.name: json.loads(next(d.glob("part-*")).read_text()) for d in (tmp_path / "out").glob("case=*")}
    assert got == {"case=k1": "Unknown.", "case=k2": 'say "hi" now', "case=k3": "Unknown."}


def test_exact_depth_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [1]), ("b", 3, [3, 4]), ("b", 4, None)], "c string, i int, frames array<int>")
    assert files.write_exact(df, str(tmp_path / "out"), "frames", 2, "c") == 2
    assert {(r.c, r.i) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 1), ("b", 3)}
    with pytest.raises(ValueError, match="no row has 9"):
        files.write_exact(df, str(tmp_path / "none"), "frames", 9, "c")


def test_candidates_and_data_set(spark, tmp_path):
    known = spark.createDataFrame([("a", "q1"), ("b", "q2")], "case string, question string")

    def read(text):
        (tmp_path / "c.json").write_text(text)
        return {r.case: r.answer for r in cases.read_candidates(spark, str(tmp_path / "c.json"), known).collect()}

    assert read('{"a": "Yes", "b": ""}') == {"a": "Yes", "b": ""}
    for text, what in (('["a"]', "no object"), ('{"a": 3, "b": "x"}', "answer of a is no string"), ('{"a": "x"}', "no answer for b"), ('{"a": "x", "b": "y", "z": "w"}', "unknown case z")):
        with pytest.raises(Exception, match=what):
            read(text)
    cases.write_data_set(spark, str(tmp_path / "d"), "train.txt", "val.txt", ("hook", "needle driver"))
    text = "".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))
    assert text == cases.data_set_text("train.txt", "val.txt", ("hook", "needle driver")) == "nc: 2\nnames:\n- hook\n- needle driver\ntrain: train.txt\nval: val.txt\n"


def test_archive_members_are_read_alone(spark, tmp_path, monkeypatch):
    import os

    from spanlab.sources import archives

    (tmp_path / "sub").mkdir()
    for k in range(2):
        with zipfile.ZipFile(tmp_path / "sub" / f"a{k}.zip", "w") as z:
            for i in range(6):
                z.writestr(f"VID0{k}/{i}/frames.bin", os.urandom(300_000))
                z.writestr(f"VID0{k}/{i}/meta.txt", f"shard {k}-{i}")
    spark.dataSource.register(archives.ZipMembers)
    load = lambda **o: spark.read.format("zip_members").options(path=str(tmp_path), **o).load()
    meta = load(members="*/meta.txt").collect()
    assert sorted(bytes(r.content).decode() for r in meta) == sorted(f"shard {k}-{i}" for k in range(2) for i in range(6))
    listed = load(content="false").collect()
    assert len(listed) == 24 and all(r.content is None for r in listed) and sum(r["size"] for r in listed) > 3_600_000
    assert load(members="*.bin", taskbytes="500000").rdd.getNumPartitions() == 12 and load(members="none").count() == 0
    # the reader itself, with the bytes counted
    read = []
    real = archives.opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            data = self.f.read(None if n < 0 else n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(archives, "opened", lambda p: Counted(real(p)))
    reader = archives.ZipReader({"path": str(tmp_path / "sub" / "a0.zip"), "members": "*/meta.txt"})
    assert len([x for p in reader.partitions() for x in reader.read(p)]) == 6
    assert sum(read) < 20_000
