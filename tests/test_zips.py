"""Archives as a data source and their extraction, and table functions for SQL."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from perigee.functions import tables as table_functions
from perigee.operators import ranges, series
from perigee.sources import archives, zips


def packed(path, files, **more):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
        for name, mode in more.items():
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, "elsewhere")


def nested(depth, payload):
    data = payload
    for level in range(depth):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("in.zip" if level else "leaf.txt", data)
        data = held.getvalue()
    return data


def test_one_archive_runs_in_many_tasks(spark, tmp_path):
    files = [(f"d{i % 7}/f{i:04d}.bin", os.urandom(200)) for i in range(900)]
    packed(tmp_path / "big.zip", files)
    packed(tmp_path / "small.zip", [("a", b"x"), ("sub/", b"")])
    x = zips.read_members(spark, f"file://{tmp_path}", content=True, split=20_000)
    assert x.rdd.getNumPartitions() > 5
    got = {r["member"]: (bytes(r["content"]), r["size"], r["crc32"]) for r in x.where("path like '%big.zip'").collect()}
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        assert got == {i.filename: (z.read(i), i.file_size, i.CRC) for i in z.infolist()}
    one = x.where(F.col("member") == "d3/f0003.bin")
    assert one.count() == 1 and x.where(F.col("member").startswith("d5/")).count() == sum(n.startswith("d5/") for n, _ in files)
    assert {(r["member"], r["directory"]) for r in x.where("path like '%small.zip'").collect()} == {("a", False), ("sub/", True)}
    assert zips.read_members(spark, f"file://{tmp_path}").where("content is not null").count() == 0


def test_nested_archives_and_filters(spark, tmp_path):
    packed(tmp_path / "n.zip", [("deep.zip", nested(8, b"leaf")), ("plain.txt", b"1")])
    x = zips.read_members(spark, f"file://{tmp_path}/n.zip", content=True)
    got = {r["member"]: r["depth"] for r in x.collect()}
    assert max(got.values()) == zips.DEEPEST and got["plain.txt"] == 0
    two = "deep.zip!in.zip"
    assert x.where(F.col("member") == two).count() == 1 and x.where(F.col("member").startswith(two + "!")).count() == sum(m.startswith(two + "!") for m in got)
    assert archives.members(spark, f"file://{tmp_path}").count() == len(got)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(root) for f in files if not f.endswith(".crc")}


def test_extraction_commits_whole_and_skips_what_lies_there(spark, tmp_path):
    files = [(f"p/{i % 3}/f{i}.txt", f"text {i}".encode() * 50) for i in range(60)]
    packed(tmp_path / "a.zip", [*files[:40], ("empty/", b"")])
    packed(tmp_path / "b.zip", files[40:])
    source, to = f"file://{tmp_path}", f"file://{tmp_path}/out"
    want = {n: d for n, d in files}
    assert zips.extract(spark, source, to) == {"written": 60, "same": 0, "size": sum(map(len, want.values()))}
    assert tree(tmp_path / "out") == want
    os.remove(tmp_path / "out" / "p/0/f0.txt")
    assert zips.extract(spark, source, to) == {"written": 1, "same": 59, "size": len(want["p/0/f0.txt"])} and tree(tmp_path / "out") == want
    (tmp_path / "out" / "p/1/f1.txt").write_bytes(b"other")
    os.remove(tmp_path / "out" / "p/0/f0.txt")
    with pytest.raises(zips.Refused, match="conflict"):
        zips.extract(spark, source, to)
    assert "p/0/f0.txt" not in tree(tmp_path / "out")
    with pytest.raises(zips.Refused):
        zips.extract(spark, source, f"file://{tmp_path}/raw/x", (f"file://{tmp_path}/raw",))


@pytest.mark.parametrize("name", ["/abs", "../up", "a/../../up", "C:/x", "C:x", "a:b", "\\\\host\\x", "..\\up", "./", "a/b"])
def test_unsafe_names_are_refused(spark, tmp_path, name):
    packed(tmp_path / "a.zip", [("fine", b"1"), (name, b"2")])
    if name == "a/b":
        assert zips.extract(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")["written"] == 2
        return
    if name == "./":  # a folder without a name holds nothing
        assert zips.extract(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")["written"] == 1
        return
    with pytest.raises(zips.Refused, match="unsafe"):
        zips.extract(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out" / "fine")


def test_links_duplicates_and_damage_are_refused(spark, tmp_path):
    for i, (files, more, why) in enumerate([([("a", b"1")], {"l": 0xA1FF}, "link"), ([("a/b", b"1"), ("A/B", b"2")], {}, "duplicate"), ([("a", b"1"), ("a/b", b"2")], {}, "duplicate")]):
        (tmp_path / str(i)).mkdir()
        packed(tmp_path / str(i) / "x.zip", files, **more)
        with pytest.raises(zips.Refused, match=why):
            zips.extract(spark, f"file://{tmp_path}/{i}", f"file://{tmp_path}/out{i}")
    (tmp_path / "bad").mkdir()
    with zipfile.ZipFile(tmp_path / "bad" / "x.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"fine " * 100)
        z.writestr("second", b"payload " * 100)
    data = (tmp_path / "bad" / "x.zip").read_bytes()
    (tmp_path / "bad" / "x.zip").write_bytes(data.replace(b"payload payload", b"payload PAYLOAD", 1))
    with pytest.raises(Exception, match="(?i)crc"):
        zips.extract(spark, f"file://{tmp_path}/bad", f"file://{tmp_path}/outbad")
    assert tree(tmp_path / "outbad") == {} if os.path.exists(tmp_path / "outbad") else True


def test_table_functions_equal_the_operators(spark):
    table_functions.register(spark)
    x = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("channel"), (F.col("id") * 7 + F.when(F.col("id") % 40 < 3, 500).otherwise(0)).alias("ts_ns"), (F.xxhash64("id") % 4 != 0).alias("positive"))
    x = x.dropDuplicates(["channel", "ts_ns"])
    x.createOrReplaceTempView("samples")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(spark.sql("SELECT * FROM perigee_islands(TABLE(samples), 'channel', 90)")) == rows(ranges.islands(x, ["channel"], 90).select("channel", "start_ns", "end_ns"))
    assert rows(spark.sql("SELECT * FROM perigee_islands(TABLE(SELECT ts_ns, bool_and(positive) AS positive FROM samples GROUP BY ts_ns), '', 90)")) == rows(ranges.islands(x.groupBy("ts_ns").agg(F.bool_and("positive").alias("positive")), [], 90))
    some = x.where("channel is not null").select("channel", "ts_ns")
    got = spark.sql("SELECT channel, ts_ns FROM perigee_strides(TABLE(SELECT *, count(*) OVER (PARTITION BY channel) AS series_rows FROM samples WHERE channel IS NOT NULL), 'channel', 80)")
    assert rows(got) == rows(series.stride(some, 80))
    s = spark.sql("SELECT channel, sum(samples), count(*), count_if(first) FROM perigee_sessions(TABLE(samples), 'channel', 100) GROUP BY channel").collect()
    assert sum(r[1] for r in s) == x.count() and all(r[2] > 1 and r[3] == 1 for r in s)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM perigee_islands(TABLE(samples), 'nope', 90)")
