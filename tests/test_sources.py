"""Readers, file signatures, contracts and sinks."""

import hashlib
import json

import pytest

from paneloom.functions.dates import parse_timestamp
from paneloom.operators import panel
from paneloom.sources import contracts, files, readers, sinks


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,x\n2,y,extra\n".encode())
    df = readers.read_source(spark, str(tmp_path / "a.csv"), "csv")
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "b.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert readers.read_source(spark, str(tmp_path / "b.json"), "json").count() == 2
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_source(spark, str(tmp_path / "c.jsonl"), "jsonl").count() == 2
    with pytest.raises(ValueError):
        readers.read_source(spark, str(tmp_path), "xml")


def test_signatures(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\ny\r\n")
    (tmp_path / "b.txt").write_bytes(b"x\ny\n")
    (tmp_path / "c.txt").write_bytes(b"\x0a" * 0 + b"xy")
    got = {r.path[-5:]: r for r in files.file_signatures(spark, str(tmp_path)).collect()}
    assert got["a.txt"].bom == "utf-8-sig" and got["a.txt"].newline_style == "CRLF"
    assert got["b.txt"].bom is None and got["b.txt"].newline_style == "LF" and got["c.txt"].newline_style == "NONE_OR_BINARY"
    assert got["b.txt"].sha256 == hashlib.sha256(b"x\ny\n").hexdigest()


def test_discovery_cardinality(spark, tmp_path):
    for name in ("a.parquet", "b.parquet", "c.csv"):
        (tmp_path / name).write_bytes(b"x")
    rows = files.discover(spark, str(tmp_path), ["*.parquet"], ["b*"], "one").collect()
    assert [r.relative_path for r in rows] == ["a.parquet"] and rows[0].cardinality_ok


def test_ambiguous_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Mã CK` int, ma_ck int")
    with pytest.raises(ValueError):
        files.resolve_columns(df, {"id": ["ma ck"]})
    assert files.resolve_columns(df.select("`Mã CK`"), {"id": ["ma ck"]}).columns == ["id"]


def test_sink_refuses_broken_tables_and_existing_targets(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    contract = contracts.Contract({"k": "string", "v": "int"}, unique=[["k"]])
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "t"), contract=contract)
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["k"])
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(df, str(tmp_path / "t"))


def test_dates(spark):
    cases = {"2020-01-02": "2020-01-02 00:00:00", "2/1/2020": "2020-01-02 00:00:00", "20200102": "2020-01-02 00:00:00", "2020-01": "2020-01-01 00:00:00",
             "2020": "2020-01-01 00:00:00", "2020-01-02T03:00:00+07:00": "2020-01-01 20:00:00", "soon": None, "2020-13-01": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: None if r.x is None else str(r.x) for r in df.withColumn("x", parse_timestamp(df.t)).collect()}
    assert got == cases
    strict = {r.t: r.x for r in df.withColumn("x", parse_timestamp(df.t, partial=False)).collect()}
    assert strict["2020"] is None and strict["2020-01"] is None and strict["2020-01-02"] is not None


def test_alias_precedence(spark):
    rows = spark.createDataFrame([("s", "Old 1"), ("s", "  old   1 "), ("s", "ｎew 2"), ("t", "Old 1")], "source_id string, raw_entity string")
    aliases = spark.createDataFrame([("s", "Old 1", "a"), ("s", "OLD 1", "b")], "source_id string, alias string, target string")
    got = {(r.source_id, r.raw_entity): (r.entity_id, r.method) for r in panel.resolve_entities(rows, aliases).collect()}
    assert got[("s", "Old 1")] == ("A", "registered_raw_alias")
    assert got[("s", "  old   1 ")] == ("B", "registered_normalized_alias")
    assert got[("s", "ｎew 2")] == ("NEW 2", "normalized_identity") and got[("t", "Old 1")] == ("OLD 1", "normalized_identity")


def test_files_of_any_size_have_signatures(spark, tmp_path, monkeypatch):
    import hashlib

    from paneloom.sources import files

    texts = {"a b.txt": b"\xef\xbb\xbfone\r\ntwo", "c.bin": bytes(range(256)) * 40, "f.txt": b"x" * 4095 + b"\r\n" + b"y" * 9000, "g": b"\xfe\xffab\n"}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(files, "PIECE", 4096)

    def rows(df):
        return {r["path"].rsplit("/", 1)[1].replace("%20", " "): r for r in df.collect()}

    plain, cut = (rows(files.file_signatures(spark, str(tmp_path), largest)) for largest in (files.LARGEST_FILE, 5))
    for name, content in texts.items():
        for r in (plain[name], cut[name]):
            assert (r["sha256"], r["size_bytes"], r["problem"]) == (hashlib.sha256(content).hexdigest(), len(content), None), name
            assert (r["bom"], r["newline_style"]) == (plain[name]["bom"], plain[name]["newline_style"])
    assert plain["f.txt"]["newline_style"] == "CRLF" and plain["a b.txt"]["bom"] == "utf-8-sig"
    for chunk in (7, 4096, 2**26):
        trees = rows(files.tree_signatures(spark, str(tmp_path), chunk))
        for name, content in texts.items():
            parts = [hashlib.sha256(content[i : i + chunk]).digest() for i in range(0, len(content), chunk)]
            assert (trees[name]["tree_sha256"], trees[name]["chunk_count"]) == (hashlib.sha256(b"".join(parts)).hexdigest(), len(parts)), (name, chunk)
    assert files.sign_range("nosuch://host/file", 0, 5)[5] == "STORE_NOT_READABLE_IN_PIECES"


def test_a_file_beyond_one_cell(spark, tmp_path):
    import hashlib
    import shutil

    from paneloom.sources import files

    if shutil.disk_usage(tmp_path).free < 8 * 2**30:
        import pytest

        pytest.skip("no room")
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 * 2**30)  # sparse
    row = files.file_signatures(spark, str(tmp_path)).first()
    assert row["size_bytes"] == 3 * 2**30 and row["problem"] is None
    digest = hashlib.sha256()
    for _ in range(3 * 2**30 // 2**24):
        digest.update(bytes(2**24))
    assert row["sha256"] == digest.hexdigest()
