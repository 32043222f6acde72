import json
import sqlite3

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from inodeatlas.operators import aggregate, reduction
from inodeatlas.sinks import documents, writers
from inodeatlas.sources import changelog, inventory, reports, sqlite


def lines(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "value string")


def test_inventory_lines(spark):
    good, bad = inventory.parse_inventory(
        lines(spark, 'f,33204,1,2,10,1,2,3,"/a/b,c.txt"', "f,1,2", "f,x,1,2,10,1,2,3,/a", "")
    )
    row = good.collect()[0]
    assert (row.path, row.mode, row.size, row.mtime, row.fileset) == ("/a/b,c.txt", 33204, 10, 3, None)
    assert sorted(r.reject for r in bad.collect()) == ["column count", "column count", "not an integer"]


def test_inventory_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('f,33204,1,2,10,1,2,3,fs,"/a/b"\n')
    (tmp_path / "b.csv").write_text("l,41471,1,2,11,1,2,3,fs,/c/d\n")
    good, _ = inventory.parse_inventory(inventory.read_lines(spark, str(tmp_path)), "ten")
    assert sorted((r.type, r.fileset, r.path) for r in good.collect()) == [("f", "fs", "/a/b"), ("l", "fs", "/c/d")]


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('f, 33204 ,1,2,10,1,2,3,"/a ""q"",\nb"\nf,1,2\n')
    raw = inventory.read_quoted_csv(spark, str(tmp_path), 9)
    counts = aggregate.validity_counts(raw, raw.columns[:8]).collect()[0]
    assert tuple(counts) == (2, 1, 1)
    typed = inventory.typed_base_columns(raw)
    assert sorted(r.size for r in typed.collect() if r.size) == [10]
    assert typed.count() == 2


def test_policy_listing(spark):
    cells = [str(i) for i in range(18)]
    cells[4], cells[5], cells[9], cells[10] = "100", "fs1", "7", "8"
    cells[11], cells[12], cells[13], cells[15] = "-rw-r--r--", "1", "2", "3"
    cells[17] = "/mnt/a%20b+c d"
    ok = " ".join(cells)
    link = ok.replace("-rw-r--r--", "lrwxrwxrwx")
    folder = ok.replace("-rw-r--r--", "drwxr-xr-x")
    good, bad = inventory.parse_policy_listing(lines(spark, ok, link, folder, "a b", ok + "x" * 2000), "/mnt")
    rows = {r.type: r for r in good.collect()}
    assert rows["f"].path == "/a b+c d" and rows["f"].mode == 0o100644 and rows["f"].fileset == "fs1"
    assert rows["l"].mode == 0o120777
    assert sorted(r.reject for r in bad.collect()) == ["column count", "not a file or link", "too long"]


def test_listing(spark):
    df = inventory.parse_listing(lines(spark, "/a,b.db, 10", "# no", "", "  ", "nocomma", "/x,abc", "/�,1"))
    rows = sorted((r.path or "", r.size or 0, r.malformed) for r in df.collect())
    assert rows == [("", 0, True), ("", 0, True), ("/a,b.db", 10, False)]


def database(path, rows):
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE entries (name, type, mode, uid, gid, size, atime, ctime, mtime, extra)")
        con.executemany("INSERT INTO entries VALUES (?,?,?,?,?,?,?,?,?,0)", rows)


def test_sqlite_scan_and_resumable_export(spark, tmp_path, monkeypatch):
    for i in range(5):
        folder = tmp_path / f"d{i}"
        folder.mkdir()
        database(folder / "db.sqlite", [(f"n{j}" if j else "", "f", 33188, i, j, 10 * j, 1, 2, 3) for j in range(3)])
    files = [str(tmp_path / f"d{i}" / "db.sqlite") for i in range(5)] + [str(tmp_path / "none")]
    assert sqlite.read_named(spark, files, per_task=2).filter("error is null").count() == 15
    listing = inventory.parse_listing(lines(spark, *[f"{f},1" for f in files[:3]]))
    fix = lambda df: (
        inventory.normalize_entries(df, str(tmp_path), "/db.sqlite").filter("reject is null").drop("reject")
    )
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    assert writers.export_entries(spark, listing, out, progress, 2, fix) == 3
    more = inventory.parse_listing(lines(spark, *[f"{f},1" for f in files]))
    assert writers.export_entries(spark, more, out, progress, 2, fix) == 3
    assert writers.export_entries(spark, more, out, progress, 2, fix) == 0
    back = [r.value for r in spark.read.text(out).collect()]
    assert len(back) == len(set(back)) == 15
    kept = writers.read_export(spark, out, progress, "line string")
    assert kept.count() == 15
    # a run that dies between its rows and its progress leaves no row twice
    again = str(tmp_path / "again"), str(tmp_path / "again-progress")
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: 1 / 0 if "again-progress" in path else plain(self, path, *a, **k))
    with pytest.raises(ZeroDivisionError):
        writers.export_entries(spark, more, *again, 2, fix)
    monkeypatch.undo()
    assert writers.read_export(spark, *again, "line string").count() == 0
    assert writers.export_entries(spark, more, *again, 2, fix) == 6
    assert spark.read.text(again[0]).count() == 30 and writers.read_export(spark, *again, "line string").count() == 15
    assert len(writers.forget_unfinished(spark, *again)) == 1 and spark.read.text(again[0]).count() == 15
    assert writers.read_export(spark, str(tmp_path / "no"), str(tmp_path / "none"), "line string").count() == 0
    assert "f,33188,0,0,0,1,2,3,/d0/null" in back
    sizes = [r["n"] for r in spark.read.text(out).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2


def test_json_messages(spark):
    def message(**kw):
        base = dict(inode=5, path="/a", event="IN_CREATE", fileSize=3, permissions="rw", ownerUserId=1)
        return json.dumps({**base, **kw})

    bodies = [
        message(), message(event="IN_ISDIR IN_CREATE"), message(event="IN_ISDIR"), message(event="WHAT"),
        message(inode=0), message(path=""), "{", "", None,
    ]
    raw = spark.createDataFrame(list(enumerate(bodies)), "offset long, value string")
    good, bad = changelog.parse_gpfs(raw)
    rows = {r.eid: r for r in good.collect()}
    assert set(rows) == {0, 1} and rows[1].is_dir and not rows[0].is_dir and rows[0].size == 3
    assert bad.count() == 7
    audit = reduction.reader_audit(changelog.tag_gpfs(raw), "IN_CREATE").collect()[0]
    assert tuple(audit) == (9, 7, 2, 0)


def test_fid_lines(spark):
    base = "t=[0x1:0x2:0x0] ef=0xf u=0:7 nid=x"
    good, bad = changelog.parse_lustre(
        lines(
            spark,
            f"10 01CREAT 1 2 0x0 {base} p=[0x9:0x1:0x0] name",
            f"11 08RENME 1 2 0x0 {base} p=[p1] new s=[s1] sp=[sp1] old",
            f"12 10OPEN 1 2 0x0 {base} m=rw-",
            f"13 17MTIME 1 2 0x0 {base}",
            "14 01CREAT",
            f"15 03NONE 1 2 0x0 {base}",
            f"16 08RENME 1 2 0x0 {base} p=[p1] new",
            "",
        )
    )
    rows = {r.eid: r for r in good.collect()}
    assert set(rows) == {10, 11, 12, 13}
    assert (rows[10].target_fid, rows[10].parent_fid, rows[10].name, rows[10].gid) == ("0x1:0x2:0x0", "0x9:0x1:0x0", "name", "7")
    assert (rows[11].source_fid, rows[11].source_parent_fid, rows[11].old_name) == ("s1", "sp1", "old")
    assert rows[12]["mode"] == "rw-" and rows[13].name is None
    assert bad.count() == 3


def test_kafka_options():
    o = changelog.kafka_options("h:1", "t", start={0: 5}, end={0: 9}, partition=0)
    assert o["assign"] == '{"t": [0]}' and o["startingOffsets"] == '{"t": {"0": 5}}'
    assert o["endingOffsets"] == '{"t": {"0": 9}}'
    assert changelog.kafka_options("h:1", "t", start=1000)["startingTimestamp"] == "1000"
    assert "startingOffsets" not in changelog.kafka_options("h:1", "t", start="committed")


def test_report_runs(spark, tmp_path):
    head = "uid,metric,count,min,p10,p25,p50,p75,p90,p99,max,mean\n"
    for run in ("uid-dd-1", "uid-dd-2", "gid-dd-1"):
        (tmp_path / f"{run}.csv").write_text(head + "7,size,3,1,1,2,3,4,5,6,9,3.5\n")
    rows = reports.read_report_runs(spark, [str(p) for p in tmp_path.glob("*.csv")]).collect()
    assert sorted((r.typ, r.run, r.id, r.p99) for r in rows) == [
        ("gid", "gid-dd-1", 7, 6), ("uid", "uid-dd-1", 7, 6), ("uid", "uid-dd-2", 7, 6),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("update", "1", "/a"), ("delete", "2", "/b")], "op string, fid string, path string")
    writers.write_changes(df, "json", path=str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_changes(df, "none")
    assert json.loads(writers.kafka_value(df).collect()[0].value)["op"] == "update"
    writers.write_parquet(df, str(tmp_path / "p"), ["op"])
    assert reports.read_table(spark, str(tmp_path / "p")).count() == 2
    counts = spark.createDataFrame(
        [("prefix", "/a/b", 1, 4), ("user", "10", 0, 1), ("user", "9", 0, 2), ("prefix", "/z", 0, 3)],
        "kind string, name string, worker int, count long",
    )
    writers.write_counts_csv(counts, str(tmp_path / "c"))
    got = [r.value for r in spark.read.text(str(tmp_path / "c")).coalesce(1).collect()]
    assert sorted(got) == sorted(["user, 9, 0, 2", "user, 10, 0, 1", "prefix, /z, 0, 3", "prefix, /a/b, 1, 4"])


def test_failed_batches_are_receipts(spark):
    from inodeatlas.operators.documents import receipt_totals
    from inodeatlas.operators.packing import pack_documents

    docs = spark.createDataFrame(
        [(0, f"s{i}", json.dumps({"n": "x" * n})) for i, n in enumerate([3, 4, 5, 1])],
        "lane long, subject string, document string",
    )

    def refuse(request):
        if len(request["ingest_data"]["gmeta"]) > 1:
            raise RuntimeError("too many")
        return {"ok": True}

    packed = pack_documents(docs, 22)
    receipts = documents.write_documents(packed, refuse)
    values = [json.loads(r.value) for r in receipts.orderBy("batch").collect()]
    assert [v["succeed"] for v in values] == [False, False]
    assert json.loads(values[0]["resp"])["message"] == "too many"
    totals = receipt_totals(documents.write_documents(packed)).collect()[0]
    assert totals.documents == 4 and totals["bytes"] == sum(len(json.dumps({"n": "x" * n})) for n in [3, 4, 5, 1])


def test_receipts_are_totalled_by_group_in_one_reading(spark):
    from inodeatlas.operators.documents import receipt_totals
    from inodeatlas.operators.packing import pack_documents
    from inodeatlas.sinks import documents

    def sender(request):
        if request["ingest_data"]["gmeta"][0]["n"] % 10 == 3:
            raise ValueError("refused")
        return {"acknowledged": True}

    calls = spark.range(2500).select(F.col("id").cast("string").alias("subject"), F.to_json(F.struct(F.col("id").alias("n"))).alias("document"))
    receipts = documents.write_documents(pack_documents(calls, 1), sender)
    told = receipts.select("value", F.get_json_object("value", "$.succeed").alias("succeed"))
    got = {r["succeed"]: (r["receipts"], r["documents"]) for r in receipt_totals(told, by=["succeed"]).collect()}
    assert got == {"true": (2250, 2250), "false": (250, 250)}


def test_databases_are_written_anew_and_read_in_batches(spark, tmp_path):
    from inodeatlas.plans import written

    rows = [("/d%d" % (i % 3), None if i == 4 else f"n{i}", "f", 33188, i, None if i == 5 else 0, 10 * i, 1, 2, 3) for i in range(12)]
    inv = spark.createDataFrame(rows, "folder string, name string, type string, mode long, uid long, gid long, size long, atime long, ctime long, mtime long")
    for _ in range(2):  # as by a second attempt of each task
        listed = [r.value for r in written._write_databases(inv, str(tmp_path)).collect()]
    assert sorted(listed) == [f"{tmp_path}/d{i}/db.sqlite,1" for i in range(3)]
    back = [tuple(r.values()) for i in range(3) for b in sqlite.read_entries(f"{tmp_path}/d{i}/db.sqlite") for r in b.to_pylist()]
    told = [(f"{tmp_path}{f}/db.sqlite", *[None if v is None else str(v) for v in rest], None) for f, *rest in rows]
    assert sorted(back, key=str) == sorted(told, key=str)
    # columns of any types read as ``str`` writes each value
    odd = [1, 2.0, None, "x", b"y", 2**62, 1e20]
    with sqlite3.connect(tmp_path / "odd") as con:
        con.execute("CREATE TABLE entries (name, type, mode, uid, gid, size, atime, ctime, mtime)")
        con.executemany("INSERT INTO entries VALUES (?, ?, ?, ?, 1.0, ?, NULL, 'a', 7)", [(v, i, v, 0.5, 2 - i) for i, v in enumerate(odd)])
    got = [list(r.values())[1:] for b in sqlite.read_entries(str(tmp_path / "odd")) for r in b.to_pylist()]
    assert got == [[None if v is None else str(v), str(i), None if v is None else str(v), "0.5", "1.0", str(2 - i), None, "a", "7", None] for i, v in enumerate(odd)]


def test_numbers_of_entries_are_read_once(spark):
    entries = spark.createDataFrame([("/in/a/db", "n", "f", *"1234567", None)], sqlite.SCHEMA)
    good = inventory.normalize_entries(entries, "/in", "/db").filter("reject is null")
    assert [tuple(r) for r in good.collect()] == [("f", 1, 2, 3, 4, 5, 6, 7, "/a/n", None)]
    text = good._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("trim(") == 7
