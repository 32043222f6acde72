import itertools
import stat

import pytest
from pyspark.sql import functions as F

from inodeatlas.functions import events, modes, paths, text


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "level, want", [(0, "/"), (1, "/a"), (2, "/a/b"), (3, None), (4, None), (-1, "/")]
)
def test_prefix_at(spark, level, want):
    assert values(spark, paths.prefix_at("v", level), ["/a/b/c.txt"]) == [want]


def test_prefixes_and_deepest(spark):
    items = ["/a/b/c.txt", "/x", "/a/b/c/d/e/f", "/a//b/c/"]
    assert values(spark, paths.prefixes("v", 0, 4), items) == [
        ["/", "/a", "/a/b"],
        ["/"],
        ["/", "/a", "/a/b", "/a/b/c"],
        ["/", "/a", "/a/", "/a//b"],
    ]
    assert values(spark, paths.deepest_prefix("v", 0, 4), items) == ["/a/b", "/", "/a/b/c", "/a//b"]
    assert values(spark, paths.deepest_prefix("v", 1, 3), items) == ["/a/b", None, "/a/b", "/a/"]


def test_ancestors_and_depth(spark):
    items = ["/", "/a", "/a/b/c"]
    assert values(spark, paths.ancestors("v", 0, 5), items) == [["/"], ["/", "/a"], ["/", "/a", "/a/b", "/a/b/c"]]
    assert values(spark, paths.depth("v"), items) == [0, 1, 3]


def test_names_and_joins(spark):
    items = ["/a/b.txt", "/a", "/", "a", "/a/b/"]
    assert values(spark, paths.base_name("v"), items) == ["b.txt", "a", "", "a", "b"]
    assert values(spark, paths.parent_path("v"), items) == ["/a", "/", "/", ".", "/a"]
    assert values(spark, paths.join_path("v", F.lit("x")), ["/", "/a"]) == ["/x", "/a/x"]


def test_affixes(spark):
    assert values(spark, paths.strip_prefix("v", "/mnt"), ["/mnt/a", "/b"]) == ["/a", "/b"]
    assert values(spark, paths.strip_affixes("v", "/x", ".db"), ["/x/a.db", "/x/a", "/y/a.db"]) == ["/a", None, None]


def test_workers(spark):
    assert values(spark, paths.worker_bucket("v"), ["abc"]) == [891568578 % 64]
    got = [values(spark, paths.shrink_worker(F.lit(63), F.lit(d)), ["x"])[0] for d in range(6)]
    assert got == [63, 63, 31, 15, 7, 7]


def test_mode_examples(spark):
    pairs = {
        "-rw-r--r--": 0o100644,
        "-rwsr-xr-x": 0o104755,
        "drwxr-sr-x": 0o042755,
        "drwxrwxrwt": 0o041777,
        "-rwxr-sr--": 0o102754,
        "-r-Srwxr-x": 0o104475,
        "drwxrwx--T": 0o041770,
        "-rwsr-sr-x": 0o106755,
    }
    assert values(spark, modes.text_to_mode("v"), list(pairs)) == list(pairs.values())
    assert values(spark, modes.mode_to_text("v"), list(pairs.values()), "int") == list(pairs)
    bad = ["", "-rw-r--r-", "?rw-r--r--", "-rw-r--r-s", "-wr-r--r--", "-rw-r--r--x"]
    assert values(spark, modes.text_to_mode("v"), bad) == [None] * 6


def test_mode_round_trip(spark):
    x, last = ["x", "-", "s", "S"], ["x", "-", "t", "T"]
    triple = lambda e: ["".join(p) for p in itertools.product("r-", "w-", e)]
    texts = ["".join(p) for p in itertools.product("-dl", triple(x), triple(x), triple(last))]
    assert len(texts) == 12288
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.withColumn("m", modes.text_to_mode("t")).withColumn("back", modes.mode_to_text("m"))
    rows = df.collect()
    assert all(r.t == r.back and stat.filemode(r.m) == r.t for r in rows)


def test_times_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(spark, text.utc_text("v"), [0, 1700000000, -1], "long")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["1970-01-01 00:00:00 +00:00", "2023-11-14 22:13:20 +00:00", "1969-12-31 23:59:59 +00:00"]


def test_text_forms(spark):
    assert values(spark, text.url_decode("v"), ["a%2Fb+c", "100%", "x%20y"]) == ["a/b+c", "100%", "x y"]
    assert values(spark, text.strip_brackets("v"), ["[a:b]", "[a", "a"]) == ["a:b", "[a", "a"]
    assert values(spark, text.unquote_field("v"), ['"/a,b"', '""x"']) == ["/a,b", "x"]
    assert values(spark, text.strict_long("v"), ["12", "-3", " 7 ", "1.5", "x", ""]) == [12, -3, 7, None, None, None]
    parsed = values(spark, text.parse_count_line("v"), ["prefix,/a,b/c,3,17", "user,5,0,2", "broken"])
    assert parsed[0].asDict() == dict(kind="prefix", name="/a,b/c", worker=3, count=17)
    assert parsed[1].name == "5" and parsed[2] is None
    spaced = values(spark, text.parse_count_line("v", ", "), ["prefix, /a, b, 3, 17"])[0]
    assert (spaced.name, spaced.worker, spaced["count"]) == ("/a, b", 3, 17)
    assert values(spark, text.size_text(F.lit(2), F.lit(3145728)), ["x"]) == ["ingested 2 docs (3145728 bytes, 3.00 MB)"]


def test_floor_division(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (-8, 2), (0, 3)], "s long, n long")
    assert [r[0] for r in df.select(text.floor_div("s", "n")).collect()] == [-4, 3, -4, 0]


def test_keys_and_subjects(spark):
    df = spark.createDataFrame([("user", "5"), ("group", "6"), ("prefix", "/u/x")], "kind string, name string")
    rows = df.select(text.subject("kind", "name").alias("s"), text.tagged_key("kind", "name").alias("k")).collect()
    assert [r.s for r in rows] == ["user_id::5", "group_id::6", "dir::/u/x"]
    assert [r.k for r in rows] == ["u5", "g6", "/u/x"]
    back = values(spark, text.untag_key("v"), [r.k for r in rows])
    assert [(b.kind, b.name) for b in back] == [("user", "5"), ("group", "6"), ("prefix", "/u/x")]
    parts = values(spark, text.split_subject("v"), ["dir::/a::b"])[0]
    assert (parts.typ, parts.name) == ("dir", "/a::b")


def test_errors_and_codes(spark):
    df = spark.createDataFrame([(12, 10), (3, 0)], "a long, e long")
    gap, rel = text.value_errors("a", "e")
    assert [tuple(r) for r in df.select(gap, rel).collect()] == [(2, 0.2), (3, None)]
    assert values(spark, events.event_code("v", "fid"), ["01CREAT", "99XXX"]) == ["01CREAT", None]
    assert values(spark, events.event_code("v", "inotify"), ["IN_OPEN", "OPEN"]) == ["IN_OPEN", None]


def test_base64(spark):
    assert values(spark, text.base64_binary(text.base64_text(F.col("v").cast("binary"))), ["abc"]) == [b"abc"]


def test_deepest_prefix_of_odd_paths(spark):
    def plain(path, lo, hi):
        parts = ("/" + path.strip("/")).split("/")
        level = min(len(parts) - 2, hi - 1)
        return None if level < lo else "/" if level <= 0 else "/".join(parts[: level + 1])

    odd = ["", "/", "//", "a", "/a", "a/b", "/a/b/", "//a//b", "/a//", "/é/ü/x", "/ / /x", "/a/b/c/d/e/f", "a/b//c"]
    spans = [(lo, hi) for lo in range(-1, 5) for hi in range(1, 7)]
    df = spark.createDataFrame([(p,) for p in odd], "p string")
    row_of = df.select("p", *[paths.deepest_prefix("p", lo, hi).alias(f"s{i}") for i, (lo, hi) in enumerate(spans)])
    for row in row_of.collect():
        assert [row[f"s{i}"] for i in range(len(spans))] == [plain(row.p, lo, hi) for lo, hi in spans], row.p


def test_fan_out_makes_each_name_once(spark):
    from inodeatlas.operators.dimensions import explode_dimensions

    inv = spark.createDataFrame([(1, None, "/a/b/c"), (None, 2, "x")], "uid long, gid long, path string")
    rows = explode_dimensions(inv, deepest=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(") <= 1  # of the name that comes out, not of each that goes in
    assert sorted(map(tuple, rows.collect())) == [("group", "2"), ("prefix", "/a/b"), ("user", "1")]
