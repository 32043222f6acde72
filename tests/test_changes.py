import random

import pytest
from pyspark.sql import functions as F

import model
from inodeatlas.operators import namespace, reduction, refresh, scans
from inodeatlas.schemas import FID_EVENTS, FID_RULES, INOTIFY_EVENTS, INOTIFY_RULES, NULL_FID
from inodeatlas.sources.changelog import poll_batches
from inodeatlas.streaming import run
from inodeatlas.streaming.follow import follow_namespace, order_partitions

PATH_SCHEMA = (
    "eid long, batch_id long, inode long, is_dir boolean, event_type string, path string, size long, atime long, "
    "ctime long, mtime long, permissions string, uid long, gid long"
)
FID_SCHEMA = (
    "eid long, batch_id long, event_type string, target_fid string, uid string, gid string, parent_fid string, "
    "name string, source_fid string, source_parent_fid string"
)
EXTRA = ("size", "atime", "ctime", "mtime", "permissions", "uid", "gid")
RULES = {"inotify": INOTIFY_RULES, "fid": FID_RULES}


def frame(spark, events, profile):
    schema = PATH_SCHEMA if profile == "inotify" else FID_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(e.get(c) for c in names) for e in events], schema)


def path_event(eid, kind, inode, path, batch=0, is_dir=False, size=0):
    return dict(eid=eid, batch_id=batch, inode=inode, is_dir=is_dir, event_type=kind, path=path, size=size)


def fid_event(eid, kind, fid, parent=None, name=None, batch=0, source=None, old=None):
    return dict(
        eid=eid, batch_id=batch, event_type=kind, target_fid=fid, parent_fid=parent, name=name,
        source_fid=source, source_parent_fid=old,
    )


def kept(spark, events, profile, enabled=True):
    rows = reduction.reduce_events(frame(spark, events, profile), profile, enabled).collect()
    return [r.eid for r in sorted(rows, key=lambda r: (r.batch_id, r.first_eid, r.eid))]


def changes(spark, events, profile, reduce=False, resolver=None, state=None, **kw):
    ev = reduction.reduce_events(frame(spark, events, profile), profile, reduce)
    known = spark.createDataFrame(list(resolver.items()), "fid string, path string") if resolver else None
    new, out = namespace.apply_events(state or namespace.empty_state(spark), ev, profile, known, **kw)
    return new, sorted((r.flush, r.op, r.fid, r.path) for r in out.collect())


@pytest.mark.parametrize(
    "kinds, want",
    [
        (["01CREAT", "14SATTR", "11CLOSE", "06UNLNK"], []),
        (["17MTIME", "11CLOSE"], [0]),
        (["10OPEN", "10OPEN"], [0, 1]),
        (["01CREAT", "08RENME", "06UNLNK"], [0, 1, 2]),
        (["01CREAT", "06UNLNK", "17MTIME"], [2]),
        (["02MKDIR", "17MTIME", "07RMDIR"], []),
        (["06UNLNK", "01CREAT"], [0, 1]),
    ],
)
def test_fid_rules(spark, kinds, want):
    events = [
        fid_event(i, k, NULL_FID if k == "08RENME" else "f", "d", "n", source="f" if k == "08RENME" else None)
        for i, k in enumerate(kinds)
    ]
    assert kept(spark, events, "fid") == want


def test_inotify_rules(spark):
    kinds = ["IN_CREATE", "IN_OPEN", "IN_DELETE"]
    assert kept(spark, [path_event(i, k, 1, "/a") for i, k in enumerate(kinds)], "inotify") == [1]
    # no barrier here, and only the latest creation goes
    kinds = ["IN_CREATE", "IN_CREATE", "IN_MOVED_TO", "IN_DELETE_SELF"]
    assert kept(spark, [path_event(i, k, 1, "/a") for i, k in enumerate(kinds)], "inotify") == [0, 2]


def test_slot_order_holds_without_rules(spark):
    events = [fid_event(1, "02MKDIR", "d"), fid_event(2, "01CREAT", "f"), fid_event(3, "08RENME", NULL_FID, source="d")]
    for enabled in (True, False):
        assert kept(spark, events, "fid", enabled) == [1, 3, 2]


@pytest.mark.parametrize("profile", ["inotify", "fid"])
def test_reduction_matches_the_model(spark, profile):
    events = model.history(11, 400, profile, batch=60)
    want = [
        e["eid"] for b in range(7)
        for e in model.reduce_slots([e for e in events if e["batch_id"] == b], profile, RULES[profile])
    ]
    assert kept(spark, events, profile) == want


@pytest.mark.parametrize("profile", ["inotify", "fid"])
def test_reduction_of_any_slots(spark, profile):
    """Random slots of all event types, most of which make no sense."""
    rng = random.Random(5)
    kinds = INOTIFY_EVENTS if profile == "inotify" else FID_EVENTS
    # closers and openers more often than the rest
    paired = ("01CREAT", "02MKDIR", "06UNLNK", "07RMDIR", "IN_CREATE", "IN_DELETE")
    weighted = [k for k in kinds for _ in range(4 if k in paired else 1)]
    events = []
    for eid in range(3000):
        kind, own = rng.choice(weighted), rng.randrange(60)
        if profile == "inotify":
            events.append(path_event(eid, kind, own, "/a", batch=eid // 1500))
        else:
            moved = kind == "08RENME"
            events.append(fid_event(eid, kind, NULL_FID if moved else f"f{own}", "d", "n", eid // 1500, source=f"f{own}" if moved else None))
    want = [e["eid"] for b in range(2) for e in model.reduce_slots([e for e in events if e["batch_id"] == b], profile, RULES[profile])]
    assert kept(spark, events, profile) == want


def test_reduction_of_a_long_slot(spark):
    """One object with very many events in a batch: no list of them is made."""
    n = 300_000
    kind = F.element_at(F.array(*map(F.lit, ("01CREAT", "17MTIME", "06UNLNK", "11CLOSE", "18CTIME", "06UNLNK"))), (F.col("eid") % 6 + 1).cast("int"))
    null = F.lit(None).cast("string")
    ev = spark.range(n).select(F.col("id").alias("eid")).select(
        "eid", F.lit(0).cast("long").alias("batch_id"), kind.alias("event_type"), F.lit("f").alias("target_fid"), *[null.alias(c) for c in ("uid", "gid", "parent_fid", "name", "source_fid", "source_parent_fid")]
    )
    out = reduction.reduce_events(ev, "fid")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" in plan
    got = {r.event_type: r["count"] for r in out.groupBy("event_type").count().collect()}
    # creation and deletion go in pairs, every second deletion stays, of the others the first outside a life
    assert got == {"06UNLNK": n // 6, "11CLOSE": 1, "18CTIME": 1}


def test_rules_that_cannot_be_counted(spark):
    with pytest.raises(ValueError, match="block"):
        reduction._ignored({"a": ("ignore", ("b",))}, set())


def moments(rows, *names):
    schema = ", ".join(f"{n} struct<b:long,f:long,e:long,s:int>" if n in ("at", "since", "begin", "end") else f"{n} string" for n in names)
    return [tuple((v // 10, 0, v, 1) if isinstance(v, int) else v for v in r) for r in rows], schema


@pytest.mark.parametrize("few", [True, False])
def test_lookup_and_between(spark, monkeypatch, few):
    """As-of lookups and pairs of spans and events equal the joins that they stand for, and make no other rows."""
    monkeypatch.setattr(scans, "BATCHES_PER_BLOCK", 3)
    rng = random.Random(2)
    told = [(rng.choice("abz"), t, rng.choice(["x", "y", None])) for t in rng.sample(range(400), 80)]
    asked = [(rng.choice("abcz"), rng.randrange(400), str(i)) for i in range(60)]
    facts, questions = spark.createDataFrame(*moments(told, "k", "since", "v")), spark.createDataFrame(*moments(asked, "k", "at", "id"))
    for inclusive in (False, True):
        got = {r.id: r.v for r in scans.lookup(questions, facts, ["k"], "v", "at", "since", inclusive, few).collect()}
        want = {i: max(((t, v or "") for k2, t, v in told if k2 == k and (t < at or (inclusive and t == at))), default=(0, ""))[1] or None for k, at, i in asked}
        assert got == want
    spans = [(rng.choice("abc"), b, rng.choice([None, b + rng.randrange(1, 90)]), str(i)) for i, b in enumerate(rng.sample(range(400), 50))]
    joined = scans.between(spark.createDataFrame(*moments(spans, "k", "begin", "end", "id")), facts, ["k"], "begin", "end", "since", few)
    pairs = [(i, t) for k, b, e, i in spans for k2, t, _ in told if k2 == k and b < t and (e is None or t < e)]
    assert sorted((r.span.id, r.event.since.e) for r in joined.collect()) == sorted(pairs)


def test_hot_directory_is_not_joined_by_time(spark):
    """A directory with many lives and many children: lookups make as many rows as they are asked."""
    folders = spark.range(600).select(F.lit("/d").alias("folder"), moment(F.col("id") * 2).alias("since"), F.col("id").cast("string").alias("owner0"))
    claims = spark.range(600).select(F.lit("/d").alias("folder"), moment(F.col("id") * 2 + 1).alias("seq"), F.col("id").cast("string").alias("fid"))
    seen = scans.lookup(claims, folders, ["folder"], "owner0", "seq", "since")
    assert [r.owner0 for r in seen.orderBy("seq").collect()] == [str(i) for i in range(600)]
    text = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    joins = [node for node in plan_nodes(seen) if "Join" in node.nodeName()]
    assert joins and all(node.metrics().get("numOutputRows").get().value() <= 1200 for node in joins), [n.nodeName() for n in plan_nodes(seen)]


def moment(e):
    return F.struct(F.floor(e / 10).cast("long").alias("b"), F.lit(0).cast("long").alias("f"), e.cast("long").alias("e"), F.lit(1).alias("s"))


def plan_nodes(df):
    """Operators of the final plan of a collected DataFrame."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        while node.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in node.nodeName():
            node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan()
        out.append(node)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_rounds_of_collisions_shrink(spark):
    """A chain of renames, each onto the place that the last one has left: later rounds touch its rest only."""
    events = []
    for i in range(40):  # bystanders
        events.append(path_event(len(events), "IN_CREATE", 1000 + i, f"/q{i}"))
    for i in range(12):
        events.append(path_event(len(events), "IN_CREATE", i + 1, f"/p{i}"))
    for i in range(11):  # object i moves onto the place of i + 1, unless it has been removed itself
        events.append(path_event(len(events), "IN_MOVED_TO", i + 1, f"/p{i + 1}", batch=1))
    events = [{**e, **dict.fromkeys(("atime", "ctime", "mtime", "uid", "gid"), 0), "permissions": "p"} for e in events]
    ev = reduction.reduce_events(frame(spark, events, "inotify"), "inotify", False)
    rounds = []
    _, out = namespace.apply_events(namespace.empty_state(spark), ev, "inotify", rounds=rounds)
    assert as_rows(out, "inotify") == want_rows(events, "inotify", False)
    assert rounds[0] == 63 and len(rounds) > 2 and max(rounds[1:]) <= 33 and rounds[-1] < rounds[1], rounds


def test_long_chains_of_collisions_are_settled_in_slices(spark, monkeypatch):
    """Many objects on few paths: a chain as long as the log takes three rounds, and slices of 16 rows."""
    rng, events = random.Random(7), []
    for i in range(30):
        events.append(path_event(len(events), "IN_CREATE", i + 1, f"/p{i}"))
    for i in range(29):  # whether a rename holds depends on the one before it, and so on
        events.append(path_event(len(events), "IN_MOVED_TO", i + 1, f"/p{i + 1}", batch=1))
    for _ in range(150):
        kind = rng.choice(("IN_CREATE", "IN_MOVED_TO", "IN_MOVED_TO", "IN_DELETE"))
        events.append(path_event(len(events), kind, rng.randrange(40) + 1, f"/p{rng.randrange(4)}", batch=len(events) // 40))
    events = [{**e, **dict.fromkeys(("atime", "ctime", "mtime", "uid", "gid"), 0), "permissions": "p"} for e in events]
    ev = reduction.reduce_events(frame(spark, events, "inotify"), "inotify", False)
    settle, calls = namespace.collisions.removals, []

    def in_small_slices(placed, prior):
        calls.append(1)
        return settle(placed, prior, 16)

    monkeypatch.setattr(namespace.collisions, "removals", in_small_slices)
    rounds = []
    _, out = namespace.apply_events(namespace.empty_state(spark), ev, "inotify", rounds=rounds)
    assert as_rows(out, "inotify") == want_rows(events, "inotify", False)
    assert len(rounds) == 3 and calls == [1], rounds


def test_keys_of_few_rows_need_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "FEW_ROWS", 5)
    even = spark.range(10).select((F.col("id") % 2).alias("k"), F.lit(None).cast("string").alias("none"))
    assert not scans.is_few(even)
    assert scans.is_few(even, F.col("k"), F.col("none"))
    assert not scans.is_few(even.union(even.limit(1)), F.col("none"), F.col("k"))


def test_poll_batches_and_types(spark):
    df = spark.createDataFrame([(0, "IN_OPEN"), (9999, "IN_CREATE"), (10000, "IN_OPEN")], "eid long, event_type string")
    assert [r.batch_id for r in poll_batches(df).orderBy("eid").collect()] == [0, 0, 1]
    assert reduction.drop_event_types(df, " IN_OPEN , NOPE").count() == 1
    assert reduction.unknown_event_types("IN_OPEN,NOPE", "inotify") == ["NOPE"]


def test_create_and_delete_in_one_flush(spark):
    events = [path_event(0, "IN_CREATE", 1, "/a"), path_event(1, "IN_DELETE", 1, "/a")]
    assert changes(spark, events, "inotify")[1] == []
    # the parent is known here and is reported
    events = [fid_event(0, "01CREAT", "f", "d", "n"), fid_event(1, "06UNLNK", "f", "d", "n")]
    assert changes(spark, events, "fid", resolver={"d": "/m"})[1] == [(0, "update", "d", "/m")]


def test_create_flush_delete(spark):
    events = [path_event(0, "IN_CREATE", 1, "/a"), path_event(1, "IN_DELETE", 1, "/a", batch=1)]
    assert changes(spark, events, "inotify")[1] == [(0, "update", "1", "/a"), (1, "delete", "1", "/a")]
    assert changes(spark, events, "inotify", flush_every=2)[1] == []


def test_directory_rename_moves_what_is_below(spark):
    events = [
        path_event(0, "IN_CREATE", 1, "/a", is_dir=True),
        path_event(1, "IN_CREATE", 2, "/a/x"),
        path_event(2, "IN_CREATE", 3, "/a/y", is_dir=True),
        path_event(3, "IN_CREATE", 4, "/a/y/z"),
        path_event(4, "IN_MOVED_TO", 1, "/b", batch=1),
        path_event(5, "IN_CREATE", 5, "/b/y/w", batch=2),
    ]
    got = changes(spark, events, "inotify")[1]
    assert [c[1:] for c in got if c[0] == 1] == [
        ("update", "1", "/b"), ("update", "2", "/b/x"), ("update", "3", "/b/y"), ("update", "4", "/b/y/z"),
    ]
    assert (2, "update", "5", "/b/y/w") in got
    events = [
        fid_event(0, "02MKDIR", "a", "r", "a"), fid_event(1, "01CREAT", "x", "a", "x"),
        fid_event(2, "02MKDIR", "q", "r", "q"),
        fid_event(3, "08RENME", NULL_FID, "q", "b", batch=1, source="a", old="r"),
    ]
    got = changes(spark, events, "fid", resolver={"r": "/"})[1]
    assert [c[1:] for c in got if c[0] == 1] == [
        ("update", "a", "/q/b"), ("update", "q", "/q"), ("update", "r", "/"), ("update", "x", "/q/b/x"),
    ]


def test_rename_over_existing(spark):
    # in slot order the overwritten file must come first
    events = [path_event(0, "IN_CREATE", 2, "/b"), path_event(1, "IN_CREATE", 1, "/a")]
    both = events + [path_event(2, "IN_MOVED_TO", 1, "/b")]
    assert changes(spark, both, "inotify")[1] == [(0, "update", "1", "/b")]
    later = events + [path_event(2, "IN_MOVED_TO", 1, "/b", batch=1)]
    assert [c for c in changes(spark, later, "inotify")[1] if c[0] == 1] == [
        (1, "delete", "2", "/b"), (1, "update", "1", "/b"),
    ]


def test_attributes_keep_their_owner(spark):
    events = [
        {**path_event(0, "IN_CREATE", 1, "/a", size=5), "uid": 7, "permissions": "rw"},
        {**path_event(1, "IN_ATTRIB", 1, "/a", batch=1, size=9), "uid": 8, "permissions": "r"},
    ]
    ev = reduction.reduce_events(frame(spark, events, "inotify"), "inotify")
    out = namespace.apply_events(namespace.empty_state(spark), ev, "inotify")[1].orderBy("flush").collect()
    assert [(r.size, r.uid, r.permissions) for r in out] == [(5, 7, "rw"), (9, 7, "rw")]


def test_unknown_parent_and_lost_path(spark):
    events = [fid_event(0, "01CREAT", "f", "nowhere", "n")]
    assert changes(spark, events, "fid", resolver={"d": "/m"})[1] == []
    events = [
        fid_event(0, "01CREAT", "f", "d", "n"),
        fid_event(1, "08RENME", NULL_FID, "nowhere", "n", batch=1, source="f", old="d"),
        fid_event(2, "06UNLNK", "f", "nowhere", "n", batch=2),
    ]
    assert changes(spark, events, "fid", resolver={"d": "/m"})[1] == [
        (0, "update", "d", "/m"), (0, "update", "f", "/m/n"), (1, "update", "d", "/m"), (2, "delete", "f", "FileRemoved"),
    ]


def test_functional_script(spark):
    """create, modify, rename, mkdir, move, delete: only the base directory is left."""
    steps = [
        fid_event(0, "01CREAT", "f", "base", "hello"),
        fid_event(1, "17MTIME", "f"),
        fid_event(2, "08RENME", NULL_FID, "base", "hi", source="f", old="base"),
        fid_event(3, "02MKDIR", "d", "base", "dir"),
        fid_event(4, "08RENME", NULL_FID, "d", "hi", source="f", old="base"),
        fid_event(5, "06UNLNK", "f", "d", "hi"),
        fid_event(6, "07RMDIR", "d", "base", "dir"),
    ]
    steps = [{**s, "batch_id": s["eid"]} for s in steps]
    state, got = changes(spark, steps, "fid", resolver={"base": "/m/base"})
    live = state.filter("alive").select("fid").collect()
    assert [r.fid for r in live] == ["base"]
    assert [c for c in got if c[1] == "delete"] == [(5, "delete", "f", "/m/base/dir/hi"), (6, "delete", "d", "/m/base/dir")]


def as_rows(df, profile):
    return sorted(
        (r.flush, r.op, r.fid, r.path) + (tuple(r[c] for c in EXTRA) if profile == "inotify" and r.op == "update" else ())
        for r in df.collect()
    )


def want_rows(events, profile, reduce, every=1):
    told = model.replay(
        events, profile, RULES[profile] if reduce else {}, {"1": "/base"} if profile == "fid" else None, every
    )
    return sorted((f, o, i, p) + (tuple(e[c] for c in EXTRA) if e else ()) for f, o, i, p, e in told)


def base_resolver(spark, profile):
    return spark.createDataFrame([("1", "/base")], "fid string, path string") if profile == "fid" else None


@pytest.mark.parametrize(
    "profile, seed, every, reduce", [("inotify", 3, 2, False), ("inotify", 8, 1, True), ("fid", 4, 3, True), ("fid", 5, 1, False)]
)
def test_feed_matches_the_model(spark, profile, seed, every, reduce):
    events = model.history(seed, 140, profile)
    ev = reduction.reduce_events(frame(spark, events, profile), profile, reduce)
    _, out = namespace.apply_events(namespace.empty_state(spark), ev, profile, base_resolver(spark, profile), every)
    assert as_rows(out, profile) == want_rows(events, profile, reduce, every)


def test_shared_paths_match_the_model(spark):
    from inodeatlas.plans.tables import gpfs_events

    df = gpfs_events(spark, "/root/testdata/sf0.001", crowded=True)
    df = df.withColumn("batch_id", F.floor(F.col("eid") / 100).cast("long"))
    events = [r.asDict() for r in df.orderBy("eid").collect()]
    ev = reduction.reduce_events(df, "inotify", False)
    _, out = namespace.apply_events(namespace.empty_state(spark), ev, "inotify")
    assert as_rows(out, "inotify") == want_rows(events, "inotify", False)


@pytest.mark.parametrize("profile, poll, every, reduce", [("inotify", 40, 1, True), ("fid", 40, 1, True), ("inotify", 13, 3, True), ("fid", 17, 2, True)])
def test_stream_equals_replay(spark, tmp_path, profile, poll, every, reduce):
    """Micro-batches that cut polls and flushes give the feed of the whole history."""
    events = model.history(21, 120, profile, batch=poll)
    df = frame(spark, events, profile)
    inbox = tmp_path / "in"
    size = 40 if every == 1 else 31
    for b in range(-(-120 // size)):
        part = df.filter(F.floor(F.col("eid") / size) == b).drop("batch_id")
        part.coalesce(1).write.mode("append").parquet(str(inbox))
    schema = df.drop("batch_id").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    # small bases, so that compaction takes part
    handle = follow_namespace(
        spark, profile, str(tmp_path), base_resolver(spark, profile), poll_size=poll, flush_every=every, compact_every=2
    )
    assert run.run_to_end(stream, handle, str(tmp_path / "checkpoint"), timeout=300)
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "changes"))
    assert as_rows(out, profile) == want_rows(events, profile, reduce, every)


@pytest.mark.parametrize("profile", ["inotify", "fid"])
def test_reads_do_not_grow_with_the_state(spark, tmp_path, profile):
    """The same micro-batch against a state of 60 and of 600 directories opens as many rows."""
    opened, fed = [], []
    for size in (60, 600):
        folder = str(tmp_path / f"{profile}{size}")
        handle = follow_namespace(spark, profile, folder, reduce=False, poll_size=None, compact_every=1, rows_per_bucket=40)
        rows = []
        for d in range(size):
            if profile == "inotify":
                rows.append(("d%d" % d, None, "d%d" % d, "/d%d" % d, True))
                rows += [("%d" % (10_000 + 3 * d + i), "d%d" % d, f"x{i}", None, False) for i in range(3)]
            else:
                rows.append((f"d{d}", None, f"d{d}", f"/d{d}", True))
                rows += [(f"f{d}_{i}", f"d{d}", f"x{i}", None, False) for i in range(3)]
        if profile == "inotify":  # inodes are numbers
            rows = [(f[1:] if f.startswith("d") else f, p[1:] if p else None, n, a, is_dir) for f, p, n, a, is_dir in rows]
        state = spark.createDataFrame([(f, p, n, a, is_dir, 1, 1, 1, 1, "p", 1, 1, True, True) for f, p, n, a, is_dir in rows], handle.table.read(0).schema)
        handle.table.write(2, state)  # a base
        if profile == "inotify":
            batch = [path_event(0, "IN_CREATE", 90_000, "/d7/new"), path_event(1, "IN_MOVED_TO", 9, "/d3/moved", is_dir=True), path_event(2, "IN_MOVED_TO", 10_000 + 12, "/d5/x1")]
        else:
            batch = [fid_event(0, "01CREAT", "new", "d7", "new"), fid_event(1, "08RENME", NULL_FID, "d3", "moved", source="d9", old="r"), fid_event(2, "06UNLNK", "f4_0", "d4", "x0")]
        handle(frame(spark, batch, profile).drop("batch_id"), 2)
        opened.append(handle.rows_read)
        fed.append(sorted(tuple(r) for r in spark.read.parquet(f"{folder}/changes/4").select("op", "fid", "path").collect()))
    assert fed[0] == fed[1] and ("update", "new" if profile == "fid" else "90000", "/d7/new") in fed[0]
    assert any(p == "/d3/moved/x2" for _, _, p in fed[0])
    if profile == "inotify":  # what stood in the way
        assert ("delete", str(10_000 + 3 * 5 + 1), "/d5/x1") in fed[0]
    assert 0 < opened[1] < 1.5 * opened[0] + 200 < 600 * 4


def test_flush_waits_for_its_last_poll(spark, tmp_path):
    """A deletion in the next micro-batch takes back what the flush would have told."""
    handle = follow_namespace(spark, "inotify", str(tmp_path), poll_size=2, flush_every=2)
    first = [path_event(0, "IN_CREATE", 7, "/a"), path_event(1, "IN_CREATE", 8, "/b")]
    second = [path_event(2, "IN_DELETE", 7, "/a"), path_event(3, "IN_MODIFY", 8, "/b")]
    for n, events in enumerate((first, second)):
        handle(frame(spark, events, "inotify").drop("batch_id"), n)
    handle.finish()
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "changes"))
    assert [(r.flush, r.op, r.fid, r.path) for r in out.collect()] == [(0, "update", "8", "/b")]


def test_small_micro_batches_are_not_compiled(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.codegen.wholeStage", []
    before = spark.conf.get(key)
    handle = follow_namespace(spark, "inotify", str(tmp_path), reduce=False, poll_size=2)
    monkeypatch.setattr(handle, "_apply", lambda rows, step: seen.append(spark.conf.get(key)))
    batch = frame(spark, [path_event(i, "IN_CREATE", i, f"/a{i}") for i in range(3)], "inotify").drop("batch_id")
    handle(batch, 0)
    monkeypatch.setattr("inodeatlas.streaming.follow.SMALL_BATCH", 2)
    handle(batch.withColumn("eid", F.col("eid") + 3), 1)
    assert seen == ["false", before] and spark.conf.get(key) == before


def test_stream_of_ignored_events_and_repeated_batch(spark, tmp_path):
    handle = follow_namespace(spark, "inotify", str(tmp_path), ignore="IN_OPEN")
    opened = frame(spark, [path_event(0, "IN_OPEN", 7, "/a")], "inotify").drop("batch_id")
    created = frame(spark, [path_event(0, "IN_CREATE", 7, "/a")], "inotify").drop("batch_id")
    # the first micro-batch runs again after a final flush
    for batch, want in ((opened, []), (created, [(0, "update", "7", "/a")])):
        handle(batch, 0)
        handle.finish()
        out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "changes"))
        assert [(r.flush, r.op, r.fid, r.path) for r in out.collect()] == want


def test_partitions_with_the_same_offsets(spark):
    df = spark.createDataFrame([(1, 5, "c"), (0, 5, "a"), (0, 6, "b"), (1, 7, "d")], "partition int, offset long, what string")
    got = order_partitions(df, 10).orderBy("eid").collect()
    assert [(r.eid, r.what) for r in got] == [(10, "a"), (11, "b"), (12, "c"), (14, "d")]


def test_state_snapshot(spark):
    events = model.history(5, 200, "fid")
    ev = reduction.reduce_events(frame(spark, events, "fid"), "fid", False)
    state, _ = namespace.apply_events(namespace.empty_state(spark), ev, "fid", base_resolver(spark, "fid"))
    rows = {r.fid: r for r in namespace.state_snapshot(state).collect()}
    m = model.Model("fid", {"1": "/base"})
    for b in range(10):
        for e in model.reduce_slots([x for x in events if x["batch_id"] == b], "fid", {}):
            m.apply(e, 0)
        m.flush()
    assert {f: r.path for f, r in rows.items()} == {f: n["path"] for f, n in m.nodes.items()}
    assert {f for f, r in rows.items() if r.emitted} == m.told
    totals = namespace.state_summary(state).collect()[0]
    assert (totals.objects, totals.lost, totals.emitted) == (len(m.nodes), 0, len(m.told))
    for f, r in rows.items():
        assert (r.children or []) == sorted(k for k, n in m.nodes.items() if n["parent"] == f)


def test_pass_through_and_counts_stream(spark, tmp_path):
    df = frame(spark, model.history(41, 100, "fid"), "fid").drop("batch_id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    handle = run.pass_through_stream("fid", "json", path=str(tmp_path / "out"))
    run.run_to_end(stream, handle, str(tmp_path / "c1"))
    one = df.withColumn("batch_id", F.lit(0).cast("long"))
    assert spark.read.json(str(tmp_path / "out")).count() == reduction.reduce_events(one, "fid").count()
    running = run.count_stream(stream, ["event_type"])
    query = running.writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in df.groupBy("event_type").count().collect()}


def test_idle_stream_stops(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = run.start(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "c"), interval="100 milliseconds")
    run.stop_when_idle(query, 1.5)
    assert not query.isActive and sum(seen) == 5


@pytest.mark.parametrize("lanes", [None, 2])
def test_document_stream(spark, tmp_path, lanes):
    df = spark.createDataFrame([(f"s{i}", '{"n": %d}' % i) for i in range(20)], "subject string, document string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run.run_to_end(stream, run.document_stream(30, str(tmp_path / "receipts"), lanes=lanes), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "receipts"))
    assert got.agg(F.sum("documents")).collect()[0][0] == 20 and "ingested_at" in got.columns


def test_refresh_equals_recomputation(spark):
    from inodeatlas.operators.aggregate import finish_stats, key_partials

    columns = "fid string, path string, size long, atime long, ctime long, mtime long, uid long, gid long"
    row = lambda f, p, s, u: (f, p, s, 1, 2, 3, u, u % 2)
    before = spark.createDataFrame([row(str(i), f"/a/d{i % 4}/f{i}", i, i % 3) for i in range(40)], columns)
    feed = [(0, "update", *row("1", "/a/d9/f1", 100, 1)), (1, "delete", *row("2", None, None, 0)[:2], *[None] * 6)]
    feed += [(1, "update", *row("99", "/b/c/f", 7, 5)), (0, "update", *row("2", "/a/d0/f2", 1, 2))]
    changes_ = spark.createDataFrame(feed, "flush long, op string, " + columns)
    got = finish_stats(refresh.refresh_aggregates(key_partials(before), before, changes_), ["kind", "name"])
    want = finish_stats(key_partials(refresh.merge_primary(before, changes_)), ["kind", "name"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_refresh_takes_back(spark, monkeypatch, seed):
    """Random changes: counts, sums and extremes after them, while only changed files are fanned out."""
    from inodeatlas.operators.aggregate import finish_stats, key_partials

    rng = random.Random(seed)
    columns = "fid string, path string, size long, atime long, ctime long, mtime long, uid long, gid long"
    new = lambda f: (f, f"/a/d{rng.randrange(4)}/e{rng.randrange(2)}/f{f}", rng.randrange(20), *(rng.randrange(1, 9) for _ in range(3)), rng.randrange(3), rng.randrange(2))
    before = spark.createDataFrame([new(str(i)) for i in range(80)], columns)
    feed = []
    for flush in range(3):
        for f in rng.sample(range(90), 6):
            feed.append((flush, "delete", str(f), *[None] * 7) if rng.random() < 0.4 else (flush, "update", *new(str(f))))
    changes_ = spark.createDataFrame(feed, "flush long, op string, " + columns)
    fanned = []
    plain = refresh._extremes
    monkeypatch.setattr(refresh, "_extremes", lambda after, keys, *rest: fanned.append(keys.count()) or plain(after, keys, *rest))
    got = finish_stats(refresh.refresh_aggregates(key_partials(before), before, changes_), ["kind", "name"])
    after = refresh.merge_primary(before, changes_)
    want = finish_stats(key_partials(after), ["kind", "name"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(fanned) <= 1 and sum(fanned) < want.count()
    # an update that takes no extreme away reads no other file
    quiet = spark.createDataFrame([(9, "update", "new", "/a/d0/e0/new", 5, 4, 4, 4, 1, 1)], "flush long, op string, " + columns)
    fanned.clear()
    out = refresh.refresh_aggregates(key_partials(before), before, quiet)
    assert fanned == [] and out.exceptAll(key_partials(refresh.merge_primary(before, quiet)).select(*out.columns)).isEmpty()


def test_children_in_long_form(spark):
    events = [path_event(0, "IN_CREATE", 1, "/a", is_dir=True), *[path_event(i, "IN_CREATE", i + 1, f"/a/{i}") for i in range(1, 6)]]
    state, _ = changes(spark, events, "inotify")
    assert sorted(tuple(r) for r in namespace.state_children(state).collect()) == [("1", str(i)) for i in range(2, 7)]
    assert "children" not in namespace.state_snapshot(state, lists=False).columns


def test_a_long_log_passes_through_in_few_micro_batches(spark, tmp_path, monkeypatch):
    from inodeatlas.plans import written

    monkeypatch.setattr(written, "POLL_SIZE", 10)
    numbers = []
    plain = written.pass_through_stream
    monkeypatch.setattr(written, "pass_through_stream", lambda *a, **k: (lambda h: lambda b, n: (numbers.append(n), h(b, n)))(plain(*a, **k)))
    kinds = ("signup", "view", "click", "error", "purchase")
    rows = [(i, i % 7, kinds[i * i % 11 % 5], float(i), '{"k": %d}' % (i % 3)) for i in range(11_000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    told = written.stream_pass_through(spark, str(tmp_path))
    batches = run.poll_batches(written.gpfs_rows(spark.read.parquet(str(tmp_path / "events.parquet"))), 10)
    whole = reduction.reduce_events(batches, "inotify").select("batch_id", "slot", "eid", "event_type")
    told = sorted(tuple(r) for r in told.collect())
    assert told and told == sorted(tuple(r) for r in whole.collect())
    assert 1 < len(numbers) <= 25


@pytest.mark.parametrize("name", ["namespace_feed", "complete_keys"])
def test_long_streams_have_few_micro_batches(spark, monkeypatch, name):
    from pyspark.sql import streaming

    from inodeatlas.plans import streams

    started = []
    plain = streaming.DataStreamWriter.start
    monkeypatch.setattr(streaming.DataStreamWriter, "start", lambda *a, **k: started.append(plain(*a, **k)) or started[-1])
    monkeypatch.setattr(streams, "POLL_SIZE", 10)  # 1000 events, 6000 files
    monkeypatch.setattr(streams, "BATCH_POLLS", 2)
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    monkeypatch.setattr(streams, "MOST_BATCHES", 4)
    assert getattr(streams, name)(spark, "/root/testdata/sf0.001").count()
    assert 1 < len({p["batchId"] for p in started[0].recentProgress if p["numInputRows"]}) <= 5
