import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.sources import folder
from lodestone.sources.store import SCHEMAS, Store, guard, read_text_file, write_atomically


def test_folder_batch(spark, tmp_path):
    for name, data in {"a.txt": b"\xef\xbb\xbfhello", ".hidden.md": b"x", "bin/no.txt": b"x", "sub/b.py": b"pass", "blank.txt": b"  ", "pic.png": b"x", "u.txt": "ü".encode("utf-16")}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    folder.register(spark)
    got = {r.path: r.text for r in spark.read.format("folder").option("filesPerPartition", "2").load(str(tmp_path)).collect()}
    assert got == {"a.txt": "hello", ".hidden.md": "x", "sub/b.py": "pass", "u.txt": "ü"}
    with pytest.raises(Exception):
        spark.read.format("folder").load(str(tmp_path / "missing")).collect()


def test_formats_refuse_a_second_claim():
    f = folder.plain_formats()
    assert f.find("A.TXT") and not f.find("a.png")
    with pytest.raises(ValueError):
        f.register((".TXT",), None)
    with pytest.raises(ValueError):
        f.register(("txt",), None)


def test_store_commits_together(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    assert s.read("chunk_vector").count() == 0 and s.models() == []
    v = spark.createDataFrame([("c1", "m1", [1.0], 1, None), ("c2", "m2", [2.0], 1, None)], SCHEMAS["chunk_vector"])
    o = spark.createDataFrame([(1, "p", 0, 0, 0, None, None, None)], SCHEMAS["outbox"])
    s.commit(chunk_vector=v, outbox=o)
    assert s.models() == ["m1", "m2"] and [r.chunk_id for r in s.vectors("m2").collect()] == ["c2"] and s.vectors("none").count() == 0 and s.read("outbox").count() == 1


def test_guard_and_files(tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert guard(str(tmp_path), "x.txt") == str(tmp_path / "x.txt")
    os.symlink(tmp_path / "x.txt", tmp_path / "link.txt")
    for bad in ("", "../y", ".lodestone/db", "link.txt"):
        with pytest.raises(ValueError):
            guard(str(tmp_path), bad)
    os.mkfifo(tmp_path / "pipe.txt")
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/one.txt").write_text("1")
    os.link(tmp_path / "in/one.txt", tmp_path / "in/two.txt")
    os.link(tmp_path / "x.txt", tmp_path / "in/three.txt")
    for bad in ("NUL", "in/com1.txt", "aux.md", "pipe.txt", ".LODESTONE/x", "in/.Lodestone"):
        with pytest.raises(ValueError):
            guard(str(tmp_path), bad)
    assert guard(str(tmp_path), "in/two.txt") and guard(str(tmp_path / "in"), "one.txt")
    with pytest.raises(ValueError, match="another name"):
        guard(str(tmp_path / "in"), "three.txt")
    write_atomically(str(tmp_path / "n.bin"), b"a\0b")
    with pytest.raises(ValueError):
        read_text_file(str(tmp_path / "n.bin"))
    with pytest.raises(ValueError):
        read_text_file(str(tmp_path))


def test_streaming_debounce_and_delivery(spark, tmp_path):
    from lodestone.streaming.debounce import debounced

    src, t0 = str(tmp_path / "events"), datetime(2024, 1, 1)
    kind = "seq long, path string, kind string, ts timestamp"
    rows = [(1, "a", "Created", 0), (2, "a", "Modified", 300), (3, "b", "Created", 0), (4, "b", "Deleted", 100), (5, "c", "Deleted", 0), (6, "c", "Created", 200), (7, "end", "Modified", 60_000), (8, "end2", "Modified", 120_000)]
    spark.createDataFrame([(s, p, k, t0 + timedelta(milliseconds=ms)) for s, p, k, ms in rows[:6]], kind).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(s, p, k, t0 + timedelta(milliseconds=ms)) for s, p, k, ms in rows[6:]], kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = debounced(stream, 750).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.path: (r.kind, r.n) for r in spark.table("settled").collect()}
    assert got.get("a") == ("Created", 2) and got.get("c") == ("Modified", 2) and "b" not in got


def test_delivery_reads_the_disk_and_writes_only_changes(spark):
    from lodestone.streaming.debounce import deliver

    manifest = spark.createDataFrame([("a", "h1", 1, "active", None, "h1", None), ("b", "h2", 1, "active", None, None, None)], "path string, hash string, size long, status string, created long, last_synced_hash string, updated timestamp")
    disk = spark.createDataFrame([("a", "h1", 1, None), ("c", "h3", 1, None)], "path string, hash string, size long, created long")
    calls = []
    run = deliver(lambda: manifest, lambda: disk, lambda m, c: calls.append(({r.path: r.status for r in m.collect()}, {r.path: r.change for r in c.collect()})))
    run(spark.createDataFrame([("a",)], "path string"), 0)
    assert not calls
    run(spark.createDataFrame([("b",), ("c",)], "path string").withColumn("x", F.lit(1)), 1)
    assert calls == [({"a": "active", "b": "deleted", "c": "active"}, {"b": "Removed", "c": "Added"})]


def test_the_clock_settles_and_what_is_pending_can_be_read(spark, tmp_path):
    from lodestone.streaming.debounce import debounced, pending

    src, kind = str(tmp_path / "events"), "seq long, path string, kind string, ts timestamp"
    t0 = datetime(2024, 1, 1)
    rows = [(1, "a", "Created", t0), (2, "a", "Modified", t0), (3, "b", "Created", t0), (4, "b", "Deleted", t0), (5, "c", "Deleted", t0)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(kind).parquet(src)
    q = debounced(stream(), 600_000, by_clock=True).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "cp1")).start()
    try:
        while not q.lastProgress or not q.lastProgress["stateOperators"] or q.lastProgress["stateOperators"][0]["numRowsTotal"] < 3:
            time.sleep(0.2)
    finally:
        q.stop()
    assert spark.table("held").count() == 0
    assert {r.path: (r.kind, r.n) for r in pending(spark, str(tmp_path / "cp1")).collect()} == {"a": ("Created", 2), "c": ("Deleted", 1)}
    q = debounced(stream(), 100, by_clock=True).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        end = time.monotonic() + 90
        while spark.table("quiet").count() < 2 and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert {r.path: (r.kind, r.n) for r in spark.table("quiet").collect()} == {"a": ("Created", 2), "c": ("Deleted", 1)}
    assert pending(spark, str(tmp_path / "cp2")).count() == 0


def test_change_stream_of_a_folder(spark, tmp_path):
    root, state = tmp_path / "folder", tmp_path / "state"
    os.makedirs(root)
    (root / "a.txt").write_text("1")
    (root / "b.txt").write_text("1")
    folder.register(spark)

    def changes():
        stream = spark.readStream.format("folder").option("as", "changes").option("state", str(state)).load(str(root))
        got = []
        q = stream.writeStream.foreachBatch(lambda df, _: got.extend((r.path, r.kind) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(got)

    assert changes() == [("a.txt", "Created"), ("b.txt", "Created")]
    os.remove(root / "a.txt")
    (root / "b.txt").write_text("22")
    (root / "c.txt").write_text("3")
    assert changes() == [("a.txt", "Deleted"), ("b.txt", "Modified"), ("c.txt", "Created")]
    assert changes() == []
    assert max(len(open(f, encoding="utf-8").read()) for f in (tmp_path / "cp/offsets").glob("[0-9]*")) < 1000


def test_children_and_listing(spark, tmp_path):
    from lodestone.operators import tools as O

    os.makedirs(tmp_path / "docs/deep")
    os.makedirs(tmp_path / "docs/.lodestone")
    (tmp_path / "docs/b.txt").write_text("12345")
    (tmp_path / "docs/deep/c.txt").write_text("1")
    os.symlink(tmp_path / "docs/b.txt", tmp_path / "docs/link.txt")
    f = folder.Folder(spark, str(tmp_path))
    rows = f.children("docs")
    assert {(r.path, r.is_directory, r.size, r.link) for r in rows.where("path not like '%lodestone'").collect()} == {("docs/b.txt", False, 5, False), ("docs/deep", True, None, False), ("docs/link.txt", False, len(str(tmp_path / "docs/b.txt")), True)}
    assert [r.name for r in O.inspect_directory(rows, "docs").collect()] == ["b.txt", "deep"]
    assert tuple(O.directory_notes(rows, "docs").first()) == (2, 1, False)
    with pytest.raises(ValueError):
        f.children("../x")
    listed = {r.path: (r.length, r.created_utc <= r.modified_utc) for r in f.listing().collect()}
    assert listed == {"docs/b.txt": (5, True), "docs/deep/c.txt": (1, True)}
    assert folder.Folder(spark, str(tmp_path / "docs/deep")).there(spark.createDataFrame([("c.txt", 1), ("x.txt", 2)], "path string, n long")).collect() == [("c.txt", 1)]
    assert spark.read.format("folder").option("as", "listing").load(str(tmp_path)).count() == 2


def test_executors_list_what_a_walk_finds(spark, tmp_path):
    from lodestone.sources import folder

    for p in ["a.txt", "b.bin", "d/a.md", "d/e/f/g/h/i.txt", "d/e/x.txt", "node_modules/n.txt", "d/.git/c.txt", "empty/z/y.jpg", "ü/ß.txt"]:
        os.makedirs((tmp_path / "t" / p).parent, exist_ok=True)
        (tmp_path / "t" / p).write_text(p)
    (tmp_path / "t" / "big.txt").write_text("x" * 50)
    os.symlink(tmp_path / "t" / "a.txt", tmp_path / "t" / "link.txt")
    files = folder.Folder(spark, str(tmp_path / "t"), max_bytes=40)
    want = {p: (s.st_size, s.st_mtime) for p, s in folder.walk(files.root, 40)}
    got = {r.path: (r.length, r.modified_utc) for r in files.listing().collect()}
    assert got.keys() == want.keys() == {"a.txt", "d/a.md", "d/e/f/g/h/i.txt", "d/e/x.txt", "ü/ß.txt"} and all(got[p][0] == want[p][0] for p in want)
    asked = files.listing(spark.createDataFrame([(p,) for p in ["a.txt", "big.txt", "b.bin", "gone.txt", "d", "link.txt"]], "path string"))
    assert {(r.path, r.length, r.modified_utc) for r in asked.collect()} == {("a.txt", *got["a.txt"])}
    with pytest.raises(OSError):
        folder.Folder(spark, str(tmp_path / "nowhere")).listing()


def test_polls_give_each_change_once(spark, tmp_path):
    from lodestone.sources import folder

    root = tmp_path / "t"
    os.makedirs(root / "d")
    for p in ("a.txt", "d/b.txt", "c.txt"):
        (root / p).write_text(p)
    watch = folder.Watch(folder.Folder(spark, str(root)), str(tmp_path / "state"))
    seen = lambda found: {(r.path, r.kind) for r in found.collect()}
    n, first = watch.poll()
    assert (n, seen(first)) == (1, {("a.txt", "Created"), ("d/b.txt", "Created"), ("c.txt", "Created")})
    assert watch.poll()[0] == 1  # not taken in: the same again
    watch.done(1)
    (root / "a.txt").write_text("longer than before")
    os.remove(root / "c.txt")
    (root / "d" / "new.txt").write_text("new")
    n, second = watch.poll()
    assert (n, seen(second)) == (2, {("a.txt", "Modified"), ("c.txt", "Deleted"), ("d/new.txt", "Created")})
    watch.done(2)
    # Another process goes on where this one ended.
    again = folder.Watch(watch.folder, str(tmp_path / "state"))
    assert again.last() == 2 and again.poll()[1].count() == 0 and sorted(x for x in os.listdir(tmp_path / "state") if not x.startswith(".")) == ["done-2", "listing-2", "listing-3"]
    got = []
    (root / "e.txt").write_text("e")
    q = again.run(lambda changes, number: got.append((number, seen(changes))), str(tmp_path / "cp"), "1 second")
    try:
        end = time.monotonic() + 90
        while not got and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert got[0] == (3, {("e.txt", "Created")})


def test_holds_survive_a_restart_and_the_last_release_publishes(spark, tmp_path):
    from lodestone.streaming.debounce import HOLD, RELEASE, gated

    kind, src, t0 = "seq long, path string, kind string, ts timestamp", str(tmp_path / "events"), datetime(2024, 1, 1)

    def told(*events):
        spark.createDataFrame([(s, p, k, t0 + timedelta(seconds=s)) for s, p, k in events], kind).coalesce(1).write.mode("append").parquet(src)

    def run(new, most_ms=600_000, wait=0):
        """A run of the stream until it has read `new` events and given `wait` rows."""
        got = []
        take = lambda batch, epoch: got.extend((r.path, r.kind, r.n) for r in batch.collect())
        q = gated(spark.readStream.schema(kind).parquet(src), most_ms, shards=3).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"cp{most_ms}")).start()
        try:
            end = time.monotonic() + 90
            while (sum(p["numInputRows"] for p in q.recentProgress) < new or len(got) < wait) and time.monotonic() < end:
                time.sleep(0.1)
        finally:
            q.stop()
        return set(got)

    told((1, "a", "Created"), (2, None, HOLD), (3, "b", "Created"), (4, "b", "Modified"), (5, None, HOLD), (6, "c", "Created"), (7, "c", "Deleted"), (8, "d", "Modified"), (9, None, RELEASE))
    assert run(9) == {("a", "Created", 1)}
    # Another run of the stream: one hold is left, and what it holds back is still there.
    told((10, "d", "Deleted"), (11, "e", "Created"))
    assert run(2) == set()
    told((12, None, RELEASE), (13, "f", "Created"))
    assert run(2) == {("b", "Created", 2), ("d", "Deleted", 2), ("e", "Created", 1), ("f", "Created", 1)}
    # Nobody releases: the hold ends by itself.
    told((14, None, HOLD), (15, "g", "Created"))
    assert ("g", "Created", 1) in run(15, 1500, wait=6)


def test_tasks_of_a_made_corpus_have_so_many_files_whatever_the_scan_has(spark, tmp_path, monkeypatch):
    from lodestone.plans import registry, retrieval
    from lodestone.sources.tables import dealt

    cores = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(0, 10, 1, 1), 50).rdd.getNumPartitions() == cores
    sizes = [n for n in dealt(spark.range(0, 10_000, 1, 1), 500).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
    assert sum(sizes) == 10_000 and max(sizes) <= 1000 and len(sizes) >= 20
    spark.range(0, 1000, 1, 1).selectExpr("id doc_id", "'' text").write.parquet(f"{tmp_path}/documents.parquet")
    parts, real = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 20)
    assert {r.embedder for r in registry.QUERIES["topic_quality"](spark, str(tmp_path)).collect()} == {"histogram", "lsa"} and parts[0] >= 50
