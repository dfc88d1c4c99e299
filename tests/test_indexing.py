"""A folder's index through its life: passes, queue, searches, another model."""

import os

from pyspark.sql import functions as F

from lodestone.operators import indexing as X
from lodestone.operators.chunking import chunks
from lodestone.operators.service import HistogramEmbedder
from lodestone.plans.index import as_files
from lodestone.sources import folder
from lodestone.sources.store import Store


def test_folder_index_through_its_life(spark, tmp_path):
    root, e = tmp_path / "folder", HistogramEmbedder(64)
    os.makedirs(root)
    texts = {"a.txt": "apples and pears " * 200, "b.txt": "rivers, mountains and valleys", "c.txt": "zzzz qqqq xxxx"}
    for p, t in texts.items():
        (root / p).write_text(t)
    folder.register(spark)
    files = folder.Folder(spark, str(root))
    s = Store(spark, str(tmp_path / "index"), buckets=4)
    first = X.index_pass(s, files, e)
    assert first == {"scanned": 3, "indexed": 3, "unchanged": 0, "deferred": 0, "chunks": 5, "vectors": 5, "changes": 3}
    assert s.read("chunk_vector").count() == 5 and s.read("outbox").count() == 3 and s.read("file_manifest").where("last_synced_hash = file_hash").count() == 3
    assert X.index_pass(s, files, e) == {"scanned": 3, "indexed": 0, "unchanged": 3, "deferred": 0, "chunks": 0, "vectors": 0, "changes": 0}

    q = spark.createDataFrame([(1, "rivers and mountains"), (2, "zzzz xxxx")], "query_id long, query string")
    best = {r.query_id: (r.path, r.text) for r in X.search(s, files, q, e).where("place = 1").collect()}
    assert best == {1: ("b.txt", texts["b.txt"]), 2: ("c.txt", texts["c.txt"])}
    assert {r.query_id: r.path for r in X.find_files(s, files, q, e).where("rank = 1").collect()} == {1: "b.txt", 2: "c.txt"}

    done = X.deliver_due(s, files, e)
    assert done == {"done": 3, "retried": 0, "failed": 0} and s.read("chunk_vector").count() == 5

    (root / "b.txt").write_text("deserts and oceans")
    os.remove(root / "c.txt")
    (root / "a.txt").write_text("apples and pears " * 20)
    (root / "d.txt").write_text("a new file")
    assert {r.path for r in X.search(s, files, q, e).collect()} == set()
    skipped = spark.createDataFrame([("c.txt",)], "path string")
    assert X.index_pass(s, files, e, skipped)["changes"] == 3
    assert s.read("chunk_manifest").groupBy().agg(F.count("*"), F.countDistinct("chunk_id")).first() == (4, 4)
    assert X.index_pass(s, files, e) == {"scanned": 3, "indexed": 0, "unchanged": 3, "deferred": 0, "chunks": 0, "vectors": 0, "changes": 1}
    assert s.read("file_manifest").where("status = 'deleted'").count() == 1 and s.read("chunk_vector").count() == 4
    assert X.deliver_due(s, files, e)["done"] == 4
    assert s.read("file_manifest").count() == 3 and s.read("chunk_vector").count() == 3 == s.read("chunk_manifest").count()
    assert X.deliver_due(s, files, e) == {"done": 0, "retried": 0, "failed": 0}
    assert sorted(r.id for r in s.read("outbox").collect()) == list(range(1, 8))

    other = HistogramEmbedder(32)
    assert X.index_pass(s, files, other)["indexed"] == 3 and s.models() == ["histogram-32", "histogram-64"]
    active = {r.model_version_id: r.is_active_for_write for r in s.read("embedding_model_registry").collect()}
    assert active == {"histogram-32": True, "histogram-64": False}
    before = s.read("chunk_vector").count()
    assert s.vacuum() > 0 and Store(spark, str(tmp_path / "index")).read("chunk_vector").count() == before and not os.listdir(tmp_path / "index" / "_stage")


def test_delivery_retries_what_is_not_as_recorded(spark, tmp_path):
    root, e = tmp_path / "folder", HistogramEmbedder(64)
    os.makedirs(root)
    (root / "a.txt").write_text("one")
    folder.register(spark)
    files = spark.read.format("folder").load(str(root))
    s = Store(spark, str(tmp_path / "index"), buckets=2)
    X.index_pass(s, files, e)
    s.commit({"file_manifest": (s.read("file_manifest").withColumns({"file_hash": F.lit("another"), "last_synced_hash": F.lit(None).cast("string")}), None)})
    assert X.deliver_due(s, files, e) == {"done": 0, "retried": 1, "failed": 0}
    row = s.read("outbox").first()
    assert row.attempts == 1 and row.status == 0 and row.error and row.next_attempt_utc > row.created_utc


def test_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "folder")
    folder.register(spark)
    s = Store(spark, str(tmp_path / "index"), buckets=2)
    files = spark.read.format("folder").load(str(tmp_path / "folder"))
    assert set(X.index_pass(s, files, HistogramEmbedder(8)).values()) == {0}
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert X.search(s, files, q, HistogramEmbedder(8)).count() == 0


def test_indexer_waits_retries_and_drains(spark, tmp_path):
    from lodestone.operators.service import READY, Hold, IndexState
    from lodestone.streaming.indexer import Indexer

    root = tmp_path / "folder"
    folder.register(spark)
    s, state, clock, hold = Store(spark, str(tmp_path / "index"), buckets=2), IndexState(), [0.0], Hold()
    x = Indexer(s, lambda: spark.read.format("folder").load(str(root)), HistogramEmbedder(8), state, hold, clock=lambda: clock[0], sleep=lambda seconds: clock.__setitem__(0, clock[0] + seconds))
    assert not x.tick() and state.error and state.state != READY  # there is no folder yet
    os.makedirs(root)
    (root / "a.txt").write_text("one two")
    assert not x.tick()  # the next try is not due
    clock[0] = 31.0
    assert x.tick() and state.state == READY and s.read("chunk_vector").count() == 1
    (root / "a.txt").write_text("three four")
    (root / "b.txt").write_text("five six")
    with hold:
        clock[0] = 400.0
        assert not x.tick()
    x.apply(spark.createDataFrame([("b.txt", "Created")], "path string, kind string"), 0)
    assert s.read("chunk_vector").count() == 2 and s.read("file_manifest").where("file_path = 'a.txt' and updated_utc = created_utc").count() <= 1
    assert x.drain() == 2 and s.read("outbox").where("status <> 2").count() == 0
    assert x.tick() and s.read("outbox").where("status = 0").count() == 1


def test_only_files_asked_for_are_opened(spark, tmp_path):
    root, e = tmp_path / "folder", HistogramEmbedder(64)
    os.makedirs(root / "sub")
    for i in range(30):
        (root / ("sub" if i % 2 else ".") / f"f{i:02d}.txt").write_text("".join(chr(97 + (i * 7 + j) % 26) * (1 + (i + j) % 5) + " " for j in range(40)))
    opened = spark.sparkContext.accumulator(0)
    files, s, seen = folder.Folder(spark, str(root), opened=opened), Store(spark, str(tmp_path / "index"), buckets=4), [0]

    def since():
        n, seen[0] = opened.value - seen[0], opened.value
        return n

    assert files.listing().count() == 30 and since() == 0
    X.index_pass(s, files, e)
    assert since() == 60  # for the hash, and to embed
    # Just written: a later write could have the same time, so all are read again.
    assert X.index_pass(s, files, e)["unchanged"] == 30 and since() == 30
    (root / "f04.txt").write_text("something else")
    only = spark.createDataFrame([("f04.txt",), ("gone.txt",)], "path string")
    assert X.index_pass(s, files, e, only=only)["indexed"] == 1 and since() == 2  # what isn't there is only looked for
    q = spark.createDataFrame([(1, (root / "f08.txt").read_text())], "query_id long, query string")
    found = X.search(s, files, q, e, results=1).collect()
    hits = X._hits(s, q, e, 4, X.DEFAULT)[0].select("path").distinct().count()
    assert found[0].path == "f08.txt" and since() <= hits <= 4
    assert X.find_files(s, files, q, e).where("rank = 1").first().path == "f08.txt" and since() == 0
    s.commit({"file_manifest": (s.read("file_manifest").where("file_path = 'f10.txt'").withColumn("last_synced_hash", F.lit(None).cast("string")), None)})
    X.deliver_due(s, files, e, most=100)
    assert since() == 1


def test_files_that_can_not_be_read_stay(spark, tmp_path, monkeypatch):
    root, e = tmp_path / "folder", HistogramEmbedder(8)
    os.makedirs(root)
    for n in "ab":
        (root / f"{n}.txt").write_text(n * 3)

    class Locked(folder.Folder):
        def read(self, paths=None):
            locked = F.col("path") == "b.txt"
            rows = super().read(paths)
            return rows.select("path", *[F.when(~locked, F.col(c)).alias(c) for c in ("length", "modified_utc", "created_utc", "hash", "text")], F.when(locked, folder.SKIPPED).otherwise(F.col("state")).alias("state"))

    s = Store(spark, str(tmp_path / "index"), buckets=2)
    assert X.index_pass(s, folder.Folder(spark, str(root)), e)["indexed"] == 2
    assert X.index_pass(s, Locked(spark, str(root)), e) == {"scanned": 1, "indexed": 0, "unchanged": 1, "deferred": 0, "chunks": 0, "vectors": 0, "changes": 0}
    os.remove(root / "b.txt")
    assert X.index_pass(s, folder.Folder(spark, str(root)), e)["changes"] == 1


def test_lookups_and_growth_of_a_store(spark, tmp_path):
    root, e = tmp_path / "folder", HistogramEmbedder(8)
    os.makedirs(root)
    for i in range(20):
        (root / f"{i}.txt").write_text(f"text {i}")
    s = Store(spark, str(tmp_path / "index"), buckets=8)
    X.index_pass(s, folder.Folder(spark, str(root)), e)
    row = X.lookup(s, "7.txt")
    assert [r.file_path for r in row.collect()] == ["7.txt"] and X.lookup(s, "x.txt").count() == 0
    assert len(row.inputFiles()) < len(s.read("file_manifest").inputFiles())
    before = {n: sorted(map(str, s.read(n).collect())) for n in ("file_manifest", "chunk_vector", "outbox")}
    assert s.grow(most=1) == 32 and Store(spark, str(tmp_path / "index")).buckets == 32
    assert before == {n: sorted(map(str, s.read(n).collect())) for n in before} and X.lookup(s, "7.txt").count() == 1
    assert X.index_pass(s, folder.Folder(spark, str(root)), e)["unchanged"] == 20 and s.models() == ["histogram-8"]


def test_latent_semantic_index(spark, tmp_path):
    import pytest

    from lodestone.operators.service import LsaEmbedder

    s = Store(spark, str(tmp_path / "index"), buckets=2)
    rows = [(f"{n}{i}.txt", t) for n, t in (("car", "the car drives on the road with an engine"), ("auto", "an automobile drives on the road with an engine"), ("bake", "bread and cake come out of the oven")) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc string, text string")
    e = LsaEmbedder.fitted(s, docs, 3)
    assert e.dimension <= 3 and s.fit(e.model_version_id) and s.fit("other") is None
    again = LsaEmbedder.loaded(s, e.model_version_id)
    assert again.model_version_id == e.model_version_id and again.model.include_trigrams
    with pytest.raises(LookupError):
        LsaEmbedder.loaded(s, "other")
    files = docs.select(F.col("doc").alias("path"), F.length("text").cast("long").alias("length"), F.current_timestamp().alias("modified_utc"), F.sha2("text", 256).alias("hash"), "text")
    assert X.index_pass(s, files, again)["indexed"] == 9
    q = spark.createDataFrame([(1, "car"), (2, "oven")], "query_id long, query string")
    top = {r.query_id: r.path for r in X.find_files(s, files, q, again).where("rank = 1").collect()}
    assert top[1].startswith(("car", "auto")) and top[2].startswith("bake")
    with pytest.raises(ValueError, match="rebuilt"):
        X.index_pass(s, files, type("Other", (HistogramEmbedder,), {"model_version_id": e.model_version_id})(5))


def test_search_notes(spark, tmp_path):
    from lodestone.config import Config

    root, e = tmp_path / "folder", HistogramEmbedder(64)
    os.makedirs(root)
    for n, t in {"a": "aaaa bbbb", "b": "aaaa bbbc", "c": "aaaa cccc", "d": "zzzz"}.items():
        (root / f"{n}.txt").write_text(t)
    files, s = folder.Folder(spark, str(root)), Store(spark, str(tmp_path / "index"), buckets=2)
    X.index_pass(s, files, e)
    (root / "b.txt").write_text("other")
    os.remove(root / "c.txt")
    q = spark.createDataFrame([(1, "aaaa bbbb"), (2, "~~~~")], "query_id long, query string")
    rows = {r.query_id: r for r in X.search_notes(s, files, q, e).collect()}
    assert (rows[1].ranked, rows[1].stale, rows[1].unavailable, rows[1].dropped, rows[1].selected, rows[1].below_floor, rows[1].truncated) == (4, 1, 1, 1, 1, False, False)
    low = X.search_notes(s, files, q, e, config=Config(floor=1.1)).where("query_id = 1").first()
    assert low.below_floor and low.selected == 0 and low.dropped == 0 and low.best > 0.99
    assert X.search(s, files, q, e, config=Config(floor=1.1)).count() == 0


def test_busy_files_wait_for_another_try(spark, tmp_path, monkeypatch):
    from lodestone.operators.service import READY, IndexState
    from lodestone.streaming.indexer import Indexer

    root = tmp_path / "folder"
    os.makedirs(root)
    (root / "a.txt").write_text("one")
    busy = {"b.txt"}

    class Watched(folder.Folder):
        def settled(self, paths, pause=0.0):
            return super().settled(paths, 0.0).withColumn("state", F.when(F.col("path").isin(*busy or [""]), "Busy").otherwise(F.col("state")))

    clock = [0.0]
    s, state = Store(spark, str(tmp_path / "index"), buckets=2), IndexState()
    x = Indexer(s, lambda: Watched(spark, str(root)), HistogramEmbedder(8), state, clock=lambda: clock[0], sleep=lambda seconds: clock.__setitem__(0, clock[0] + seconds))
    assert x.tick() and state.state == READY
    (root / "a.txt").write_text("two")
    (root / "b.txt").write_text("three")
    x.apply(spark.createDataFrame([("a.txt",), ("b.txt",), ("gone.txt",)], "path string"), 0)
    assert s.read("chunk_vector").count() == 1 and set(x.waiting) == {"b.txt"}
    assert x.again() == 1  # not due yet
    clock[0] += 1.0
    assert x.again() == 1 and x.waiting["b.txt"][1] == 2
    busy.clear()
    clock[0] += 1.0
    assert x.again() == 0 and s.read("chunk_vector").count() == 2
    busy.add("b.txt")
    (root / "b.txt").write_text("four")
    x.apply(spark.createDataFrame([("b.txt",)], "path string"), 1)
    for _ in range(4):
        clock[0] += 1.0
        x.again()
    assert not x.waiting and s.read("file_manifest").where("file_path = 'b.txt' and file_hash = sha2('four', 256)").count() == 0


def test_run_takes_in_a_stream_and_drains(spark, tmp_path):
    from lodestone.operators.service import IndexState
    from lodestone.sources.edits import Workspace
    from lodestone.streaming.debounce import Notifications
    from lodestone.streaming.indexer import Indexer

    root, told = tmp_path / "folder", Notifications(str(tmp_path / "told"))
    os.makedirs(root)
    (root / "a.txt").write_text("one")
    w = Workspace(str(root), told)
    w.create("early.txt", "before it runs")
    assert not os.listdir(told.root)
    told.running = True
    s = Store(spark, str(tmp_path / "index"), buckets=2)
    x = Indexer(s, lambda: folder.Folder(spark, str(root)), HistogramEmbedder(8), IndexState(), every=1e9)
    rounds = []

    def stopped():
        rounds.append(1)
        if len(rounds) == 2:
            w.create("b.txt", "two")
        return len(rounds) > 2

    x.run(stopped, pause=0.0, changes=told.stream(spark).select("path"), checkpoint=str(tmp_path / "cp"))
    assert sorted(r.file_path for r in s.read("file_manifest").collect()) == ["a.txt", "b.txt", "early.txt"]
    assert s.read("outbox").where("status <> 2").count() == 0


def test_a_pass_over_what_has_not_changed_opens_nothing(spark, tmp_path):
    """Files of recorded length and time aren't read; one of another length, another time or in a changed directory only is, or none."""
    root, e = tmp_path / "folder", HistogramEmbedder(16)
    for i in range(24):
        at = root / f"d{i % 4}" / f"e{i % 3}"
        os.makedirs(at, exist_ok=True)
        (at / f"f{i:02d}.txt").write_text(f"text number {i} " * 9)
        os.utime(at / f"f{i:02d}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    opened = spark.sparkContext.accumulator(0)
    files, s = folder.Folder(spark, str(root), opened=opened), Store(spark, str(tmp_path / "index"), buckets=8)
    assert X.index_pass(s, files, e)["indexed"] == 24 and opened.value == 48
    quiet = {"scanned": 24, "indexed": 0, "unchanged": 24, "deferred": 0, "chunks": 0, "vectors": 0, "changes": 0}
    assert X.index_pass(s, files, e) == quiet and opened.value == 48
    # The same length, another text and time; a new file beside others; one that is gone.
    (root / "d0" / "e0" / "f00.txt").write_text("TEXT number 0 " * 9)
    (root / "d1" / "e1" / "new.txt").write_text("a new one")
    os.remove(root / "d2" / "e2" / "f02.txt")
    assert X.index_pass(s, files, e) == {"scanned": 24, "indexed": 2, "unchanged": 22, "deferred": 0, "chunks": 2, "vectors": 2, "changes": 3} and opened.value == 52
    # A write that keeps length and time is only seen by a full pass.
    (root / "d3" / "e0" / "f03.txt").write_text("text NUMBER 3 " * 9)
    os.utime(root / "d3" / "e0" / "f03.txt", (1_700_000_003, 1_700_000_003))
    assert X.index_pass(s, files, e)["changes"] == 0
    assert X.index_pass(s, files, e, full=True)["changes"] == 1
    # Another model: every file is embedded, though no directory has changed.
    assert X.index_pass(s, files, HistogramEmbedder(8))["indexed"] == 24


def test_a_change_of_one_path_reads_one_bucket(spark, tmp_path):
    e, s = HistogramEmbedder(8), Store(spark, str(tmp_path / "index"), buckets=16)
    rows = spark.range(1000).selectExpr("concat('a/f', id, '.txt') path", "20L length", "timestamp'2024-01-01' modified_utc", "sha2(concat('words of file ', id), 256) hash", "concat('words of file ', id) text")
    X.index_pass(s, rows, e)
    s.trace = []
    only = spark.createDataFrame([("a/f7.txt",)], "path string")
    changed = rows.where("path = 'a/f7.txt'").withColumns({"text": F.lit("other words"), "hash": F.sha2(F.lit("other words"), 256)})
    assert X.index_pass(s, changed, e, only=only)["changes"] == 1
    large = [(n, b) for n, b in s.trace if n in ("file_manifest", "chunk_manifest", "chunk_vector", "outbox")]
    assert large and all(b <= 1 for _, b in large) and {n for n, _ in large} == {"file_manifest", "chunk_manifest", "chunk_vector"}
    # Of the bucket's rows, those of the key alone come out of the scan.
    key = spark.createDataFrame([("a/f7.txt",)], "p string").select(X.file_id(F.col("p")).alias("file_id"))
    found = s.read("file_manifest", key)
    assert found.count() == 1 and len(found.inputFiles()) <= 2 and "PushedFilters: [In(file_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "EqualTo(file_id" in plan
    s.trace = []
    X.deliver_due(s, changed, e, most=1)
    assert max(b for n, b in s.trace if n != "outbox") <= 1


def test_operations_behind_a_failure_wait(spark, tmp_path):
    """A path's second operation isn't done before its first; another path's is."""
    e, s = HistogramEmbedder(8), Store(spark, str(tmp_path / "index"), buckets=2)
    rows = spark.createDataFrame([("a.txt", 3, "h1", "one"), ("b.txt", 3, "h2", "two")], "path string, length long, hash string, text string").withColumn("modified_utc", F.lit("2024-01-01").cast("timestamp"))
    X.index_pass(s, rows, e)
    first = s.read("outbox")
    again = first.withColumn("id", F.col("id") + 10)
    # a.txt is recorded with another hash than it has, so it fails; b.txt waits for its delivery and is as recorded.
    manifest = s.read("file_manifest").withColumns({"file_hash": F.when(F.col("file_path") == "a.txt", "other").otherwise(F.col("file_hash")), "last_synced_hash": F.lit(None).cast("string")})
    s.commit({"outbox": (again, None), "file_manifest": (manifest, None)})
    assert X.deliver_due(s, rows, e) == {"done": 2, "retried": 1, "failed": 0}
    state = {(r.file_path, r.id): (r.status, r.attempts) for r in s.read("outbox").collect()}
    assert state == {("a.txt", 1): (0, 1), ("a.txt", 11): (0, 0), ("b.txt", 2): (2, 0), ("b.txt", 12): (2, 0)}
    # Nor is it claimed while the first waits for its next try.
    s.commit({"outbox": (s.read("outbox").where("id = 1").withColumn("next_attempt_utc", F.lit("2200-01-01").cast("timestamp")), None)})
    assert X.deliver_due(s, rows, e) == {"done": 0, "retried": 0, "failed": 0}


def test_a_search_by_cells_equals_the_scan(spark, tmp_path):
    e, s = HistogramEmbedder(16), Store(spark, str(tmp_path / "index"), buckets=2)
    rows = spark.range(200).selectExpr("concat('f', id, '.txt') path", "10L length", "timestamp'2024-01-01' modified_utc", "repeat(concat(char(97 + id % 26), char(97 + id % 7), ' '), int(3 + id % 50)) text").withColumn("hash", F.sha2("text", 256))
    X.index_pass(s, rows, e)
    index = X.vector_index(s, e, cells=12)
    q = rows.where("path in ('f3.txt', 'f40.txt')").selectExpr("path query_id", "text query")
    by_scan, by_cells = (sorted(map(tuple, X.search(s, rows, q, e, index=i).select("query_id", "place", "path", "score").collect())) for i in (None, index))
    assert by_cells == by_scan and by_scan
    assert X.bring_up_to_date(s, e, index) == 0
    notes = {r.query_id: r for r in X.search_notes(s, rows, q, e, index=index).collect()}
    assert notes["f3.txt"].ranked == 20 and notes["f3.txt"].selected == len([r for r in by_scan if r[0] == "f3.txt"])


def test_busy_files_wait_through_a_restart(spark, tmp_path):
    from lodestone.operators.service import IndexState
    from lodestone.streaming.indexer import Indexer

    s, made = Store(spark, str(tmp_path / "index"), buckets=2), []
    for _ in range(2):
        made.append(Indexer(s, lambda: None, HistogramEmbedder(8), IndexState(), clock=lambda: 7.0))
        made[-1].start()
        if len(made) == 1:
            made[0].waiting["b.txt"] = (9.0, 2)
            made[0]._keep()
    assert made[1].waiting == {"b.txt": (7.0, 2)}
    made[1].waiting.clear()
    made[1]._keep()
    assert s.noted("waiting") == {}


def test_only_texts_that_are_asked_for_are_cut(spark):
    """A pass tells files from blank texts without cutting them into tokens, and cuts those to embed alone: no condition on a scan, which all texts meet, has tokens."""
    rows = spark.createDataFrame([("a.txt", "one two"), ("b.txt", " \u2003\n"), ("c.txt", ""), ("d.txt", None), ("e.txt", "\u3000three")], "path string, text string")
    files = folder.Frame(as_files(rows))
    wanted = spark.createDataFrame([("a.txt",), ("b.txt",)], "path string")
    assert sorted(r.path for r in files.listing().collect()) == ["a.txt", "e.txt"]
    cut = chunks(files.read(wanted))
    assert [(r.path, r.content) for r in cut.collect()] == [("a.txt", "one two")]
    assert [(r.path, r.content) for r in chunks(rows.orderBy("path")).collect()] == [("a.txt", "one two"), ("e.txt", "three")]
    for df in (files.listing(), cut):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan and not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract_all" in x]


def test_files_with_hashes_are_asked_for_by_them(spark):
    """What has another hash by now is left out where the texts are picked, so that windows and vectors aren't shuffled to compare it."""
    rows = spark.createDataFrame([("a.txt", "one two"), ("b.txt", "three")], "path string, text string")
    files = folder.Frame(as_files(rows))
    listed = files.listing().select("path", F.when(F.col("path") == "b.txt", "old").otherwise(F.col("hash")).alias("hash"))
    assert [r.path for r in files.read(listed).collect()] == ["a.txt"]
    assert sorted(r.path for r in files.read(listed.select("path")).collect()) == ["a.txt", "b.txt"]
