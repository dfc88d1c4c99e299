import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conversations as V
from lodestone.operators import service as S
from lodestone.sources import folder
from lodestone.sources.store import SCHEMAS


def test_state_stays_ready_after_a_later_failure():
    s = S.IndexState()
    with pytest.raises(S.NotReady):
        s.ensure_queryable()
    s.failed("disk")
    with pytest.raises(S.NotReady, match="disk"):
        s.ensure_queryable()
    s.succeeded()
    s.failed("later")
    s.ensure_queryable()


def test_telemetry_classifies(spark):
    t = S.Telemetry()
    t.call("a", lambda: None)
    for error, status in ((S.NotReady("x"), "NotReady"), (TimeoutError(), "TimedOut"), (ValueError(), "Failed")):

        def fail(error=error):
            raise error

        with pytest.raises(type(error)):
            t.call("a", fail)
        assert t.points[-1][1] == status
    assert t.rows(spark).where("status = 'Success'").count() == 1


def test_external_embedder_validates(spark):
    df = spark.createDataFrame([("a",), ("bb",), (None,)], "t string")
    ok = S.ExternalEmbedder("m", 1, lambda ts: [[float(len(t))] for t in ts], "q: ", 2)
    assert [r[0][0] for r in df.select(ok.embed(F.col("t"))).collect()] == [1, 2, 0]
    assert [r[0][0] for r in df.select(ok.embed(F.col("t"), query=True)).collect()] == [4, 5, 3]
    with pytest.raises(Exception, match="width"):
        df.select(S.ExternalEmbedder("m", 2, lambda ts: [[1.0] for _ in ts]).embed(F.col("t"))).collect()


def test_profiles_are_not_replaced():
    profiles = {"histogram": S.HistogramEmbedder}
    assert S.choose(profiles, None, "histogram").model_version_id == "histogram-64"
    with pytest.raises(ValueError):
        S.choose(profiles, "other", "histogram")


def test_hold_and_its_last_release():
    now, told = [0.0], []
    h = S.Hold(10, lambda: now[0], lambda: told.append(now[0]))
    with h:
        with h:
            assert h.active
        assert h.active and not told
        now[0] = 11
        assert not h.active
    assert not h.active and told == [11]


def test_settling(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for f in (a, b):
        open(f, "w").close()
    grown = lambda _: open(b, "a").write("x") and None
    assert folder.settle([a, b, str(tmp_path / "c")], wait=grown) == ["Settled", "Busy", "Missing"]
    assert folder.settle([a], wait=lambda _: os.remove(a)) == ["Missing"]
    assert folder.settle([], wait=lambda _: None) == []


def test_telemetry_runs_the_search(spark):
    t = S.Telemetry()
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        t.call("a", lambda: broken)
    got = t.call("a", lambda: spark.range(3))
    assert got.count() == 3 and [p[1] for p in t.points] == ["Failed", "Success"] and t.points[1][2] > 0



def test_deadlines(spark):
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    with pytest.raises(TimeoutError):
        S.within(spark, 1.0, lambda: spark.range(4).select(slow("id")).collect())
    assert S.within(spark, 60.0, lambda: spark.range(4).count()) == 4
    with pytest.raises(ZeroDivisionError):
        S.within(spark, 60.0, lambda: 1 / 0)
    df = spark.createDataFrame([("a",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="longer than"):
        df.select(S.ExternalEmbedder("m", 1, lambda ts: time.sleep(3) or [[1.0]], deadline=0.2).embed(F.col("t"))).collect()


def test_embedding_telemetry(spark):
    t = S.EmbeddingTelemetry(spark)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string").repartition(2)
    df.select(S.ExternalEmbedder("m", 1, t.measured("m", lambda ts: [[1.0] for _ in ts]), batch=2).embed(F.col("t"))).collect()

    def late(ts):
        raise TimeoutError

    with pytest.raises(Exception):
        df.select(S.ExternalEmbedder("m", 1, t.measured("m", late)).embed(F.col("t"))).collect()
    rows = {r.status: r for r in t.rows().collect()}
    assert rows["Success"].texts == 3 and rows["Success"].calls >= 2 and rows["Success"].ms >= 0


@pytest.mark.parametrize(("url", "ok"), [("http://localhost:11434", True), ("http://127.0.0.9/", True), ("https://[::1]:8", True), ("http://10.0.0.1", False), ("http://example.org", False), ("ftp://localhost", False), ("http://localhost.example.org", False), ("http://localhost@example.org", False), ("", False)])
def test_models_on_this_machine_only(url, ok):
    if ok:
        assert S.loopback(url) == url
    else:
        with pytest.raises(ValueError):
            S.loopback(url)


def test_histogram_embedder_gives_unit_vectors(spark):
    e = S.HistogramEmbedder(8)
    rows = [r.v for r in spark.createDataFrame([("abca",), ("",), ("  ",), (None,)], "t string").select(e.embed(F.col("t")).alias("v")).collect()]
    assert sum(x * x for x in rows[0]) == pytest.approx(1) and all(set(r) == {0.0} for r in rows[1:])


def test_conversations(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    c, m = spark.createDataFrame([("x", None, None, 3)], SCHEMAS["conversation"]), spark.createDataFrame([("x", 1, "a", "{}", None), ("x", 2, "b", "{}", None)], SCHEMAS["message"])
    new = spark.createDataFrame([("x", 1, "a", "{}"), ("y", 2, "a", "{}"), ("x", 3, "b", "{}")], "conversation_id string, at long, agent_name string, message_json string")
    c, m = V.append(c, m, new, now)
    assert {r.conversation_id: r.next_seq for r in c.collect()} == {"x": 5, "y": 2}
    assert sorted((r.conversation_id, r.seq) for r in m.collect()) == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 1)]
    assert V.of_agent(m, "b").count() == 2
    c, m = V.delete("x", c, m)
    assert c.count() == 1 and m.count() == 1
    s = spark.createDataFrame([("a", "x", "1", None)], SCHEMAS["session_state"])
    assert [r.session_json for r in V.save_session(s, spark.createDataFrame([("a", "x", "2", None)], SCHEMAS["session_state"])).collect()] == ["2"]
