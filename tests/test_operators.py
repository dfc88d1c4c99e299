import json
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.operators import changes as C
from lodestone.operators import chunking, features
from lodestone.operators import retrieval as R
from lodestone.operators import tools as O


def test_chunks_cover_and_drop_covered_windows(spark):
    files = spark.createDataFrame([(str(n), " ".join(map(str, range(n)))) for n in (0, 1, 8, 9, 14, 15, 30)], "path string, text string")
    rows = chunking.chunks(files, Config(chunk_tokens=8, chunk_overlap=2)).collect()
    for n in (1, 8, 9, 14, 15, 30):
        spans = sorted((r.token_start, r.token_end) for r in rows if r.path == str(n))
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a == 8 for a, b in spans[:-1]) and all(y[0] - x[0] == 6 for x, y in zip(spans, spans[1:], strict=False))
        assert len(spans) == 1 or spans[-1][1] > spans[-2][1]
    assert not [r for r in rows if r.path == "0"]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        Config(chunk_tokens=8, chunk_overlap=8)


def test_knn_ties_zero_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, vector array<double>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in R.knn(v, q, 3).collect())
    assert got == [(i, k + 1, d, s) for i in range(5) for k, (d, s) in enumerate([(1, 1.0), (3, 1.0), (2, 0.0)])]
    with pytest.raises(ValueError):
        R.knn(v, q, 0)


def test_knn_equals_a_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(R, "ROW_BLOCK", 7)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(5)
    x, q = rng.integers(-2, 3, (150, 4)).astype(float), rng.integers(-2, 3, (11, 4)).astype(float)
    ids = [f"v{i:03d}" for i in rng.permutation(150)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "id string, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, vector array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(x) @ unit(q).T, 6) + 0.0
    for k, least in ((5, 0.0), (200, -1.0)):
        want = {(j, ids[i], r + 1) for j in range(11) for r, i in enumerate(sorted((i for i in range(150) if scores[i, j] >= least), key=lambda i: (-scores[i, j], ids[i]))[:k])}
        assert {(r.query_id, r.id, r["rank"]) for r in R.knn(v, asked, k, least).collect()} == want


def test_rerank_against_plain_version(spark):
    words = "red green blue cyan black white grey pink".split()
    rng = random.Random(1)
    rows = [(q, " ".join(rng.sample(words, 3)), i, round(rng.random(), 3), " ".join(rng.sample(words, 4)), rng.randint(1, 6)) for q in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, query string, id long, score double, text string, token_count long")
    got = {}
    for r in sorted(R.rerank(df, 5, 14).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(4):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2]))
        chosen, left, used = [], list(mine), 0
        while left and len(chosen) < 5:
            best = None
            for r in left:
                qs, ps = set(r[1].split()), set(r[4].split())
                rel = 0.7 * min(1, max(0, r[3])) + 0.3 * len(qs & ps) / len(qs)
                like = max((len(ps & set(c[4].split())) / len(ps | set(c[4].split())) for c in chosen), default=0.0)
                if best is None or 0.7 * rel - 0.3 * like > best[0] + 1e-12:
                    best = (0.7 * rel - 0.3 * like, r)
            left.remove(best[1])
            if not chosen or used + best[1][5] <= 14:
                chosen.append(best[1])
                used += best[1][5]
        assert got[q] == [c[2] for c in chosen]


def test_bags_equal_the_column_terms(spark):
    from lodestone.functions import text as T

    texts = ["readHTTP2Frame running boxes, glasses the the x 9", None, "", "ßtraße ÉTÉS 12ab naïve's", "  ", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(2)
    got = {r.doc: {b.term: b.tf for b in r.bag} for r in features.bags(df).collect()}
    assert got == {r.doc: dict(Counter(r.t)) for r in df.select("doc", T.index_terms(F.col("text")).alias("t")).collect()}
    with_trigrams = {r.doc: {b.term: b.tf for b in r.bag} for r in features.bags(df, True).collect()}
    marked = {r.doc: r.t for r in df.select("doc", F.flatten(F.transform(T.index_terms(F.col("text")), lambda w: T.trigrams(w))).alias("t")).collect()}
    assert with_trigrams == {d: dict(Counter(b) + Counter(marked[d])) for d, b in got.items()}


def test_lsa_equals_the_eigenvectors_of_the_whole_matrix(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    docs = [" ".join(rng.choices(words[t * 12 : t * 12 + 24], k=30)) for t in (0, 1, 2, 3) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc long, text string").repartition(3)
    model = features.fit_lsa(df, 4, include_trigrams=False)
    a = np.zeros((len(docs), len(model.terms)))
    for i, d in enumerate(docs):
        for t, n in Counter(features.stem_word(w) for w in d.split()).items():
            if t in model.terms:
                a[i, model.terms.index(t)] = (1 + np.log(n)) * model.idf[model.terms.index(t)]
    values, vectors = np.linalg.eigh(a.T @ a)
    want = vectors[:, np.argsort(values)[::-1][:4]]
    # The same space, whatever the signs.
    assert np.abs(np.abs((want * model.projection).sum(0)) - 1).max() < 1e-4


def test_lsa_brings_synonyms_together(spark):
    corpus = [f"the {w} {x}" for w in ("lorry", "truck") for x in ("drives along the motorway with cargo", "needs diesel and a driver", "parks near the warehouse gate")] + ["flour and yeast make dough", "the oven browns the dough", "yeast lifts flour overnight"]
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc long, text string")
    model = features.fit_lsa(docs, 2)
    again = features.LsaModel.from_json(json.loads(json.dumps(model.to_json())))
    words = spark.createDataFrame([("lorry",), ("truck",), ("dough",), ("unknownword",)], "text string")
    v = {r.text: np.array(r.v) for r in words.select("text", again.transform(F.col("text")).alias("v")).collect()}
    assert v["lorry"] @ v["truck"] > 0.9 > v["lorry"] @ v["dough"] and not v["unknownword"].any()
    assert np.abs(np.linalg.norm(v["lorry"]) - 1) < 1e-5
    with pytest.raises(ValueError):
        features.fit_lsa(docs.where("false"), 2)


@pytest.mark.parametrize(
    ("kinds", "want"),
    [("CD", None), ("CM", "Created"), ("DC", "Modified"), ("DM", "Deleted"), ("MD", "Deleted"), ("CDC", "Created"), ("CDM", "Modified"), ("MM", "Modified")],
)
def test_fold(spark, kinds, want):
    from lodestone.streaming.debounce import net

    names = {"C": "Created", "D": "Deleted", "M": "Modified"}
    events = [names[k] for k in kinds]
    assert spark.createDataFrame([(events,)], "k array<string>").select(C.fold_kinds(F.col("k"))).first()[0] == want
    state = ""
    for e in events:
        state = net(state, e)
    assert (state or None) == want


def test_debounce_gap_at_the_window_begins_anew(spark):
    rows = [(i, "a", "Modified", datetime.fromtimestamp(1_700_000_000 + ms / 1000)) for i, ms in enumerate((0, 749, 1499))]
    got = C.debounce(spark.createDataFrame(rows, "seq long, path string, kind string, ts timestamp"), 750_000).collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_bounded_keeps_the_first_and_stops(spark):
    hits = spark.createDataFrame([("b/x", 1, "y" * 10), ("a", 1, "z" * 90), ("b/c/x", 1, "w"), ("b/y", 1, "v" * 100)], "path string, line int, text string")
    assert [r.path for r in O.bounded(hits, 10, 50).orderBy("path").collect()] == ["a"]
    assert sorted(r.path for r in O.bounded(hits, 10, 100).collect()) == ["a", "b/x"]


def test_replace_lines_keeps_line_ends(spark):
    df = spark.createDataFrame([("a\r\nb\r\nc",)], "t string")
    assert df.select(O.replace_lines(F.col("t"), 2, 2, "x$1")).first()[0] == "a\r\nx$1\r\nc"
    assert df.select(O.replace_lines(F.col("t"), 3, 3, "x")).first()[0] == "a\r\nb\r\nx"
    with pytest.raises(Exception, match="1 to 3"):
        df.select(O.replace_lines(F.col("t"), 4, 4, "x")).collect()


def test_failures_end_in_failed(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ops = spark.createDataFrame([(1, 0, 0), (2, 0, 9)], "id long, status int, attempts int").withColumns({"next_attempt_utc": now, "error": F.lit(None).cast("string")})
    got = {r.id: r for r in C.fail(ops, now, F.lit("down")).collect()}
    assert (got[1].status, got[1].attempts) == (C.PENDING, 1) and (got[2].status, got[2].attempts) == (C.FAILED, 10)


def test_ranges_say_where_they_stop(spark):
    rows = [("a", "1\n22\n333\n"), ("b", ""), ("c", "one"), ("d", "x" * 30 + "\ny\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    notes = lambda *a, **k: {r.path: (r.total, r.returned, r.truncated, r.next_line, r.note) for r in O.read_notes(files, *a, **k).collect()}
    assert notes() == {"a": (3, 3, False, None, None), "b": (0, 0, False, None, "no lines"), "c": (1, 1, False, None, None), "d": (2, 2, False, None, None)}
    got = notes(1, None, 2, 30)
    assert got["a"] == (3, 2, True, 3, "stopped after 2 lines; line 3 of 3 is next") and got["d"] == (2, 1, True, 2, "stopped after 30 characters; line 2 of 2 is next")
    assert notes(2, 5)["a"][4] == "ends early, with line 3" and notes(4)["a"][4] == "4 is past the last line, 3"
    assert {r.path: r.version for r in O.read_notes(files).collect()} == {r.path: r.version for r in O.file_text(files).collect()}
    with pytest.raises(ValueError):
        O.read_notes(files, 3, 2)
    shown = {(r.path, r.line): r.text for r in O.read_lines(files, 1, None, 2, 30).collect()}
    assert Counter(p for p, _ in shown) == {"a": 2, "c": 1, "d": 1}


def test_history_and_transcripts(spark):
    c = spark.createDataFrame([("x", 3), ("a", 5), ("b", 5), ("z", 1)], "conversation_id string, updated long")
    m = spark.createDataFrame([("a",), ("a",), ("z",)], "conversation_id string")
    assert [tuple(r) for r in O.history(c, m, 2).orderBy("place").collect()] == [("a", 5, 2, 1, True), ("b", 5, 0, 2, True)]
    assert {r.truncated for r in O.history(c, m, 4).collect()} == {False} and O.history(c.where("false"), m).count() == 0
    rows = [('{"role": "assistant", "text": "", "tool_calls": [{"name": "f", "arguments": {"b": "2", "a": "1"}}, {"name": "g"}]}',), ('{"role": "tool", "tool_results": ["abcdef", null]}',), ("{broken",), ('{"text": "x"}',), (None,), ('{"role": "user", "text": "abcdef"}',)]
    got = [tuple(r.t) for r in spark.createDataFrame(rows, "j string").select(O.transcript(F.col("j"), 4).alias("t")).collect()]
    bad = ("unreadable", None, [], [], False)
    assert got == [("assistant", None, ["f(a=1,)", "g()"], [], False), ("tool", None, [], ["abcd", ""], False), bad, bad, bad, ("user", "abcd", [], [], True)]


def test_digests_tell_which_directories_differ(spark):
    from lodestone.operators import changes as C

    a = {"x.txt": "1", "d/a.txt": "1", "d/b.txt": "2", "d/e/c.txt": "3", "d/e/f/g.txt": "4", "h/i.txt": "5"}
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, sign string")
    changed = lambda b: {r.directory for r in C.changed_directories(df(a), df(b)).collect()}
    assert changed(a) == set()
    assert changed(a | {"d/e/c.txt": "9"}) == {"d/e"} and changed(a | {"d/e/f/n.txt": "1"}) == {"d/e/f"}
    # What two files have is exchanged, a file is moved, one is gone with its directory.
    assert changed(a | {"d/a.txt": "2", "d/b.txt": "1"}) == {"d"}
    assert changed({k: v for k, v in a.items() if k != "h/i.txt"}) == {"h"} and changed(a | {"y.txt": "1"}) == {""}
    trees = {r.directory: r for r in C.tree_digests(df(a)).collect()}
    other = {r.directory: r for r in C.tree_digests(df(a | {"d/e/f/g.txt": "0"})).collect()}
    assert {d for d in trees if trees[d].tree != other[d].tree} == {"", "d", "d/e", "d/e/f"} and {d for d in trees if trees[d].own != other[d].own} == {"d/e/f"}
    assert trees["d"].files == 4 and trees[""].files == 6


def test_a_path_stops_at_its_first_failure(spark):
    from lodestone.operators import changes as C

    rows = [(1, "a", 0, True), (2, "a", 1, False), (3, "a", 0, True), (4, "b", 0, True), (5, "b", 1, True), (6, "c", 0, None), (7, "c", 1, True)]
    out = C.stop_at_failures(spark.createDataFrame(rows, "id long, file_path string, op_type int, ok boolean"))
    assert {r.id: r.outcome for r in out.collect()} == {1: "done", 2: "failed", 3: "blocked", 4: "done", 5: "done", 6: "failed", 7: "blocked"}
    assert {(r.file_path, r.id, r.op_type) for r in C.delivered_state(out).collect()} == {("a", 1, 0), ("b", 5, 1)}


def test_texts_are_counted_in_slabs_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.functions.slabs import slabs

    texts = pa.array(["ab " * 50, None, "", "c" * 500, "de", "fg"])
    parts = [p.to_pylist() for p in slabs(texts, size=200)]
    assert sum(parts, []) == texts.to_pylist() and max(sum(len(t or "") for t in p) for p in parts if len(p) > 1) <= 200
    assert [len(p) for p in slabs(texts, rows=4, size=1 << 20)] == [4, 2]
    # Both ways to the terms take a batch apart.
    sizes, whole = [], features.counted

    def counted(part, include_trigrams):
        sizes.append(sum(len(t) for t in part.to_pylist()))
        return whole(part, include_trigrams)

    monkeypatch.setattr(features, "counted", counted)
    monkeypatch.setattr(features, "arrow_udf", lambda kind: lambda run: lambda text: run)
    monkeypatch.setattr(features, "cut_words", lambda text: text)
    big = pa.array(["word two " * 20_000] * 20)
    model = features.LsaModel(["two"], np.ones(1, np.float32), np.ones((1, 1), np.float32))
    assert len(pa.concat_arrays(model.transform(None)(iter([big])))) == 20
    assert len(sizes) == 4 and max(sizes) <= 1 << 20


def test_word_terms_as_a_column_equal_those_of_each_word():
    import pyarrow as pa

    words = ["", "a", "The", "HTTP", "readHTTP2Frame", "boxes", "glasses", "runnING", "ing", "strings", "ßtraßes", "ÉTÉS", "naïves", "x9", "日本語s", "İstanbuls", "withed"]
    of, terms = features.words_terms(pa.array(words))
    got = [[t for i, t in zip(of.tolist(), terms.to_pylist(), strict=True) if i == k] for k in range(len(words))]
    assert got == [features.word_terms(w) for w in words]


def test_document_frequencies_count_documents_under_the_null_term(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["one two two", "two three", None, "", "one five", "five six"] * 5)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    want = {r.term: r.df for r in features.document_frequency(features.term_rows(df, True)).collect()}
    monkeypatch.setattr(features, "HELD_TERMS", 3)
    assert {r.term: r.df for r in features.document_frequencies(df, True).collect()} == want | {None: 30}


def test_enqueue_numbers_follow_paths_wherever_ranges_are_cut(spark):
    # Counting a range's rows reads fewer columns than numbering them, and joins other ranges by size.
    changes = spark.range(60_000).repartition(7).select(F.concat(F.lit("p"), F.format_string("%06d", "id")).alias("path"), F.repeat(F.col("id").cast("string"), 20).alias("change"))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = C.enqueue(changes, 1000, F.current_timestamp()).select("id", "file_path", "op_type").collect()
        assert sorted((r.id, r.file_path) for r in got) == [(1000 + i, f"p{i:06d}") for i in range(60_000)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_topic_corpus_names_are_those_of_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from lodestone.operators.corpus import topic_corpus

    rows = spark.createDataFrame([(i,) for i in (0, 7, 150_000, 399_999, 2_000_003, 2_000_004)], "doc_id long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["topic_corpus"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(entry.oracle_sql()["topic_corpus"]).fetchall())
    assert topic_corpus(rows.withColumnRenamed("doc_id", "id")).where(r"path rlike '-[0-9]{5,}\\.txt$'").count() == 4


def test_sorted_terms_equal_the_column_terms(spark):
    from lodestone.functions import text as T

    texts = ["readHTTP2Frame running boxes, glasses the the x 9", None, "", "ßtraße ÉTÉS 12ab naïve's zz 日本語", "  ", "a b c", "two two one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(2)
    got = {r.doc: tuple(r.s) for r in df.select("doc", features.sorted_terms(F.col("text")).alias("s")).collect()}
    want = {r.doc: (len(set(r.t)), len(r.t), " ".join(sorted(set(r.t)))) for r in df.select("doc", T.index_terms(F.col("text")).alias("t")).collect()}
    assert got == want


def test_histograms_count_slabs_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from lodestone.functions import vector as V

    sizes, whole = [], V._counts

    def counts(texts, dim, blank):
        sizes.append(sum(len(t) for t in texts.to_pylist()))
        return whole(texts, dim, blank)

    monkeypatch.setattr(V, "_counts", counts)
    monkeypatch.setattr(V, "arrow_udf", lambda kind: lambda run: lambda text: run)
    texts = pa.array(["abc " * 100_000] * 6)
    for f in (V.histogram, V.unit_histogram):
        assert len(pa.concat_arrays(f(None)(iter([texts])))) == 6
    assert len(sizes) == 6 and max(sizes) <= 1 << 20
