"""Queries of the change engine: snapshots, bursts, the manifest and the delivery queue.

The disk holds all documents. The record holds the labelled ones, those of quality 0 with another
hash, and pages, which are gone from disk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..operators import changes as C
from ..operators import chunking
from ..sources.tables import change_events, files, outbox, read
from .base import CHUNKS, FILES, query

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_SNAPSHOTS = f"""{FILES}, disk AS (SELECT path, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(2 AS BIGINT) AS created FROM f),
rec AS (SELECT path, CASE WHEN quality = 0 THEN 'old' ELSE sha256(text) END AS hash, CAST(1 AS BIGINT) AS created, toxic FROM f JOIN labels USING (doc_id) UNION ALL SELECT 'pages/' || page_id || '.html', sha256(html), 1, 0 FROM pages),
skip AS (SELECT 'pages/' || page_id || '.html' AS path FROM pages WHERE starts_with(url, 'http://')),
diff AS (SELECT coalesce(d.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'Added' WHEN d.path IS NULL THEN 'Removed' ELSE 'Modified' END AS change, d.hash, d.size, CASE WHEN d.path IS NULL THEN NULL ELSE coalesce(r.created, d.created) END AS created
  FROM disk d FULL JOIN rec r ON d.path = r.path WHERE (d.hash IS NULL OR r.hash IS NULL OR d.hash <> r.hash) AND NOT (d.path IS NULL AND r.path IN (SELECT path FROM skip)))"""


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _disk(spark, sf):
    return files(spark, sf).select("path", chunking.file_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"), F.lit(2).cast("long").alias("created"))


def _page_path():
    return F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path")


def _recorded(spark, sf):
    docs = files(spark, sf).join(read(spark, sf, "labels"), "doc_id")
    docs = docs.select("path", F.when(F.col("quality") == 0, "old").otherwise(chunking.file_hash(F.col("text"))).alias("hash"), F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("created"), "toxic")
    pages = read(spark, sf, "pages").select(_page_path(), chunking.file_hash(F.col("html")).alias("hash"), F.octet_length("html").cast("long").alias("size"), F.lit(1).cast("long").alias("created"), F.lit(0).alias("toxic"))
    return docs.unionByName(pages)


def _diff(spark, sf):
    skipped = read(spark, sf, "pages").where(F.col("url").startswith("http://")).select(_page_path())
    return C.snapshot_diff(_disk(spark, sf), _recorded(spark, sf), skipped)


@query("path_filter", r"SELECT page_id, (regexp_matches(p, '\.html$') AND NOT regexp_matches(p, '(^|/)(bin|obj|node_modules|\.git|\.vs|\.lodestone)(/|$)') AND octet_length(encode(html)) <= 4096) AS indexable FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || CASE WHEN contains(url, 'blog.') THEN '/bin/x.html' WHEN contains(url, '#') THEN '.tmp' ELSE '/index.html' END AS p FROM pages)")
def path_filter(spark, sf):
    url = F.col("url")
    tail = F.when(url.contains("blog."), "/bin/x.html").when(url.contains("#"), ".tmp").otherwise("/index.html")
    path = F.concat(F.regexp_extract(url, r"^[a-z]+://([^?#]*)", 1), tail)
    return read(spark, sf, "pages").select("page_id", C.indexable(path, F.octet_length("html"), max_bytes=4096).alias("indexable"))


@query("snapshot_diff", f"WITH {_SNAPSHOTS} SELECT path, change, hash, size, created FROM diff")
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query("snapshot_diff_tree", f"WITH {_SNAPSHOTS} SELECT path, change, hash, size, created FROM diff")
def snapshot_diff_tree(spark, sf):
    """The same, of the directories alone whose digests differ."""
    skipped = read(spark, sf, "pages").where(F.col("url").startswith("http://")).select(_page_path())
    return C.snapshot_diff_by_tree(_disk(spark, sf), _recorded(spark, sf), skipped)


@query("classify_files", f"WITH {_SNAPSHOTS} SELECT d.path, CASE WHEN c.path IS NOT NULL OR r.hash IS NULL OR r.toxic = 1 THEN 'Embed' WHEN r.hash <> d.hash THEN 'Deferred' ELSE 'Unchanged' END AS disposition FROM disk d LEFT JOIN rec r USING (path) LEFT JOIN (SELECT path FROM diff WHERE change = 'Added') c USING (path)")
def classify_files(spark, sf):
    """Only the files added are changed in this pass; the toxic ones have no vectors."""
    states = _recorded(spark, sf).withColumn("has_vectors", F.col("toxic") == 0)
    return C.classify(_disk(spark, sf), states, _diff(spark, sf).where("change = 'Added'"))


_MANIFEST = """mf AS (SELECT r.path, r.hash, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'active' END AS status, r.created, CASE WHEN r.hash <> 'old' THEN r.hash END AS last_synced_hash FROM rec r),
ap AS (SELECT coalesce(m.path, c.path) AS path, CASE WHEN change IN ('Added', 'Modified') THEN c.hash ELSE m.hash END AS hash, CASE WHEN change = 'Removed' THEN 'deleted' WHEN change IS NOT NULL THEN 'active' ELSE m.status END AS status,
  coalesce(m.created, c.created) AS created, CASE WHEN change IN ('Added', 'Modified') AND m.status = 'deleted' THEN NULL ELSE m.last_synced_hash END AS last_synced_hash
  FROM mf m FULL JOIN diff c ON m.path = c.path WHERE NOT (m.path IS NULL AND change = 'Removed'))"""


def _manifest(spark, sf):
    status = F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("status")
    return _recorded(spark, sf).select("path", "hash", "size", status, "created", F.when(F.col("hash") != "old", F.col("hash")).alias("last_synced_hash"), F.lit(None).cast("timestamp").alias("updated"))


def _applied(spark, sf):
    return C.apply_changes(_manifest(spark, sf), _diff(spark, sf), now())


@query("manifest_apply", f"WITH {_SNAPSHOTS}, {_MANIFEST} SELECT path, hash, status, created, last_synced_hash FROM ap")
def manifest_apply(spark, sf):
    return _applied(spark, sf).select("path", "hash", "status", "created", "last_synced_hash")


@query("enqueue_changes", f"WITH {_SNAPSHOTS} SELECT 1000 + row_number() OVER (ORDER BY path) - 1 AS id, path AS file_path, CAST(change = 'Removed' AS BIGINT) AS op_type, CAST(0 AS BIGINT) AS status FROM diff")
def enqueue_changes(spark, sf):
    return C.enqueue(_diff(spark, sf), 1000, now()).select("id", "file_path", "op_type", "status")


@query("mark_synced", f"WITH {_SNAPSHOTS}, {_MANIFEST} SELECT a.path, CASE WHEN a.status = 'active' AND a.hash = d.hash THEN d.hash ELSE a.last_synced_hash END AS last_synced_hash FROM ap a LEFT JOIN disk d USING (path)")
def mark_synced(spark, sf):
    delivered = _disk(spark, sf).select("path", F.col("hash").alias("delivered_hash"))
    return C.mark_synced(_applied(spark, sf), delivered).select("path", "last_synced_hash")


@query("index_status_counts", f"WITH {_SNAPSHOTS}, {_MANIFEST} SELECT count(*) FILTER (last_synced_hash IS NOT NULL AND last_synced_hash = hash) AS delivered, count(*) FILTER (last_synced_hash IS NULL OR last_synced_hash <> hash) AS pending, count(*) AS active FROM ap WHERE status = 'active'")
def index_status_counts(spark, sf):
    from ..operators.tools import status_counts

    return status_counts(_applied(spark, sf))


@query("superseded_chunks", f"WITH {FILES}, {CHUNKS}, n AS (SELECT path, regexp_extract_all(text, '\\S+') AS tok FROM f), m AS (SELECT path, tok, unnest(range(0, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(tok) - 128) / 112.0) AS BIGINT) END)) AS i FROM n), w AS (SELECT sha256('chunk::' || sha256('file::' || path) || '::' || i || '::' || sha256(array_to_string(tok[i * 112 + 1 : i * 112 + 128], ' '))) AS chunk_id FROM m) SELECT file_id, chunk_id FROM ck WHERE chunk_id NOT IN (SELECT chunk_id FROM w)")
def superseded_chunks(spark, sf):
    """The default windows against windows of half the size, which only short files share."""
    f = files(spark, sf)
    old, new = (chunking.chunks(f, c).select("file_id", "chunk_id") for c in (Config(), Config(chunk_tokens=128, chunk_overlap=16)))
    return C.superseded(old, new)


@query("vector_upsert", "SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000000, 'new' FROM embeddings WHERE label = 0")
def vector_upsert(spark, sf):
    v = read(spark, sf, "embeddings")
    old = v.select(F.col("vec_id").alias("chunk_id"), F.lit("old").alias("version"))
    new = v.where("label % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("new").alias("version")).unionByName(v.where("label = 0").select((F.col("vec_id") + 1_000_000_000).alias("chunk_id"), F.lit("new").alias("version")))
    return C.upsert(old, new, ["chunk_id"])


@query("delete_cascade", f"WITH {FILES}, {CHUNKS}, g AS (SELECT sha256('file::' || path) AS file_id FROM f JOIN labels USING (doc_id) WHERE toxic = 1) SELECT (SELECT count(*) FROM f) - (SELECT count(*) FROM g) AS files, count(*) AS chunks, count(*) AS vectors FROM ck WHERE file_id NOT IN (SELECT file_id FROM g)")
def delete_cascade(spark, sf):
    f = files(spark, sf).join(read(spark, sf, "labels"), "doc_id", "left").select(chunking.file_id(F.col("path")).alias("file_id"), F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("status"))
    c = chunking.chunks(files(spark, sf)).select("file_id", "chunk_id")
    left = C.delete_files(f, c, c.select("chunk_id"), f.select("file_id"))
    one = [x.agg(F.count("*").alias(n)) for x, n in zip(left, ("files", "chunks", "vectors"), strict=True)]
    # Each is a single row.
    return one[0].crossJoin(one[1]).crossJoin(one[2])


@query("model_registry", "SELECT n_name AS model_version_id, n_name = 'JAPAN' AS is_active_for_write FROM nation WHERE n_name <> 'JAPAN' UNION ALL SELECT 'JAPAN', true")
def model_registry(spark, sf):
    registry = read(spark, sf, "nation").select(F.col("n_name").alias("model_version_id"), F.lit(True).alias("is_active_for_write"))
    return C.activate_model(registry, registry.limit(1).select(F.lit("JAPAN").alias("model_version_id"), F.lit(False).alias("is_active_for_write")))


_EVENTS = "ev AS (SELECT event_id AS seq, 'user' || user_id AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind, ts FROM events)"


@query(
    "debounce_fold",
    f"""WITH {_EVENTS}, l AS (SELECT *, lag(ts) OVER w AS p FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, seq) AS burst FROM l),
b AS (SELECT path, max(ts) AS last, count(*) AS n, list(kind ORDER BY ts, seq) AS ks FROM g GROUP BY path, burst)
SELECT path, epoch_us(last) AS last_us, n, nullif(list_reduce(list_prepend('', ks), lambda s, k: CASE WHEN s = '' THEN k WHEN s = 'Created' AND k = 'Deleted' THEN '' WHEN s = 'Created' THEN 'Created' WHEN s = 'Deleted' AND k = 'Created' THEN 'Modified' WHEN s = 'Deleted' THEN 'Deleted' ELSE k END), '') AS kind FROM b""",
)
def debounce_fold(spark, sf):
    return C.debounce(change_events(spark, sf), 6 * 3600 * 1_000_000).select("path", F.unix_micros("last").alias("last_us"), "n", "kind")


@query("rename_expand", f"WITH {_EVENTS} SELECT seq, path, kind FROM ev WHERE kind <> 'Modified' UNION ALL SELECT seq, path, 'Deleted' FROM ev WHERE kind = 'Modified' UNION ALL SELECT seq, path || '.new', 'Created' FROM ev WHERE kind = 'Modified'")
def rename_expand(spark, sf):
    e = change_events(spark, sf)
    renamed = F.col("kind") == "Modified"
    e = e.select("seq", "ts", F.col("path").alias("old_path"), F.when(renamed, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(renamed, "Renamed").otherwise(F.col("kind")).alias("kind"))
    return C.expand_renames(e).select("seq", "path", "kind")


_OUTBOX = "ob AS (SELECT event_id AS id, 'user' || user_id AS file_path, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS op_type, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS status, event_id % 12 AS attempts, ts, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error FROM events)"


@query("outbox_claim", f"WITH {_OUTBOX} SELECT id, file_path, CAST(1 AS BIGINT) AS status FROM ob WHERE status = 0 AND ts <= {_NOW} ORDER BY id LIMIT 32")
def outbox_claim(spark, sf):
    return C.claim(outbox(spark, sf), now()).select("id", "file_path", "status")


@query("outbox_requeue", f"WITH {_OUTBOX} SELECT id, CAST(CASE WHEN status = 1 THEN 0 ELSE status END AS BIGINT) AS status FROM ob")
def outbox_requeue(spark, sf):
    return C.requeue(outbox(spark, sf)).select("id", "status")


@query("outbox_backoff", f"WITH {_OUTBOX} SELECT id, CAST(attempts + 1 AS BIGINT) AS attempts, CAST(CASE WHEN attempts + 1 >= 10 THEN 3 ELSE 0 END AS BIGINT) AS status, CASE WHEN attempts + 1 >= 10 THEN epoch_us(ts) ELSE epoch_us({_NOW}) + CAST(least(pow(2, attempts), 300) * 1000000 AS BIGINT) END AS next_us FROM ob")
def outbox_backoff(spark, sf):
    return C.fail(outbox(spark, sf), now(), F.lit("down")).select("id", "attempts", "status", F.unix_micros("next_attempt_utc").alias("next_us"))


@query("outbox_prune", f"WITH {_OUTBOX} SELECT id, CAST(status AS BIGINT) AS status FROM ob WHERE NOT (status = 2 AND epoch_us(ts) < epoch_us({_NOW}) - 86400000000)")
def outbox_prune(spark, sf):
    return C.prune(outbox(spark, sf), now()).select("id", "status")


@query("outbox_deliver", f"WITH {_OUTBOX}, {_SNAPSHOTS}, {_MANIFEST}, u AS (SELECT 'user' || row_number() OVER (ORDER BY path) AS file_path, hash, last_synced_hash, status FROM ap) SELECT o.id, CASE WHEN op_type = 1 THEN CASE WHEN u.hash IS NULL THEN 'delete' ELSE 'skip' END WHEN u.hash IS NULL OR coalesce(u.last_synced_hash = u.hash, false) THEN 'skip' ELSE 'upsert' END AS action FROM ob o LEFT JOIN (SELECT * FROM u WHERE status = 'active') u USING (file_path)")
def outbox_deliver(spark, sf):
    """The manifest's files are named after users, in the order of their paths."""
    m = C.numbered(_applied(spark, sf), "path").withColumn("path", F.concat(F.lit("user"), (F.col("place") + 1).cast("string")))
    return C.deliverable(outbox(spark, sf), m).select("id", "action")


@query("failed_files_latest", f"WITH {_OUTBOX} SELECT file_path, max(id) AS id, max_by(error, id) AS error, CAST(max_by(attempts, id) AS BIGINT) AS attempts FROM ob WHERE status = 3 GROUP BY file_path ORDER BY file_path LIMIT 21")
def failed_files_latest(spark, sf):
    from ..operators.tools import failed_latest

    return failed_latest(outbox(spark, sf))


@query("failed_files", f"WITH {_OUTBOX} SELECT count(DISTINCT file_path) AS failed FROM ob WHERE status = 3")
def failed_files(spark, sf):
    return outbox(spark, sf).where("status = 3").agg(F.countDistinct("file_path").alias("failed"))


@query(
    "index_status",
    f"""WITH {_OUTBOX}, {_SNAPSHOTS}, {_MANIFEST}, x AS (SELECT file_path, max_by(error, id) AS error, max_by(attempts, id) AS attempts FROM ob WHERE status = 3 GROUP BY file_path ORDER BY file_path LIMIT 6), y AS (SELECT * FROM x ORDER BY file_path LIMIT 5)
SELECT count(*) FILTER (coalesce(last_synced_hash = hash, false)) AS delivered, count(*) FILTER (NOT coalesce(last_synced_hash = hash, false)) AS pending, count(*) AS active, (SELECT count(DISTINCT file_path) FROM ob WHERE status = 3) AS failed,
  (SELECT string_agg(file_path || ' ' || error || ' ' || attempts, ';' ORDER BY file_path) FROM y) AS failures, (SELECT count(*) > 5 FROM x) AS more_failures FROM ap WHERE status = 'active'""",
)
def index_status(spark, sf):
    from ..operators import tools

    listed = F.array_join(F.transform("failures", lambda x: F.concat_ws(" ", x["file_path"], x["error"], x["attempts"].cast("string"))), ";")
    return tools.index_status(_applied(spark, sf), outbox(spark, sf), 5).withColumn("failures", listed)


@query("delivery_order", f"WITH {_OUTBOX} SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY id) AS step FROM ob WHERE status = 0")
def delivery_order(spark, sf):
    return C.in_order(outbox(spark, sf).where(F.col("status") == C.PENDING)).select("id", "file_path", "step")


_TRIED = f"""{_OUTBOX}, tr AS (SELECT id, file_path, op_type, attempts % 4 > 0 AS ok FROM ob),
oc AS (SELECT *, min(CASE WHEN NOT ok THEN id END) OVER (PARTITION BY file_path) AS stop FROM tr),
os AS (SELECT id, file_path, op_type, CASE WHEN stop IS NULL OR id < stop THEN 'done' WHEN id = stop THEN 'failed' ELSE 'blocked' END AS outcome FROM oc)"""


def _tried(spark, sf):
    """Every third or so of the operations fails."""
    return C.stop_at_failures(outbox(spark, sf).select("id", "file_path", "op_type", (F.col("attempts") % 4 > 0).alias("ok")))


@query("ordered_delivery", f"WITH {_TRIED} SELECT id, file_path, outcome FROM os")
def ordered_delivery(spark, sf):
    return _tried(spark, sf).select("id", "file_path", "outcome")


@query("delivered_state", f"WITH {_TRIED} SELECT file_path, max(id) AS id, arg_max(op_type, id) AS op_type FROM os WHERE outcome = 'done' GROUP BY file_path")
def delivered_state(spark, sf):
    """What a sink holds after upserts and deletes of each path up to its first failure."""
    return C.delivered_state(_tried(spark, sf))


@query("own_files", r"SELECT page_id, regexp_matches(lower(p), '(^|[/\\])\.lodestone([/\\]|$)') AS own FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.lodestone/' || url WHEN 1 THEN 'a\.LodeStone\' || url WHEN 2 THEN 'x.lodestone/' || url WHEN 3 THEN url || '/.Lodestone' ELSE url END AS p FROM pages)")
def own_files(spark, sf):
    url, kind = F.col("url"), F.col("page_id") % 5
    path = F.when(kind == 0, F.concat(F.lit(".lodestone/"), url)).when(kind == 1, F.concat(F.lit("a\\.LodeStone\\"), url)).when(kind == 2, F.concat(F.lit("x.lodestone/"), url)).when(kind == 3, F.concat(url, F.lit("/.Lodestone"))).otherwise(url)
    return read(spark, sf, "pages").select("page_id", C.own(path).alias("own"))


@query("creation_times", "SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN ts ELSE ts - INTERVAL 1 DAY END) AS created_us FROM events")
def creation_times(spark, sf):
    """Some files have no time of creation, or that of an empty one."""
    ts, none = F.col("ts").cast("timestamp"), F.lit("1601-01-01 00:00:00").cast("timestamp")
    created = F.when(F.col("event_id") % 3 == 0, none).when(F.col("event_id") % 5 != 0, ts - F.expr("interval 1 day"))
    return read(spark, sf, "events").select("event_id", F.unix_micros(C.created_or_modified(created, ts)).alias("created_us"))
