"""Queries over texts: tokens, chunks, terms, frequencies."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import chunking, features
from ..sources.shared import cut
from ..sources.tables import files, read
from .base import CHUNKS, FILES, TERMS, query

_WORDS = r"""an AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([^\p{Lu}])(\p{Lu})', '\1 \2', 'g'), '([^\p{Nd} ])(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})([^\p{Nd} ])', '\1 \2', 'g'), ' ')) AS p
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS t FROM documents)),
sm AS (SELECT doc_id, lower(p) AS w FROM an),
tm AS (SELECT doc_id, CASE WHEN len(w) > 5 AND w LIKE '%ing' THEN left(w, len(w) - 3) WHEN len(w) > 4 AND w LIKE '%ed' THEN left(w, len(w) - 2) WHEN len(w) > 4 AND w LIKE '%es' THEN left(w, len(w) - 2)
  WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, len(w) - 1) ELSE w END AS term FROM sm),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tm WHERE len(term) > 1 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + """) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


@query("tokenize_stats", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_distinct FROM documents")
def tokenize_stats(spark, sf):
    t = T.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("file_identity", f"WITH {FILES} SELECT doc_id, sha256('file::' || path) AS file_id, sha256(text) AS file_hash, left(sha256(text), 16) AS version, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM f")
def file_identity(spark, sf):
    h = chunking.file_hash(F.col("text"))
    return files(spark, sf).select("doc_id", chunking.file_id(F.col("path")).alias("file_id"), h.alias("file_hash"), F.left(h, F.lit(16)).alias("version"), F.octet_length("text").alias("size_bytes"))


@query("chunk_documents", f"WITH {FILES}, {CHUNKS} SELECT path, chunk_index, token_start, token_end, chunk_hash FROM ck")
def chunk_documents(spark, sf):
    return chunking.chunks(files(spark, sf)).select("path", "chunk_index", "token_start", "token_end", "chunk_hash")


@query("chunk_ids", f"WITH {FILES}, {CHUNKS} SELECT chunk_id, file_id, chunk_index FROM ck")
def chunk_ids(spark, sf):
    return chunking.chunks(files(spark, sf)).select("chunk_id", "file_id", "chunk_index")


@query("chunk_coverage", f"WITH {FILES}, {CHUNKS} SELECT path, count(*) AS chunks, max(token_end) AS tokens, CAST(sum(token_end - token_start) AS BIGINT) AS window_tokens FROM ck GROUP BY path")
def chunk_coverage(spark, sf):
    c = chunking.chunks(files(spark, sf)).select("path", "token_start", "token_end")
    return c.groupBy("path").agg(F.count("*").alias("chunks"), F.max("token_end").alias("tokens"), F.sum(F.col("token_end") - F.col("token_start")).alias("window_tokens"))


_HISTOGRAM = """hc AS (SELECT doc_id, CAST(unicode(unnest(string_split(text, ''))) % 64 AS BIGINT) AS bucket FROM documents),
h AS (SELECT doc_id, bucket, count(*) AS n FROM hc GROUP BY ALL), hn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM h GROUP BY ALL)"""


@query("histogram_embed", f"WITH {_HISTOGRAM} SELECT h.doc_id, bucket, n, round(n / norm, 6) AS value FROM h JOIN hn USING (doc_id)")
def histogram_embed(spark, sf):
    h = read(spark, sf, "documents").select("doc_id", V.histogram(F.col("text")).alias("h"))
    return h.select("doc_id", F.posexplode(F.arrays_zip("h", V.normalize(F.col("h")).alias("v"))).alias("bucket", "x")).where("x.h > 0").select("doc_id", "bucket", F.col("x.h").alias("n"), F.round("x.v", 6).alias("value"))


@query("term_set", f"WITH t AS (SELECT doc_id, {TERMS.format('text')} AS terms FROM documents) SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, sha256(array_to_string(list_sort(terms), ' ')) AS terms FROM t")
def term_set(spark, sf):
    t = T.terms(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("terms"))


@query("identifier_split", f"WITH {_WORDS} SELECT p AS part, count(*) AS n FROM an GROUP BY ALL")
def identifier_split(spark, sf):
    runs = F.regexp_extract_all("text", F.lit(T.TERM), F.lit(0))
    return read(spark, sf, "documents").select(F.explode(F.flatten(F.transform(runs, T.split_identifier))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("stem_stopwords", f"WITH {_WORDS} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words, sha256(string_agg(term, ' ' ORDER BY term)) AS terms FROM tf GROUP BY doc_id")
def stem_stopwords(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", features.sorted_terms(F.col("text")).alias("w")).where("w.n_terms > 0")
    return d.select("doc_id", "w.n_terms", "w.n_words", F.sha2("w.terms", 256).alias("terms"))


@query("char_trigrams", f"WITH t AS (SELECT DISTINCT unnest({TERMS.format('text')}) AS term FROM documents) SELECT term, array_to_string(list_transform(range(1, len(term) + 1), lambda i: '3:' || substr('^' || term || '$', i, 3)), ' ') AS trigrams FROM t")
def char_trigrams(spark, sf):
    t = read(spark, sf, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return t.select("term", F.array_join(T.trigrams(F.col("term")), " ").alias("trigrams"))


def _term_rows(spark, sf):
    return features.term_rows(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("term_frequency", f"WITH {_WORDS} SELECT doc_id AS doc, term, tf FROM tf")
def term_frequency(spark, sf):
    return _term_rows(spark, sf)


def _frequencies(spark, sf):
    return features.document_frequencies(read(spark, sf, "documents").select("text")).where("term IS NOT NULL")


@query("doc_frequency", f"WITH {_WORDS} SELECT term, df FROM df")
def doc_frequency(spark, sf):
    return _frequencies(spark, sf)


@query("vocabulary_cap", f"WITH {_WORDS} SELECT term, df FROM df WHERE df >= 2 ORDER BY df DESC, term LIMIT 4096")
def vocabulary_cap(spark, sf):
    return features.vocabulary(_frequencies(spark, sf))


@query("tfidf", f"WITH {_WORDS}, v AS (SELECT * FROM df WHERE df >= 2 ORDER BY df DESC, term LIMIT 4096), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id AS doc, term, round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 6) AS weight FROM tf JOIN v USING (term), n")
def tfidf(spark, sf):
    # Counted once and written; frequencies, the number of documents and the weights come from that.
    bags = cut(features.bags(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")))
    rows = bags.select("doc", F.explode("bag").alias("b")).select("doc", "b.term", "b.tf")
    return features.tf_idf(rows, features.vocabulary(features.document_frequency(rows)), bags.count()).withColumn("weight", F.round("weight", 6))


@query("lsa_similarity")
def lsa_similarity(spark, sf):
    """Every twentieth document by the passage of the benchmark that is nearest to it, in a space fitted on all documents."""
    from ..operators.retrieval import knn

    docs = read(spark, sf, "documents")
    model = features.fit_lsa(docs.select(F.col("doc_id").alias("doc"), "text"), 16)
    vectors = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), model.transform(F.col("text")).alias("vector"))
    # Written once, as they are counted and then scored in groups.
    queries = cut(docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), model.transform(F.col("text")).alias("vector")))
    return knn(vectors, queries, 1)


@query("lsa_update", "SELECT count(*) AS documents, true AS near FROM documents")
def lsa_update(spark, sf):
    """A model of four in five documents, brought up to date with the others, against one fitted on all: whether the documents' vectors are within 15 degrees of each other on average."""
    # The texts are cut and counted once, for both fits, the update and the vectors.
    bags = features.stored_bags(read(spark, sf, "documents").select((F.col("doc_id") % 5 == 0).cast("int").alias("part"), "text")).persist()
    try:
        model, full = features.update_lsa(features.fit_lsa(bags.where("part = 0"), 8, False), bags.where("part = 1")), features.fit_lsa(bags, 8, False)
        mean = F.avg(F.when(F.col("known"), F.col("cosine")))
        return cut(features.cosines(bags, model, full).agg(F.count("*").alias("documents"), (mean >= math.cos(math.radians(15))).alias("near")))
    finally:
        bags.unpersist()


@query("jaccard_pairs", f"WITH t AS (SELECT doc_id, {TERMS.format('text')} AS s FROM documents) SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def jaccard_pairs(spark, sf):
    from ..operators.retrieval import jaccard

    t = read(spark, sf, "documents").select("doc_id", T.terms(F.col("text")).alias("s"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("u"))
    return t.join(b, "doc_id").select("doc_id", F.round(jaccard(F.col("s"), F.col("u")), 6).alias("jaccard"))


@query("line_count", r"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CAST(suffix(text, chr(10)) AS INT) END AS BIGINT) AS lines, CASE WHEN contains(text, chr(13)) THEN 'cr' ELSE 'lf' END AS newline FROM documents")
def line_count(spark, sf):
    newline = F.when(T.newline_of(F.col("text")).contains("\r"), "cr").otherwise("lf")
    return read(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"), newline.alias("newline"))


@query("replace_literal", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) AS BIGINT) AS n, sha256(replace(text, 'the', 'T$1E')) AS text_hash FROM documents")
def replace_literal(spark, sf):
    new, n = T.replace_literal(F.col("text"), "the", "T$1E")
    return read(spark, sf, "documents").select("doc_id", n.alias("n"), F.sha2(new, 256).alias("text_hash"))


@query("path_names", f"WITH {FILES} SELECT doc_id, 'doc' || doc_id || '.txt' AS name, 'txt' AS extension, regexp_replace(path, '[^\\p{{L}}\\p{{Nd}}]', '_', 'g') AS table_name FROM f")
def path_names(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("doc_id", T.file_name(p).alias("name"), T.extension(p).alias("extension"), T.sanitize(p).alias("table_name"))
