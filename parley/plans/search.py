"""Lexical, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import MARKED, UNMARKED
from ..operators import hybrid as H
from ..operators import lexical as L
from ..operators import search as S
from ..operators import vectors as V
from ..operators.graph import removed, stored
from ..sources.tables import CONTACTS, DATED, PASSAGES, QUESTIONS, VECTORS, contacts, dated_passages, embedded_passages, opening_questions, passages, sql, table, vectors
from .base import query

QUESTION = "What about the nation and the thation?"
_INDEXES: dict = {}


def passage_index(spark, sf) -> L.Index:
    """The index over the passages, built once in an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = L.build_index(dated_passages(spark, sf))
    return _INDEXES[key]


def _one(spark):
    return spark.createDataFrame([(0, QUESTION)], "question_id int, question string")


def _fold(text: str) -> str:
    return f"translate(lower({text}), '{MARKED}', '{UNMARKED}')"


def _terms(languages=("en", "ru")) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set().union(*(L.STOP_WORDS[x] for x in languages))))
    return f"""terms AS (SELECT question_id, CASE WHEN length(w) >= 6 THEN w[:greatest(4, length(w) - 2)] ELSE w END AS term, length(w) >= 6 AS prefix, count(*) AS times FROM
 (SELECT question_id, unnest((CASE WHEN len(kept) > 0 THEN kept ELSE f END)[1:12]) AS w FROM (SELECT question_id, f, list_filter(f, lambda x: NOT list_contains([{stop}]::VARCHAR[], x)) AS kept FROM
 (SELECT question_id, list_filter(string_split_regex({_fold("question")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2) AS f FROM questions))) GROUP BY ALL)"""


_ONE = f"questions AS (SELECT 0 AS question_id, '{QUESTION}' AS question)"
_TOKENS = f"""tok AS (SELECT passage_id, word, count(*) AS tf, dl FROM (SELECT passage_id, len(w) AS dl, unnest(w) AS word FROM
 (SELECT passage_id, list_filter(string_split_regex({_fold("text")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM passages)) GROUP BY ALL),
 lens AS (SELECT passages.passage_id, coalesce(any_value(dl), 0) AS dl FROM passages LEFT JOIN tok USING (passage_id) GROUP BY 1)"""
_HITS = "hits AS (SELECT term, prefix, passage_id, sum(tf)::BIGINT AS tf, any_value(dl) AS dl FROM (SELECT DISTINCT term, prefix FROM terms) JOIN tok ON word[:4] = term[:4] AND (word = term OR prefix AND starts_with(word, term)) GROUP BY ALL)"
_BM25 = f"""corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), df AS (SELECT term, prefix, count(*) AS df FROM hits GROUP BY ALL),
 bm25 AS (SELECT question_id, passage_id, round(sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * {L.K1 + 1} / (tf + {L.K1} * (1 - {L.B} + {L.B} * dl / avgdl))), 9) AS score
 FROM terms JOIN hits USING (term, prefix) JOIN df USING (term, prefix), corpus GROUP BY question_id, passage_id)"""
_LEXICAL = (PASSAGES, _TOKENS, _ONE, _terms(), _HITS, _BM25)


@query(sql("SELECT passage_id, round(score, 5) AS score FROM bm25 ORDER BY bm25.score DESC, passage_id LIMIT 12", *_LEXICAL))
def search_bm25_topk(spark, sf):
    """The twelve best passages for a question: the limit is the report."""
    q = _one(spark)
    return L.search(passage_index(spark, sf), q, L.passes(q), 12).select("passage_id", F.round("score", 5).alias("score"))


@query(sql("SELECT passage_id, round(score, 5) AS score FROM bm25", *_LEXICAL))
def bm25_scores(spark, sf):
    return L.all_scores(passage_index(spark, sf), _one(spark)).select("passage_id", F.round("score", 5).alias("score"))


@query(sql("SELECT passage_id, term, tf, dl FROM hits", PASSAGES, _TOKENS, _ONE, _terms(), _HITS))
def prefix_terms_match(spark, sf):
    return L.term_hits(passage_index(spark, sf), L.asked_terms(_one(spark))).select("passage_id", "term", "tf", "dl")


@query(sql("SELECT word AS term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tok GROUP BY word HAVING count(*) >= 5", PASSAGES, _TOKENS))
def index_vocabulary(spark, sf):
    """Words of at least five passages with their document and corpus frequency, from the blocks' heads alone."""
    return passage_index(spark, sf).postings().groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("df"), F.sum("occurrences").alias("cf")).where("df >= 5")


_SCOPED = "(SELECT 0 AS part, passage_id, score FROM bm25 JOIN passages USING (passage_id) WHERE call_id = 'src1' ORDER BY score DESC, passage_id LIMIT 8) UNION ALL (SELECT 1, passage_id, score FROM bm25 JOIN passages USING (passage_id) WHERE call_id <> 'src1' ORDER BY score DESC, passage_id LIMIT 4)"


@query(sql(f"SELECT part, passage_id, round(score, 5) AS score FROM ({_SCOPED})", *_LEXICAL))
def scoped_search(spark, sf):
    """A call's eight best passages, then the four best of others: the limits are the report."""
    q = _one(spark).withColumn("call_id", F.lit("src1"))
    asked = L.passes(q)
    found = L.search(passage_index(spark, sf), q, asked, 12).join(asked.select("question_id", "part", "most"), ["question_id", "part"])
    return found.where("rank <= most").select("part", "passage_id", F.round("score", 5).alias("score"))


_PASSES = """passes AS (SELECT question_id, 0 AS part, call_id AS only_call, NULL AS other_than, CASE WHEN call_id IS NULL THEN 12 ELSE 8 END AS most, since, until, vec FROM questions
 UNION ALL SELECT question_id, 1, NULL, call_id, 4, since, until, vec FROM questions WHERE call_id IS NOT NULL)"""
_CALLED = "(only_call IS NULL OR call_id = only_call) AND (other_than IS NULL OR call_id <> other_than)"
_TIMED = '(since IS NULL OR "at" >= since AND "at" < until)'
_INSIDE = f"{_CALLED} AND {_TIMED}"
_FOUND = f"found AS (SELECT question_id, part, passage_id, call_id, score, most, row_number() OVER (PARTITION BY question_id, part ORDER BY score DESC, passage_id) AS rank FROM bm25 JOIN passes USING (question_id) JOIN dated USING (passage_id) WHERE {_INSIDE})"
_ASKED = (PASSAGES, DATED, VECTORS, QUESTIONS, _TOKENS, _terms(), _HITS, _BM25, _PASSES)


@query(sql("SELECT question_id, part, passage_id, call_id, round(score, 5) AS score, rank::INT AS rank FROM found WHERE rank <= most", *_ASKED, _FOUND))
def search_questions(spark, sf):
    """The opening questions of all conversations at once, each within its call and period."""
    q = opening_questions(spark, sf)
    asked = L.passes(q)
    scratch: list = []
    best = stored(L.search(passage_index(spark, sf), q, asked, 12, scratch=scratch), "found")
    for read in scratch:
        removed(read)
    found = best.join(asked.select("question_id", "part", "most"), ["question_id", "part"])
    return found.where("rank <= most").select("question_id", "part", "passage_id", "call_id", F.round("score", 5).alias("score"), "rank")


_REQUESTS = "questions AS (SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END AS call_id, CASE WHEN item_id % 2 = 0 THEN item_id % 70 END AS lim FROM benchmark)"


@query(sql("""SELECT question_id, passage_id, call_id, round(score, 5) AS score, NULL AS note FROM (SELECT question_id, passage_id, p.call_id, score, least(50, greatest(1, coalesce(lim, 10))) AS lim, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank
 FROM bm25 JOIN questions q USING (question_id) JOIN passages p USING (passage_id) WHERE q.call_id IS NULL OR q.call_id = p.call_id) WHERE rank <= lim
 UNION ALL SELECT question_id, NULL, NULL, NULL, 'query has no searchable tokens' FROM questions WHERE question_id NOT IN (SELECT question_id FROM terms)""", PASSAGES, _TOKENS, _REQUESTS, _terms(()), _HITS, _BM25))
def tool_search_passages(spark, sf):
    """Requests to the passage tool, some for one call, with limits in and out of bounds: its hits and notes."""
    b = table(spark, sf, "benchmark")
    call = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    q = b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), call.alias("call_id"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") % 70).alias("limit"))
    hits, notes = L.tool_search(passage_index(spark, sf), q)
    return hits.select("question_id", "passage_id", "call_id", F.round("score", 5).alias("score"), F.lit(None).cast("string").alias("note")).unionByName(notes, allowMissingColumns=True)


_NEAR = f"""near AS (SELECT question_id, part, passage_id, row_number() OVER (PARTITION BY question_id, part ORDER BY score DESC, passage_id) AS rank FROM
 (SELECT question_id, part, passage_id, round(list_cosine_similarity(v.vec, p.vec), 12) AS score FROM passes p, vectors v JOIN dated ON passage_id = vec_id WHERE p.vec IS NOT NULL AND p.question_id IN (SELECT question_id FROM terms) AND {_INSIDE}))"""
_ALONE = f"""alone AS (SELECT question_id, part, passage_id, score, since, until, most, row_number() OVER (PARTITION BY question_id, part ORDER BY score DESC, passage_id) AS rank
 FROM bm25 JOIN passes USING (question_id) JOIN dated USING (passage_id) WHERE vec IS NULL AND {_CALLED})"""
_FUSED = """fused AS (SELECT question_id, part, passage_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT question_id, part, passage_id, rank FROM found JOIN (SELECT question_id, part FROM passes WHERE vec IS NOT NULL) USING (question_id, part) WHERE rank <= 30
 UNION ALL SELECT question_id, part, passage_id, rank FROM near WHERE rank <= 30) GROUP BY ALL)"""


@query(sql("""SELECT question_id, part, passage_id, call_id, length(text) AS chars, round(score, 6) AS score, rank::INT AS rank FROM (SELECT question_id, part, passage_id, score, most, row_number() OVER (PARTITION BY question_id, part ORDER BY score DESC, passage_id) AS rank FROM
 (SELECT question_id, part, passage_id, score, most FROM fused JOIN passes USING (question_id, part) UNION ALL
 SELECT question_id, part, passage_id, score, most FROM alone JOIN dated USING (passage_id) WHERE rank <= most AND (since IS NULL OR "at" >= since AND "at" < until))) JOIN passages USING (passage_id) WHERE rank <= most""", *_ASKED, _FOUND, _NEAR, _ALONE, _FUSED))
def hybrid_questions(spark, sf):
    """The opening questions by words and vectors together; those without a vector by words alone."""
    p, q = dated_passages(spark, sf), opening_questions(spark, sf)
    found = H.hybrid(passage_index(spark, sf), p, q, embedded_passages(spark, sf))
    return found.select("question_id", "part", "passage_id", "call_id", F.char_length("text").cast("long").alias("chars"), F.round("score", 6).alias("score"), "rank")


_COSINE = "cos AS (SELECT v.vec_id, v.contact_id, list_dot_product(v.vec, q.vec) / (sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(q.vec, q.vec))) AS score FROM vectors v, (SELECT vec FROM vectors WHERE vec_id = 0) q)"


@query(sql("SELECT vec_id, contact_id, round(score, 5) AS score FROM cos", VECTORS, _COSINE))
def cosine_scores(spark, sf):
    v = vectors(spark, sf)
    q = v.where("vec_id = 0").select(F.col("vec").alias("q"))
    return v.join(F.broadcast(q), F.lit(True)).select("vec_id", "contact_id", F.round(S.cosine(F.col("vec"), F.col("q")), 5).alias("score"))


@query(sql("SELECT vec_id, contact_id, round(score, 5) AS score FROM cos ORDER BY cos.score DESC, vec_id LIMIT 30", VECTORS, _COSINE))
def cosine_topk(spark, sf):
    """The 30 nearest vectors: the limit is the report."""
    v = vectors(spark, sf)
    return S.nearest(v, v.where("vec_id = 0").select(F.col("vec").alias("q")), 30).withColumn("score", F.round("score", 5))


@query(sql("SELECT contact_id, round(max(score), 5) AS score FROM cos WHERE vec_id <> 0 GROUP BY contact_id HAVING max(score) >= 0.05", VECTORS, _COSINE))
def contact_best_match(spark, sf):
    v = vectors(spark, sf)
    q = v.where("vec_id = 0").select(F.col("vec").alias("q"))
    scored = v.where("vec_id <> 0").join(F.broadcast(q), F.lit(True)).select("contact_id", S.cosine(F.col("vec"), F.col("q")).alias("score"))
    return scored.groupBy("contact_id").agg(F.max("score").alias("best")).where("best >= 0.05").select("contact_id", F.round("best", 5).alias("score"))


_OWN = "own AS (SELECT passage_id, row_number() OVER (ORDER BY score DESC, passage_id) AS rank FROM (SELECT passage_id, round(score, 12) AS score FROM cos JOIN passages ON passage_id = vec_id))"


@query(sql("SELECT passage_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT passage_id, row_number() OVER (ORDER BY score DESC, passage_id) AS rank FROM bm25 UNION ALL SELECT passage_id, rank FROM own) WHERE rank <= 30 GROUP BY passage_id", *_LEXICAL, VECTORS, _COSINE, _OWN))
def rrf_hybrid(spark, sf):
    """The 30 best passages by words and the 30 best by vectors, fused."""
    q, v = _one(spark), vectors(spark, sf)
    words = L.search(passage_index(spark, sf), q, L.passes(q), 30)
    asked = v.where("vec_id = 0").select(F.lit(0).alias("question_id"), F.lit(0).alias("part"), "vec")
    near = V.nearest(embedded_passages(spark, sf), asked, 30)
    return H.fused([words, near], ["passage_id"]).withColumn("score", F.round("score", 6))


@query(sql("""SELECT contact_id, count(*) AS dim, round(sum(x * x / n2), 4) AS norm, round(sum(x / sqrt(n2) * pos), 3) AS probe FROM (
 SELECT contact_id, pos, avg(x) AS x, sum(avg(x) * avg(x)) OVER (PARTITION BY contact_id) AS n2 FROM (SELECT contact_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vectors) GROUP BY contact_id, pos) GROUP BY contact_id""", VECTORS))
def contact_centroids(spark, sf):
    c = S.centroids(vectors(spark, sf))
    probe = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.select("contact_id", F.size("vec").cast("long").alias("dim"), F.round(S.dot(F.col("vec"), F.col("vec")), 4).alias("norm"), F.round(probe, 3).alias("probe"))


@query(sql("""SELECT round(avg((r IS NOT NULL)::INT::DOUBLE), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (
 SELECT q.qid, min(rank) AS r FROM (SELECT DISTINCT contact_id AS qid FROM vectors) q LEFT JOIN (
  SELECT q.contact_id AS qid, v.contact_id AS label, row_number() OVER (PARTITION BY q.contact_id ORDER BY list_dot_product(v.vec, q.vec) / sqrt(list_dot_product(v.vec, v.vec)) DESC, v.vec_id) AS rank
  FROM vectors v JOIN (SELECT contact_id, vec_id, vec FROM vectors QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY vec_id) = 1) q ON v.vec_id <> q.vec_id) s
  ON s.qid = q.qid AND s.label = q.qid AND rank <= 5 GROUP BY q.qid)""", VECTORS))
def retrieval_quality(spark, sf):
    """hit@5 and MRR of searching each contact's voice by its first sample. The queries are one row per contact."""
    v = vectors(spark, sf)
    first = v.groupBy(F.col("contact_id").alias("question_id")).agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("skip")).withColumn("part", F.lit(0))
    top = V.nearest(v, first, 5, item="vec_id")
    relevant = v.select(F.col("contact_id").alias("query_id"), F.col("vec_id").alias("item"))
    return S.retrieval_metrics(top.select(F.col("question_id").alias("query_id"), F.col("vec_id").alias("item"), "rank"), relevant, 5).select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


_CLUSTERS = "clusters AS (SELECT a.vec_id AS cluster, list_transform(list_zip(a.vec, b.vec), lambda x: x[1] + x[2]) AS vec FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0)"


@query(sql("""SELECT cluster, contact_id, display_name, round(score, 5) AS score, rank::INT AS rank FROM (SELECT cluster, contact_id, score, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 12) DESC, contact_id) AS rank FROM
 (SELECT cluster, contact_id, max(list_cosine_similarity(c.vec, v.vec)) AS score FROM clusters c, vectors v JOIN contacts USING (contact_id) WHERE NOT is_owner AND attributes = '{"consent_voice":"true"}' GROUP BY cluster, contact_id) WHERE score >= 0.2) JOIN contacts USING (contact_id) WHERE rank <= 3""", VECTORS, CONTACTS, _CLUSTERS))
def speaker_candidates(spark, sf):
    """The three contacts most alike to each cluster of a voice (here sums of two samples), by the best of their samples."""
    v = vectors(spark, sf)
    second = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    clusters = v.where("vec_id % 20 = 0").join(second, "vec_id").select(F.col("vec_id").alias("cluster"), F.zip_with("vec", "other", lambda x, y: x + y).alias("vec"))
    return V.speaker_candidates(clusters, v, contacts(spark, sf), 0.2).select("cluster", "contact_id", "display_name", F.round("score", 5).alias("score"), "rank")


_SPACED = "' ' || trim(regexp_replace(lower({}), '\\s+', ' ', 'g')) || ' '"


@query(sql(f"SELECT item_id, count(passage_id) AS n_passages FROM (SELECT item_id, {_SPACED.format('text')} AS item FROM benchmark) LEFT JOIN (SELECT passage_id, {_SPACED.format('text')} AS whole FROM passages) ON trim(item) <> '' AND contains(whole, item) GROUP BY item_id", PASSAGES))
def quotes_found(spark, sf):
    """In how many passages the words of a whole benchmark item stand in a row."""
    items = table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = S.occurrences(passages(spark, sf), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_passages"))


@query(sql(f"""SELECT item_id, k, count(passage_id) AS n_passages FROM (SELECT item_id, k, {_SPACED.format("list_aggregate(w[3:2 + k], 'string_agg', ' ')")} AS item FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w, unnest([2, 4, 9]) AS k FROM benchmark))
 LEFT JOIN (SELECT passage_id, {_SPACED.format('text')} AS whole FROM passages) ON trim(item) <> '' AND contains(whole, item) GROUP BY ALL""", PASSAGES))
def phrases_found(spark, sf):
    """In how many passages phrases of two, four and nine words from each benchmark item stand."""
    from ..functions.text import squeezed

    b = table(spark, sf, "benchmark").select("item_id", F.split(squeezed(F.col("text")), " ").alias("w"), F.explode(F.array(F.lit(2), F.lit(4), F.lit(9))).alias("k"))
    items = b.select(F.struct("item_id", "k").alias("item_id"), F.array_join(F.expr("slice(w, 3, k)"), " ").alias("text"))
    hits = S.occurrences(passages(spark, sf), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "item_id", "left").select("item_id.item_id", "item_id.k", F.coalesce("n", F.lit(0)).alias("n_passages"))
