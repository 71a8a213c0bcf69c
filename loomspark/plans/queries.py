"""A query for each operator, over the tables of a folder, with equivalent SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import numeric, text
from loomspark.functions.numeric import fixed
from loomspark.operators import audit, evaluation, links, retrieval, routing, runstats, traces
from loomspark.plans.base import ORACLE, QUERIES, query, t  # noqa: F401  kept here for the driver
from loomspark.sources.scratch import materialise
from loomspark.streaming import logs

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\-]*')"
BM25 = rf"""
toks AS (SELECT doc_id, {TOK} AS tk FROM documents),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tk) AS term FROM toks) GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM toks),
idfs AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st),
qt AS (SELECT unnest(['general', 'public', 'license', 'version']) AS term),
w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idfs) ELSE idf END AS idf FROM qt JOIN idfs USING (term)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM toks) JOIN qt USING (term) GROUP BY ALL),
hit AS (SELECT tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tk) / avgdl))) AS s
        FROM tf JOIN w USING (term) JOIN toks USING (doc_id), st GROUP BY tf.doc_id),
bm AS (SELECT doc_id, CAST(CAST(coalesce(s, 0) AS DECIMAL(30,6)) AS DOUBLE) AS score FROM toks LEFT JOIN hit USING (doc_id))
"""


@query(f"WITH {BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_search(spark, d):
    return retrieval.bm25_search(spark, d)


def _asked(spark, d):
    v = t(spark, d, "embeddings")
    return v, v.where("vec_id % 100 = 0")


DENSE = """
q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
dn AS (SELECT query, vec_id, CAST(CAST(list_dot_product(embedding::DOUBLE[], e) AS DECIMAL(30,6)) AS DOUBLE) AS score FROM embeddings, q),
dr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM dn)
"""


@query(f"WITH {DENSE} SELECT query, vec_id, score, rank FROM dr WHERE rank <= 20")
def dense_rank_topk(spark, d):
    """Each vector whose id is divisible by 100 against all."""
    return retrieval.dense(*_asked(spark, d), 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BM25} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm""")
def bm25_ranks(spark, d):
    return retrieval.ranks(retrieval.bm25(t(spark, d, "documents"), retrieval.QUERY), "doc_id")


@query(f"""WITH {BM25}, {DENSE},
r1 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm),
p AS (SELECT query, id, rank FROM r1, q UNION ALL SELECT query, vec_id, rank FROM dr),
f AS (SELECT query, id, CAST(CAST(sum(1.0::DOUBLE / (60 + rank)) AS DECIMAL(30,9)) AS DOUBLE) AS score FROM p GROUP BY ALL)
SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM f) WHERE r <= 20""")
def rrf_fusion(spark, d):
    """One text query's ranking fused with the dense ranking of each vector whose id is divisible by 100."""
    ranked = retrieval.ranks(retrieval.bm25(t(spark, d, "documents"), retrieval.QUERY), "doc_id").withColumnRenamed("doc_id", "id")
    return retrieval.hybrid(materialise(ranked, "ranking"), *_asked(spark, d), 20)


@query(f"""WITH {BM25}, o AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
r1 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm),
d AS (SELECT vec_id AS id, CAST(CAST(list_dot_product(embedding::DOUBLE[], e) AS DECIMAL(30,6)) AS DOUBLE) AS score FROM embeddings, o),
r2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM d)
SELECT id, CAST(CAST(sum(1.0::DOUBLE / (60 + rank)) AS DECIMAL(30,9)) AS DOUBLE) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 5""")
def fuse_rankings(spark, d):
    """J4 on whole rankings."""
    v = t(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    scored = v.join(F.broadcast(one)).select(F.col("vec_id").alias("id"), fixed(numeric.dot(F.col("embedding"), F.col("_q"))).alias("score"))  # one row
    a = retrieval.ranks(retrieval.bm25(t(spark, d, "documents"), retrieval.QUERY).withColumnRenamed("doc_id", "id"), "id")
    return retrieval.fuse([a, retrieval.ranks(scored, "id")], "id")


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, trim(regexp_replace(text, '\n', E'\n\n', 'g'), E' \n\t\r') AS body FROM documents WHERE length(trim(text, E' \n\t\r')) > 0),
p AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '\n\s*\n'), lambda x: length(trim(x, E' \n\t\r')) > 0) AS ps FROM b),
f AS (SELECT doc_id, ps, 1 AS i, 0 AS ix, '' AS cur, NULL::VARCHAR AS done FROM p WHERE length(body) > 2000
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN cur <> '' AND length(cur) + length(ps[i]) + 2 > 2000 THEN ix + 1 ELSE ix END,
    CASE WHEN cur = '' THEN ps[i] WHEN length(cur) + length(ps[i]) + 2 > 2000 THEN right(cur, 300) || E'\n\n' || ps[i] ELSE cur || E'\n\n' || ps[i] END,
    CASE WHEN cur <> '' AND length(cur) + length(ps[i]) + 2 > 2000 THEN cur END FROM f WHERE i <= len(ps)),
c AS (SELECT doc_id, 0 AS chunk_ix, body AS t FROM p WHERE length(body) <= 2000
  UNION ALL SELECT doc_id, ix - 1, done FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, ix, cur FROM f WHERE i = len(ps) + 1 AND cur <> '')
SELECT doc_id, '' AS section, chunk_ix::BIGINT AS chunk_ix, length(t)::INT AS chars, sha256(t) AS sha FROM c""")
def chunk_pack(spark, d):
    """Lines count as paragraphs here, as the tables' texts have no blank lines."""
    docs = t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return retrieval.chunks(docs).select("doc_id", "section", "chunk_ix", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS parts FROM l WHERE length(trim(line)) > 0 GROUP BY doc_id""")
def chunk_headings(spark, d):
    """Each line as a heading: the sections of a document are its lines that aren't blank."""
    docs = t(spark, d, "documents").select("doc_id", F.concat(F.lit("# h\n"), F.regexp_replace("text", "\n", "\n# h\n")).alias("text"))
    parts = docs.select("doc_id", F.explode(text.sections(F.col("text"))).alias("s")).where(F.length(text.strip(F.col("s.body"))) > 0)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("""WITH k AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(w) + greatest(len(w) - 1, 0) + 1 + (len(w) > 1)::INT END::BIGINT AS features,
  w[1] AS first_word FROM k""")
def router_features(spark, d):
    docs = t(spark, d, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size(text.router_features(body)).cast("long").alias("features"), F.get(text.router_tokens(body), F.lit(0)).alias("first_word"))


FEATS = """
k AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
f AS (
  SELECT doc_id, lang, unnest(w) AS term FROM k
  UNION ALL SELECT doc_id, lang, w[i] || '_' || w[i + 1] FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM k)
  UNION ALL SELECT doc_id, lang, '@start:' || w[1] FROM k WHERE len(w) > 0
  UNION ALL SELECT doc_id, lang, '@start2:' || w[1] || '_' || w[2] FROM k WHERE len(w) > 1),
tf AS (SELECT doc_id AS id, lang AS label, term, count(*) AS tf FROM f GROUP BY ALL),
tot AS (SELECT count(*) AS n, count(DISTINCT lang) AS c FROM documents),
idf AS (SELECT term, df, cf, (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) * (ln(c::DOUBLE / cf) + 1) AS idf
        FROM (SELECT term, count(*) AS df, count(DISTINCT label) AS cf FROM tf GROUP BY term), tot),
raw AS (SELECT label, term, sum(1 + ln(tf)) * any_value(idf) AS w FROM tf JOIN idf USING (term) GROUP BY ALL),
cent AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS weight FROM raw)
"""


def _lexical(spark, d):
    docs = t(spark, d, "documents")
    feats = routing.features(docs, "lang")
    freqs = feats.groupBy("term", "label").agg(F.count(F.lit(1)).alias("d"))
    weights = materialise(routing.idf(freqs, docs, "lang"), "idf")
    return feats, weights, materialise(routing.centroids(feats, weights), "centroids")


@query(f"WITH {FEATS} SELECT term, df, cf, CAST(CAST(idf AS DECIMAL(30,6)) AS DOUBLE) AS idf FROM idf")
def tfidf_idf(spark, d):
    docs = t(spark, d, "documents")
    out = routing.idf(routing.frequencies(docs, "lang"), docs, "lang")
    return out.select("term", "df", "cf", fixed(F.col("idf")).alias("idf"))


@query(f"WITH {FEATS} SELECT label, count(*) AS terms, CAST(CAST(max(weight) AS DECIMAL(30,6)) AS DOUBLE) AS top FROM cent GROUP BY label")
def tfidf_centroids(spark, d):
    return _lexical(spark, d)[2].groupBy("label").agg(F.count(F.lit(1)).alias("terms"), fixed(F.max("weight")).alias("top"))


LEX = """,
q AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM q GROUP BY id),
ls AS (SELECT q.id, c.label, sum(q.w * c.weight) AS s FROM q JOIN cent c USING (term) GROUP BY ALL),
lex AS (SELECT nrm.id, l.label, CAST(CAST(coalesce(s / norm, 0) AS DECIMAL(30,4)) AS DOUBLE) AS score
        FROM nrm CROSS JOIN (SELECT DISTINCT label FROM cent) l LEFT JOIN ls ON ls.id = nrm.id AND ls.label = l.label)
"""


@query(f"WITH {FEATS} {LEX} SELECT id, label, score FROM lex")
def lexical_scores(spark, d):
    return routing.lexical_scores(*_lexical(spark, d))


@query(f"""WITH {FEATS} {LEX}, g AS (SELECT id, label AS got, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM lex)
SELECT lang AS want, got, count(*) AS n FROM g JOIN documents ON doc_id = id WHERE r = 1 GROUP BY ALL""")
def lexical_confusion(spark, d):
    best = routing.best_label(lexical_scores(spark, d))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("want"))
    return best.join(docs, "id").groupBy("want", F.col("predicted").alias("got")).agg(F.count(F.lit(1)).alias("n"))


LEX_LOO = """,
g AS (SELECT label, term, sum(1 + ln(tf)) AS s, count(*) AS d FROM tf GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
b0 AS (SELECT term, count(*) AS cf, sum(d) AS df, (ln(any_value(n)::DOUBLE / (sum(d) + 1)) + 1) * (ln((SELECT c FROM tot)::DOUBLE / count(*)) + 1) AS idf FROM g, nd GROUP BY term),
sq AS (SELECT label, sum((s * idf) * (s * idf)) AS q FROM g JOIN b0 USING (term) GROUP BY label),
own AS (SELECT tf.id, tf.label AS want, tf.term, 1 + ln(tf.tf) AS w, b0.idf,
  CASE WHEN df > 1 THEN (ln(n::DOUBLE / df) + 1) * (ln((SELECT c FROM tot)::DOUBLE / (cf - (g.d = 1)::INT)) + 1) ELSE 0 END AS lf
  FROM tf JOIN b0 USING (term) JOIN g ON g.term = tf.term AND g.label = tf.label, nd),
pr AS (SELECT own.id, any_value(want) AS want, g.label, sum(w * lf * (s - CASE WHEN g.label = want THEN w ELSE 0 END) * lf) AS dot,
  sum(((s - CASE WHEN g.label = want THEN w ELSE 0 END) * lf) * ((s - CASE WHEN g.label = want THEN w ELSE 0 END) * lf) - (s * idf) * (s * idf)) AS more FROM own JOIN g USING (term) GROUP BY own.id, g.label),
qn AS (SELECT id, any_value(want) AS want, sqrt(sum(w * lf * w * lf)) AS norm FROM own GROUP BY id),
lo AS (SELECT qn.id, qn.want, sq.label, CAST(CAST(coalesce(dot, 0) / CASE WHEN q + coalesce(more, 0) > 1e-12 THEN sqrt(q + coalesce(more, 0)) ELSE 1 END / CASE WHEN norm > 0 THEN norm ELSE 1 END AS DECIMAL(30,4)) AS DOUBLE) AS score
  FROM qn CROSS JOIN sq LEFT JOIN pr ON pr.id = qn.id AND pr.label = sq.label)
"""


@query(f"WITH {FEATS} {LEX_LOO} SELECT id, want, label, score FROM lo")
def lexical_loo(spark, d):
    return routing.lexical_loo(t(spark, d, "documents"), "lang")


CENT = """
x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL),
dc AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS weight FROM m),
ds AS (SELECT x.vec_id AS id, dc.label, CAST(CAST(sum(x.x * weight) AS DECIMAL(30,4)) AS DOUBLE) AS score FROM x JOIN dc USING (pos) GROUP BY ALL)
"""


@query(f"WITH {CENT} SELECT label, pos::INT AS pos, CAST(CAST(weight AS DECIMAL(30,6)) AS DOUBLE) AS weight FROM dc")
def dense_centroids(spark, d):
    return routing.dense_centroids(t(spark, d, "embeddings")).select("label", "pos", fixed(F.col("weight")).alias("weight"))


def _dense_scores(spark, d):
    v = t(spark, d, "embeddings")
    return routing.dense_scores(v, routing.dense_centroids(v))


@query(f"""WITH {CENT}, r AS (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM ds)
SELECT id, label::VARCHAR AS predicted FROM r WHERE r = 1""")
def dense_classify(spark, d):
    return routing.best_label(_dense_scores(spark, d))


@query(f"""WITH {CENT}, r AS (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM ds)
SELECT id, max(label) FILTER (r = 1) AS first, max(score) FILTER (r = 1) AS first_score, max(label) FILTER (r = 2) AS second,
  max(score) FILTER (r = 2) AS second_score FROM r WHERE r <= 2 GROUP BY id""")
def top_two_labels(spark, d):
    return routing.runner_up(_dense_scores(spark, d))


@query(f"""WITH {CENT}, z AS (SELECT id, label, score, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM ds WINDOW w AS (PARTITION BY id))
SELECT id, label, CAST(CAST(0.2::DOUBLE * (CASE WHEN sd < 1e-9 THEN 0 ELSE (score - mu) / sd END) + 0.8::DOUBLE * (CASE WHEN sd < 1e-9 THEN 0 ELSE (-score + mu) / sd END) AS DECIMAL(30,4)) AS DOUBLE) AS score FROM z""")
def zscore_blend(spark, d):
    dense = _dense_scores(spark, d)
    return routing.blend(dense, dense.withColumn("score", -F.col("score")))


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 3 = 0 AS held_out FROM documents")
def stratified_split(spark, d):
    return routing.stratified_split(t(spark, d, "documents"), "lang", "doc_id")


LOO = """
x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT label, pos, sum(x) AS s FROM x GROUP BY ALL),
c AS (SELECT x.vec_id AS id, x.label AS want, s.label, x.x, CASE WHEN x.label = s.label THEN s.s - x.x ELSE s.s END AS v FROM x JOIN s USING (pos)),
sc AS (SELECT id, want, label, CAST(CAST(CASE WHEN sum(v * v) > 0 THEN sum(x * v) / sqrt(sum(v * v)) ELSE 0 END AS DECIMAL(30,4)) AS DOUBLE) AS score FROM c GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM sc)
"""


@query(f"WITH {LOO} SELECT count(*) AS n, count(*) FILTER (want <> label) AS missed, CAST(CAST(avg((want = label)::INT) AS DECIMAL(30,6)) AS DOUBLE) AS accuracy FROM b WHERE r = 1")
def loo_accuracy(spark, d):
    return evaluation.held_out_accuracy(_loo(spark, d))


@query(f"WITH {LOO} SELECT id, want, label AS got FROM b WHERE r = 1 AND want <> label")
def held_out_misses(spark, d):
    return evaluation.misses(_loo(spark, d))


def _loo(spark, d):
    s = routing.loo_scores(t(spark, d, "embeddings"))
    return s.groupBy("id").agg(F.max("want").alias("want"), F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("got"))


@query(f"WITH {LOO} SELECT want, label AS got, count(*) AS n FROM b WHERE r = 1 AND want <> label GROUP BY ALL")
def confusion(spark, d):
    return evaluation.confusion(_loo(spark, d))


SWEEP = f"""{LOO}, w AS (SELECT unnest(range(11)) / 10.0 AS weight),
a AS (SELECT weight, id, arg_min(label, (-(score * weight + (label = 0)::INT * (1 - weight)::DOUBLE * 0.1), label)) AS got, any_value(want) AS want FROM sc, w GROUP BY ALL),
sw AS (SELECT weight::DOUBLE AS weight, count(*) FILTER (want = got) AS correct FROM a GROUP BY weight)"""


@query(f"WITH {SWEEP} SELECT weight, correct FROM sw")
def weight_sweep(spark, d):
    """Accuracy by weight of the score against a prior for label 0; folds are scored once."""
    s = routing.loo_scores(t(spark, d, "embeddings"))
    weights = spark.createDataFrame([(i / 10,) for i in range(11)], "weight double")
    value = F.col("score") * F.col("weight") + (F.col("label") == 0).cast("int") * (1 - F.col("weight")) * 0.1
    got = s.join(F.broadcast(weights)).groupBy("weight", "id").agg(F.max("want").alias("want"), F.min_by("label", F.struct(-value, F.col("label"))).alias("got"))
    return got.groupBy("weight").agg(F.count(F.when(F.col("want") == F.col("got"), 1)).alias("correct"))


@query(f"WITH {SWEEP} SELECT weight, correct FROM sw ORDER BY correct DESC, weight LIMIT 1")
def best_weight(spark, d):
    return routing.best_weight(weight_sweep(spark, d))


@query(f"""WITH {CENT}, r AS (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM ds WHERE id % 3 = 0 OR label IN (1, 4, 7))
SELECT id, label::VARCHAR AS predicted FROM r WHERE r = 1""")
def candidate_restriction(spark, d):
    """Two of three rows may only go to three labels."""
    scores = _dense_scores(spark, d).withColumn("allowed", F.when(F.col("id") % 3 != 0, F.array(F.lit(1), F.lit(4), F.lit(7))))
    return routing.best_label(routing.restricted(scores))


@query("SELECT doc_id, (length(text) // 4 + 512)::BIGINT AS est_ctx FROM documents")
def est_ctx(spark, d):
    return t(spark, d, "documents").select("doc_id", text.est_ctx(F.col("text")).alias("est_ctx"))


PAYLOAD = "event_id::VARCHAR || '|' || event_type || '|' || coalesce(props, '')"


def _chain(spark, d):
    events = t(spark, d, "events")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    return audit.text_chain(events, "event_id", payload, "user_id")


@query(f"""WITH h AS (SELECT user_id, event_id, sha256({PAYLOAD}) AS hash FROM events)
SELECT user_id, event_id, hash, coalesce(lag(hash) OVER w, repeat('0', 64)) AS prev_hash, row_number() OVER w - 1 AS seq FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def audit_chain(spark, d):
    """A chain for each user; digests run in parallel before the window."""
    return _chain(spark, d).withColumn("seq", F.col("seq").cast("long"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, event_type, user_id, value FROM events), g AS (SELECT line_no, line_no > 2 AND user_id % 7 = 3 AS changed FROM l)
SELECT count(*) FILTER (changed) = 0 AS ok, min(line_no) FILTER (changed) AS broken_at FROM g""")
def audit_chain_verify(spark, d):
    """A log of all events, in which some users' lines after the third are altered."""
    events = t(spark, d, "events")
    log = audit.text_log(events, "event_id", F.to_json(F.struct(*sorted(events.columns))))
    changed = (F.col("line_no") > 2) & (F.get_json_object("payload", "$.user_id").cast("long") % 7 == 3)
    altered = F.when(changed, F.replace("payload", F.lit('"event_type":'), F.lit('"event_tipe":'))).otherwise(F.col("payload"))
    return audit.verify(log.withColumn("digest", F.sha2(altered, 256)))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 15")
def audit_tail(spark, d):
    return audit.tail(t(spark, d, "events"), "event_id", 15).select("event_id", "event_type")


@query("""SELECT i.event_id AS seq, r.event_id AS result_seq FROM events i LEFT JOIN events r ON r.event_type = 'purchase' AND r.event_id - 1 = i.event_id WHERE i.event_type = 'click'""")
def intent_result_join(spark, d):
    e = t(spark, d, "events")
    intents = e.where("event_type = 'click'").select(F.col("event_id").alias("seq"))
    results = e.where("event_type = 'purchase'").select(F.col("event_id").alias("seq"), (F.col("event_id") - 1).alias("ref"))
    return audit.intent_results(intents, results)


@query("""SELECT i.event_id AS seq FROM events i WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.event_id - 1 = i.event_id)""")
def unmatched_intents(spark, d):
    e = t(spark, d, "events")
    intents = e.where("event_type = 'click'").select(F.col("event_id").alias("seq"))
    return audit.unmatched_intents(intents, e.where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("ref")))


def _drops(spark, d):
    line = F.format_string(
        "%s %s TCP 10.0.0.%s 203.0.113.%s 5%s 443 - %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "error", "DROP").otherwise("ALLOW"),
        (F.col("user_id") % 250).cast("string"), (F.col("event_id") % 250).cast("string"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "RECEIVE").otherwise("SEND"),
    )
    return logs.drops(t(spark, d, "events").select(line.alias("value")))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'TCP' AS proto, '203.0.113.' || (event_id % 250) AS dst, '443' AS dport
FROM events WHERE event_type = 'error' AND event_id % 7 <> 0""")
def drop_log_filter(spark, d):
    return _drops(spark, d)


@query("SELECT count(*) AS total FROM events WHERE event_type = 'error' AND event_id % 7 <> 0")
def drop_total(spark, d):
    return logs.running_total(_drops(spark, d))


@query("""SELECT p_partkey, CAST(CAST(least(p_size / 2.0, 10.0) AS DECIMAL(30,4)) AS DOUBLE) AS next_interval,
CASE WHEN 100.0 * 0.85 - 0.6 * p_size > 0 THEN CAST(CAST(p_size::DOUBLE * p_retailprice / (100.0::DOUBLE * 0.85::DOUBLE - 0.6::DOUBLE * p_size) AS DECIMAL(30,4)) AS DOUBLE) END AS thickness FROM part""")
def engineering_formulas(spark, d):
    f = numeric.FORMULAS
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return t(spark, d, "part").select(
        "p_partkey", fixed(f["next_interval"].fn(size), 4).alias("next_interval"), fixed(f["required_thickness"].fn(size, price, F.lit(100.0), F.lit(0.85)), 4).alias("thickness")
    )


def _wilson_sql(c: str, n: str) -> tuple[str, str]:
    p, z2 = f"({c}::DOUBLE / {n})", "(1.96::DOUBLE * 1.96)"
    centre = f"({p} + {z2} / (2 * {n}))"
    half = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n}::DOUBLE * {n})))"
    scale = f"(1 + {z2} / {n})"
    six = lambda x: f"CAST(CAST({x} AS DECIMAL(30,6)) AS DOUBLE)"
    return six(f"greatest(0, ({centre} - {half}) / {scale})"), six(f"least(1, ({centre} + {half}) / {scale})")


LOW, HIGH = _wilson_sql("correct", "n")


@query(f"""WITH c AS (SELECT lang AS category, count(*) FILTER (toxic = 0) AS correct, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT category, correct, n, CAST(CAST(correct::DOUBLE / n AS DECIMAL(30,6)) AS DOUBLE) AS accuracy, {LOW} AS low, {HIGH} AS high FROM c""")
def by_category(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    return evaluation.by_category(rows.select(F.col("lang").alias("category"), F.when(F.col("toxic") == 0, "correct").otherwise("wrong").alias("verdict")))


@query("""WITH p AS (SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS prompt, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY conv_id)
SELECT count(*) AS traces, count(DISTINCT prompt) AS prompts, count(DISTINCT roles) AS role_sets, max(turns) AS longest, sum(turns)::BIGINT AS turns FROM p""")
def trace_profile(spark, d):
    return traces.profile(t(spark, d, "conversations"))


@query("SELECT turns, count(*) AS n FROM (SELECT count(*) AS turns FROM conversations GROUP BY conv_id) GROUP BY turns")
def turn_histogram(spark, d):
    return traces.histogram(t(spark, d, "conversations"))


@query("""WITH s AS (SELECT conv_id, turn, role, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations)
SELECT conv_id, NOT coalesce(bool_or(same), false) AS alternates, arg_max(role, turn) = 'assistant' AS ends_on_assistant FROM s GROUP BY conv_id""")
def role_alternation(spark, d):
    return traces.alternation(t(spark, d, "conversations"))


@query("""SELECT * EXCLUDE role FROM (SELECT conv_id, turn, role, count(*) OVER w AS n_before, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars_before FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""")
def prediction_prefixes(spark, d):
    return traces.prefixes(t(spark, d, "conversations"))


SPLIT = """s AS (SELECT conv_id, prompt, CASE WHEN ('0x' || substr(md5(coalesce(prompt, '')), 1, 6))::BIGINT % 5 = 0 THEN 'eval' ELSE 'train' END AS side
FROM (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations GROUP BY conv_id))"""


@query(f"WITH {SPLIT} SELECT conv_id, side FROM s")
def prompt_grouped_split(spark, d):
    return traces.split_by_prompt(t(spark, d, "conversations")).select("conv_id", "side")


@query("SELECT text AS prompt FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 = 0")
def leak_check(spark, d):
    """A split by id, which leaves copies on both sides."""
    side = F.when(F.col("doc_id") % 5 == 0, "eval").otherwise("train")
    return traces.leaked(t(spark, d, "documents").select(F.col("text").alias("prompt"), side.alias("side")))


@query(f"WITH {SPLIT} SELECT count(*) AS leaked FROM (SELECT prompt FROM s WHERE side = 'train' INTERSECT SELECT prompt FROM s WHERE side = 'eval')")
def leak_free_split(spark, d):
    """A split by prompt has none."""
    return traces.leaked(traces.split_by_prompt(t(spark, d, "conversations"))).agg(F.count(F.lit(1)).alias("leaked"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe(spark, d):
    return traces.exact_dedupe(t(spark, d, "documents"), F.col("text"), "doc_id")


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, greatest(1, count(*) OVER () // 96) AS stride FROM events)
SELECT event_id FROM r WHERE n % stride = 0 AND n < 96 * stride""")
def strided_sample(spark, d):
    return traces.strided(t(spark, d, "events").select("event_id"), "event_id", 96)


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS c FROM events)
SELECT event_id FROM r WHERE n % (CASE WHEN c > 400 THEN c // 400 + 1 ELSE 1 END) = 0 OR n = c - 1""")
def downsample(spark, d):
    return traces.downsampled(t(spark, d, "events").select("event_id"), "event_id")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(generate_series(0, len(h) - 1))::INT AS ord, unnest(h) AS href FROM l""")
def link_extract(spark, d):
    return links.hrefs(t(spark, d, "pages")).drop("url")


@query(r"""WITH p AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)', 1), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'index' ELSE left(lower(s), 80) END || CASE WHEN lower(url) LIKE '%.pdf' THEN '.pdf' ELSE '.html' END AS file, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM p""")
def fetch_manifest(spark, d):
    """K10, F18, F33, F35"""
    return links.manifest(t(spark, d, "pages")).select("page_id", "file", F.col("bytes").cast("long").alias("bytes"), "sha256")


def _metrics(spark, d):
    e = t(spark, d, "events")
    return e.select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), F.col("event_id").cast("double").alias("t"), F.lit(200_000).cast("long").alias("total_steps"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 5 == 0, F.col("user_id") % 60 / 10).alias("vram_gb"),
    )


METRICS = "m AS (SELECT event_type AS run_id, event_id AS step, event_id::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN value END AS loss, CASE WHEN event_id % 5 = 0 THEN (user_id % 60) / 10.0::DOUBLE END AS vram_gb FROM events)"
HMS = lambda x: f"CASE WHEN {x} <= 0 THEN '--' WHEN {x} >= 3600 THEN floor({x} / 3600)::BIGINT || 'h ' || lpad(floor({x} % 3600 / 60)::BIGINT::VARCHAR, 2, '0') || 'm' ELSE floor({x} / 60)::BIGINT || 'm ' || lpad(floor({x} % 60)::BIGINT::VARCHAR, 2, '0') || 's' END"
TILES = f"""ti AS (SELECT run_id, arg_min(loss, step) FILTER (loss IS NOT NULL) AS first_loss, arg_max(loss, step) FILTER (loss IS NOT NULL) AS last_loss, max(coalesce(vram_gb, 0)) AS peak_gb,
max(step) AS step, max(t) AS elapsed, 200000::BIGINT AS total_steps, CASE WHEN max(coalesce(vram_gb, 0)) = 0 THEN 'none' WHEN max(vram_gb) > 5.2 THEN 'over' WHEN max(vram_gb) > 4.8 THEN 'near' ELSE 'ok' END AS band,
CAST(CAST(max(t) / nullif(max(step), 0) AS DECIMAL(30,6)) AS DOUBLE) AS per_step, CAST(CAST(100.0::DOUBLE * max(step) / 200000 AS DECIMAL(30,2)) AS DOUBLE) AS pct,
{HMS('(max(t) / nullif(max(step), 0) * (200000 - max(step)))')} AS eta FROM m GROUP BY run_id)"""


@query(f"WITH {METRICS} SELECT run_id, step, loss AS value FROM m WHERE loss IS NOT NULL")
def metric_series(spark, d):
    return runstats.series(_metrics(spark, d), "loss")


@query(f"WITH {METRICS}, {TILES} SELECT * FROM ti")
def run_tiles(spark, d):
    return runstats.tiles(_metrics(spark, d))


@query(f"""WITH {METRICS}, {TILES} SELECT run_id, config, CASE WHEN run_id IN ('click', 'view') THEN 'done' ELSE 'running' END AS status, last_loss, coalesce(peak_gb, 0) AS peak_gb
FROM (SELECT DISTINCT event_type AS run_id, 'model ' || event_type AS config FROM events UNION ALL VALUES ('unstarted', 'none')) LEFT JOIN ti USING (run_id)""")
def run_index(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("run_id")).distinct()
    configs = e.select("run_id", F.concat(F.lit("model "), "run_id").alias("config")).union(spark.createDataFrame([("unstarted", "none")], "run_id string, config string"))
    summaries = e.where(F.col("run_id").isin("click", "view")).select("run_id", F.lit("done").alias("status"))
    return runstats.run_index(configs, summaries, _metrics(spark, d))


@query(f"WITH {METRICS} SELECT CASE WHEN coalesce(vram_gb, 0) = 0 THEN 'none' WHEN vram_gb > 5.2 THEN 'over' WHEN vram_gb > 4.8 THEN 'near' ELSE 'ok' END AS band, count(*) AS n FROM m GROUP BY 1")
def vram_bands(spark, d):
    return _metrics(spark, d).groupBy(runstats.band(F.col("vram_gb")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {METRICS} SELECT run_id, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM m) WHERE r <= 40")
def last_metric_rows(spark, d):
    return runstats.last_rows(_metrics(spark, d)).select("run_id", "step")


@query("""WITH s AS (SELECT user_id AS run_id, event_id AS step, sum(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events)
SELECT run_id, min(step) AS step FROM s WHERE spent >= 500 GROUP BY run_id""")
def token_budget(spark, d):
    steps = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.rint("value").cast("long").alias("tokens"))
    return traces.budget_crossing(steps, 500)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, CAST(CAST(sum(value) AS DECIMAL(18,4)) AS DOUBLE) AS total FROM events GROUP BY ALL")
def events_stream_tumbling(spark, d):
    """An extension; the batch twin of the stream."""
    return logs.tumbling(t(spark, d, "events"))


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 6000) || ' [cut]' ELSE text END AS text FROM documents")
def text_truncation(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 6000, " [cut]").alias("text"))


@query(r"SELECT page_id, left(lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 80) AS slug FROM pages")
def slugs(spark, d):
    return t(spark, d, "pages").select("page_id", text.slug(F.col("url"), 80).alias("slug"))


from loomspark.plans import checks  # noqa: E402, F401  registers its queries
