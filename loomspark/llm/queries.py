"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, chat_format, decontaminate, langid, license_scan, quality, sharding, simhash, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod n; of a null id as of an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    odd = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    turns = chat_format.canonical_turns(rows, F.to_variant_object(F.struct("role", "text")), ["conv_id", "turn"])
    out = chat_format.format_turns(turns, "conv_id", ["turn", "part"])
    read = out.select("conv_id", "formatted", "loss_mask", chat_format.read_turns(F.col("formatted")).alias("turns"))
    loss = chat_format.masked_text(F.col("formatted"), F.col("loss_mask"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)', '\1\2\\\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)', '\1\2\\\3', 'g') AS t
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(r) + length('<|im_sep|>') + length(t) + length('<|im_end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 3) -> DataFrame:
    """Documents arrive in turn, are compacted and read back through the manifest: every row as it was, its text as a digest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, target_bytes=64 << 20, fanout=4)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
    version = store.compact()["version"]
    store.vacuum()
    return store.read(version).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


OP3_SQL = "SELECT * EXCLUDE (text), sha256(text) AS text_sha256 FROM documents"


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    words = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return found.select("doc_id", words("repeated").alias("repeated_words"), words("removed").alias("removed_words"), shown("repeated").alias("repeated"), shown("removed").alias("removed"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
p AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM n),
c AS (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS copies, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS later FROM p),
w AS (SELECT doc_id, s + unnest(range(50)) AS word, later FROM c WHERE copies > 1),
k AS (SELECT doc_id, word, bool_and(later) AS removed FROM w GROUP BY ALL),
i AS (SELECT doc_id, word, removed, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS run, word - row_number() OVER (PARTITION BY doc_id, removed ORDER BY word) AS part FROM k),
a AS (SELECT doc_id, min(word) AS s, max(word) + 1 AS e FROM i GROUP BY doc_id, run), r AS (SELECT doc_id, min(word) AS s, max(word) + 1 AS e FROM i WHERE removed GROUP BY doc_id, part),
x AS (SELECT doc_id, sum(e - s)::BIGINT AS repeated_words, string_agg(s || '-' || e, ',' ORDER BY s) AS repeated FROM a GROUP BY doc_id),
y AS (SELECT doc_id, sum(e - s)::BIGINT AS removed_words, string_agg(s || '-' || e, ',' ORDER BY s) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, repeated_words, coalesce(removed_words, 0) AS removed_words, repeated, coalesce(removed, '') AS removed FROM x LEFT JOIN y USING (doc_id)
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold(3) != 1))
    return langid.identify(docs, model, [F.col("doc_id"), (fold(3) == 1).alias("held_out")])


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, fold(5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    """The definition of spans in SQL; texts of phrases and templates are those of the operator."""
    rows = [(i, label, "true", body) for i, (body, label) in enumerate(license_scan.PHRASES.items())]
    rows += [(len(license_scan.PHRASES) + i, label, "false", body) for i, (label, body) in enumerate(license_scan.TEMPLATES)]
    values = ", ".join(f"({i}, '{label}', {phrase}, '{body}')" for i, label, phrase, body in rows)
    return rf"""
WITH tw AS (SELECT template, label, phrase, string_split(body, ' ') AS w FROM (VALUES {values}) x(template, label, phrase, body)),
tg AS (SELECT template, label, phrase, len(w) AS size, unnest(range(len(w) - 1)) AS t, unnest(w[:-2]) AS one, unnest(w[2:]) AS two FROM tw),
d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT uid, unnest(range(len(w) - 1)) AS p, unnest(w[:-2]) AS one, unnest(w[2:]) AS two FROM d WHERE len(w) > 1),
v AS (SELECT uid, template, label, phrase, size, p - t AS diag, bit_or(1::BIGINT << t::INT) AS held, min(p) AS low, max(p) AS high FROM g JOIN tg USING (one, two) GROUP BY ALL),
m AS (SELECT uid, template, label, size, diag, bit_count(bit_or(held) OVER near) AS votes FROM v WHERE NOT phrase WINDOW near AS (PARTITION BY uid, template ORDER BY diag RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
n AS (SELECT *, votes::DOUBLE / (size - 1) AS share, votes::BIGINT * 1000000000 - diag AS own, round(votes * 1e9 / (size - 1))::HUGEINT * 1000000 + votes * 1000 - template AS among FROM m WHERE votes::DOUBLE / (size - 1) >= 0.7),
b AS (SELECT *, own = max(own) OVER (PARTITION BY uid, template ORDER BY 2.0::DOUBLE * diag / (2 * size - 1) RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS first,
  among = max(among) OVER (PARTITION BY uid ORDER BY diag RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS fits FROM n),
s AS (SELECT uid, label, diag AS start, true AS base, 1.0::DOUBLE AS share FROM v WHERE phrase AND bit_count(held) = size - 1 UNION ALL SELECT uid, label, NULL, false, share FROM b WHERE first AND fits),
a AS (SELECT uid, count(*) FILTER (base) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score, count(*) AS n_spans FROM s GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score,
  coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN a USING (uid)"""


OP7_SQL = _op7_sql()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_langid": op5_langid,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op3_sharding": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op7_license_scan": OP7_SQL}
