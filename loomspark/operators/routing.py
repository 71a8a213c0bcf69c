"""Text classification by centroids, blending, overrides, hold-outs and the routing decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.numeric import dot, fixed
from loomspark.functions.text import est_ctx, modality, router_features
from loomspark.operators.retrieval import positions
from loomspark.sources.scratch import materialise

#: Patterns that ask for code, name repairs, spreadsheets and documents, the routes they leave, and the reasons given.
RUN_VERB = r"(?i)\b(run|execute|debug|traceback)\b"
CODE_NOUN = r"(?i)\b(script|code|program|python|snippet|function|pytest|unit tests?|stack trace)\b"
REPAIR = r"(?i)\b(fix|fixed|repair|debug|broken|breaks|crash(es|ed)?|bug|wrong|error|fails?|failing|hangs?|patch|correct)\b"
SHEET = r"(?i)\.xlsx\b|\bexcel\b|\bspreadsheet\b"
DOCUMENT = r"(?i)\.docx\b|\bword document\b"
VISION_ROUTES = ["scan_understanding", "drawing_qa", "handwriting"]
DOCUMENT_ROUTES = ["approval_note", "summarize"]
CODE_REASON = "run/execute + code noun -> code routes only"
SHEET_REASON = "explicit .xlsx/spreadsheet -> spreadsheet deliverable"
DOCUMENT_REASON = "explicit .docx -> document deliverable routes only"


def features(docs: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """key, label, term, tf; written once, as centroids, weights and scores all read it. Texts are dealt out by key, so their many terms are counted where they are."""
    dealt = docs.select(F.col(key).alias("id"), F.col(label).alias("label"), F.coalesce("text", F.lit("")).alias("text")).repartition("id")
    each = dealt.select("id", "label", F.explode(router_features(F.col("text"))).alias("term"))
    return materialise(each.groupBy("id", "label", "term").agg(F.count(F.lit(1)).alias("tf")), "features")


def frequencies(docs: DataFrame, label: str) -> DataFrame:
    """A1, A2: term, label, d (documents that hold it): distinct within a document without any shuffle, so only counts are sent."""
    terms = docs.select(F.col(label).alias("label"), F.explode(F.array_distinct(router_features(F.coalesce("text", F.lit(""))))).alias("term"))
    return terms.groupBy("term", "label").agg(F.count(F.lit(1)).alias("d"))


def idf(freqs: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """A1-A3: term, df, cf, idf = (ln((N + 1) / (df + 1)) + 1) (ln(C / cf) + 1), of ``frequencies``."""
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(label)).alias("c"))
    terms = freqs.groupBy("term").agg(F.sum("d").alias("df"), F.count(F.lit(1)).alias("cf"))
    value = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * (F.log(F.col("c") / F.col("cf")) + 1)
    return terms.join(F.broadcast(totals)).select("term", "df", "cf", value.alias("idf"))


def centroids(feats: DataFrame, weights: DataFrame) -> DataFrame:
    """A4: label, term, weight of unit length."""
    sums = feats.groupBy("label", "term").agg(F.sum(1 + F.log("tf")).alias("s")).join(weights.select("term", "idf"), "term")
    raw = sums.select("label", "term", (F.col("s") * F.col("idf")).alias("w"))
    norm = raw.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "label").select("label", "term", (F.col("w") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("weight"))


def classes(cents: DataFrame, most: int = 1000) -> list:
    """The labels of a classifier, in order: a row each, on the driver; ValueError beyond ``most``."""
    labels = [r["label"] for r in cents.select("label").distinct().limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"more than {most} classes")
    return sorted(labels, key=lambda x: (x is not None, x))


def lexical_scores(feats: DataFrame, weights: DataFrame, cents: DataFrame) -> DataFrame:
    """Id, label, score for every label, 0 without a common term.

    A term's idf and its weights in all classes are one row, so the features are joined once; a document's norm and its products with
    all classes are sums of one aggregation, with partial sums before anything is sent.
    """
    labels = classes(cents)
    by_class = cents.groupBy("term").pivot("label", labels).agg(F.first("weight")) if labels else cents.select("term").distinct()
    by_class = by_class.toDF("term", *[f"_w{i}" for i in range(len(labels))])
    model = weights.select("term", "idf").join(by_class, "term", "left")
    w = (1 + F.log("tf")) * F.col("idf")
    sums = [F.sum(w * F.coalesce(f"_w{i}", F.lit(0.0))).alias(f"_s{i}") for i in range(len(labels))]
    each = feats.join(model, "term").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"), *sums)
    scored = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_s{i}").alias("s")) for i, x in enumerate(labels)])
    each = each.select("id", "norm", F.explode(scored).alias("c"))
    return each.select("id", "c.label", fixed(F.col("c.s") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 4).alias("score"))


def best_label(scores: DataFrame, key: str = "id", default: str = "qa") -> DataFrame:
    """Largest score, then the first label; no candidate: the default."""
    return scores.groupBy(key).agg(F.coalesce(F.min_by(F.col("label").cast("string"), F.struct(-F.col("score"), F.col("label"))), F.lit(default)).alias("predicted"))


def runner_up(scores: DataFrame, key: str = "id") -> DataFrame:
    """The two best labels with their scores."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "label")
    two = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    return two.groupBy(key).agg(pick(1, "label").alias("first"), pick(1, "score").alias("first_score"), pick(2, "label").alias("second"), pick(2, "score").alias("second_score"))


def dense_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """A5: label, pos, weight: the mean by element, of unit length."""
    mean = vectors.select(label, F.posexplode("embedding").alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, label).select(F.col(label).alias("label"), "pos", (F.col("m") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("weight"))


def as_vectors(cents: DataFrame) -> DataFrame:
    return cents.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "weight"))), lambda x: x["weight"]).alias("centroid"))


def dense_scores(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", most: int = 1000) -> DataFrame:
    """key, label, score: every vector against every class; classes are broadcast, ``most`` of them at most."""
    classes(cents, most)
    return vectors.select(key, "embedding").join(F.broadcast(as_vectors(cents))).select(F.col(key).alias("id"), "label", fixed(dot(F.col("embedding"), F.col("centroid")), 4).alias("score"))


def zscores(scores: DataFrame, key: str = "id") -> DataFrame:
    """Over the labels of a query; population deviation, 0 where it is below 1e-9."""
    w = W.partitionBy(key)
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    return scores.withColumn("z", F.when(sd < 1e-9, 0.0).otherwise((F.col("score") - mean) / F.when(sd >= 1e-9, sd)))


def blend(lexical: DataFrame, dense: DataFrame, weight: float = 0.8, key: str = "id") -> DataFrame:
    """Union of labels; what one side lacks counts 0."""
    a, b = zscores(lexical, key).select(key, "label", F.col("z").alias("a")), zscores(dense, key).select(key, "label", F.col("z").alias("b"))
    both = a.join(b, [key, "label"], "full")
    return both.select(key, "label", fixed((1 - weight) * F.coalesce("a", F.lit(0.0)) + weight * F.coalesce("b", F.lit(0.0)), 4).alias("score"))


def stratified_split(rows: DataFrame, label: str, order: str, every: int = 3) -> DataFrame:
    """Within a class, each third row in order is held out; no class is gathered in one task."""
    out = positions(rows.select(order, label), [F.col(label), F.col(order)], [label])
    return out.select(order, label, (F.col("position") % every == 0).alias("held_out"))


def loo_scores(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Cosine of each row with each class's mean, its own row taken out of its own class by subtraction."""
    dims = vectors.select(key, "label", F.posexplode("embedding").alias("pos", "x"))
    sums = dims.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda v: v["s"]).alias("sum"))
    classes(sums)
    own = vectors.select(F.col(key).alias("id"), F.col("label").alias("want"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pairs = own.join(F.broadcast(sums))
    rest = F.when(F.col("want") == F.col("label"), F.zip_with("sum", "e", lambda s, x: s - x)).otherwise(F.col("sum"))
    scored = pairs.select("id", "want", "label", "e", rest.alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return scored.select("id", "want", "label", fixed(F.when(norm > 0, dot(F.col("e"), F.col("c")) / F.when(norm > 0, norm)).otherwise(0.0), 4).alias("score"))


def overrides(prompts: DataFrame) -> DataFrame:
    """Prompt, modality, allowed (null: all), reason; the first rule that holds wins."""
    p = F.col("prompt")
    code = F.regexp_like(p, F.lit(RUN_VERB)) & F.regexp_like(p, F.lit(CODE_NOUN))
    kind = modality(F.col("files"))
    rules: list[tuple[Column, list[str], Column]] = [
        (kind != "text", VISION_ROUTES, F.concat(kind, F.lit(" attached -> vision routes only"))),
        (code & F.regexp_like(p, F.lit(REPAIR)), ["code_fix", "code_write"], F.lit(CODE_REASON)),
        (code, ["code_write"], F.lit(CODE_REASON)),
        (F.regexp_like(p, F.lit(SHEET)), ["spreadsheet"], F.lit(SHEET_REASON)),
        (F.regexp_like(p, F.lit(DOCUMENT)), DOCUMENT_ROUTES, F.lit(DOCUMENT_REASON)),
    ]
    allowed, reason = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for cond, labels, why in reversed(rules):
        allowed = F.when(cond, F.array(*map(F.lit, labels))).otherwise(allowed)
        reason = F.when(cond, why).otherwise(reason)
    return prompts.select("prompt", kind.alias("modality"), allowed.alias("allowed"), reason.alias("reason"))


def restricted(scores: DataFrame, allowed: str = "allowed") -> DataFrame:
    """P4"""
    return scores.where(F.col(allowed).isNull() | F.array_contains(allowed, F.col("label")))


def two_digits(score: Column) -> Column:
    return score.cast("decimal(30,2)").cast("string")


def decisions(routed: DataFrame) -> DataFrame:
    """est_ctx, swap_required and the reason line.

    Needs prompt, files, first and first_score, second and second_score (null: one candidate), model_id, resident (null: none), and for the
    notes override, used_fallback, max_ctx and requires_tools (array).
    """
    kind, model = modality(F.col("files")), F.col("model_id")
    pdfs = F.size(F.filter("files", lambda f: F.endswith(F.lower(f), F.lit(".pdf"))))
    ctx = est_ctx(F.col("prompt"), pdfs, F.size("files") - pdfs)
    swap = F.col("resident").isNotNull() & (F.col("resident") != model)
    how = F.when(F.col("resident").isNull(), "cold start").when(swap, F.concat(F.lit("swap from "), "resident")).otherwise("resident")
    rival = F.concat(F.lit(" vs "), "second", F.lit(" "), two_digits(F.col("second_score")))
    head = F.concat("first", F.lit(" ("), two_digits(F.col("first_score")), F.coalesce(rival, F.lit("")), F.lit(")"))
    notes = F.concat_ws(
        "; ", "override", F.when(F.col("used_fallback"), F.concat(F.lit("no model declares '"), "first", F.lit("', fell back to "), model)),
        F.when(ctx > F.col("max_ctx"), F.concat(F.lit("est_ctx exceeds max_ctx "), F.col("max_ctx").cast("string"), F.lit(", retrieval must truncate"))),
        F.when(F.size("requires_tools") > 0, F.concat(F.lit("requires "), F.array_join("requires_tools", ", "))),
    )
    line = F.concat_ws(
        " · ", head, F.when(kind == "text", "image absent").otherwise(F.concat(kind, F.lit(" attached"))),
        F.concat((ctx / 1000).cast("decimal(30,1)").cast("string"), F.lit("k ctx")), F.concat(F.lit("-> "), model, F.lit(" ["), how, F.lit("]")), F.nullif(notes, F.lit("")),
    )
    return routed.select("*", ctx.alias("est_ctx"), swap.alias("swap_required"), line.alias("decision"))


def best_weight(swept: DataFrame) -> DataFrame:
    """Of weight and correct, the smallest weight among the best."""
    return swept.agg(F.min_by("weight", F.struct(-F.col("correct"), F.col("weight"))).alias("weight"), F.max("correct").alias("correct"))


#: A scorer gives id, label, score; documents come with id, text and what the scorer needs.
Scorer = Callable[[DataFrame], DataFrame]


def lexical_scorer(labelled: DataFrame, label: str, key: str = "doc_id") -> Scorer:
    """Scores texts by the centroids of labelled ones."""
    freqs = materialise(frequencies(labelled, label), "frequencies")
    weights = materialise(idf(freqs, labelled, label), "idf")
    cents = materialise(centroids(features(labelled, label, key), weights), "centroids")

    def score(docs: DataFrame) -> DataFrame:
        return lexical_scores(features(docs.withColumn("_label", F.lit(None).cast("string")), "_label", key), weights, cents)

    return score


def dense_scorer(labelled: DataFrame, key: str = "vec_id") -> Scorer:
    """Scores vectors by the centroids of labelled ones."""
    cents = materialise(dense_centroids(labelled), "centroids")
    return lambda vectors: dense_scores(vectors, cents, key)


def hybrid_scorer(lexical: Scorer, encoded: Callable[[DataFrame], DataFrame | None], dense: Scorer, weight: float = 0.8) -> Scorer:
    """``encoded`` turns documents into vectors; where it gives None (no weights are at hand), the lexical scores stand alone."""

    def score(docs: DataFrame) -> DataFrame:
        vectors = encoded(docs)
        return lexical(docs) if vectors is None else blend(lexical(docs), dense(vectors), weight)

    return score


def lexical_loo(rows: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """Id, want, label, score of each text against idf and centroids that are fitted without it; every class needs two texts.

    Without a text, N and the df of its terms are one less, a term's cf too if only this text held it in its class, and the class's sum loses
    the text's part. Terms that the text doesn't hold have the same idf whichever text is left out, so a class's squared norm is that of these
    weights, corrected on the text's own terms: all of it is one join by term and one aggregation by text.
    """
    if small := [r[label] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where("n < 2").limit(1).collect()]:
        raise ValueError(f"class {small[0]} has one text only")
    feats = features(rows, label, key)
    by_class = materialise(feats.groupBy("label", "term").agg(F.sum(1 + F.log("tf")).alias("s"), F.count(F.lit(1)).alias("d")), "classes")
    labels = classes(by_class)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    value = lambda df, cf: (F.log(F.col("n") / (df + 1)) + 1) * (F.log(F.lit(float(len(labels))) / cf) + 1)
    terms = by_class.groupBy("term").agg(
        F.sum("d").alias("df"), F.count(F.lit(1)).alias("cf"),
        *[F.sum(F.when(F.col("label").eqNullSafe(F.lit(x)), F.col(c))).alias(f"_{c}{i}") for c in ("s", "d") for i, x in enumerate(labels)],
    )
    terms = terms.join(F.broadcast(total)).withColumn("idf", value(F.col("df"), F.col("cf")))
    terms = materialise(terms, "terms")
    part = lambda i: F.coalesce(f"_s{i}", F.lit(0.0))
    squares = terms.agg(*[F.sum((part(i) * F.col("idf")) ** 2).alias(f"_q{i}") for i in range(len(labels))])
    own = F.lit(0).cast("long")
    for i, x in enumerate(labels):
        own = F.when(F.col("label").eqNullSafe(F.lit(x)), F.col(f"_d{i}")).otherwise(own)
    left = F.when(F.col("df") > 1, value(F.col("df") - 1, F.col("cf") - (own == 1).cast("int"))).otherwise(0.0)
    tf = 1 + F.log("tf")
    each = feats.join(terms, "term").withColumn("_left", left).withColumn("_w", tf * F.col("_left"))
    sums = [F.sqrt(F.sum(F.col("_w") ** 2)).alias("norm"), F.first("label").alias("want")]
    for i, x in enumerate(labels):
        rest = (part(i) - F.when(F.col("label").eqNullSafe(F.lit(x)), tf).otherwise(0.0)) * F.col("_left")
        sums += [F.sum(F.col("_w") * rest).alias(f"_dot{i}"), F.sum(rest ** 2 - (part(i) * F.col("idf")) ** 2).alias(f"_more{i}")]
    out = each.groupBy("id").agg(*sums).join(F.broadcast(squares))
    safe = lambda x: F.when(x > 1e-12, F.sqrt(F.greatest(x, F.lit(1e-12)))).otherwise(1.0)
    scored = [F.struct(F.lit(x).alias("label"), (F.col(f"_dot{i}") / safe(F.col(f"_q{i}") + F.col(f"_more{i}"))).alias("s")) for i, x in enumerate(labels)]
    out = out.select("id", "want", "norm", F.explode(F.array(*scored)).alias("c"))
    return out.select("id", "want", "c.label", fixed(F.col("c.s") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 4).alias("score"))
