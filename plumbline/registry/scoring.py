"""Scores, the decision rule, evaluation, action list, score reuse, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key
from plumbline.functions.labels import recode_stars
from plumbline.functions.scores import decide, round_to, softmax_argmax
from plumbline.operators.actions import action_rows
from plumbline.operators.cache import cache_hit, cache_miss
from plumbline.operators.evaluate import confusion_matrix, evaluate_overall, evaluate_per_class, evaluation_report
from plumbline.operators.prepare import with_text
from plumbline.operators.scoring import INPUT_LABEL, PipelineScorer, ensemble_join, predict, score, train_classifier
from plumbline.operators.split import stratified_split
from plumbline.plans.small import likely
from plumbline.plans.views import customers, event_rows, logits, reviews, rows_of, scores, table
from plumbline.registry.prepare import labelled_rows
from plumbline.registry.sql import with_views
from plumbline.session import work_path
from plumbline.sources.results import export_results


def softmaxed(spark, sf):
    df = logits(spark, sf).withColumn("logits", F.array("s0", "s1", "s2"))
    out = df.withColumn("r", softmax_argmax("logits"))
    return out.select(
        "row_id",
        *[round_to(F.get("r.probs", F.lit(i)), 6).alias(f"p{i}") for i in range(3)],
        "r.pred",
        round_to("r.confidence", 6).alias("confidence"),
    )


def decided(spark, sf):
    return decide(scores(spark, sf)).select("row_id", "label", "sentiment", "confidence", "model_used")


def joined(spark, sf):
    both = scores(spark, sf)
    first = both.select("row_id", F.col("social_pred").alias("pred"), F.col("social_conf").alias("confidence"))
    second = both.select("row_id", F.col("reviews_pred").alias("pred"), F.col("reviews_conf").alias("confidence"))
    return ensemble_join(first, second).select(
        "row_id", "social_pred", round_to("social_conf", 6).alias("social_conf"),
        "reviews_pred", round_to("reviews_conf", 6).alias("reviews_conf"),
    )


def crm_actions(spark, sf):
    """The list is drawn first; only its rows, capped in number, meet texts and customers."""
    top = action_rows(event_rows(spark, sf))
    people, texts = customers(spark, sf), table(spark, sf, "documents")
    listed = top.withColumn("customer_id", F.col("row_id") % rows_of(people)).withColumn(
        "doc_id", F.col("row_id") % rows_of(texts)
    )
    # At most 1,000 rows, so they are the side to broadcast.
    with_people = people.join(F.broadcast(listed), "customer_id")
    return (
        texts.select("doc_id", "text")
        .join(F.broadcast(with_people), "doc_id")
        .select("rank", "row_id", "customer_id", "customer_name", "text", "sentiment", "confidence", "model_used")
    )


def cached_scores(spark, sf):
    """Scores that exist already: one per distinct text of the labelled documents."""
    docs = table(spark, sf, "documents").select("doc_id", content_key("text").alias("content_key"))
    marks = table(spark, sf, "labels").join(docs, "doc_id")
    return marks.groupBy("content_key").agg(F.max("quality").alias("quality"))


def missed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cache_miss(docs, cached_scores(spark, sf), "doc_id")


def hit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cache_hit(docs, cached_scores(spark, sf), "doc_id").select("doc_id", "content_key", "quality")


def judged(spark, sf):
    """Ensemble decisions next to the labels of the reviews."""
    truth = reviews(spark, sf).select(F.col("doc_id").alias("row_id"), recode_stars("stars").alias("truth"))
    return decided(spark, sf).join(truth, "row_id").select(F.col("truth").alias("label"), F.col("label").alias("pred"))


def matrix(spark, sf):
    return confusion_matrix(judged(spark, sf))


def overall(spark, sf):
    return evaluate_overall(matrix(spark, sf)).select("metric", round_to("value", 6).alias("value"))


def per_class(spark, sf):
    return evaluate_per_class(matrix(spark, sf)).select(
        "class", round_to("precision", 6).alias("precision"), round_to("recall", 6).alias("recall")
    )


def report(spark, sf):
    return evaluation_report(judged(spark, sf))


def training_split(spark, sf):
    """Labelled ids with their split."""
    return stratified_split(labelled_rows(spark, sf), "doc_id", "label", holdout=0.2, test_share=0.5)


def with_texts(spark, sf, rows):
    """Rows with the texts of their documents; of the texts only those in demand are shuffled."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rows.join(likely(docs, rows, "doc_id"), "doc_id")


def train_eval(spark, sf):
    split = training_split(spark, sf)
    train, held = split.where(F.col("split") == "train"), split.where(F.col("split") != "train")
    model = train_classifier(with_texts(spark, sf, train))
    test = score(with_texts(spark, sf, held), {"tuned": PipelineScorer(model)})
    return evaluation_report(test, "label", "tuned_pred")


def scored_texts(spark, sf):
    """All documents scored by two classifiers trained on different labels, then decided."""
    rows = training_split(spark, sf).where(F.col("split") == "train")
    marks = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2).alias("mark"))
    social = train_classifier(with_texts(spark, sf, rows), max_iter=10)
    review = train_classifier(with_texts(spark, sf, rows.join(marks, "doc_id")), label_col="mark", max_iter=10)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scorers = {"social": PipelineScorer(social), "reviews": PipelineScorer(review)}
    return predict(docs, scorers).select("doc_id", "sentiment", "label", "confidence", "model_used")


_CACHED = """
keyed as (select doc_id, text, sha256(text) as content_key from documents),
cached as (select content_key, max(quality) as quality from labels join keyed using (doc_id) group by 1)"""

_JUDGED = """
judged as (
  select cast(case when 1 + row_id % 5 <= 2 then 0 when 1 + row_id % 5 = 3 then 1 else 2 end as int) as label, label as pred
  from v_decided
)"""

_CLASSES = _JUDGED + """,
classes as (
  select c as class, count(*) filter (where label = c) as support, count(*) filter (where pred = c) as predicted,
    count(*) filter (where label = c and pred = c) as hits
  from judged, (select unnest([0, 1, 2]) as c) group by c
),
overall as (
  select sum(hits)::double / sum(support)::double as accuracy,
    sum(coalesce(2::double * hits / nullif(support + predicted, 0), 0) * support) / sum(support)::double as f1
  from classes
)"""

def export_columns(spark, sf):
    """An upload with a label of its own, its text in the first column, through the export and back."""
    upload = table(spark, sf, "documents").select(
        F.col("text").alias("review"), "doc_id", F.col("source").alias("label"), F.lit("theirs").alias("confidence")
    )
    decided_ = with_text(upload).drop("confidence").withColumnRenamed("label", INPUT_LABEL)
    scored = decided_.withColumns(
        {"sentiment": F.lit("neutral"), "label": F.lit(1), "confidence": F.lit(0.5), "model_used": F.lit("social")}
    )
    path = work_path(spark, "export")
    export_results(scored, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("doc_id").cast("long"), "review", "label", "sentiment", F.col("confidence").cast("double"), "model_used")


ENTRIES = {
    "export_columns": (
        export_columns,
        """select doc_id, text as review, source as label, 'neutral' as sentiment, 0.5::double as confidence, 'social' as model_used
        from documents""",
    ),
    "softmax_argmax": (
        softmaxed,
        with_views(
            ["v_scores"],
            "select row_id, "
            + ", ".join(f"round(exp(s{i}) / (exp(s0) + exp(s1) + exp(s2)), 6) as p{i}" for i in range(3))
            + ", social_pred as pred, round(social_conf, 6) as confidence from v_scores join v_logits using (row_id)",
        ),
    ),
    "ensemble_decide": (
        decided,
        with_views(["v_decided"], "select row_id, label, sentiment, confidence, model_used from v_decided"),
    ),
    "ensemble_join": (
        joined,
        with_views(
            ["v_scores"],
            "select row_id, social_pred, round(social_conf, 6) as social_conf, reviews_pred, round(reviews_conf, 6) as reviews_conf from v_scores",
        ),
    ),
    "crm_action_list": (
        crm_actions,
        with_views(
            ["v_predictions"],
            """select cast(r as int) as rank, row_id, c_custkey as customer_id, c_name as customer_name, text, sentiment, confidence, model_used
            from (select *, row_number() over (order by confidence desc, row_id) as r, count(*) over () as n
                  from v_predictions where sentiment = 'negative')
            join customer on c_custkey = row_id % (select count(*) from customer)
            where r <= least(1000, greatest(1, ceil(n * 0.1::double)))""",
        ),
    ),
    "score_cache_miss": (
        missed,
        "with " + _CACHED.strip() + " select min(doc_id) as doc_id, text, content_key from keyed where content_key not in (select content_key from cached) group by all",
    ),
    "score_cache_hit": (
        hit,
        "with " + _CACHED.strip() + " select doc_id, content_key, quality from keyed join cached using (content_key)",
    ),
    "confusion_matrix": (
        matrix,
        with_views(["v_decided"], "select label, pred, count(*) as n from judged group by all", _JUDGED),
    ),
    "eval_overall": (
        overall,
        with_views(
            ["v_decided"],
            "select 'test_accuracy' as metric, round(accuracy, 6) as value from overall union all select 'test_f1', round(f1, 6) from overall",
            _CLASSES,
        ),
    ),
    "eval_per_class": (
        per_class,
        with_views(
            ["v_decided"],
            """select cast(class as int) as class, round(coalesce(hits::double / nullif(predicted, 0), 0), 6) as precision,
            round(coalesce(hits::double / nullif(support, 0), 0), 6) as recall from classes""",
            _CLASSES,
        ),
    ),
    "evaluation_report": (
        report,
        with_views(
            ["v_decided"],
            """select 'test_accuracy' as metric, cast(null as int) as class, round(accuracy, 4) as value from overall
            union all select 'test_f1', null, round(f1, 4) from overall
            union all select 'precision', cast(class as int), round(coalesce(hits::double / nullif(predicted, 0), 0), 4) from classes
            union all select 'recall', cast(class as int), round(coalesce(hits::double / nullif(support, 0), 0), 4) from classes""",
            _CLASSES,
        ),
    ),
    "train_eval": (train_eval, None),
    "score_text": (scored_texts, None),
}
