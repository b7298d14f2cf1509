"""Text preparation, recoding, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.labels import label_id, label_name, recode_polarity, recode_stars
from plumbline.functions.text import (
    MAX_TOKENS,
    SPACE_PATTERN,
    SPECIAL_PATTERN,
    URL_PATTERN,
    clean_text,
    text_length,
    token_count,
    truncate_tokens,
)
from plumbline.operators.metrics import distinct_values, profile_columns
from plumbline.operators.prepare import drop_missing, to_labelled, upload_text
from plumbline.operators.split import numbered_copies, split_counts, stratified_sample, stratified_split
from plumbline.plans.views import reviews, table
from plumbline.registry.sql import with_views

SAMPLE_ROWS = 300


def upload_text_column(spark, sf):
    first_column = reviews(spark, sf).select(F.col("text").alias("review"), "doc_id", "source")
    return upload_text(first_column)


def recoded_stars(spark, sf):
    return reviews(spark, sf).select("doc_id", "stars", recode_stars("stars").alias("label"))


def recoded_polarity(spark, sf):
    return reviews(spark, sf).select("doc_id", "polarity", recode_polarity("polarity").alias("label"))


def label_names(spark, sf):
    named = reviews(spark, sf).withColumn("label", recode_stars("stars")).withColumn("name", label_name("label"))
    return named.select("doc_id", "label", "name", label_id("name").alias("label_again"))


def dropped_missing(spark, sf):
    return drop_missing(reviews(spark, sf), ["text", "stars"]).select("doc_id", "text", "stars")


def text_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_length("text").alias("text_length"))


def cleaned_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_text("text").alias("clean"))


def cleaned_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean_text("html").alias("clean"))


def labelled_view(spark, sf):
    return to_labelled(drop_missing(reviews(spark, sf), ["text"]), "text", recode_stars("stars"))


def truncated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_tokens("text").alias("text"))


def token_counts(spark, sf):
    parts = [
        table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text"),
        table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"),
    ]
    counted = parts[0].unionByName(parts[1]).withColumn("n_tokens", token_count("text"))
    return counted.select("origin", "id", "part", "n_tokens", F.least("n_tokens", F.lit(MAX_TOKENS)).alias("n_kept"))


def labelled_rows(spark, sf):
    """Supervised labels as three classes."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return table(spark, sf, "labels").select("doc_id", label.cast("int").alias("label"))


def split_rows(spark, sf):
    return stratified_split(labelled_rows(spark, sf), "doc_id", "label", holdout=0.2, test_share=0.5)


def split_reviews(spark, sf):
    df = reviews(spark, sf).select("doc_id", recode_stars("stars").alias("label"))
    return stratified_split(df, "doc_id", "label", holdout=0.01, test_share=0.99)


def split_plain(spark, sf):
    return stratified_split(reviews(spark, sf).select("doc_id"), "doc_id", None, holdout=0.1, test_share=0.5)


def split_content(spark, sf):
    """Texts without ids: numbered by content, so that files and partitions do not matter."""
    docs = table(spark, sf, "documents").select("text", F.coalesce("lang", F.lit("")).alias("label"))
    split = stratified_split(numbered_copies(docs, ["text", "label"], "row_key"), "row_key", "label", holdout=0.2, test_share=0.5)
    return split.select("row_key", "label", "split")


def sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return stratified_sample(docs, "doc_id", SAMPLE_ROWS, ["lang"])


def sample_plain(spark, sf):
    return stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", SAMPLE_ROWS)


def profile(spark, sf):
    return profile_columns(table(spark, sf, "events"))


def social_targets(spark, sf):
    return distinct_values(reviews(spark, sf), "polarity")



def _clean(column: str) -> str:
    out = column
    for pattern in (URL_PATTERN, SPECIAL_PATTERN, SPACE_PATTERN):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out}, ' ')"


_SQUEEZED = f"trim(regexp_replace(text, '{SPACE_PATTERN}', ' ', 'g'), ' ')"
_N_TOKENS = f"cast(case when {_SQUEEZED} = '' then 0 else len(string_split({_SQUEEZED}, ' ')) end as int)"


def _allocate(source: str, target: str, by: str, n: str, quota: str, total: str) -> str:
    """CTE ``target`` = ``source`` with ``quota``: largest remainder of ``total`` over ``n``."""
    order = f"order by rest desc, {by}" if by else "order by rest desc"
    return f"""
{target} as (
  select * exclude (base, rest, t), cast(base + case when row_number() over ({order}) <= t - sum(base) over () then 1 else 0 end as bigint) as {quota}
  from (select *, ({total} * {n}) // nullif(whole_{n}, 0) as base, ({total} * {n}) % nullif(whole_{n}, 0) as rest, {total} as t
        from (select *, cast(sum({n}) over () as bigint) as whole_{n} from {source}))
)"""


def _ranked(source: str, by: str, seed: int = 42) -> str:
    part = f"partition by {by} " if by else ""
    return f"""
ranked as (
  select *, row_number() over ({part}order by md5('{seed}-' || doc_id), doc_id) as r from {source}
)"""


def _split_sql(rows: str, by: str, holdout: float, test: float) -> str:
    group = f"group by {by}" if by else ""
    select = f"{by}, " if by else ""
    join = f"using ({by})" if by else "on true"
    return ", ".join(
        part.strip()
        for part in (
            f"rws as ({rows})",
            f"sizes as (select {select}count(*) as n from rws {group})",
            f"sized as (select *, cast(ceil({holdout}::double * sum(n) over ()) as bigint) as held_total from sizes)",
            _allocate("sized", "q1", by, "n", "held", "held_total"),
            f"q1s as (select *, cast(ceil({test}::double * sum(held) over ()) as bigint) as test_total from q1)",
            _allocate("q1s", "q2", by, "held", "test", "test_total"),
            _ranked("rws", by),
            f"assigned as (select ranked.*, case when r <= test then 'test' when r <= held then 'val' else 'train' end as split "
            f"from ranked join q2 {join})",
        )
    )


_LABEL_ROWS = (
    "select doc_id, cast(case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as int) as label from labels"
)
_CONTENT_ROWS = (
    "select sha256(concat(coalesce(sha256(text), '-'), sha256(label))) || '-' || (row_number() over (partition by text, label) - 1) as doc_id, "
    "label from (select text, coalesce(lang, '') as label from documents)"
)
_STAR_LABEL = "cast(case when 1 + doc_id % 5 <= 2 then 0 when 1 + doc_id % 5 = 3 then 1 else 2 end as int)"


def _sample_sql(by: str) -> str:
    group, select = (f"group by {by}", f"{by}, ") if by else ("", "")
    join = f"using ({by})" if by else "on true"
    return "with " + ", ".join(
        part.strip()
        for part in (
            f"sizes as (select {select}count(*) as n from documents {group})",
            f"sized as (select *, cast(least({SAMPLE_ROWS}, sum(n) over ()) as bigint) as wanted from sizes)",
            _allocate("sized", "q", by, "n", "quota", "wanted"),
            _ranked("documents", by),
        )
    ) + f" select doc_id, lang from ranked join q {join} where r <= quota"


_PROFILE = " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as n_null, count(distinct {c}) as n_distinct from events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
)

_STARS = "cast(case when stars in (1, 2) then 0 when stars = 3 then 1 when stars in (4, 5) then 2 else stars end as int)"
_POLARITY = "cast(case polarity when 0 then 0 when 2 then 1 when 4 then 2 else polarity end as int)"

ENTRIES = {
    "upload_text_column": (
        upload_text_column,
        with_views(["v_reviews"], "select text, doc_id, source from v_reviews where text is not null"),
    ),
    "recode_stars": (recoded_stars, with_views(["v_reviews"], f"select doc_id, stars, {_STARS} as label from v_reviews")),
    "recode_polarity": (
        recoded_polarity,
        with_views(["v_reviews"], f"select doc_id, polarity, {_POLARITY} as label from v_reviews"),
    ),
    "label_names": (
        label_names,
        with_views(
            ["v_reviews"],
            f"""select doc_id, label, case label when 0 then 'negative' when 1 then 'neutral' when 2 then 'positive' end as name,
            label as label_again from (select doc_id, {_STARS} as label from v_reviews)""",
        ),
    ),
    "drop_missing": (
        dropped_missing,
        with_views(["v_reviews"], "select doc_id, text, stars from v_reviews where text is not null and stars is not null"),
    ),
    "text_length": (text_lengths, "select doc_id, cast(length(text) as int) as text_length from documents"),
    "clean_text": (cleaned_text, f"select doc_id, {_clean('text')} as clean from documents"),
    "clean_html": (cleaned_html, f"select page_id, {_clean('html')} as clean from pages"),
    "labelled_view": (
        labelled_view,
        with_views(["v_reviews"], f"select text, {_STARS} as label from v_reviews where text is not null"),
    ),
    "truncate_tokens": (
        truncated,
        f"select doc_id, array_to_string(string_split({_SQUEEZED}, ' ')[1:{MAX_TOKENS}], ' ') as text from documents",
    ),
    "token_counts": (
        token_counts,
        f"""select origin, id, part, n_tokens, least(n_tokens, {MAX_TOKENS}) as n_kept from (
          select 'documents' as origin, doc_id as id, 0::bigint as part, {_N_TOKENS} as n_tokens from documents
          union all select 'conversations', conv_id, turn, {_N_TOKENS} from conversations)""",
    ),
    "stratified_split": (
        split_rows,
        "with " + _split_sql(_LABEL_ROWS, "label", 0.2, 0.5) + " select doc_id, label, split from assigned",
    ),
    "stratified_split_reviews": (
        split_reviews,
        "with "
        + _split_sql(f"select doc_id, {_STAR_LABEL} as label from documents", "label", 0.01, 0.99)
        + " select doc_id, label, split from assigned",
    ),
    "random_split": (
        split_plain,
        "with " + _split_sql("select doc_id from documents", "", 0.1, 0.5) + " select doc_id, split from assigned",
    ),
    "split_by_content": (
        split_content,
        "with " + _split_sql(_CONTENT_ROWS, "label", 0.2, 0.5) + " select doc_id as row_key, label, split from assigned",
    ),
    "split_counts": (
        lambda spark, sf: split_counts(split_rows(spark, sf)),
        "with " + _split_sql(_LABEL_ROWS, "label", 0.2, 0.5) + " select split, count(*) as n from assigned group by split",
    ),
    "stratified_sample": (sample_rows, _sample_sql("lang")),
    "random_sample": (sample_plain, _sample_sql("")),
    "profile_columns": (profile, _PROFILE),
    "distinct_values": (social_targets, with_views(["v_reviews"], "select distinct polarity from v_reviews")),
}
