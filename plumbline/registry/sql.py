"""SQL texts of the views, and pieces the check queries share."""

from __future__ import annotations

TS = "'%Y-%m-%d %H:%M:%S.%f'"

VIEWS = {
    "v_predictions": """
v_predictions as (
  select e.event_id as row_id, e.ts, d.text, cast(length(d.text) as int) as text_length,
    case event_type when 'error' then 'negative' when 'view' then 'neutral'
                    when 'click' then 'neutral' else 'positive' end as sentiment,
    cast(case event_type when 'error' then 0 when 'view' then 1 when 'click' then 1 else 2 end as int) as label,
    round(0.34::double + 0.66::double * value / (value + 50::double), 4) as confidence,
    case when user_id % 2 = 0 then 'social' else 'reviews' end as model_used
  from events e join documents d on d.doc_id = e.event_id % (select count(*) from documents)
)""",
    "v_reviews": """
v_reviews as (
  select doc_id, case when doc_id % 17 = 0 then null else text end as text, lang, source,
    cast(1 + doc_id % 5 as int) as stars, cast(2 * (doc_id % 3) as int) as polarity
  from documents
)""",
    "v_logits": "v_logits as (select doc_id as row_id, "
    + ", ".join(
        f"('0x' || substr(md5('{m}{c}-' || text), 1, 8))::bigint::double / 4294967296::double * 4::double as {m}{c}"
        for m in "sr"
        for c in range(3)
    )
    + " from documents)",
    "v_scores": "v_scores as (select row_id, "
    + ", ".join(
        f"cast(case when {m}0 >= {m}1 and {m}0 >= {m}2 then 0 when {m}1 >= {m}2 then 1 else 2 end as int) as {n}_pred, "
        f"1 / (exp({m}0 - greatest({m}0, {m}1, {m}2)) + exp({m}1 - greatest({m}0, {m}1, {m}2)) "
        f"+ exp({m}2 - greatest({m}0, {m}1, {m}2))) as {n}_conf"
        for m, n in (("s", "social"), ("r", "reviews"))
    )
    + " from v_logits)",
    "v_decided": """
v_decided as (
  select row_id, label, case label when 0 then 'negative' when 1 then 'neutral' else 'positive' end as sentiment,
    round(case model_used when 'social' then social_conf else reviews_conf end, 4) as confidence, model_used
  from (
    select *, least(social_pred, reviews_pred) as label,
      case when social_pred = reviews_pred
           then case when social_conf >= reviews_conf then 'social' else 'reviews' end
           when social_pred < reviews_pred then 'social' else 'reviews' end as model_used
    from v_scores)
)""",
    "v_orders": """
v_orders as (
  select o_orderkey as row_id, o_orderdate as ts,
    case o_orderstatus when 'F' then 'negative' when 'O' then 'neutral' else 'positive' end as sentiment,
    cast(o_custkey % 3 as varchar) as tenant
  from orders
)""",
    "v_train": """
v_train as (
  select * from v_predictions where ts < (select max(ts) from v_predictions) - interval 168 hours
)""",
    "v_recent": """
v_recent as (
  select * from v_predictions where ts >= (select max(ts) from v_predictions) - interval 168 hours
)""",
    "v_clusters": """
v_parts as (
  select vec_id, label, unnest(generate_series(1, len(embedding))) as i, unnest(embedding)::double as x
  from embeddings
),
v_centroids as (select label as cluster, i, avg(x) as c from v_parts group by all),
v_distance as (
  select p.vec_id, k.cluster, sum((p.x - k.c) * (p.x - k.c)) as d
  from v_parts p join v_centroids k using (i) group by all
),
v_clusters as (select vec_id, cast(arg_min(cluster, d) as int) as cluster from v_distance group by all)""",
    "v_cluster_log": """
v_cluster_log as (
  select p.*, c.cluster from v_predictions p
  join v_clusters c on c.vec_id = p.row_id % (select count(*) from embeddings)
)""",
}

NEEDS = {
    "v_scores": ["v_logits"],
    "v_decided": ["v_logits", "v_scores"],
    "v_train": ["v_predictions"],
    "v_recent": ["v_predictions"],
    "v_cluster_log": ["v_predictions", "v_clusters"],
}


def with_views(views: list[str], body: str, ctes: str = "", recursive: bool = False) -> str:
    """``body`` below the named views, what they need, and further CTEs."""
    order: list[str] = []
    for name in views:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    parts = [VIEWS[v].strip() for v in order]
    if ctes:
        parts.append(ctes.strip())
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


FRACTIONS = "[" + ", ".join(f"{i / 10}::double" for i in range(11)) + "]"


def quantile_edges(column: str) -> str:
    """Sorted distinct interpolated quantiles in ten steps."""
    return f"list_sort(list_distinct(quantile_cont({column}::double, {FRACTIONS})))"


def width_edges(column: str) -> str:
    """Eleven equal steps from the least to the greatest value."""
    steps = ", ".join(
        f"min({column}) + {i}::double * ((max({column}) - min({column})) / 10::double)" for i in range(10)
    )
    return f"list_sort(list_distinct([{steps}, max({column})]))"


def bins_of(edges_cte: str, by: str) -> str:
    """One row per bin of a CTE ``(by, e)``."""
    return (
        f"select {by}, bin, e[bin + 1] as lo, e[bin + 2] as hi, bin = len(e) - 2 as closes "
        f"from (select {by}, e, cast(unnest(range(len(e) - 1)) as int) as bin from {edges_cte})"
    )


def in_bin(x: str) -> str:
    return f"{x} >= lo and ({x} < hi or (closes and {x} = hi))"


def psi_of(frame: str, by: str) -> str:
    """PSI per ``by`` of a CTE with columns expected and actual."""
    return f"""
select {by}, sum((q - p) * ln(q / p)) as psi from (
  select {by}, greatest(expected, 0.0001::double) / sum(greatest(expected, 0.0001::double)) over (partition by {by}) as p,
    greatest(actual, 0.0001::double) / sum(greatest(actual, 0.0001::double)) over (partition by {by}) as q
  from {frame}) group by {by}"""


def level(col: str) -> str:
    return (
        f"case when {col} is null then 'unknown' when {col} < 0.1::double then 'low' "
        f"when {col} < 0.2::double then 'medium' when {col} < 0.3::double then 'high' else 'critical' end"
    )


def risk(col: str) -> str:
    return f"coalesce(round(least(greatest({col} / 0.3::double * 100::double, 0::double), 100::double), 1), 0::double)"


def counts_by(alias: str = "") -> str:
    """The four sentiment counts."""
    return ", ".join(
        [f"count(*) filter (where {alias}sentiment = '{s}') as {s}" for s in ("negative", "neutral", "positive")]
        + ["count(*) as total"]
    )
