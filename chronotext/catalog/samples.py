"""Queries over seeded sampling, probabilities, noise and perturbation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.catalog.corpora import iso, order_corpus
from chronotext.functions.hashing import uniform
from chronotext.functions.vectors import anchor_probabilities
from chronotext.operators.augment import EMOJIS, EMPHASES, HASHTAGS, URLS, perturb
from chronotext.operators.sampling import (
    daily_prevalence,
    date_spine,
    draw_unbalanced,
    label_noise,
    resample_by_prevalence,
    shuffled,
    time_of_day,
)
from chronotext.operators.ranking import positions
from chronotext.operators.split import stratified_split, time_key


def sql_u(salt: str, *keys: str, seed: int = 42) -> str:
    """The uniform of the hashing module in SQL."""
    joined = " || ':' || ".join(keys)
    return f"(('0x' || substr(md5({joined} || ':{seed}:{salt}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def sql_h(salt: str, *keys: str, seed: int = 42) -> str:
    joined = " || ':' || ".join(keys)
    return f"('0x' || substr(md5({joined} || ':{seed}:{salt}'), 1, 15))::BIGINT"


def sql_pick(u: str, n: int | str) -> str:
    return f"floor({u} * {n})::INT"


def sql_list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o + "'" for o in options) + "]"


@query(
    "daily_spine",
    """SELECT strftime(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)), '%Y-%m-%d') AS day
FROM events""",
)
def daily_spine(spark, sf_dir):
    bounds = table(spark, sf_dir, "events").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return date_spine(bounds).select(iso("day").alias("day"))


@query(
    "event_day_shares",
    """WITH c AS (SELECT event_type, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type AS label, strftime(d, '%Y-%m-%d') AS day, round(n / sum(n) OVER (PARTITION BY d), 6) AS share FROM c""",
)
def event_day_shares(spark, sf_dir):
    shares = daily_prevalence(table(spark, sf_dir, "events"), "event_type", "ts")
    return shares.select("label", iso("day").alias("day"), F.round("weight", 6).alias("share"))


@query(
    "anchor_probabilities",
    """WITH s AS (SELECT event_id, value / 50 - 1 AS b FROM events),
e AS (SELECT event_id, exp(-2.5 * (-1 - b) ** 2) AS x, exp(-2.5 * b ** 2) AS y, exp(-2.5 * (1 - b) ** 2) AS z,
             -2.5 * least((-1 - b) ** 2, b ** 2, (1 - b) ** 2) AS top,
             -2.5 * (-1 - b) ** 2 AS sx, -2.5 * b ** 2 AS sy, -2.5 * (1 - b) ** 2 AS sz FROM s),
r AS (SELECT event_id, exp(sx - top) AS x, exp(sy - top) AS y, exp(sz - top) AS z FROM e)
SELECT event_id, round(0.95 * x / (x + y + z) + 0.05 / 3, 6) AS low, round(0.95 * y / (x + y + z) + 0.05 / 3, 6) AS mid,
       round(0.95 * z / (x + y + z) + 0.05 / 3, 6) AS high FROM r""",
)
def class_probabilities(spark, sf_dir):
    p = anchor_probabilities(F.col("value") / 50 - 1)
    scored = table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    return scored.select("event_id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query(
    "random_times_of_day",
    f"SELECT event_id, {sql_pick(sql_u('time', 'event_id'), 86400)} AS second FROM events",
)
def random_times_of_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", time_of_day(uniform(42, "time", "event_id")).alias("second"))


SQL_CDF = """
c AS (SELECT {label} AS label, {day} AS day, count(*) AS n FROM {source} GROUP BY ALL),
w AS (SELECT label, day, n / sum(n) OVER (PARTITION BY day) AS weight FROM c),
p AS (SELECT label, day, weight / sum(weight) OVER (PARTITION BY {group}) AS p FROM w),
cdf AS (SELECT label, day, sum(p) OVER (PARTITION BY {group} ORDER BY {item}) AS hi,
               lead({item}) OVER (PARTITION BY {group} ORDER BY {item}) IS NULL AS final FROM p),
iv AS (SELECT label, day, coalesce(lag(hi) OVER (PARTITION BY {group} ORDER BY {item}), 0) AS lo,
              CASE WHEN final THEN 2 ELSE hi END AS hi FROM cdf)
"""


@query(
    "prevalence_resample",
    f"""WITH {SQL_CDF.format(label='event_type', day='ts::DATE', source='events', group='label', item='day')},
draws AS (SELECT label, i, {sql_u('day', 'label', 'i')} AS u, {sql_pick(sql_u('time', 'label', 'i'), 86400)} AS s
          FROM (SELECT DISTINCT label FROM w), range((SELECT count(*) // 5 FROM events)) r(i))
SELECT d.label, d.i, strftime(iv.day + to_seconds(d.s), '%Y-%m-%d %H:%M:%S') AS moment
FROM draws d JOIN iv ON iv.label = d.label AND iv.lo <= d.u AND d.u < iv.hi""",
)
def prevalence_resample(spark, sf_dir):
    """As many draws per event type as a fifth of the events, on days weighted by the type's share."""
    events = table(spark, sf_dir, "events")
    drawn = resample_by_prevalence(events, events.count() // 5, 42, "event_type", "ts")
    return drawn.select("label", "i", iso("timestamp", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(
    "unbalanced_draw",
    f"""WITH {SQL_CDF.format(label='event_type', day='ts::DATE', source='events', group='day', item='label')},
days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM w)),
draws AS (SELECT i, floor({sql_u('any-day', 'i')} * (SELECT max(n) FROM days))::BIGINT AS pos, {sql_u('class', 'i')} AS u,
                 {sql_pick(sql_u('time', 'i'), 86400)} AS s FROM range((SELECT count(*) FROM events)) r(i))
SELECT d.i, iv.label, strftime(iv.day + to_seconds(d.s), '%Y-%m-%d %H:%M:%S') AS moment
FROM draws d JOIN days USING (pos) JOIN iv ON iv.day = days.day AND iv.lo <= d.u AND d.u < iv.hi""",
)
def unbalanced_draw(spark, sf_dir):
    """As many draws as there are events: a uniform day, then a type by that day's shares."""
    events = table(spark, sf_dir, "events")
    drawn = draw_unbalanced(spark, daily_prevalence(events, "event_type", "ts"), events.count())
    return drawn.select("i", "label", iso("timestamp", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(
    "label_noise",
    f"""WITH n AS (
  SELECT o_orderkey AS row_id, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label, o_orderpriority AS label_name,
         row_number() OVER (ORDER BY {sql_h('noise', 'o_orderkey')}, o_orderkey) AS r,
         {sql_pick(sql_u('swap', 'o_orderkey'), 4)} AS j FROM orders)
SELECT row_id, label_name, CASE WHEN r <= floor((SELECT count(*) FROM orders) * 0.05)
  THEN j + (j >= label)::INT ELSE label END::INT AS label FROM n""",
)
def noisy_labels(spark, sf_dir):
    return label_noise(order_corpus(spark, sf_dir), 0.05).select("row_id", "label_name", "label")


@query(
    "seeded_shuffle",
    f"""SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY {sql_h('shuffle', 'o_orderkey')}, o_orderkey) - 1 AS position
FROM orders""",
)
def seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return shuffled(rows).select("row_id", "position")


@query(
    "stable_time_order",
    "SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) - 1 AS position FROM orders",
)
def stable_time_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), time_key("o_orderdate").alias("t"))
    return positions(rows, ["t", "row_id"]).select("row_id", "position")


@query(
    "stratified_split",
    f"""WITH sizes AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT ceil(sum(n) * 0.3)::BIGINT AS n_test, sum(n)::BIGINT AS n FROM sizes),
q AS (SELECT g, (sizes.n * n_test) // t.n AS base, (sizes.n * n_test) % t.n AS rest,
             {sql_h('class', 'g', seed=0)} AS tie FROM sizes, t),
quota AS (SELECT g, base + (row_number() OVER (ORDER BY rest DESC, tie)
                            <= (SELECT n_test FROM t) - (SELECT sum(base) FROM q))::INT AS quota FROM q),
r AS (SELECT o_orderkey, o_orderpriority AS g,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sql_h('stratified', 'o_orderkey')}, o_orderkey) AS rn
      FROM orders)
SELECT o_orderkey AS row_id, r.g AS label_name, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN quota ON r.g = quota.g""",
)
def stratified(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label_name")
    )
    return stratified_split(rows, "label_name", 0.3).select("row_id", "label_name", "split")


def sql_step(step: str, rate: float, options: list[str]) -> str:
    kind = f"{sql_list(options)}[{sql_pick(sql_u(step + '-kind', 'doc_id'), len(options))} + 1]"
    return f"CASE WHEN {sql_u(step, 'doc_id')} < {rate} THEN {kind} END"


@query(
    "perturbed_texts",
    f"""WITH a AS (
  SELECT doc_id, CASE WHEN {sql_u('emphasis', 'doc_id')} < 0.25
    THEN rtrim(text, '.') || {sql_list(EMPHASES)}[{sql_pick(sql_u('emphasis-kind', 'doc_id'), 3)} + 1] ELSE text END AS t,
    concat_ws(' ', {sql_step('hashtag', 0.30, HASHTAGS)}, {sql_step('emoji', 0.15, EMOJIS)},
              {sql_step('url', 0.08, URLS)}) AS tail FROM documents),
b AS (SELECT doc_id, CASE WHEN tail <> '' THEN t || ' ' || tail ELSE t END AS t FROM a),
w AS (SELECT doc_id, t, CASE WHEN {sql_u('typo', 'doc_id')} < 0.05 THEN string_split(t, ' ') END AS words FROM b),
x AS (SELECT *, {sql_pick(sql_u('typo-word', 'doc_id'), 'len(words)')} AS pos FROM w),
y AS (SELECT *, words[pos + 1] AS word FROM x),
z AS (SELECT *, {', '.join(f"{sql_pick(sql_u(f'typo-try-{k}', 'doc_id'), 'length(word)')} + 1 AS t{k}" for k in range(3))}
      FROM y),
s AS (SELECT *, CASE {' '.join(f"WHEN lower(substr(word, t{k}, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN t{k}" for k in range(3))}
      END AS spot FROM z),
v AS (SELECT *, substr(word, spot, 1) AS old,
             substr(replace('aeiou', lower(substr(word, spot, 1)), ''), {sql_pick(sql_u('typo-vowel', 'doc_id'), 4)} + 1, 1) AS new
      FROM s)
SELECT doc_id AS row_id, CASE WHEN spot IS NULL THEN t ELSE array_to_string(
  words[:pos] || [substr(word, 1, spot - 1) || CASE WHEN old <> lower(old) THEN upper(new) ELSE new END || substr(word, spot + 1)]
  || words[pos + 2:], ' ') END AS text FROM v""",
)
def perturbed_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return perturb(texts).select("row_id", "text")
