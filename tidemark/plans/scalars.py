"""Scalar function families over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as cf
from tidemark.functions import text as tf
from tidemark.plans.registry import R, query
from tidemark.plans.roles import customers, predictions, scores, table, transactions


@query("S_string", "SELECT customer_id, segment || '__' || city AS key, starts_with(city, 'NATION_1') AS starts, contains(city, '_2') AS has, lower(segment) AS folded FROM cu")
def s_string(spark, d):
    return customers(spark, d).select("customer_id", F.concat_ws("__", "segment", "city").alias("key"), F.startswith("city", F.lit("NATION_1")).alias("starts"), F.contains("city", F.lit("_2")).alias("has"), tf.fold("segment").alias("folded"))


@query("S_accent_fold", "SELECT 'cancion nino uber' AS folded, 'K = 0 – x' AS tidy, CAST(1234.5 AS DOUBLE) AS number")
def s_accents(spark, d):
    one = spark.createDataFrame([("CANCIÓN niño Über", "$K=0$ -- x", "1.234,5")], "a string, b string, c string")
    return one.select(tf.fold("a").alias("folded"), tf.tidy_math("b").alias("tidy"), tf.parse_decimal_comma("c").alias("number"))


@query("S_prefix_split", "SELECT customer_id, split_part(city, '_', 1) AS prefix, substr(segment, 1, 3) AS short FROM cu")
def s_prefix(spark, d):
    return customers(spark, d).select("customer_id", F.substring_index("city", "_", 1).alias("prefix"), F.substring("segment", 1, 3).alias("short"))


@query("S_formats", "SELECT customer_id, replace(replace(replace(format('{:,.2f}', balance), ',', ';'), '.', ','), ';', '.') AS shown FROM cu")
def s_formats(spark, d):
    return customers(spark, d).select("customer_id", tf.number("balance", 2).alias("shown"))


@query("S_es_co_fixed", "SELECT '0,6832' AS a, '48.723' AS b, '25,7 %' AS c, '< 0,001' AS d, 'a, b y c' AS e, '1.5K' AS f, '[0,1000; 0,2000]' AS g")
def s_es(spark, d):
    one = spark.range(1)
    return one.select(tf.number(F.lit(0.68321)).alias("a"), tf.integer(F.lit(48723)).alias("b"), tf.percent(F.lit(0.2573)).alias("c"), tf.p_value(F.lit(0.0001)).alias("d"), tf.listing(F.array(*map(F.lit, "abc"))).alias("e"), tf.magnitude_suffix(F.lit(1500.0)).alias("f"), tf.interval(F.lit(0.1), F.lit(0.2)).alias("g"))


@query("S_dates", "SELECT event_id, strftime(ts, '%Y-%m') AS month, isodow(ts) - 1 AS weekday, date_sub('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS days, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS shifted FROM events")
def s_dates(spark, d):
    e = table(spark, d, "events")
    start = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return e.select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.weekday("ts").alias("weekday"), cf.days_between("ts", start).alias("days"), F.date_format(F.col("ts") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd").alias("shifted"))


@query("S_math", f"SELECT id, {R('ln(1 + y)', 'log1p')}, {R('log10(y + 1)', 'log10')}, CAST(floor(y) AS BIGINT) AS down, CAST(ceil(y) AS BIGINT) AS up, {R('sqrt(y)', 'root')}, {R('round_even(y, 0)', 'half_even')}, {R('1 / (1 + exp(-(a - y) / 5))', 'sigmoid')}, {R('greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))', 'logaddexp')} FROM pr")
def s_math(spark, d):
    y = F.col("y")
    return predictions(spark, d).select("id", F.log1p(y).alias("log1p"), F.log10(y + 1).alias("log10"), F.floor(y).alias("down"), F.ceil(y).alias("up"), F.sqrt(y).alias("root"), cf.half_even(y).alias("half_even"), cf.sigmoid((F.col("a") - y) / 5).alias("sigmoid"), cf.logaddexp("a", "b").alias("logaddexp"))


@query("S_logit", f"SELECT id, {R('ln(p / (1 - p))', 'logit')} FROM (SELECT id, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM sc)")
def s_logit(spark, d):
    return scores(spark, d).select("id", cf.logit("p").alias("logit"))


@query("S_interp", f"SELECT id, {R('CASE WHEN s <= 100 THEN 0 WHEN s <= 1000 THEN 0.6 * (s - 100) / 900 WHEN s <= 5000 THEN 0.6 + 0.4 * (s - 1000) / 4000 ELSE 1 END', 'v')} FROM sc")
def s_interp(spark, d):
    return scores(spark, d).select("id", cf.interp("s", F.array(F.lit(100.0), F.lit(1000.0), F.lit(5000.0)), F.array(F.lit(0.0), F.lit(0.6), F.lit(1.0))).alias("v"))


@query("S_bin_codes", "SELECT customer_id, CAST(len(list_filter([5, 10, 15], lambda x: x < nation)) AS BIGINT) AS l, CAST(len(list_filter([5, 10, 15], lambda x: x <= nation)) AS BIGINT) AS r FROM cu")
def s_bins(spark, d):
    cuts = F.array(F.lit(5), F.lit(10), F.lit(15))
    return customers(spark, d).select("customer_id", cf.bin_left("nation", cuts).alias("l"), cf.bin_right("nation", cuts).alias("r"))


@query("S_isclose", "SELECT id, abs(a - y) <= 1e-8 + 0.01 * abs(y) AS near FROM pr")
def s_close(spark, d):
    return predictions(spark, d).select("id", cf.isclose("a", "y", 0.01).alias("near"))


@query("S_nulls", f"WITH g AS (SELECT customer_id, nullif(nation % 3, 0) AS v FROM cu) SELECT customer_id, v IS NULL AS missing, coalesce(v, -1) AS filled FROM g")
def s_nulls(spark, d):
    v = F.nullif(F.col("nation") % 3, F.lit(0).cast("long"))
    return customers(spark, d).select("customer_id", v.isNull().alias("missing"), F.coalesce(v, F.lit(-1)).alias("filled"))


@query("S_arrays", f"SELECT vec_id, {R('list_sum(e)', 'total')}, {R('list_max(e)', 'top')}, CAST(list_position(e, list_max(e)) AS BIGINT) AS place, {R('e[2] - e[1]', 'step')} FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def s_arrays(spark, d):
    e = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    a = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    return a.select("vec_id", F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("e").alias("top"), F.array_position("e", F.array_max("e")).alias("place"), (F.get("e", F.lit(1)) - F.get("e", F.lit(0))).alias("step"))


@query("S_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events")
def s_json(spark, d):
    return table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("long") + 1).alias("k"))


@query("S_hash", "SELECT customer_id, sha256(segment || '#' || customer_id) AS digest FROM cu")
def s_hash(spark, d):
    return customers(spark, d).select("customer_id", F.sha2(F.concat_ws("#", "segment", F.col("customer_id").cast("string")), 256).alias("digest"))


@query("S_dice", f"SELECT customer_id, {R('CAST(CAST(chr(48) || chr(120) || substr(md5(CAST(customer_id AS VARCHAR) || chr(35) || 42), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0', 'u')} FROM cu")
def s_dice(spark, d):
    return customers(spark, d).select("customer_id", cf.dice(F.col("customer_id"), 42).alias("u"))


@query("S_map", "SELECT customer_id, CASE type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code FROM tx")
def s_map(spark, d):
    return transactions(spark, d).select("customer_id", cf.recode("type", {"view": 1, "click": 2}, 0).alias("code"))
