"""Experiment-store queries: X1 to X7, A38, A41, E23 to E29, E31, E34, E35, IO14, IO16."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import inference as inf
from tidemark.operators import order as od
from tidemark.operators import relational as rl
from tidemark.operators import store as st
from tidemark.operators.metrics import verdict
from tidemark.plans.registry import DICE, R, query
from tidemark.plans.roles import fold_values, predictions, table
from tidemark.session import scratch
from tidemark.sources import io

#: Runs made of folds: a row per treatment (model) and half (optimizer), with its scores.
_RUNS = "ru AS (SELECT treatment AS model, CASE WHEN CAST(substr(block, 6, 2) AS INT) <= 6 THEN 'grid' ELSE 'random' END AS optimizer, avg(value) AS mean_score, count(*) AS n, sum(value) / 1000 AS total_s FROM fo GROUP BY 1, 2)"


def _runs(spark, d):
    half = F.when(F.substring("block", 6, 2).cast("int") <= 6, "grid").otherwise("random")
    return fold_values(spark, d).groupBy(F.col("treatment").alias("model"), half.alias("optimizer")).agg(F.avg("value").alias("mean_score"), F.count("*").alias("n"), (F.sum("value") / 1000).alias("total_s"))


@query("X1_upsert", f"WITH {_RUNS}, nw AS (SELECT model, optimizer, 1.0 AS mean_score FROM ru WHERE optimizer = 'grid') SELECT model, optimizer, {R('mean_score', 'mean_score')} FROM ru WHERE optimizer <> 'grid' UNION ALL SELECT model, optimizer, mean_score FROM nw")
def x1(spark, d):
    old = _runs(spark, d).select("model", "optimizer", "mean_score")
    new = old.filter("optimizer = 'grid'").withColumn("mean_score", F.lit(1.0))
    return old.join(new, ["model", "optimizer"], "left_anti").unionByName(new)


@query("X2_status_lookup", f"WITH {_RUNS} SELECT count(*) > 0 AS there FROM ru WHERE model = '5-LOW' AND optimizer = 'grid'")
def x2(spark, d):
    return _runs(spark, d).filter("model = '5-LOW' AND optimizer = 'grid'").agg((F.count("*") > 0).alias("there"))


@query("X3_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x3(spark, d):
    return st.decode_json(table(spark, d, "events"), {"props": "k bigint"}).select("event_id", F.col("props.k").alias("k"))


@query("X5_relative_paths", "SELECT DISTINCT regexp_replace('/data/runs/' || n_name || '/model', '^/data/runs/', '') AS path FROM nation")
def x5(spark, d):
    return table(spark, d, "nation").select(st.relative_paths(F.concat(F.lit("\\data\\runs\\"), "n_name", F.lit("\\model")), "/data/runs").alias("path")).distinct()


@query("X6_pending", f"WITH {_RUNS}, p AS (SELECT model, optimizer FROM (SELECT DISTINCT model FROM ru) CROSS JOIN (VALUES ('grid'), ('random'), ('genetic')) o(optimizer)) SELECT * FROM p WHERE (model, optimizer) NOT IN (SELECT (model, optimizer) FROM ru WHERE n >= 40)")
def x6(spark, d):
    r = _runs(spark, d)
    plan = r.select("model").distinct().crossJoin(rl.plan_grid(spark, optimizer=["grid", "random", "genetic"]))
    return plan.join(r.filter("n >= 40").select("model", "optimizer"), ["model", "optimizer"], "left_anti")


@query("X7_import_best", f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_score DESC, optimizer) AS k FROM ru) SELECT model, optimizer, 'first study' AS origin FROM r WHERE k = 1")
def x7(spark, d):
    return st.import_best(_runs(spark, d), ["model"], "mean_score", ["optimizer"], "first study").select("model", "optimizer", "origin")


@query("A38_registry_summary", f"WITH {_RUNS} SELECT optimizer, count(*) AS n, count(*) FILTER (WHERE n >= 40) AS ok, {R('avg(mean_score)', 'mean_score')}, {R('sum(total_s) / 3600', 'hours')} FROM ru GROUP BY 1")
def a38(spark, d):
    return st.summary(_runs(spark, d).withColumn("status", F.when(F.col("n") >= 40, "ok").otherwise("error")), ["optimizer"])


@query("A41_distinct_configs", "SELECT vec_id, len(list_distinct(list_transform(embedding[1:8], lambda x: round(x, 0)))) AS n_distinct FROM embeddings")
def a41(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.array_distinct(F.transform(F.slice("embedding", 1, 8), lambda x: F.bround(x.cast("double"), 0) + 0.0))).alias("n_distinct"))


@query("E23_optimizer_comparison", f"WITH {_RUNS}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY mean_score DESC) AS k FROM ru) SELECT optimizer, {R('avg(k)', 'mean_rank')}, count(*) FILTER (WHERE k = 1) AS wins, {R('avg(total_s) / 60', 'minutes')} FROM r GROUP BY 1")
def e23(spark, d):
    r = _runs(spark, d).withColumn("k", F.rank().over(Window.partitionBy("model").orderBy(F.col("mean_score").desc())))
    return r.groupBy("optimizer").agg(F.avg("k").alias("mean_rank"), F.count_if(F.col("k") == 1).alias("wins"), (F.avg("total_s") / 60).alias("minutes"))


@query("E24_difference_from_baseline", f"WITH w AS (SELECT block, treatment, value - max(value) FILTER (WHERE treatment = '1-URGENT') OVER (PARTITION BY block) AS d FROM fo) SELECT treatment, {R('avg(d)', 'mean')}, count(*) FILTER (WHERE d > 0) AS better FROM w WHERE treatment <> '1-URGENT' GROUP BY 1")
def e24(spark, d):
    base = F.max(F.when(F.col("treatment") == "1-URGENT", F.col("value"))).over(Window.partitionBy("block"))
    w = fold_values(spark, d).withColumn("d", F.col("value") - base).filter("treatment <> '1-URGENT'")
    return w.groupBy("treatment").agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("better"))


_TR = "tr AS (SELECT substr(block, 1, 4) AS blk, treatment AS opt, row_number() OVER (PARTITION BY substr(block, 1, 4), treatment ORDER BY block) - 1 AS step, max(value) OVER (PARTITION BY substr(block, 1, 4), treatment ORDER BY block) AS value FROM fo), bw AS (SELECT *, max(value) OVER (PARTITION BY blk) AS best, min(CASE WHEN step = 0 THEN value END) OVER (PARTITION BY blk) AS worst, count(*) OVER (PARTITION BY blk, opt) AS n FROM tr), rg AS (SELECT *, (best - value) / (best - worst) AS regret FROM bw WHERE best > worst)"


def _traces(spark, d):
    w = Window.partitionBy("blk", "opt").orderBy("block")
    f = fold_values(spark, d).select(F.substring("block", 1, 4).alias("blk"), F.col("treatment").alias("opt"), "block", "value")
    return f.select("blk", "opt", (F.row_number().over(w) - 1).alias("step"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


@query("E25_anytime_curves", f"WITH {_TR} SELECT opt, {R('g / 20.0', 'fraction')}, {R('avg(regret)', 'mean')}, {R('quantile_cont(regret, 0.25)', 'q25')}, {R('quantile_cont(regret, 0.75)', 'q75')} FROM rg, (SELECT unnest(range(1, 21)) AS g) WHERE step = least(ceil(round(g / 20.0 * n, 9)) - 1, n - 1) GROUP BY opt, g")
def e25(spark, d):
    return st.anytime(_traces(spark, d), ["blk"], "opt")[0]


@query("E25_anytime_searches", f"WITH {_TR} SELECT blk, opt, {R('avg(regret)', 'area')}, {R('arg_max(regret, step)', 'final')}, min(CASE WHEN regret <= 0.05 THEN step END) + 1 AS evals_to_95 FROM rg GROUP BY 1, 2")
def e25b(spark, d):
    return st.anytime(_traces(spark, d), ["blk"], "opt")[1]


@query("E26_diversity_rows", f"SELECT vec_id, i - 1 AS generation, {R('embedding[i]', 'best')}, {R('embedding[i + 8]', 'mean')} FROM embeddings, (SELECT unnest(range(1, 9)) AS i)")
def e26(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("best"), F.slice("embedding", 9, 8).alias("mean"))
    return e.select("vec_id", F.posexplode(F.arrays_zip("best", "mean")).alias("generation", "z")).select("vec_id", "generation", "z.best", "z.mean")


@query("E27_leaderboard", f"WITH {_RUNS}, b AS (SELECT model, max(mean_score) AS best, sum(total_s) AS cost FROM ru GROUP BY 1) SELECT model, {R('best', 'best')}, {R('cost', 'cost')}, rank() OVER (ORDER BY best DESC) AS place FROM b")
def e27(spark, d):
    b = _runs(spark, d).groupBy("model").agg(F.max("mean_score").alias("best"), F.sum("total_s").alias("cost"))
    return b.withColumn("place", F.rank().over(Window.orderBy(F.col("best").desc())))


@query("E28_verdict", "SELECT nation, CASE WHEN abs(avg(balance) - 5000) < 200 THEN 'ties' WHEN avg(balance) > 5000 THEN 'wins' ELSE 'loses' END AS verdict FROM cu GROUP BY 1")
def e28(spark, d):
    from tidemark.plans.roles import customers

    g = customers(spark, d).groupBy("nation").agg((F.avg("balance") - 5000).alias("diff"))
    return g.withColumn("p", F.when(F.abs("diff") < 200, 0.5).otherwise(0.001)).select("nation", verdict("p", "diff").alias("verdict"))


@query("E29_superiority", f"WITH w AS (SELECT block, max(value) FILTER (WHERE treatment = '1-URGENT') AS a, max(value) FILTER (WHERE treatment = '5-LOW') AS b FROM fo GROUP BY 1) SELECT avg(a) > avg(b) AS better_mean, count(*) FILTER (WHERE a > b) > count(*) / 2.0 AS better_mostly, min(a - b) > 0 AS never_worse FROM w")
def e29(spark, d):
    f = fold_values(spark, d)
    w = f.groupBy("block").agg(F.max(F.when(F.col("treatment") == "1-URGENT", F.col("value"))).alias("a"), F.max(F.when(F.col("treatment") == "5-LOW", F.col("value"))).alias("b"))
    return w.agg((F.avg("a") > F.avg("b")).alias("better_mean"), (F.count_if(F.col("a") > F.col("b")) > F.count("*") / 2).alias("better_mostly"), (F.min(F.col("a") - F.col("b")) > 0).alias("never_worse"))


@query("E31_cross_dataset", f"WITH m AS (SELECT substr(block, 1, 4) AS year, treatment, avg(value) AS v FROM fo GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY v DESC, treatment) AS place, max(v) OVER (PARTITION BY year) AS best FROM m) SELECT year, treatment, place, {R('(v - best) / best', 'relative')} FROM r")
def e31(spark, d):
    m = fold_values(spark, d).groupBy(F.substring("block", 1, 4).alias("year"), "treatment").agg(F.avg("value").alias("v"))
    best = F.max("v").over(Window.partitionBy("year"))
    return m.select("year", "treatment", F.row_number().over(Window.partitionBy("year").orderBy(F.col("v").desc(), "treatment")).alias("place"), ((F.col("v") - best) / best).alias("relative"))


@query("E34_intervals_per_model")
def e34(spark, d):
    p, out = predictions(spark, d), None
    for c in ("a", "b"):
        boot = inf.bootstrap_regression(p.withColumn("zero", F.col("y")), "id", "y", "zero", c, inf.N_BOOT)
        square = (F.col(c) - F.col("y")) ** 2
        est = p.agg(F.sqrt(F.avg(square)).alias("estimate"))
        sums = p.agg(F.sum(square).alias("q"), F.count(square).alias("n"))
        left_out = p.crossJoin(F.broadcast(sums)).select(F.sqrt((F.col("q") - square) / (F.col("n") - 1)).alias("estimate"))
        one = inf.bca(boot, "rmse", est, left_out).select(F.lit(c).alias("model"), "low", "high")
        out = one if out is None else out.union(one)
    return out


@query("E35_cost_table", f"WITH {_RUNS}, f AS (SELECT model, total_s AS fit FROM ru WHERE optimizer = 'grid'), i AS (SELECT model, total_s AS inference FROM ru WHERE optimizer = 'random' AND model > '2') SELECT f.model, {R('fit', 'fit')}, {R('coalesce(inference, 0)', 'inference')}, concat_ws(', ', 'fit', CASE WHEN inference IS NOT NULL THEN 'inference' END) AS sources FROM f LEFT JOIN i ON f.model = i.model")
def e35(spark, d):
    r = _runs(spark, d)
    f, i = r.filter("optimizer = 'grid'").select("model", F.col("total_s").alias("fit")), r.filter("optimizer = 'random' AND model > '2'").select("model", F.col("total_s").alias("inference"))
    return f.join(i, "model", "left").select("model", "fit", F.coalesce("inference", F.lit(0.0)).alias("inference"), F.concat_ws(", ", F.lit("fit"), F.when(F.col("inference").isNotNull(), "inference")).alias("sources"))


@query("IO1_declared_scan", "SELECT count(*) AS n, count(DISTINCT customer_id) AS customers, count(date) AS dates FROM tx")
def io1(spark, d):
    from tidemark.plans.roles import transactions

    return transactions(spark, d).agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"), F.count("date").alias("dates"))


@query("IO3_parquet_scan", f"SELECT o_orderkey, {R('o_totalprice', 'o_totalprice')} FROM orders")
def io3(spark, d):
    return io.parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("IO7_key_values", "SELECT list_sort(list(n_nationkey::VARCHAR || '=' || n_name)) AS pairs FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 0) HAVING count(*) > 0 UNION ALL SELECT ['25'] AS pairs")
def io7(spark, d):
    kv = io.key_values(table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")))
    return kv.select(F.array(F.size(F.map_keys("numbers")).cast("string")).alias("pairs"))


@query("IO11_registry_loader", "SELECT count(*) AS n FROM pr")
def io11(spark, d):
    return io.registry({"predictions": predictions}, "predictions", spark, d).agg(F.count("*").alias("n"))


@query("IO14_fingerprint", "WITH n AS (SELECT count(*) AS n FROM cu) SELECT n, true AS same FROM n")
def io14(spark, d):
    from tidemark.plans.roles import customers

    c = customers(spark, d)
    a, b = io.fingerprint(c), io.fingerprint(c.repartition(5).select(*reversed(c.columns))).select(F.col("digest").alias("other"))
    return a.crossJoin(b).select("n", (F.col("digest") == F.col("other")).alias("same"))


@query("IO16_complete_cache", f"SELECT id, {R('y', 'score')} FROM pr")
def io16(spark, d):
    p = predictions(spark, d).select("id", F.col("y").alias("score"))
    return io.complete_cache(p.select("id"), p.filter("id % 3 = 0"), lambda todo: todo.join(p, "id"), ["id"])


@query("IO12_inverted_index", "SELECT 'the cat saw the dog' AS text")
def io12(spark, d):
    from tidemark.functions.text import from_inverted_index

    words = spark.createDataFrame([({"the": [0, 3], "cat": [1], "saw": [2], "dog": [4]},)], "i map<string,array<int>>")
    return words.select(from_inverted_index(F.col("i")).alias("text"))


@query("W12_tie_by_seed", f"WITH r AS (SELECT id, row_number() OVER (ORDER BY s DESC, {DICE('id', 42)}, id) AS k, round_even(0.25 * count(*) OVER (), 0) AS n FROM sc) SELECT id, CAST(k <= n AS BIGINT) AS selected FROM r")
def w12(spark, d):
    from tidemark.plans.roles import scores

    return od.top_fraction(scores(spark, d), "s", 0.25, "id", seed=42).select("id", "selected")


@query("IO10_headerless_csv", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def io10(spark, d):
    """Round trip through CSV without a header, names supplied."""
    path = scratch(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path)
    return io.csv(spark, path, "k bigint, name string", header=False)


@query("IO5_json_round_trip", f"SELECT o_orderkey, {R('o_totalprice', 'o_totalprice')} FROM orders")
def io5(spark, d):
    path = scratch(spark, "json")
    io.write_json(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path)
    return spark.read.schema("o_orderkey bigint, o_totalprice double").json(path)


_NATION = "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation"


def _nation(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))


def _put(spark, path, content):
    """A file's bytes, through Spark's file systems."""
    fs, p = io._fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


def _zipped(files):
    import io as std
    import zipfile

    held = std.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return held.getvalue()


@query("IO2_locate_and_unzip", _NATION)
def io2(spark, d):
    """A table that lies zipped in the second of two candidate folders."""
    path, rows = scratch(spark, "zip"), _nation(spark, d).collect()  # 25 rows
    _put(spark, f"{path}/nation.csv.zip", _zipped({"nation.csv": "k,name\n" + "".join(f"{r.k},{r.name}\n" for r in rows)}))
    return io.csv(spark, io.locate(spark, [f"{path}/none", path], "nation.csv"), "k bigint, name string")


@query("IO4_csv_sink", f"SELECT o_orderkey, {R('o_totalprice', 'o_totalprice')}, 'orders' AS source FROM orders")
def io4(spark, d):
    path = scratch(spark, "csv")
    io.write_csv(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, "orders", "round trip")
    rows = io.csv(spark, f"{path}/part*", "o_orderkey bigint, o_totalprice double")
    return rows.crossJoin(F.broadcast(spark.read.schema("source string, how string").json(f"{path}/_provenance").select("source")))


@query("IO6_shared_relation", "SELECT count(*) AS n, true AS same FROM nation")
def io6(spark, d):
    a, b = (io.shared(spark, f"{d}/nation.parquet") for _ in range(2))
    return a.agg(F.count("*").alias("n")).withColumn("same", F.lit(a is b))


@query("IO8_workbook", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def io8(spark, d):
    """A workbook made of the table, read back as cells."""
    path, rows = scratch(spark, "xlsx"), _nation(spark, d).collect()  # 25 rows
    names = "".join(f"<si><t>{r.name}</t></si>" for r in rows)
    cells = "".join(f'<row><c r="A{i + 1}"><v>{r.k}</v></c><c r="C{i + 1}" t="s"><v>{i}</v></c></row>' for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    _put(spark, f"{path}/nation.xlsx", _zipped({"xl/sharedStrings.xml": f"<sst {ns}>{names}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"}))
    c = io.xlsx(spark, f"{path}/nation.xlsx")
    return c.groupBy("row").agg(F.max(F.when(F.col("column") == 1, F.col("number"))).cast("long").alias("k"), F.max(F.when(F.col("column") == 3, F.col("text"))).alias("name")).drop("row")


@query("IO13_manifest", "SELECT 'nation.csv' AS name, CAST(sum(length(n_nationkey::VARCHAR) + length(n_name) + 2) AS BIGINT) AS bytes, sha256(string_agg(n_nationkey::VARCHAR || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, 'nation' AS source FROM nation")
def io13(spark, d):
    path, rows = scratch(spark, "files"), _nation(spark, d).orderBy("k").collect()  # 25 rows
    _put(spark, f"{path}/nation.csv", "".join(f"{r.k},{r.name}\n" for r in rows).encode())
    return io.manifest(spark, path, spark.createDataFrame([("nation.csv", "nation")], "name string, source string")).select("name", "bytes", "sha256", "source")


@query("IO15_model_store", f"WITH g AS (SELECT regr_slope(y, a) AS m, regr_intercept(y, a) AS c FROM pr) SELECT id, {R('m * a + c', 'score')} FROM pr, g")
def io15(spark, d):
    """A pipeline that is saved, loaded and applied."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    p, path = predictions(spark, d), scratch(spark, "model")
    io.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y", solver="normal")]).fit(p), path)
    return io.load_pipeline(path).transform(p).select("id", F.col("prediction").alias("score"))
