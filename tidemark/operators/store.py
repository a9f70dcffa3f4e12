"""Experiment store: a keyed Parquet table with nested columns, written whole and atomically, one writer at a time.

A version is a folder; the current one is the greatest number whose _SUCCESS file is there, so readers see
all of a version or none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["task", "model", "balancing", "optimizer", "seed"]
SCHEMA = (
    "task string, model string, balancing string, optimizer string, seed long, status string, reason string, mean_score double, sd_score double, n_evaluations long, "
    "total_s double, search_s double, scores array<double>, params map<string,string>, params_by_fold array<map<string,string>>, traces array<array<double>>, model_path string, recorded_at string"
)


class Store:
    """A table of runs under a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = tuple(KEY), schema: str = SCHEMA):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), list(key), schema

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))), default=0)

    def load(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Upsert; a key that is there already is an error unless overwrite, and so is one that repeats in rows."""
        old, v = self.load(), self.version()
        new = rows.select(*old.columns)
        if new.groupBy(*self.key).count().filter("count > 1").limit(1).count():
            raise ValueError("a key repeats in the rows to add")
        if not overwrite and new.join(old, self.key, "left_semi").limit(1).count():
            raise ValueError("a key is there already")
        old.join(new, self.key, "left_anti").unionByName(new).write.parquet(f"{self.path}/v{v + 1}")

    def status(self, **key) -> str | None:
        r = self.load()
        for k, x in key.items():
            r = r.filter(F.col(k) == x)
        got = r.select("status").head()
        return got[0] if got else None

    def pending(self, plan: DataFrame, retry: Sequence[str] = ("error",)) -> DataFrame:
        """Plan rows that aren't done; errors are tried again."""
        done = self.load().filter(~F.col("status").isin(*retry))
        on = [c for c in self.key if c in plan.columns]
        return plan.join(done.select(*on).distinct(), on, "left_anti")


def decode_json(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Text columns as nested ones; unreadable text becomes null."""
    return df.withColumns({c: F.from_json(c, s, {"mode": "PERMISSIVE"}) for c, s in schemas.items()})


def relative_paths(path: str | Column, root: str) -> Column:
    """Paths below root without it, with forward slashes."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^" + "".join("\\" + x if not x.isalnum() and x != "/" else x for x in root.rstrip("/")) + "/", "")


def summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, done ones, mean score, hours per group."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.avg("mean_score").alias("mean_score"), (F.sum("total_s") / 3600.0).alias("hours"))


def import_best(source: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], origin: str) -> DataFrame:
    """The best row per group of another store, tagged with where it is from."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *tie))
    return source.withColumn("__n", n).filter("__n = 1").drop("__n").withColumn("origin", F.lit(origin))


def anytime(traces: DataFrame, block: Sequence[str], optimizer: str, points: int = 20) -> tuple[DataFrame, DataFrame]:
    """Normalised regret of searches: curves (optimizer, fraction, mean, q25, q75), and per search area, final, evals_to_95.

    traces is long: block, optimizer, step (from 0), value, the best so far.  In a block the best is the greatest value of
    any search, the worst the least first value; blocks where they are equal say nothing.
    """
    w = Window.partitionBy(*block)
    first = F.when(F.col("step") == 0, F.col("value"))
    t = traces.withColumns({"best": F.max("value").over(w), "worst": F.min(first).over(w)}).filter("best > worst")
    t = t.withColumn("regret", (F.col("best") - F.coalesce("value", "worst")) / (F.col("best") - F.col("worst")))
    own = [*block, optimizer]
    t = t.withColumn("n", F.count("*").over(Window.partitionBy(*own)))
    grid = F.explode(F.sequence(F.lit(1), F.lit(points)))
    at = F.least(F.ceil(F.round(F.col("g") / float(points) * F.col("n"), 9)) - 1, F.col("n") - 1)
    curves = t.withColumn("g", grid).filter(F.col("step") == at).groupBy(optimizer, (F.col("g") / float(points)).alias("fraction")).agg(F.avg("regret").alias("mean"), F.percentile("regret", F.lit(0.25)).alias("q25"), F.percentile("regret", F.lit(0.75)).alias("q75"))
    per = t.groupBy(*own).agg(F.avg("regret").alias("area"), F.max_by("regret", "step").alias("final"), (F.min(F.when(F.col("regret") <= 0.05, F.col("step"))) + 1).alias("evals_to_95"))
    return curves, per
