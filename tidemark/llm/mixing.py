"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...; they share the total
size by weight, none above ``MAX_REPEATS`` times its own size, the excess reshared by weight.  Closed
form: in the order of cap / weight the capped sources come first, so one running sum over the table of
sources gives the level of the rest.

Sampling: every document of a source has the expected copies target / source size.  Documents are
numbered within their source; document number j is emitted once for each integer in
(offset + (j - 1) * rate, offset + j * rate], in fixed point, so copies never exceed MAX_REPEATS and
reruns agree.  Numbering is a prefix sum in two levels: rows are numbered within (source, size level,
salt) buckets, and buckets within their source by a running sum over the table of bucket counts.  So a
source with a third of all rows is spread over some thousand buckets; and since buckets go by size,
words taken come within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_name, leave, materialize, packed_rows, quoted, unpacked_rows

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SALTS = 64
#: Fixed point of rates.
ONE = 1 << 30


def _level(size: Column) -> Column:
    """Eight levels for each doubling of the size."""
    top = F.length(F.bin(size)) - 1
    return F.when(size < 8, size).otherwise(top * 8 + F.floor(size / F.pow(F.lit(2.0), top - 3)) % 8).cast("long")


def _digest(docs: DataFrame) -> Column:
    """A digest of all columns, nulls and times to the microsecond included: equal only for identical rows."""
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.sha2(F.to_json(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))), exact).cast("binary"), 256)


def sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size and the bucket of each row, and more columns of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    rows = rows.withColumns({"skey": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")), "dice": order})
    return rows.withColumns({"level": _level(F.col("size")), "salt": F.conv(F.substring("dice", 1, 2), 16, 10).cast("int") % SALTS})


def targets(totals: DataFrame, seed: int) -> DataFrame:
    """totals (skey, source, source_size) with target, step and offset; a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1)
    df = totals.withColumn("weight", w)
    df = df.withColumn("cap", MAX_REPEATS * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight").cast("double"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    df = df.withColumns({"k": F.row_number().over(up), "capped": F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"), "spent": F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")})
    df = df.withColumn("lam", (F.sum("source_size").over(every) - F.col("capped")).cast("double") / (F.sum("weight").over(every) - F.col("spent")).cast("double"))
    df = df.withColumn("first", F.min(F.when(F.col("ratio") >= F.col("lam"), F.col("k"))).over(every))
    df = df.withColumn("level_lam", F.max(F.when(F.col("k") == F.col("first"), F.col("lam"))).over(every))
    target = F.when((F.col("k") >= F.col("first")) & (F.col("level_lam") * F.col("weight") < F.col("cap")), F.col("level_lam") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    df = df.withColumn("target", target)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(ONE)) + 0.5)).otherwise(0).cast("long")
    dice = F.md5(F.concat(F.col("skey"), F.lit(f"#{seed}")).cast("binary"))
    return df.select("skey", "source_size", "target", step.alias("step"), (F.conv(F.substring(dice, 1, 7), 16, 10).cast("long") * 4).alias("offset"))


def mix_sizes(rows: DataFrame, seed: int) -> DataFrame:
    """The rows of ``sized`` with source_size, target and copies."""
    bucket = ["skey", "level", "salt"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    totals = counts.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    before = F.sum("n").over(Window.partitionBy("skey").orderBy("level", "salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    places = counts.withColumn("before", before).join(targets(totals, seed), "skey").select(*bucket, "before", "source_size", "target", "step", "offset")
    ties = [c for c in ("digest",) if c in rows.columns]
    j = F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "dice", F.col("doc_id").asc_nulls_first(), *ties)).cast("long")
    df = rows.withColumn("nth", j).join(places, bucket).withColumn("nth", F.col("nth") + F.col("before"))
    crossed = lambda n: F.expr(f"(cast(offset as decimal(20,0)) + cast({n} as decimal(20,0)) * cast(step as decimal(12,0))) div {ONE}")
    return df.withColumn("copies", (crossed("nth") - crossed("(nth - 1)")).cast("long"))


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies per row of docs.

    Null text has size 0 and takes 0 words; a null source is a source of its own, the last; repeated rows
    are numbered one after another; rows with a null doc_id take part.  An empty table gives none.  Texts count whole, however
    long.  Other columns are ignored, whatever their names.
    """
    rows = leave(materialize(sized(docs, seed), "sizes"))
    return mix_sizes(rows, seed).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixture: each row of docs as often as it is emitted (column ``copy``, from 1), other columns as they were.

    Copies are joined back by a digest of the whole row, so that rows which differ anywhere keep their own;
    identical rows share one decision, the sum of copies over them.  Null texts, sources and ids take part as in mix_report;
    rows without words are emitted at their source's rate like others, and nothing is of an empty table.  Where docs has a column ``copy``, in any case, it stays
    and the new one is named ``copy_`` (or with more underscores); other names can't clash.
    """
    rows = leave(materialize(sized(docs, seed, _digest(docs).alias("digest")), "sizes"))
    picked = mix_sizes(rows, seed).filter("copies > 0").groupBy("digest").agg(F.sum("copies").alias("n_copies"))
    once = packed_rows(docs, _digest(docs).alias("digest")).dropDuplicates(["digest"])
    out = once.join(picked, "digest").select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("nth"))
    name = free_name("copy", docs.columns)
    return unpacked_rows(out.withColumn("row", F.struct("row.*", F.col("nth").alias(name))), [*docs.columns, name])
