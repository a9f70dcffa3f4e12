"""Sources and sinks: Parquet, CSV, JSON, key-value files, spreadsheets, manifests, fingerprints, prediction caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def locate(spark: SparkSession, candidates: Sequence[str], name: str) -> str:
    """The first candidate folder that has name; unzips name + '.zip' beside it where only that is there."""
    for c in candidates:
        for path in (f"{c}/{name}", f"{c}/{name}.zip"):
            fs, p = _fs(spark, path)
            if fs.exists(p):
                return path if not path.endswith(".zip") else unzip(spark, path)
    raise FileNotFoundError(f"{name} is in none of {list(candidates)}")


def unzip(spark: SparkSession, path: str) -> str:
    """Members of an archive written beside it, through Spark's file systems; returns the first member's path."""
    import io
    import zipfile

    content = spark.read.format("binaryFile").load(path).select("content").head()[0]
    folder, first = path.rsplit("/", 1)[0], None
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        for m in z.namelist():
            fs, p = _fs(spark, f"{folder}/{m.rsplit('/', 1)[-1]}")
            out = fs.create(p, True)
            out.write(bytearray(z.read(m)))
            out.close()
            first = first or p.toString()
    return first


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Declared columns; without a header the schema's names are supplied."""
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, source: str, how: str) -> None:
    """CSV with line feeds and a provenance file in the same folder."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
    df.sparkSession.createDataFrame([(source, how)], "source string, how string").coalesce(1).write.mode("append").json(f"{path}/_provenance")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Whole-table rewrite: written beside, the old table set aside, the new one renamed into place, the old one deleted.

    At no moment are both gone: after a crash between the two renames ``recover_parquet`` brings the old table back.
    """
    spark = df.sparkSession
    staged, old = f"{path}__staged", f"{path}__old"
    recover_parquet(spark, path)
    df.write.mode("overwrite").parquet(staged)
    fs, target = _fs(spark, path)
    aside, fresh = _fs(spark, old)[1], _fs(spark, staged)[1]
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(fresh, target):
        fs.rename(aside, target)
        raise OSError(f"{staged} could not be renamed")
    fs.delete(aside, True)


def recover_parquet(spark: SparkSession, path: str) -> None:
    """Finish or undo a rewrite that a crash broke off: the table stays if it is there, else the old one returns."""
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{path}__old")[1]
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)


_CACHE: dict[tuple[str, str], DataFrame] = {}


def shared(spark: SparkSession, path: str) -> DataFrame:
    """One cached relation per path; the suffix picks the reader."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _CACHE:
        kind = path.rsplit(".", 1)[-1]
        reader = {"csv": lambda: spark.read.csv(path, header=True, inferSchema=True), "json": lambda: spark.read.json(path)}
        _CACHE[key] = reader.get(kind, lambda: spark.read.parquet(path))().cache()
    return _CACHE[key]


def key_values(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: a map of all pairs, and one of those whose value is a number."""
    number = F.col(value).try_cast("double")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    numbers = F.map_from_entries(F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct(F.col(key), number.alias("number"))))))
    return df.agg(pairs.alias("texts"), numbers.alias("numbers"))


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of workbooks, long: path, row, column, text, number; all-empty rows and columns don't occur."""

    def cells(batches):
        import io
        import re
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
                    strings = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
                    sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
                    for c in ET.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}c"):
                        v = c.find("m:v", ns)
                        inline = c.find("m:is/m:t", ns)
                        text = inline.text if inline is not None else None if v is None else strings[int(v.text)] if c.get("t") == "s" else v.text
                        if text not in (None, ""):
                            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                            col = 0
                            for ch in letters:
                                col = col * 26 + ord(ch) - 64
                            try:
                                number = float(text.replace(",", "."))
                            except ValueError:
                                number = None
                            rows.append((p, int(row), col, text, number))
            yield pd.DataFrame(rows, columns=["path", "row", "column", "text", "number"]).astype({"number": float})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, row long, column long, text string, number double")


def registry(loaders: dict, name: str, spark: SparkSession, root: str) -> DataFrame:
    """The table of a named loader, refused where a number is missing or not finite."""
    df = loaders[name](spark, root)
    bad = F.lit(False)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(f.name)
            bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.filter(F.when(~bad, True).otherwise(F.raise_error(F.lit("missing or non-finite value")).cast("boolean")))


def manifest(spark: SparkSession, path: str, provenance: DataFrame) -> DataFrame:
    """path, bytes, sha256, source of each file; it fails for a file without provenance (name, source)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    j = f.join(provenance, "name", "left")
    return j.withColumn("source", F.when(F.col("source").isNull(), F.raise_error(F.concat(F.lit("no provenance: "), F.col("name")))).otherwise(F.col("source")))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and a content digest that neither row order nor partitioning changes."""
    text = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(text, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)"))
    g = df.agg(F.count("*").alias("n"), *(part(k).alias(f"p{k}") for k in range(8)))
    return g.select("n", F.sha2(F.concat_ws("-", *(F.coalesce(F.col(f"p{k}"), F.lit(0)).cast("string") for k in range(8))), 256).alias("digest"))


def complete_cache(wanted: DataFrame, cache: DataFrame, compute, key: Sequence[str]) -> DataFrame:
    """The cache plus what ``compute`` gives for wanted keys that it lacks."""
    todo = wanted.join(cache.select(*key).distinct(), list(key), "left_anti")
    return cache.unionByName(compute(todo))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
