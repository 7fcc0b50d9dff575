
from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glean.sources.shipping import ship

#: Explicit schemas: a byte-order mark never ends up in a column name, and nothing is read twice to guess types.
SCHEMAS = {
    "segments": "video_id string, subject string, youtube_id string, start_sec double, end_sec double, start_time string, end_time string, text string",
    "videos": "video_id string, subject string, title string, url string, status string, split string, cv_fold int, annotation_status string, content_style string, duration_min double, channel string",
    "concepts": "subject string, concept string, description string",
    "ground_truth": "video_id string, subject string, concept string",
    "folds": "video_id string, subject string, title string, url string, cv_fold int",
    "chunks": "video_id string, subject string, method string, chunk_id int, start_sec double, end_sec double, raw_text string, processed_text string",
    "frames": "video_id string, subject string, frame_id int, timestamp_sec int, image_file string, ocr_text string, ocr_char_count int, ocr_word_count int, ocr_status string",
    "scores": "video_id string, subject string, method string, chunk_id int, start_sec double, end_sec double, concept string, score double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_by_size(df: DataFrame, mb: int) -> int:
    """Partitions that hold about ``mb`` MB of the files read each, so that a task's memory does not grow with the tables; at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


def read_csv(spark: SparkSession, path: str | list[str], schema: str, **options) -> DataFrame:
    """SRC1, SRC4: CSV with a header and a given schema; globs and lists are one table."""
    return spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", mode="PERMISSIVE", **options).schema(schema).csv(path)


def read_strings(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """SRC2: every column a string, empty cells empty."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns)).fillna("")


def strict_numbers(df: DataFrame, **types: str) -> DataFrame:
    """PRJ2, strict: cast text columns; a value that is no number is an error under ANSI mode."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def lenient_numbers(df: DataFrame, **types: str) -> DataFrame:
    """PRJ2: cast text columns; a value that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """SRC5: the same table, or an error that names what is missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """SRC6."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def read_per_key(spark: SparkSession, folder: str, suffix: str, schema: str, key: str, expected: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC3: all ``{key}{suffix}`` files of a folder as one table, and the expected keys without a file."""
    found = read_csv(spark, f"{folder}/*{suffix}", schema, ignoreCorruptFiles=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix.replace('.', '[.]')}$", 1)
    found = found.withColumn(key, stem)
    missing = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    if strict and (names := [r[0] for r in missing.take(20)]):
        raise FileNotFoundError("no file for " + ", ".join(names))
    return found, missing


def best_source(spark: SparkSession, paths: list[str], schemas: dict[str, str], wanted: list[str], expected_rows: int | None = None) -> str:
    """SRC7, SRC8: of candidate CSV files, the one with most of the wanted columns, then the expected number of rows."""
    def value(path: str) -> tuple[int, bool]:
        header = spark.read.option("header", True).csv(path).limit(0).columns
        names = {c.lstrip("﻿") for c in header}
        rows = spark.read.option("header", True).csv(path).count() if expected_rows is not None else None
        return len(names & set(wanted)), rows == expected_rows

    return max(sorted(p for p in paths if exists(spark, p)), key=value)


def pending(items: DataFrame, done: DataFrame, keys: list[str], finished: Column | None = None) -> DataFrame:
    """SRC10, SRC14, SRC17: items not yet done; ``finished`` tells which rows of ``done`` count."""
    return items.join((done if finished is None else done.where(finished)).select(*keys).distinct(), keys, "left_anti")


def availability(df: DataFrame, found: Column, error: Column) -> DataFrame:
    """SRC11: struct ``screen`` (status, decision, reason); a hard failure excludes, a soft one stays pending."""
    soft = F.coalesce(error, F.lit("")) != ""
    told = lambda status, decision, reason: F.struct(F.lit(status).alias("status"), F.lit(decision).alias("decision"), F.coalesce(reason, F.lit("")).alias("reason"))
    return df.withColumn("screen", F.when(found, told("yes", "include", F.lit(""))).when(soft, told("api_error", "pending", error)).otherwise(told("no", "exclude", F.lit("no transcript"))))


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: (file, sha256, line_no, line) of text files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("body"))
    return files.select("file", "sha256", F.posexplode(F.split("body", "\n")).alias("at", "line")).select("file", "sha256", (F.col("at") + 1).alias("line_no"), "line")


def line_hits(lines: DataFrame, categories: dict[str, str], around: int = 2) -> DataFrame:
    """SRC20, SRC21: lines that match a category, with the lines up to ``around`` before and after."""
    tags = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(c)) for c, p in sorted(categories.items())]), lambda c: c.isNotNull())
    hits = lines.select("file", "line_no", F.explode(tags).alias("category"))
    spread = hits.withColumn("line_no", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around))).distinct()
    return spread.join(lines.select("file", "line_no", "line"), ["file", "line_no"])


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC19."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def crop_box(width: Column, height: Column, top: float, left: float, right: float, bottom: float) -> Column:
    """SRC18: pixel box of fractional edges, kept inside the image and at least one pixel wide and high."""
    x0, y0 = (F.greatest(F.lit(0), F.least(F.floor(d * e), d - 1)) for d, e in ((width, left), (height, top)))
    x1, y1 = (F.least(d, F.greatest(F.floor(d * e), low + 1)) for d, e, low in ((width, right, x0), (height, bottom, y0)))
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def resolve_box(video: Column, context: Column, confidence: Column, subject: Column, default: str) -> Column:
    """TX22: struct(box, origin): the video's box, else a sure context's, else the subject's, else the default."""
    pick = lambda c, n: F.when(c.isNotNull(), F.struct(c.alias("box"), F.lit(n).alias("origin")))
    return F.coalesce(pick(video, "video"), F.when(confidence == "high", pick(context, "context")), pick(subject, "subject"), F.struct(F.lit(default).alias("box"), F.lit("global").alias("origin")))


def replace_after_success(spark: SparkSession, path: str, write) -> None:
    """SNK2: ``write(folder)`` goes to a folder beside ``path``, which takes its place only once it is whole.

    If the write fails, what was there stays as it was. The old folder is moved aside, the
    new one moved in, and the old one moved back should that fail. Readers that list the
    path between the two moves find nothing, never a part.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    fs = at(path).getFileSystem(conf)

    def moved(a: str, b: str) -> bool:
        try:
            return fs.rename(at(a), at(b))
        except Py4JJavaError:  # some file systems refuse with an error
            return False

    try:
        write(new)
        there = fs.exists(at(path))
        if there and not moved(path, old):
            raise OSError(f"{path} cannot be moved aside")
        if not moved(new, path):
            if there:
                moved(old, path)
            raise OSError(f"{new} cannot be moved to {path}")
        if there:
            fs.delete(at(old), True)
    finally:
        fs.delete(at(new), True)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """SNK1, SNK10: ordered columns with a header. SNK2: an old output is replaced after success only."""
    chosen = df.select(*columns) if columns else df
    replace_after_success(df.sparkSession, path, lambda to: chosen.write.option("header", True).option("escape", '"').csv(to))


def text_report(df: DataFrame, key: str, order: str, line: Column, title: Column) -> DataFrame:
    """SNK7: (key, report): a title and the lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    return df.groupBy(key).agg(F.concat_ws("\n", F.min(title), body).alias("report"))


def canonical(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def lock(spark: SparkSession, path: str, config: dict) -> str:
    """SNK6, SNK9: write a configuration once; the same one may be locked again, another one is an error. Returns its SHA-256."""
    digest = hashlib.sha256(canonical(config).encode()).hexdigest()
    if exists(spark, path):
        if (found := spark.read.json(path).first()["sha256"]) != digest:
            raise ValueError(f"{path} holds another configuration ({found[:12]}, not {digest[:12]})")
        return digest
    spark.createDataFrame([(digest, canonical(config))], T.StructType([T.StructField("sha256", T.StringType()), T.StructField("config", T.StringType())])).coalesce(1).write.json(path)
    return digest
