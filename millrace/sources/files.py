"""Files: strict JSON lines, dual sinks, audit sheets, evaluation questions, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the evaluation sets, each a folder with test.jsonl or test.json.
EVALUATION_SETS = ["math", "olympiadbench", "college_math", "minerva_math", "aime24", "amc23"]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict: a line that is no JSON object of the schema's types fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines as text, for checks that a typed read cannot make (such as present but null keys)."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columns in alphabetical order, nulls kept. ``mode="append"`` adds files to what is there."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_view(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet and, from it, JSON lines: ``path.parquet`` and ``path.jsonl``; the input is computed once."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{path}.parquet")
    write_jsonl(df.sparkSession.read.schema(df.schema).parquet(f"{path}.parquet"), f"{path}.jsonl")


def export_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> None:
    read_jsonl(spark, source, schema).write.mode("overwrite").parquet(target)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the given columns; ValueError for those that are missing."""
    df = spark.read.parquet(path)
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def write_sheet(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header, all strings quoted where needed; nulls are empty. ``mark``: each file begins with a byte order mark, for spreadsheets."""
    names = [("\ufeff" if mark and i == 0 else "") + c for i, c in enumerate(df.columns)]
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).toDF(*names)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as strings; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).fillna("")


def evaluation_questions(spark: SparkSession, root: str, sets: list[str] = EVALUATION_SETS) -> DataFrame:
    """``eval_id, question`` of the evaluation sets under ``root``.

    Of a set the first of test.jsonl and test.json that exists is read, the latter as an array or an object
    with ``data``. The question is the first of problem, question and query that isn't empty; rows are
    numbered before those without one are dropped.
    """
    fields = "struct<problem: string, question: string, query: string>"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    for name in sets:
        for suffix in ("test.jsonl", "test.json"):
            path = f"{root.rstrip('/')}/{name}/{suffix}"
            p = fs_path(path)
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                continue
            whole = spark.read.text(path, wholetext=True)
            if suffix.endswith("l"):
                lines = F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0)
                items = F.transform(lines, lambda x: F.from_json(x, fields))
            else:
                items = F.when(F.ltrim(F.col("value")).startswith("["), F.from_json("value", f"array<{fields}>")).otherwise(F.from_json("value", f"struct<data: array<{fields}>>")["data"])
            rows = whole.select(F.posexplode(items).alias("i", "r"))
            filled = [F.when(F.col(f"r.{c}") != "", F.col(f"r.{c}")) for c in ("problem", "question", "query")]
            rows = rows.select(F.concat(F.lit(name + ":"), F.col("i")).alias("eval_id"), F.coalesce(*filled).alias("question")).where("question is not null")
            out = rows if out is None else out.unionByName(rows)
            break
    return out if out is not None else spark.createDataFrame([], "eval_id string, question string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of files of up to 2 GB, read on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def artifact_digests(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``name, bytes, sha256`` of those artifacts under ``root`` that exist: a file, or the files of a written folder (``name/part-...``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if (h := hadoop(f"{root}/{p}")).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(h)]
    out = spark.createDataFrame([], "name string, bytes bigint, sha256 string")
    for p in there:
        found = file_digests(spark, f"{root}/{p}")
        out = out.unionByName(found.select(F.concat(F.lit(p), F.when(F.endswith(F.col("path"), F.lit("/" + p)), "").otherwise(F.concat(F.lit("/"), F.element_at(F.split("path", "/"), -1)))).alias("name"), "bytes", "sha256"))
    return out


def require_digests(mismatches: DataFrame) -> None:
    """ValueError naming some of the rows of :func:`digest_mismatches`, if there are any."""
    if some := mismatches.orderBy("name").limit(5).collect():
        raise ValueError("files differ or are absent: " + ", ".join(r["name"] for r in some))


def digest_mismatches(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (``name``, ``sha256``) whose file under ``path`` is absent or differs."""
    have = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return expected.join(have, "name", "left").where("found is null or found != sha256")
