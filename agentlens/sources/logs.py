"""Reading and writing the record sets."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.sources.paths import shared_path

#: Columns that older logs may lack, with the value that keeps their meaning.
DECISION_DEFAULTS = {
    "id": "bigint", "ts": "timestamp", "task_id": "string", "selected_agent": "string", "strategy": "string", "success": "int", "reward": "double",
    "latency_s": "double", "cost_usd": "double", "correctness": "double", "escalated_to": "string", "scores": "string", "predictions": "string", "context": "string",
}
SCORE = "map<string,struct<ucb:double,exploit:double,explore:double,variance:double,bucket:string>>"


def decision_log(rows: DataFrame) -> DataFrame:
    """A decision log with all its columns: absent ones are null, importance_weight is 1 where absent or null; JSON text is
    parsed into maps and arrays (null where it does not parse)."""
    have = set(rows.columns)
    out = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in DECISION_DEFAULTS.items()], F.coalesce(F.col("importance_weight") if "importance_weight" in have else F.lit(None).cast("double"), F.lit(1.0)).alias("importance_weight"))
    return out.withColumns({"scores": F.from_json("scores", SCORE), "predictions": F.from_json("predictions", "map<string,double>"), "context": F.from_json("context", "array<double>")})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines, lines that begin with # and torn lines are left out."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#.*)?$"))
    parsed = lines.select(F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return parsed.filter("r._torn IS NULL").select("r.*").drop("_torn")


def result_agent() -> Column:
    """The agent of a result row: the first that is set of the three fields."""
    return F.coalesce("actual_agent", "agent", "requested_agent")


def attempts(spark: SparkSession, path: str, schema: str, defaults: dict, multi_line: bool = True) -> DataFrame:
    """One JSON file an attempt: unknown fields are dropped, a null becomes its field's default."""
    rows = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def _entries(store, folder: str) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a folder of what lies in a folder; files without a byte, and what Spark's reader takes as
    hidden, are left out. Local folders are gone through entry by entry, those of other stores come as one list."""
    if store.type_name == "local":
        with os.scandir(folder) as found:
            seen = ((e.name, e.path, e.is_dir(), e.is_file() and e.stat().st_size > 0) for e in found)
            yield from ((path, is_dir) for name, path, is_dir, filled in seen if (is_dir or filled) and not _hidden(name))
        return
    from pyarrow import fs

    for i in store.get_file_info(fs.FileSelector(folder)):
        is_dir = i.type == fs.FileType.Directory
        if (is_dir or i.size) and not _hidden(i.base_name):
            yield i.path, is_dir


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, path: str, root: str, glob: str, files_per_task: int) -> DataFrame:
    """The files under a folder, hidden and empty ones left out, as a table (file). Tasks list the folders level by level."""
    to, level = shared_path(spark, "listing"), 0

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, rows = fs.FileSystem.from_uri(path)[0], []
        for b in batches:
            for folder in b["file"]:
                for file, is_dir in _entries(store, folder):
                    if is_dir or fnmatchcase(file.rpartition("/")[2], glob):
                        rows.append((file, is_dir))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "folder"])
                        rows = []
        yield pd.DataFrame(rows, columns=["file", "folder"])

    folders, n = spark.createDataFrame([(root,)], "file string"), 1
    while n:
        tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // files_per_task))
        folders.repartition(tasks).mapInPandas(entries, "file string, folder boolean").write.parquet(f"{to}/level={level}")
        folders = spark.read.schema("file string, folder boolean").parquet(f"{to}/level={level}").filter("folder").select("file")
        n, level = folders.count(), level + 1
    return spark.read.schema("file string, folder boolean").parquet(to).filter("NOT folder").select("file")


def whole_files(spark: SparkSession, path: str, glob: str = "*", files_per_task: int = 2000) -> DataFrame:
    """The files under a folder whose name fits ``glob``, each read whole: path, value; ``files_per_task`` to a task.

    Spark's reader holds the list of all files on the driver. Here tasks list the folders into a table and its rows are
    dealt to the tasks that read them, so that the driver holds none. Where only Spark reaches the store, and for patterns
    and single files, Spark's reader it is, with its list."""
    from pyarrow import fs

    local = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    try:
        store, root = fs.FileSystem.from_uri(path) if (":" in path or local) and not re.search(r"[*?\[\]{}\\%]", path) else (None, "")
    except (pa.ArrowInvalid, OSError):
        store, root = None, ""
    if store is None or store.get_file_info(root).type != fs.FileType.Directory:
        found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        tasks = -(-len(found.inputFiles()) // files_per_task)
        return found.select(F.col("_metadata.file_path").alias("path"), "value").coalesce(max(1, tasks))
    at = urlsplit(path)
    begin = "file:" if store.type_name == "local" else f"{at.scheme}://{at.netloc if root.startswith('/') else ''}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, names, bodies, size = fs.FileSystem.from_uri(path)[0], [], [], 0
        for b in batches:
            for file in b.column(0).to_pylist():
                with store.open_input_stream(file) as f:
                    bodies.append(f.read())
                # As Spark names files: the characters that no URI may hold are escaped.
                names.append(begin + re.sub(r"[\x00-\x20\x7f-\xa0%#?\"<>\[\]^`{|}\\]", lambda c: quote(c[0]), file))
                size += len(bodies[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "value"])
                    names, bodies, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "value"])

    files = _listed(spark, path, root.rstrip("/") or "/", glob, files_per_task)
    tasks = -(-files.count() // files_per_task)
    return files.repartition(max(1, tasks)).mapInArrow(read, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def attempt_files(spark: SparkSession, path: str, schema: str, defaults: dict, files_per_task: int = 2000) -> DataFrame:
    """One JSON file an attempt, each read whole: the schema's columns, path and torn (the file holds no JSON object).

    Small files are read ``files_per_task`` to a task. Unknown fields are dropped, a null becomes its field's default; a
    torn file has nulls, so that it can be set apart instead of lost. A file without any byte is no attempt."""
    rows = whole_files(spark, path, files_per_task=files_per_task)
    parsed = rows.select("path", F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r")).select("path", "r.*")
    torn = F.col("_torn").isNotNull()
    return parsed.withColumns({c: F.when(~torn, F.coalesce(F.col(c), F.lit(v))) for c, v in defaults.items()}).withColumn("torn", torn).drop("_torn")


def write_files(rows: DataFrame, path: str) -> int:
    """A file of its own for each row (name, body); names may have folders. A task that runs again writes the same files.
    Returns how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, body in zip(b["name"], b["body"], strict=True):
                store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write((body or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("name", "body").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def export_rows(attempts: DataFrame, tasks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Counted attempts of live tasks with their run's machine and digest, sorted by arm, cond, sha and rep. Sizes decide
    whether Spark broadcasts the two dimensions."""
    return attempts.join(tasks.select("repo", "sha", "committed"), ["repo", "sha"]).join(manifests, "run_id", "left").orderBy("arm", "cond", "sha", "rep", "run_id")


def formatted(rows: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Numbers as text in fixed formats, nulls as empty text: what a CSV of the log holds."""
    return rows.select(*[F.when(F.col(c).isNull(), "").otherwise(F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string")).alias(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str, formats: dict[str, str]) -> None:
    formatted(rows, formats).write.option("header", True).csv(path)


def markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents under a folder: path, title (first heading, else the file's stem), date (name's prefix), kind (first
    folder), body; empty and index files are left out."""
    rows = whole_files(spark, path, "*.md").withColumnRenamed("value", "body")
    root = path.rstrip("/").split("://")[-1]
    inner = F.regexp_replace(F.substring_index("path", root, -1), "^/", "")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    kept = rows.filter((F.trim(F.regexp_replace("body", r"\s+", " ")) != "") & ~F.lower(stem).isin("index", "readme"))
    return kept.select("path", F.when(heading != "", heading).otherwise(stem).alias("title"), F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})", 1).alias("date"), F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1)).otherwise("").alias("kind"), "body")


def replace_scope(rankings: DataFrame, path: str) -> None:
    """Writes materialised rankings; only the scopes in ``rankings`` are replaced."""
    rankings.write.partitionBy("scope_type", "scope_value").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def log_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def newest_runs(spark: SparkSession, path: str, mode: str, n: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("mode") == mode).orderBy(F.desc("started"), F.desc("run_id")).limit(n)
