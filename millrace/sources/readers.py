"""Readers: whole texts from files or folders, event logs, images, configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION_SUFFIXES = ["jsonl", "json", "log", "txt", "md"]
COMMAND_KEYS = ["command", "cmd", "shell_command", "bash_command"]
OUTPUT_KEYS = ["output", "stdout", "stderr", "tool_output", "result", "content", "text"]
HISTORY = T.StructType([T.StructField(n, t) for n, t in [("timestamp_unix", T.LongType()), ("command", T.StringType()), ("exit_code", T.IntegerType()), ("filter", T.StringType()), ("original_bytes", T.LongType()), ("filtered_bytes", T.LongType()), ("compressed_bytes", T.LongType()), ("bytes_saved", T.LongType()), ("duration_ms", T.LongType())]])


def whole_texts(spark: SparkSession, paths: list[str], recursive: bool = False, suffixes: list[str] | None = None) -> DataFrame:
    """path, text: one row per file; suffixes are compared in lower case, a missing path is an error."""
    found = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(sorted(set(paths)), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if suffixes is None:
        return found
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([s.lower().lstrip(".") for s in suffixes]))


def lines(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """doc_id (the path), pos, content, in file order."""
    return whole_texts(spark, paths, **options).select(F.col("path").alias("doc_id"), F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "content"))


def event_log(spark: SparkSession, path: str, schema: T.StructType = HISTORY) -> DataFrame:
    """A JSON-lines log; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_key(value, keys: list[str]):
    """The first of the keys that a JSON text has, at its top, under `input` or under `arguments`."""
    return F.coalesce(*[F.get_json_object(value, f"$.{at}{k}") for at in ("", "input.", "arguments.") for k in keys])


def session_events(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """doc_id, pos, command, output of session logs in JSON lines; a plain `$ command` line counts as well."""
    d = lines(spark, paths, suffixes=SESSION_SUFFIXES, **options)
    plain = F.nullif(F.regexp_extract("content", r"^\s*\$ (.+)$", 1), F.lit(""))
    is_json = F.ltrim("content").startswith("{")
    return d.select("doc_id", "pos", F.when(is_json, first_key(F.col("content"), COMMAND_KEYS)).otherwise(plain).alias("command"), F.when(is_json, first_key(F.col("content"), OUTPUT_KEYS)).alias("output"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes, header struct(format, width, height) of image files."""
    from millrace.functions.text import image_size

    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.col("length").alias("n_bytes"), image_size(F.col("content")).alias("header"))


def settings(content: str, defaults: dict) -> dict:
    """A TOML configuration over defaults; a table or key that defaults do not know is an error."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for name, value in tomllib.loads(content).items():
        if name not in out:
            raise ValueError(f"unknown setting {name}")
        if isinstance(out[name], dict):
            if unknown := set(value) - set(out[name]):
                raise ValueError(f"unknown settings {sorted(unknown)} in {name}")
            out[name].update(value)
        else:
            out[name] = value
    return out


def recommendations(spark: SparkSession, content: str) -> DataFrame:
    """Learned hints as rows; a malformed file gives none."""
    schema = "auth_mode string, model_family string, structure_hash string, strategy_hint string, confidence double, observations long"
    try:
        rows = tomllib.loads(content).get("recommendation", [])
    except tomllib.TOMLDecodeError:
        rows = []
    names = [p.split()[0] for p in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
