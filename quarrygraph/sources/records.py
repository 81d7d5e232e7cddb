"""Sources of evaluation records and event lines; sinks of reports."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, value): lines of event files with their place, so that of a key the last one wins."""
    x = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "value"))
    return x.where(F.trim("value") != "")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Tool uses (timestamp, name, input as JSON) of a transcript; broken JSON is an error, other shapes are skipped."""
    block = "struct<type:string,name:string,input:string>"
    raw = spark.read.option("mode", "FAILFAST").schema(f"timestamp STRING, message STRUCT<content: ARRAY<{block}>>").json(path)
    return raw.select("timestamp", F.explode("message.content").alias("b")).where("b.type = 'tool_use'").select("timestamp", "b.name", "b.input")


def retrieval_corpus(spark: SparkSession, text: str) -> DataFrame:
    """Queries (query, text, expected) of a TOML corpus; no expected item makes a control."""
    rows = [(f"q{i}", q["text"], list(q.get("expected_top_k", []))) for i, q in enumerate(tomllib.loads(text).get("queries", []))]
    return spark.createDataFrame(rows, "query string, text string, expected array<string>")


def snippet_corpus(spark: SparkSession, text: str) -> DataFrame:
    rows = [(s["name"], s["lang"], s["code"]) for s in tomllib.loads(text).get("snippets", [])]
    return spark.createDataFrame(rows, "name string, lang string, code string")


def edit_corpus(spark: SparkSession, text: str) -> DataFrame:
    rows = [(s["name"], s.get("expected_verdict"), [(e["file"], e["content"]) for e in s.get("edits", [])]) for s in tomllib.loads(text).get("edit_sets", [])]
    return spark.createDataFrame(rows, "name string, expected_verdict string, edits array<struct<file:string,content:string>>")


def report(df: DataFrame, form: str = "json") -> str:
    """A small result as JSON, text or a Markdown table."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if form == "json":
        return json.dumps(rows, default=str)
    head = df.columns
    cells = [[str(r[c]) for c in head] for r in rows]
    if form == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["-"] * len(head), *cells])
    return "\n".join("\t".join(x) for x in [head, *cells])
