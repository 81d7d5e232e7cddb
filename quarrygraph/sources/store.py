"""The code index as snapshot tables: scan, build, upsert and delete by file, read back."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..operators import relational as R
from ..schema import DEFS, DOCS, FILES, REFS
from .extract import OVERSIZE, extract

#: Layout of the tables; another one means a rebuild.
VERSION = 2
MARKER = "version int, base bigint"
#: So many generations in a row are written as differences before one is whole again.
COMPACT_AFTER = 16
TABLES = {"files": FILES, "defs": DEFS, "refs": REFS, "docs": DOCS}
#: Folders that are never indexed.
IGNORED_FOLDERS = ".git node_modules target dist build .venv venv __pycache__ .idea".split()


def _ignore_line(p: str) -> str:
    rooted, folder = p.startswith("/") or "/" in p.rstrip("/")[:-1], p.endswith("/")
    body = T.path_glob_regex(p.strip("/"))[1:-1]
    return ("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether ignore-file lines leave a path out: the last line that fits it or any parent folder decides, `!` takes it in again.

    Folders that are never indexed stay out.
    """
    out = F.lit(False)
    for line in lines:
        p = line.strip()
        if p and p[0] != "#":
            out = F.when(path.rlike(_ignore_line(p.removeprefix("!"))), F.lit(p[0] != "!")).otherwise(out)
    return out | path.rlike("|".join(f"(?:^|/){re.escape(f)}/" for f in IGNORED_FOLDERS))


def scan_tree(spark: SparkSession, root: str, ignore_lines: list[str] = ()) -> DataFrame:
    """(fid, path, text, size, mtime, content_hash, whole) of the files to index under `root`; paths are judged before content is used.

    A file over OVERSIZE bytes has no text, and bytes that are no UTF-8 are replaced; neither is `whole`. The hash is of the content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*" + re.escape(root.strip("/")) + "/*", "")
    kept = raw.select(rel.alias("path"), "length", "modificationTime", "content")
    kept = kept.where(T.classify_path(F.col("path"), ignored(F.col("path"), list(ignore_lines))) == "index_full")
    said = F.col("content").cast("string")
    return kept.select(
        F.xxhash64("path").alias("fid"), "path", F.when(F.col("length") <= OVERSIZE, F.make_valid_utf8(said)).otherwise(F.lit("")).alias("text"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash"),
        ((F.col("length") <= OVERSIZE) & F.is_valid_utf8(said)).alias("whole"))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """Index tables of `files` (fid, path, text), with size, mtime, content_hash and whole where a scan gave them.

    A file that isn't whole is partial; an oversize one has no definitions.
    """
    has = set(files.columns)
    rec = cut(extract(files.select("fid", "path", "text")))
    info = files.select(
        "fid", "path", F.col("content_hash") if "content_hash" in has else F.sha2("text", 256).alias("content_hash"),
        (F.unix_micros("mtime") * 1000 if "mtime" in has else F.lit(None).cast("bigint")).alias("mtime_ns"), T.language(F.col("path")).alias("lang"),
        ((F.col("size") if "size" in has else F.octet_length("text")) > OVERSIZE).alias("oversize"), (F.col("whole") if "whole" in has else F.lit(True)).alias("_whole"))
    said = rec.where("record = 'file'").select("fid", "status")
    status = info.select("fid", "_whole").join(said, "fid").select("fid", F.when(F.col("_whole") | (F.col("status") == "failed"), F.col("status")).otherwise("partial").alias("parse_status"))
    return {
        "files": info.join(status, "fid").select(*FILES.names),
        "defs": rec.where("record = 'def'").select(*DEFS.names),
        "refs": rec.where("record = 'ref'").select(F.col("name").alias("callee"), *REFS.names[1:]),
        "docs": rec.where("record = 'doc'").select(*DOCS.names),
    }


def write(tables: dict[str, DataFrame], folder: str, generation: int) -> None:
    """A snapshot generation as a whole: all tables under one folder, then its marker; readers switch by its number."""
    _write(tables, folder, generation, generation)


def write_delta(fresh: dict[str, DataFrame], touched: DataFrame, folder: str, generation: int) -> None:
    """A generation as what differs from the one before it: `fresh` rows of changed files, and `touched` (fid), all changed or removed.

    It costs what the batch holds, not what the index does. Readers unite it with its predecessors back to
    the last whole generation; after COMPACT_AFTER of them the generation is written as a whole.
    """
    spark = touched.sparkSession
    base = _marker(spark, folder, generation - 1)
    if generation - base > COMPACT_AFTER:
        kept = delete_files(load(spark, folder, generation - 1), touched)
        return write({n: kept[n].unionByName(fresh[n]) for n in TABLES}, folder, generation)
    _write(fresh | {"touched": touched.select(F.col("fid").cast("bigint")).distinct()}, folder, generation, base)


def _write(tables: dict[str, DataFrame], folder: str, generation: int, base: int) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/generation={generation}/{name}")
    marker = spark.createDataFrame([(VERSION, base)], MARKER)
    marker.coalesce(1).write.mode("overwrite").parquet(f"{folder}/generation={generation}/_ready_")


def _marker(spark: SparkSession, folder: str, generation: int) -> int:
    """The last whole generation that a generation builds on, itself if it is one."""
    try:
        version, base = spark.read.schema(MARKER).parquet(f"{folder}/generation={generation}/_ready_").first()
    except AnalysisException as e:
        raise ValueError(f"generation {generation} is not complete") from e
    if version != VERSION:
        raise ValueError(f"generation {generation} has layout {version}, not {VERSION}: build it anew")
    return base


def load(spark: SparkSession, folder: str, generation: int) -> dict[str, DataFrame]:
    """The tables of a generation that was written completely, in the layout that this version reads."""
    base = _marker(spark, folder, generation)
    at = lambda g, name, schema: spark.read.schema(schema).parquet(f"{folder}/generation={g}/{name}").withColumn("_at", F.lit(g))
    if base == generation:
        return {n: at(base, n, s).drop("_at") for n, s in TABLES.items()}
    deltas = range(base + 1, generation + 1)
    for g in deltas[:-1]:
        _marker(spark, folder, g)
    # Of each file the rows of the last generation that touched it count, and of the others those of the base.
    last = reduce(DataFrame.union, [at(g, "touched", "fid bigint") for g in deltas]).groupBy("fid").agg(F.max("_at").alias("_last"))
    united = {n: reduce(DataFrame.union, [at(g, n, s) for g in (base, *deltas)]) for n, s in TABLES.items()}
    return {n: df.join(last, "fid", "left").where(F.col("_at") == F.coalesce("_last", F.lit(base))).select(*TABLES[n].names) for n, df in united.items()}


def delete_files(tables: dict[str, DataFrame], fids: DataFrame) -> dict[str, DataFrame]:
    """The tables without any row of the files (fid)."""
    gone = fids.select("fid").distinct()
    return {n: df.join(gone, "fid", "left_anti") for n, df in tables.items()}


def upsert(tables: dict[str, DataFrame], changed: DataFrame, removed: DataFrame) -> dict[str, DataFrame]:
    """The tables after `changed` (fid, path, text) were written again and `removed` (fid) deleted, in one step."""
    kept = delete_files(tables, changed.select("fid").union(removed.select("fid")))
    fresh = build(changed)
    return {n: kept[n].unionByName(fresh[n]) for n in TABLES}


def unresolved_count(tables: dict[str, DataFrame]) -> DataFrame:
    return R.unresolved(tables["refs"], tables["defs"]).agg(F.count("*").alias("unresolved_refs"))


def content_version(hash_: Column, generation: int) -> Column:
    return F.concat(F.left(hash_, F.lit(16)), F.lit(f"@{generation}"))


def fingerprint(parts: list[Column]) -> Column:
    """One hash of what an index depends on; another value means a rebuild."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
