"""Schemas of the tables: the code index, the ledger, telemetry and evaluation records."""

from pyspark.sql import types as t

_TYPES = {
    "INT": t.IntegerType(), "BIGINT": t.LongType(), "STRING": t.StringType(), "BOOLEAN": t.BooleanType(), "DOUBLE": t.DoubleType(), "FLOAT": t.FloatType(),
    "TIMESTAMP": t.TimestampType(), "ARRAY<STRING>": t.ArrayType(t.StringType()), "MAP<STRING,BIGINT>": t.MapType(t.StringType(), t.LongType()),
}


def _ddl(text: str) -> t.StructType:
    """A schema from `name TYPE, ...`; needs no session, unlike StructType.fromDDL."""
    return t.StructType([t.StructField(n, _TYPES[k]) for n, k in (c.split(" ", 1) for c in text.split(", "))])


# Column names, types and order of the tables, as other tools read and write them.
FILES = _ddl("fid BIGINT, path STRING, content_hash STRING, mtime_ns BIGINT, lang STRING, parse_status STRING, oversize BOOLEAN")
DEFS = _ddl("name STRING, fid BIGINT, start INT, end INT, start_line INT, end_line INT, visibility STRING, kind STRING, parent STRING, signature STRING")
REFS = _ddl("callee STRING, fid BIGINT, start INT, end INT, start_line INT, end_line INT, caller STRING, kind STRING, arity INT")
DOCS = _ddl("name STRING, fid BIGINT, text STRING")
FILE_EVENTS = _ddl("seq BIGINT, op STRING, path STRING, text STRING")
TASKS = _ddl("session_id STRING, repo STRING, branch STRING, started_at STRING, ended_at STRING, base_rev STRING, head_rev STRING, lines_added INT, lines_removed INT, files_touched INT, tokens_out INT, context_peak INT, turns INT")
GATE_EVENTS = _ddl("ts STRING, repo STRING, branch STRING, net INT, added INT, removed INT, warn INT, block INT, action STRING, override_reason STRING, session_id STRING")
RETRIEVAL = _ddl("session_id STRING, symbol_id STRING, name STRING, path STRING, rank INT, score DOUBLE, used INT, match_kind STRING")
SNAPSHOTS = _ddl("week STRING, month STRING, rev STRING, loc INT, symbols INT, dup_pct DOUBLE, clone_clusters INT, mean_fan_in DOUBLE, mean_fan_out DOUBLE, deps_direct INT, deps_transitive INT")
LEDGER = {"task": (TASKS, ["session_id"]), "gate": (GATE_EVENTS, ["ts", "repo", "branch", "action"]), "retrieval": (RETRIEVAL, ["session_id", "symbol_id"]), "snapshot": (SNAPSHOTS, ["week"])}
PINGS = _ddl("ingested_at TIMESTAMP, install_id_hash STRING, version STRING, os STRING, arch STRING, uptime_hours INT, languages_indexed ARRAY<STRING>, method_counts MAP<STRING,BIGINT>, method_latency_p50_ms MAP<STRING,BIGINT>, method_latency_p99_ms MAP<STRING,BIGINT>, error_counts MAP<STRING,BIGINT>, cache_hit_rate FLOAT, cold_walk_ms_p50 INT, workspace_size_bucket STRING")
