"""The scalar functions for use in SQL: temporary SQL functions, which Catalyst inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.sitemap.records import FREQUENCIES

_KINDS = "CASE WHEN instr(p, '$') > 0 AND instr(p, '$') < length(p) THEN NULL WHEN instr(p, '$') > 0 AND contains(p, '*') THEN 'both' WHEN instr(p, '$') > 0 THEN 'ending' WHEN contains(p, '*') THEN 'universal' ELSE 'prefix' END"
_HOURS = " ".join(f"WHEN '{name}' THEN {hours}" for name, hours in FREQUENCIES.items() if hours)
_NAMES = ", ".join(f"'{name}'" for name in FREQUENCIES)

FUNCTIONS = {
    "url_path(u STRING) RETURNS STRING": r"regexp_replace(u, r'(?i)^\s*[a-z][a-z0-9+.\-]*://[^/?#]*', '')",
    "encode_path(p STRING) RETURNS STRING": r"""CASE WHEN p RLIKE r'[^\x21-\x7e]|["<>]' THEN array_join(transform(split(p, ''),
        c -> CASE WHEN c RLIKE r'[^\x21-\x7e]|["<>]' THEN regexp_replace(hex(encode(c, 'UTF-8')), '(..)', r'%$1') ELSE c END), '') ELSE p END""",
    "normalize_path(p STRING) RETURNS STRING": "CASE WHEN startswith(encode_path(p), '/') THEN encode_path(p) ELSE concat('/', encode_path(p)) END",
    "pattern_kind(p STRING) RETURNS STRING": _KINDS,
    "like_pattern(p STRING) RETURNS STRING": rf"""CASE WHEN ({_KINDS}) IS NOT NULL THEN concat(regexp_replace(regexp_replace(regexp_replace(p, r'\$$', ''), '([!%_])', r'!$1'), r'\*+', '%'),
        CASE WHEN endswith(p, '$') THEN '' ELSE '%' END) END""",
    "path_matches(pattern STRING, path STRING) RETURNS BOOLEAN": "normalize_path(path) LIKE like_pattern(normalize_path(pattern)) ESCAPE '!'",
    "change_frequency(t STRING) RETURNS STRING": rf"CASE WHEN lower(regexp_replace(t, r'(?U)^\s+|\s+$', '')) IN ({_NAMES}) THEN lower(regexp_replace(t, r'(?U)^\s+|\s+$', '')) END",
    "next_due(f STRING, since TIMESTAMP) RETURNS TIMESTAMP": f"since + make_dt_interval(0, CASE f {_HOURS} END)",
    "is_outdated(f STRING, since TIMESTAMP, now TIMESTAMP) RETURNS BOOLEAN": "CASE f WHEN 'always' THEN true WHEN 'never' THEN false ELSE next_due(f, since) <= now END",
    "sitemap_priority(t STRING) RETURNS FLOAT": r"CASE WHEN t RLIKE r'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$' AND try_cast(t AS FLOAT) BETWEEN 0 AND 1 THEN try_cast(t AS FLOAT) END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
