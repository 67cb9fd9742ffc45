"""SQL surface (K1): the text functions as SQL temporary functions.

``register_sql_functions(spark)`` defines SQL-bodied functions (no Python:
Catalyst inlines the body), so ``spark.sql("SELECT clean_text(x) ...")``
plans exactly like the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from precis.functions.text import WS_CLASS

__all__ = ["register_sql_functions", "SQL_FUNCTIONS"]


def _lit(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_URL = _lit(r"http[^" + WS_CLASS + r"]+")
_SPECIAL = _lit(r"[^\p{L}\p{N}_" + WS_CLASS + r".,!?']")
_WS = _lit(r"[" + WS_CLASS + r"]+")

SQL_FUNCTIONS = {
    "strip_urls": f"(x STRING) RETURNS STRING RETURN regexp_replace(x, {_URL}, '')",
    "strip_special": f"(x STRING) RETURNS STRING RETURN regexp_replace(x, {_SPECIAL}, '')",
    "normalize_whitespace": f"(x STRING) RETURNS STRING RETURN trim(regexp_replace(x, {_WS}, ' '))",
    "clean_text": (f"(x STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(regexp_replace("
                   f"coalesce(x, ''), {_URL}, ''), {_SPECIAL}, ''), {_WS}, ' '))"),
    "whitespace_tokens": f"(x STRING) RETURNS ARRAY<STRING> RETURN filter(split(coalesce(x, ''), {_WS}), t -> t != '')",
    "preview_text": "(x STRING, n INT) RETURNS STRING RETURN concat(substring(coalesce(x, ''), 1, n), '...')",
    "add_prefix": "(x STRING) RETURNS STRING RETURN concat('summarize: ', coalesce(x, ''))",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
