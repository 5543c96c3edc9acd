"""What raw SQL may be: one reading statement."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Words that change data or the session.
BLOCKED = frozenset("insert update delete drop alter create truncate merge replace grant revoke call execute exec copy load vacuum attach detach set reset use refresh cache uncache analyze msck".split())


class UnsafeSqlError(ValueError):
    """The text isn't a single reading statement."""


#: What may hold any words and marks: texts (in which a backslash is an escape for some databases and not for others), quoted names, comments.
_TEXT = {True: r"'(?:''|\\.|[^'\\])*'", False: r"'(?:''|[^'])*'"}
_NAME, _COMMENT = r'"(?:""|[^"])*"|`[^`]*`', r"--[^\n]*|/\*.*?\*/"


def _bare(sql: str, escapes: bool) -> str:
    """The statement, as long as it was, with marks for its texts and quoted names and blanks for its comments."""
    aside = re.compile(f"(?P<kept>{_TEXT[escapes]}|{_NAME})|{_COMMENT}", re.S)
    return aside.sub(lambda m: ("?" if m["kept"] else " ") * len(m[0]), sql)


def _reading(bare: str) -> str:
    """The statement without the mark at its end, if it is one that reads."""
    bare = bare.rstrip()
    bare = bare[:-1].rstrip() if bare.endswith(";") else bare
    if ";" in bare:
        raise UnsafeSqlError("one statement only")
    words = re.findall(r"[a-z_]+", bare.lower())
    if not words or words[0] not in ("select", "with"):
        raise UnsafeSqlError("a statement begins with SELECT or WITH")
    if bad := BLOCKED & set(words):
        raise UnsafeSqlError(f"not allowed: {', '.join(sorted(bad))}")
    return bare


def check(sql: str) -> str:
    """The statement, from its first word to its last, if it reads, however a database takes backslashes in texts."""
    bare = max((_reading(_bare(sql, escapes)) for escapes in (True, False)), key=len)
    return sql[len(bare) - len(bare.lstrip()) : len(bare)]


def run(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, *, allow_raw_sql: bool = False) -> DataFrame:
    if not allow_raw_sql:
        raise UnsafeSqlError("raw SQL needs allow_raw_sql=True")
    return spark.sql(check(sql), args=params or {})
