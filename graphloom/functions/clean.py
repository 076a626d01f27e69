"""Column expressions for the cleaning rules shared by all queries. Null in, null out; blank results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def copybook(c: Column) -> Column:
    """First blank-separated word, upper case, without a final ``.CPY``."""
    word = F.regexp_replace(F.upper(F.regexp_extract(c, r"^\s*(\S+)", 1)), r"\.CPY$", "")
    return F.nullif(word, F.lit(""))


def name(c: Column) -> Column:
    """A table or callee name: trimmed, upper case."""
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def target(c: Column) -> Column:
    """A call target: blanks, quotes and full stops off both ends, upper case, no leading ``codebase::``."""
    bare = F.upper(F.regexp_replace(c, r"""^[\s'".]+|[\s'".]+$""", ""))
    return F.nullif(F.regexp_replace(bare, r"^[^:]*::", ""), F.lit(""))


def source(c: Column) -> Column:
    """A corpus source: trimmed, lower case, ``-`` written as ``_``."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_"), F.lit(""))


def codebase_of(program_id: Column) -> Column:
    """The codebase in a scoped key; a bare key belongs to ``default``."""
    return F.when(F.contains(program_id, F.lit("::")), F.substring_index(program_id, "::", 1)).otherwise(F.lit("default"))


def local_name(program_id: Column) -> Column:
    """A scoped key without its codebase."""
    return F.regexp_replace(program_id, r"^[^:]*::", "")


def tokens(c: Column) -> Column:
    """The project's token estimate: UTF-8 bytes * 10 div 32; null counts 0."""
    return F.coalesce(F.expr("0L") + F.floor(F.octet_length(c) * F.lit(10) / F.lit(32)), F.lit(0)).cast("long")
