"""One SQL text for Spark and for DuckDB: the few things they spell differently are written as macros.

``TEXTS(x)``: the distinct values of a group, sorted, as one text; ``LISTED(x)``: all its values, sorted, as one text;
``UNNEST(x)``: a row per element; ``DIV(a, b)``: integer division; ``STRIP(x)``: blanks, quotes and full stops off both
ends; ``BYTES(x)``: UTF-8 bytes; ``RX(x, p, r)``: replace every match; ``BIG(x)``: as a 64-bit integer; ``FOUND(x, p)``: all that the first group of a pattern matches, as an array; ``LASTOF(s, f)``: a field of a struct.
"""

from __future__ import annotations

import re

_SPARK = {
    "TEXTS": "array_join(array_sort(collect_set(CAST({0} AS STRING))), ',')",
    "LISTED": "array_join(array_sort(collect_list(CAST({0} AS STRING))), ',')",
    "UNNEST": "explode({0})",
    "DIV": "(({0}) div ({1}))",
    "STRIP": "trim(BOTH ' ''\".' FROM {0})",
    "BYTES": "CAST(octet_length({0}) AS BIGINT)",
    "RX": "regexp_replace({0}, r{1}, {2})",
    "BIG": "CAST({0} AS BIGINT)",
    "FOUND": "regexp_extract_all({0}, r{1}, 1)",
    "LASTOF": "{0}.{1}",
}
_DUCK = {
    "TEXTS": "coalesce(string_agg(DISTINCT CAST({0} AS VARCHAR), ',' ORDER BY CAST({0} AS VARCHAR)), '')",
    "LISTED": "coalesce(string_agg(CAST({0} AS VARCHAR), ',' ORDER BY CAST({0} AS VARCHAR)), '')",
    "UNNEST": "unnest({0})",
    "DIV": "(({0}) // ({1}))",
    "STRIP": "trim({0}, ' ''\".')",
    "BYTES": "CAST(strlen({0}) AS BIGINT)",
    "RX": "regexp_replace({0}, {1}, {2}, 'g')",
    "BIG": "CAST({0} AS BIGINT)",
    "FOUND": "regexp_extract_all({0}, {1}, 1)",
    "LASTOF": "{0}.{1}",
}
_NAME = re.compile(r"\b(" + "|".join(_SPARK) + r")\(")


def _render(sql: str, macros: dict[str, str]) -> str:
    while m := _NAME.search(sql):
        depth, args, at, quoted = 1, [m.end()], m.end(), False
        while depth:
            c = sql[at]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 1:
                    args.append(at + 1)
            at += 1
        ends = [a - 1 for a in args[1:]] + [at - 1]
        parts = [sql[a:b].strip() for a, b in zip(args, ends)]
        sql = sql[: m.start()] + macros[m[1]].format(*parts) + sql[at:]
    return sql


_PACK = re.compile(r"struct_pack\(([^()]*)\)")


def spark_sql(sql: str) -> str:
    packed = lambda m: "named_struct(" + re.sub(r"(\w+) := ", r"'\1', ", m[1]) + ")"
    return _render(_PACK.sub(packed, sql), _SPARK)


def duck_sql(sql: str) -> str:
    return _render(sql, _DUCK)
