"""Copy members written out in place, by joins: a round per nesting depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

_COPY = r"(?i)^[ \t0-9]{0,20}COPY\s+['\"]?([A-Z0-9#@$-]+)['\"]?"


def inline(texts: DataFrame, books: DataFrame, depth: int = 10) -> DataFrame:
    """(key, text): ``texts`` (key, text) with every COPY line replaced by the lines of that member of ``books`` (name, text).

    Names match in any case; of several members with a name the largest text is taken. REPLACING pairs ``==a== BY ==b==``
    are applied to the member's lines in order. A member within itself, one that isn't there, and what lies deeper than
    ``depth`` stay as they are. Lines carry their place as an array of positions, so order needs no window.
    """
    lines = lambda df, *keep: df.select(*keep, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    members = durable(lines(books.where("name is not null and text is not null").groupBy(F.upper("name").alias("name")).agg(F.max("text").alias("text")), "name"))
    known = members.select("name").distinct().withColumn("known", F.lit(True))
    todo = lines(texts.where("key is not null and text is not null"), "key").select("key", F.array("at").alias("place"), "line", F.array().cast("array<string>").alias("within"))
    done = None
    for _ in range(depth + 1):
        name = F.nullif(F.upper(F.regexp_extract("line", _COPY, 1)), F.lit(""))
        named = durable(todo.withColumn("name", name).join(known, "name", "left").withColumn("open", F.coalesce(F.col("known"), F.lit(False)) & ~F.array_contains("within", F.coalesce("name", F.lit("")))))
        plain = named.where("not open").select("key", "place", "line")
        done = plain if done is None else done.unionByName(plain)
        copies = named.where("open")
        if copies.isEmpty():
            todo = None
            break
        pairs = F.zip_with(F.regexp_extract_all("copy", F.lit(r"==(.*?)==\s+BY\s+==.*?=="), F.lit(1)), F.regexp_extract_all("copy", F.lit(r"==.*?==\s+BY\s+==(.*?)=="), F.lit(1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        met = copies.withColumnRenamed("line", "copy").join(members, "name")
        todo = met.select(
            "key", F.concat("place", F.array("at")).alias("place"), F.aggregate(pairs, F.col("line"), lambda s, p: F.replace(s, p["a"], p["b"])).alias("line"), F.concat("within", F.array("name")).alias("within")
        )
    if todo is not None:
        done = done.unionByName(todo.select("key", "place", "line"))
    return done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x")).select("key", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))
