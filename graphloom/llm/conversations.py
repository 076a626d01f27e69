"""Rebuilding conversations from message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..operators.components import components
from ..operators.lookups import lookup

#: Spellings of roles and what they mean (fixed values).
ROLES = {"human": "user", "ai": "assistant", "model": "assistant"}
KNOWN_ROLES = ("user", "assistant", "system")


def role(c: Column) -> Column:
    """Trimmed, lower case, synonyms replaced; null becomes ''."""
    low = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    out = low
    for said, meant in ROLES.items():
        out = F.when(low == said, meant).otherwise(out)
    return out


def identifier_links(messages: DataFrame) -> DataFrame:
    """(a, b): what links the messages of sources that keep no reply or quote links: a message replies to the one a seq
    before it under the same session_id, and messages of one seq, sent again, belong together. Rows without session_id,
    seq or id are linked to nothing."""
    placed = messages.where("session_id is not null and id is not null and seq is not null").select("id", "session_id", F.col("seq").cast("long").alias("seq"))
    anchors = durable(placed.groupBy("session_id", "seq").agg(F.min("id").alias("anchor"), F.count(F.lit(1)).alias("__n")))
    again = lookup(placed, anchors.where("__n > 1"), ["session_id", "seq"], "inner", count="__n").select(F.col("id").alias("a"), F.col("anchor").alias("b"))
    ends = F.explode(F.array(F.struct(F.col("seq").alias("at"), F.col("anchor").alias("a"), F.lit(None).cast(anchors.schema["anchor"].dataType).alias("b")), F.struct((F.col("seq") + 1).alias("at"), F.lit(None).cast(anchors.schema["anchor"].dataType).alias("a"), F.col("anchor").alias("b"))))
    replies = anchors.select("session_id", ends.alias("x")).groupBy("session_id", "x.at").agg(F.max("x.a").alias("a"), F.max("x.b").alias("b")).where("a is not null and b is not null")
    return again.unionByName(replies.select("a", "b"))


def assign(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, part, role, content, seq): messages with the conversation that they belong to.

    Conversations are the connected components of ``links`` (reply and quote links between message ids). A component,
    ``part``, takes the smallest session_id that a row of it carries, and all its rows go by that name, those that carry
    none or another too; components without any identifier are ignored. A session that the links don't hold together
    has several parts.
    """
    rows = messages.where("id is not null").select("id", "session_id", "role", "content", "seq")
    placed = rows.join(components(links, "a", "b"), F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
    placed = durable(placed)
    names = durable(placed.groupBy("part").agg(F.min("session_id").alias("given"), F.count(F.lit(1)).alias("__n")).where("given is not null"))
    named = lookup(placed.drop("session_id"), names, ["part"], "inner", count="__n")
    return named.select(F.col("given").alias("session_id"), "part", role(F.col("role")).alias("role"), "content", F.col("seq").cast("long").alias("seq"))


def faults(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, first_seq, fault) for the sessions of both frames; ``fault`` is null for sound ones.

    ``rows`` from ``assign``; ``sessions`` has an ``id``. All checks are aggregations: first by (session, seq), where a
    row meets the one before it through a copy shifted by one seq, then by session with map-side partial results, so
    a session of any size never sits in one task. Rows alike in session, role, content and seq count once. A session in
    several parts is broken: its messages don't follow each other.
    """
    said = rows.select("session_id", "part", "role", "seq", F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)).alias("filled"), F.sha2("content", 256).alias("digest"))
    once = said.groupBy("session_id", "role", "seq", "filled", "digest").agg(F.min("part").alias("first_part"), F.max("part").alias("last_part"))
    both = once.select(
        "session_id", "role", "filled", "first_part", "last_part", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("seq").alias("at")), F.struct(F.lit(False).alias("own"), (F.col("seq") + 1).alias("at")))).alias("x")
    ).select("session_id", "role", "filled", "first_part", "last_part", "x.own", "x.at").where("own or at is not null")
    own = lambda c: F.when(F.col("own"), c)
    by_seq = both.groupBy("session_id", "at").agg(
        F.count(own(F.lit(1))).alias("n"),
        F.max(own(F.col("role"))).alias("role"),
        F.coalesce(F.max(own(F.col("filled"))), F.lit(False)).alias("filled"),
        F.coalesce(F.max(own(~F.col("role").isin(*KNOWN_ROLES))), F.lit(False)).alias("strange"),
        F.max(F.when(~F.col("own"), F.col("role"))).alias("before"),
        F.min(own(F.col("first_part"))).alias("first_part"),
        F.max(own(F.col("last_part"))).alias("last_part"),
    )
    here = F.col("n") > 0
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))
    spoke = F.when(here & F.col("at").isNotNull() & (F.col("role") != "system"), F.struct("at", "role"))
    by_session = by_seq.groupBy("session_id").agg(
        any_of(F.col("filled")).alias("filled"),
        any_of(here & F.col("at").isNull()).alias("unordered"),
        any_of(F.col("n") > 1).alias("twice"),
        F.min(F.when(here, F.col("at"))).alias("first_seq"),
        (F.min("first_part") < F.max("last_part")).alias("apart"),
        any_of(F.col("strange")).alias("strange"),
        F.max(F.when(here & (F.col("role") == "system"), F.col("at"))).alias("last_system"),
        F.min(spoke)["role"].alias("opener"),
        any_of(here & (F.col("role") == "assistant") & (F.col("before") == "assistant")).alias("monologue"),
        any_of((F.col("before") == "user") & ~(here & (F.col("role") == "assistant") & F.col("filled"))).alias("unanswered"),
    )
    known = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct().withColumn("known", F.lit(True))
    every = by_session.join(known, "session_id", "full")
    broken = (
        F.col("known").isNull()
        | F.col("unordered")
        | F.col("twice")
        | F.col("apart")
        | F.col("strange")
        | F.coalesce(F.col("last_system") > F.col("first_seq"), F.lit(False))
        | (F.coalesce(F.col("opener"), F.lit("")) != "user")
        | F.col("monologue")
    )
    fault = F.when(~F.coalesce(F.col("filled"), F.lit(False)), "empty").when(broken, "broken").when(F.col("unanswered"), "no_reply")
    return every.select("session_id", "first_seq", fault.alias("fault"))


def conversations(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(session_id, turn, role, content): the sound sessions in order, turns counted from 0; one row per message, so a
    long conversation is never built up in one row."""
    sound = judged.where("fault is null").select("session_id", "first_seq")
    once = rows.groupBy("session_id", "seq").agg(F.max("role").alias("role"), F.max("content").alias("content"))
    return lookup(once, sound, ["session_id"], "inner").select("session_id", (F.col("seq") - F.col("first_seq")).alias("turn"), "role", "content")
