"""The p-queries of this package, and the same in SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.latest import latest
from ..session import durable, table
from . import conversations, leakage, mixing, setjoin, splitting, subjects

# --- 2: conversations


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "session_messages").where("session_id is not null")
    return durable(conversations.assign(messages, conversations.identifier_links(messages)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.faults(_rows(spark, sf_dir), table(spark, sf_dir, "sessions")).where("fault is not null").select("session_id", "fault")


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound sessions, one row per turn."""
    rows = _rows(spark, sf_dir)
    return conversations.conversations(rows, durable(conversations.faults(rows, table(spark, sf_dir, "sessions"))))


# --- 3: splitting


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the chunks above the limit."""
    return splitting.split(table(spark, sf_dir, "bw_chunks"), "chunk_id", "content", "file_name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("chunk_index = 0").select("chunk_id", "hard_cut")


# --- 6: similar sets


def _tagged(prefix: str, cleaned):  # noqa: ANN001
    return lambda x: F.concat(F.lit(f"{prefix}|"), cleaned(x))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = latest(table(spark, sf_dir, "programs"), "program_id", "ingested_at", ["copybooks", "sql_tables", "callees"])
    kinds = [("copybooks", "c", clean.copybook), ("sql_tables", "t", clean.name), ("callees", "k", clean.name)]
    parts = [F.coalesce(F.transform(c, _tagged(p, f)), F.array().cast("array<string>")) for c, p, f in kinds]
    return durable(setjoin.classes(now.select("program_id", F.concat(*parts).alias("values")), "program_id", "values", least=4))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    pairs = setjoin.expand(sets, durable(setjoin.similar(sets, 0.75)))
    return pairs.select(F.col("a").alias("program_a"), F.col("b").alias("program_b"))


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their overlap."""
    sets = _sets(spark, sf_dir)
    pairs = setjoin.expand(sets, durable(setjoin.similar(sets, 0.75)))
    return pairs.select(F.col("a").alias("program_a"), F.col("b").alias("program_b"), "overlap", "together")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per program: the first program of its class of equal sets, and its number of partners."""
    sets = _sets(spark, sf_dir)
    return setjoin.links(sets, durable(setjoin.similar(sets, 0.75))).select(F.col("key").alias("program_id"), F.col("first").alias("class"), "links")


# --- 7: leakage


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that contain a passage of it."""
    hits = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "eval_items").select("item_id").where("item_id is not null").distinct()
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("documents"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of 24 words within 2 word edits of an item's."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=24, edits=2, bits=10, recall=0.95)


# --- 8: mixing


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", clean.source(F.col("source")).alias("source"), "text")
    targets = table(spark, sf_dir, "source_targets").withColumn("source", clean.source(F.col("source")))
    sized = durable(mixing.sized(docs))
    return sized, durable(mixing.budgets(sized, targets))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that run out: read off the mix itself."""
    return p8_shares(spark, sf_dir).where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document."""
    return mixing.repeated(mixing.mix(*_mix(spark, sf_dir)))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    sized, plan = _mix(spark, sf_dir)
    return mixing.shares(durable(mixing.mix(sized, plan)), plan)


# --- 9: subject areas


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject a document touches, with its share and calibrated posterior."""
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).where(F.col("share") >= subjects.SHARE).select("doc_id", "subject")


def p9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per subject; a document of several subjects counts for each."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", clean.tokens(F.col("text")).alias("size"))
    return p9_found(spark, sf_dir).join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("tokens"))


QUERIES = {f.__name__: f for f in (p2_found, p2_conversations, p3_found, p3_pieces, p6_found, p6_overlaps, p6_links, p7_found, p7_items, p7_near, p8_found, p8_mix, p8_shares, p9_found, p9_subjects, p9_tokens)}

_SESSIONS = r"""
WITH said AS (
  SELECT DISTINCT session_id, content, seq, CASE r WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE r END AS role
  FROM (SELECT *, lower(trim(coalesce(role, ''))) AS r FROM session_messages WHERE session_id IS NOT NULL)),
placed AS (
  SELECT *, coalesce(regexp_matches(content, '\S'), false) AS filled, lag(role) OVER w AS before, lead(role) OVER w AS after, lead(coalesce(regexp_matches(content, '\S'), false)) OVER w AS after_filled,
    min(seq) OVER (PARTITION BY session_id) AS lo FROM said WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
judged AS (
  SELECT session_id, bool_or(filled) AS filled,
    bool_or(seq IS NULL) OR count(*) <> count(DISTINCT seq) OR max(seq) - min(seq) + 1 <> count(DISTINCT seq) OR bool_or(role NOT IN ('user', 'assistant', 'system'))
    OR bool_or(role = 'system' AND seq > lo) OR coalesce(arg_min(role, seq) FILTER (role <> 'system'), '') <> 'user' OR bool_or(role = 'assistant' AND coalesce(before, '') = 'assistant') AS broken,
    bool_or(role = 'user' AND NOT (coalesce(after, '') = 'assistant' AND coalesce(after_filled, false))) AS unanswered
  FROM placed GROUP BY 1),
verdict AS (
  SELECT coalesce(j.session_id, s.id) AS session_id, CASE WHEN NOT coalesce(filled, false) THEN 'empty' WHEN broken OR s.id IS NULL THEN 'broken' WHEN unanswered THEN 'no_reply' END AS fault
  FROM (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL) s FULL JOIN judged j ON s.id = j.session_id)
"""

_SPLIT = r"""
WITH tidy AS (
  SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(content, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', e'\n\n', 'g') AS t FROM bw_chunks)
"""

_SETS = r"""
WITH now AS (SELECT * FROM programs QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY ingested_at DESC) = 1),
held AS (
  SELECT program_id, 'c|' || nullif(regexp_replace(upper(regexp_extract(v, '^\s*(\S+)', 1)), '\.CPY$', ''), '') AS v FROM (SELECT program_id, unnest(copybooks) AS v FROM now)
  UNION SELECT program_id, 't|' || nullif(upper(trim(v)), '') FROM (SELECT program_id, unnest(sql_tables) AS v FROM now)
  UNION SELECT program_id, 'k|' || nullif(upper(trim(v)), '') FROM (SELECT program_id, unnest(callees) AS v FROM now)),
sized AS (SELECT program_id, v, count(*) OVER (PARTITION BY program_id) AS n FROM held WHERE v IS NOT NULL QUALIFY n >= 4),
met AS (
  SELECT a.program_id AS program_a, b.program_id AS program_b, count(*) AS overlap, any_value(a.n + b.n) AS both_n FROM sized a JOIN sized b ON a.v = b.v AND a.program_id < b.program_id GROUP BY 1, 2),
pairs AS (SELECT program_a, program_b, overlap::INT AS overlap, (both_n - overlap)::INT AS together FROM met WHERE overlap >= 0.75 * (both_n - overlap))
"""

# NFKC as far as the tables hold compatibility characters: the full-width forms of ASCII and the no-break space
_LEAKS = """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'i', item_id, text FROM eval_items),
n AS (
  SELECT side, id, regexp_extract_all(lower(translate(replace(replace(text, chr(173), ''), chr(8203), ''), (SELECT string_agg(chr(x::INT + 65248), '' ORDER BY x) FROM range(33, 127) r(x)) || chr(160), (SELECT string_agg(chr(x::INT), '' ORDER BY x) FROM range(33, 127) r(x)) || ' ')), '[a-z0-9]+') AS ws
  FROM w WHERE text IS NOT NULL AND id IS NOT NULL),
g AS (SELECT side, id, array_to_string(ws[i:i + 11], ' ') AS gram FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM n WHERE len(ws) >= 12)),
leaked AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram)
"""

ORACLE = {
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM leaked",
    "p7_items": _LEAKS + "SELECT e.item_id, count(l.doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_items WHERE item_id IS NOT NULL) e LEFT JOIN leaked l USING (item_id) GROUP BY 1",
    "p2_found": _SESSIONS + "SELECT session_id, fault FROM verdict WHERE fault IS NOT NULL",
    "p2_conversations": _SESSIONS + "SELECT session_id, (seq - lo)::BIGINT AS turn, role, content FROM placed JOIN (SELECT session_id FROM verdict WHERE fault IS NULL) USING (session_id)",
    "p3_found": _SPLIT + "SELECT chunk_id, list_bool_or(list_transform(string_split(t, e'\\n'), lambda x: strlen(x) * 10 // 32 > 1000))::INT AS hard_cut FROM tidy WHERE strlen(t) * 10 // 32 > 1000",
    "p6_found": _SETS + "SELECT program_a, program_b FROM pairs",
    "p6_links": _SETS
    + """, same AS (SELECT program_id, min(program_id) OVER (PARTITION BY vs) AS class FROM (SELECT program_id, list_sort(list(v)) AS vs FROM sized GROUP BY 1)),
both_ways AS (SELECT program_a AS program_id FROM pairs UNION ALL SELECT program_b FROM pairs)
SELECT program_id, class, count(b.program_id) AS links FROM same LEFT JOIN both_ways b USING (program_id) GROUP BY 1, 2""",
    "p6_overlaps": _SETS + "SELECT * FROM pairs",
    "p8_found": r"""
WITH sized AS (SELECT replace(lower(trim(source)), '-', '_') AS source, coalesce(strlen(text) * 10 // 32, 0) AS size FROM documents),
per AS (SELECT source, sum(size) AS n FROM sized GROUP BY 1)
SELECT t.source FROM source_targets t LEFT JOIN per USING (source) WHERE max_repeats * coalesce(n, 0) < target_share * (SELECT sum(size) FROM sized)""",
}
