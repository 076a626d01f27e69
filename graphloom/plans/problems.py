"""The p-queries of the core, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.hierarchy import ancestor_pairs, forest, nest_by_level
from ..operators.latest import latest
from ..operators.orphans import FOUND, track
from ..operators.skew import count_distinct_per_key
from ..session import table

# --- 1: hierarchies


def data_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, parent) of data items; levels 66, 77, 88 and FILLER don't count, a null level is read from the fqn."""
    items = table(spark, sf_dir, "data_items").select(
        "item_id", "program_id", "line_no", "item_name", F.coalesce("level_no", F.regexp_extract("fqn", r"\.(\d+)\.[^.]*$", 1).try_cast("int")).alias("level")
    )
    counted = items.where("(level is null or level not in (66, 77, 88)) and coalesce(upper(trim(item_name)), '') <> 'FILLER'")
    return nest_by_level(counted, "program_id", "line_no", "level", "item_id")


def call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, parent) of call-chain nodes: the parent is the node that lists it; children without a row don't count."""
    nodes = table(spark, sf_dir, "call_chain_nodes").where("node_id is not null")
    listed = nodes.select(F.col("node_id").alias("parent"), F.explode("children").alias("key")).where("key is not null").select("key", "parent")
    seen = nodes.select(F.col("node_id").alias("key"), F.lit(None).cast("long").alias("parent"))
    both = seen.withColumn("row", F.lit(True)).unionByName(listed.withColumn("row", F.lit(False)))
    return both.groupBy("key").agg(F.min("parent").alias("parent"), F.max("row").alias("row")).where("row").drop("row")


def hierarchies(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    """(hierarchy, node, root, depth, parent, path) of both kinds, climbed together; the last two only with ``paths``."""
    kinds = [links(spark, sf_dir).withColumn("hierarchy", F.lit(name)) for name, links in (("data", data_links), ("call", call_links))]
    return forest(kinds[0].unionByName(kinds[1]), "key", "parent", unique=True, complete=True, paths=paths, scope="hierarchy")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hierarchies(spark, sf_dir, paths=False).where("depth >= 6 or depth is null")
    return placed.select("hierarchy", F.col("node").alias("node_id"), F.coalesce("root", F.lit(-1).cast("long")).alias("root_id"), F.coalesce("depth", F.lit(-1)).alias("depth"))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path as text."""
    return hierarchies(spark, sf_dir).select("hierarchy", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant, distance)."""
    return ancestor_pairs(hierarchies(spark, sf_dir), scope="hierarchy")


# --- 4: orphan references


def call_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "call_targets").select("call_id", "program_id", clean.target(F.col("target")).alias("target"), F.coalesce("is_dynamic", F.lit(False)).alias("dyn"), "extracted_at", "loaded_at")
    return calls.where("target is not null").select(
        F.col("call_id").alias("ref_id"),
        F.when(F.col("dyn"), "data_items").otherwise("programs").alias("kind"),
        F.concat_ws("|", F.when(F.col("dyn"), F.col("program_id")).otherwise(clean.codebase_of(F.col("program_id"))), "target").alias("key"),
        F.col("extracted_at").alias("at"),
        F.col("loaded_at").alias("loaded"),
    )


def call_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = table(spark, sf_dir, "programs").select(
        F.lit("programs").alias("kind"),
        F.concat_ws("|", F.coalesce("codebase", clean.codebase_of(F.col("program_id"))), F.upper(clean.local_name(F.col("program_id")))).alias("key"),
        F.col("ingested_at").alias("arrived"),
        F.col("ingested_at").alias("stamp"),
        "deleted_at",
        F.col("ingested_at").alias("seen"),
    )
    none = F.lit(None).cast("timestamp_ntz" if dict(programs.dtypes)["arrived"] == "timestamp_ntz" else "timestamp")
    item = F.upper(F.trim("item_name"))
    items = table(spark, sf_dir, "data_items").where(item.isNotNull() & (item != "FILLER"))
    return programs.unionByName(
        items.select(F.lit("data_items").alias("kind"), F.concat_ws("|", "program_id", item).alias("key"), none.alias("arrived"), none.alias("stamp"), none.alias("deleted_at"), F.col("seen_at").alias("seen"))
    )


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orphan calls by their last verdict, and the snapshots."""
    state = track(call_refs(spark, sf_dir), call_parents(spark, sf_dir))
    return state.verdicts().where(F.col("status") != FOUND), state.snapshots()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)[0].select(F.col("ref_id").alias("call_id"), "status")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan calls per referenced table and month of extracted_at."""
    return _orphans(spark, sf_dir)[0].groupBy(F.col("kind").alias("referenced"), F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("calls"))


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts as they stood at the end of each month in which something came in."""
    return _orphans(spark, sf_dir)[1].select("as_of", F.col("kind").alias("referenced"), "month", "status", F.col("n").alias("calls"))


# --- 5: heavy keys


def copybook_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, copybook, n) of both tables."""
    items = table(spark, sf_dir, "data_items").select(clean.copybook(F.col("copybook")).alias("copybook"), "item_id")
    now = latest(table(spark, sf_dir, "programs"), "program_id", "ingested_at", ["copybooks"])
    listed = now.select("program_id", F.explode(F.array_distinct(F.transform("copybooks", clean.copybook))).alias("copybook"))
    a = count_distinct_per_key(items, "copybook", "item_id").withColumn("src", F.lit("data_items"))
    b = count_distinct_per_key(listed, "copybook", "program_id").withColumn("src", F.lit("programs"))
    return a.unionByName(b).select("src", "copybook", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = copybook_counts(spark, sf_dir)
    entries = counts.groupBy("src").agg(F.sum("n").alias("entries"))  # two rows, always
    return counts.join(F.broadcast(entries), "src").where("n * 100 >= entries * 3").select("src", "copybook")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per copybook the numbers of items and of programs."""
    n = lambda src: F.coalesce(F.sum(F.when(F.col("src") == src, F.col("n"))), F.lit(0)).cast("long")
    return copybook_counts(spark, sf_dir).groupBy("copybook").agg(n("data_items").alias("items"), n("programs").alias("programs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p4_found, p4_counts, p4_snapshots, p5_found, p5_counts)}

# --- the same in SQL (DuckDB)

_PLACED = r"""
WITH RECURSIVE items AS (
  SELECT DISTINCT item_id, program_id, line_no, item_name, coalesce(level_no, try_cast(regexp_extract(fqn, '\.(\d+)\.[^.]*$', 1) AS INT)) AS level FROM data_items),
counted AS (SELECT * FROM items WHERE (level IS NULL OR level NOT IN (66, 77, 88)) AND coalesce(upper(trim(item_name)), '') <> 'FILLER'),
dlinks AS (
  SELECT a.item_id AS node, arg_max(b.item_id, b.line_no) AS parent FROM counted a LEFT JOIN counted b ON a.program_id = b.program_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY 1),
listed AS (SELECT unnest(children) AS node, node_id AS parent FROM call_chain_nodes),
clinks AS (SELECT n.node_id AS node, min(l.parent) AS parent FROM (SELECT DISTINCT node_id FROM call_chain_nodes) n LEFT JOIN listed l ON l.node = n.node_id GROUP BY 1),
links AS (SELECT 'data' AS hierarchy, node, parent FROM dlinks UNION ALL SELECT 'call', node, parent FROM clinks),
reach AS (
  SELECT hierarchy, node, node AS root, 0 AS depth, node::VARCHAR AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.hierarchy, l.node, r.root, r.depth + 1, r.path || '/' || l.node FROM links l JOIN reach r ON l.hierarchy = r.hierarchy AND l.parent = r.node),
placed AS (SELECT l.hierarchy, l.node, l.parent, r.root, r.depth, r.path FROM links l LEFT JOIN reach r ON l.hierarchy = r.hierarchy AND l.node = r.node)
"""

_ORPHANS = r"""
WITH calls AS (
  SELECT DISTINCT call_id, program_id, coalesce(is_dynamic, false) AS dyn, extracted_at,
    regexp_replace(upper(regexp_replace(target, '^[\s''".]+|[\s''".]+$', '', 'g')), '^[^:]*::', '') AS target,
    CASE WHEN contains(program_id, '::') THEN split_part(program_id, '::', 1) ELSE 'default' END AS codebase FROM call_targets),
arrivals AS (
  SELECT codebase, upper(regexp_replace(program_id, '^[^:]*::', '')) AS name, min(ingested_at) AS arrived, arg_max(struct_pack(d := deleted_at), ingested_at).d AS deleted_at FROM programs GROUP BY 1, 2),
names AS (SELECT DISTINCT program_id, upper(trim(item_name)) AS name FROM data_items WHERE upper(trim(item_name)) <> 'FILLER'),
orphans AS (
  SELECT call_id, extracted_at, CASE WHEN dyn THEN 'data_items' ELSE 'programs' END AS referenced,
    CASE WHEN dyn THEN (CASE WHEN n.name IS NULL THEN 'missing' END) WHEN a.name IS NULL THEN 'missing' WHEN extracted_at < arrived THEN 'late' WHEN deleted_at <= extracted_at THEN 'deleted' END AS status
  FROM calls c LEFT JOIN arrivals a ON NOT c.dyn AND a.codebase = c.codebase AND a.name = c.target LEFT JOIN names n ON c.dyn AND n.program_id = c.program_id AND n.name = c.target
  WHERE c.target <> '')
"""

# each month again over all that had come in by then
_SNAPSHOTS = r"""
WITH calls AS (
  SELECT call_id, program_id, coalesce(is_dynamic, false) AS dyn, extracted_at, min(strftime(loaded_at, '%Y-%m')) AS came,
    regexp_replace(upper(regexp_replace(target, '^[\s''".]+|[\s''".]+$', '', 'g')), '^[^:]*::', '') AS target FROM call_targets GROUP BY ALL),
refs AS (
  SELECT call_id, extracted_at, came, CASE WHEN dyn THEN 'data_items' ELSE 'programs' END AS referenced,
    CASE WHEN dyn THEN program_id WHEN contains(program_id, '::') THEN split_part(program_id, '::', 1) ELSE 'default' END || '|' || target AS k FROM calls WHERE target <> ''),
parents AS (
  SELECT 'programs' AS referenced, codebase || '|' || upper(regexp_replace(program_id, '^[^:]*::', '')) AS k, ingested_at AS arrived, deleted_at, strftime(ingested_at, '%Y-%m') AS came FROM programs
  UNION ALL SELECT 'data_items', program_id || '|' || upper(trim(item_name)), NULL, NULL, strftime(seen_at, '%Y-%m') FROM data_items WHERE upper(trim(item_name)) <> 'FILLER'),
asked AS (SELECT * FROM parents SEMI JOIN refs USING (referenced, k)),
months AS (SELECT came AS as_of FROM refs UNION SELECT came FROM asked),
known AS (SELECT as_of, referenced, k, min(arrived) AS arrived, arg_max(struct_pack(d := deleted_at), coalesce(arrived, TIMESTAMP '1970-01-01')).d AS deleted_at FROM asked, months WHERE came <= as_of GROUP BY 1, 2, 3),
judged AS (
  SELECT m.as_of, r.referenced, r.extracted_at, CASE WHEN p.k IS NULL THEN 'missing' WHEN r.extracted_at < p.arrived THEN 'late' WHEN p.deleted_at <= r.extracted_at THEN 'deleted' END AS status
  FROM refs r JOIN months m ON r.came <= m.as_of LEFT JOIN known p ON p.as_of = m.as_of AND p.referenced = r.referenced AND p.k = r.k)
"""

_COPYBOOKS = r"""
WITH entries AS (
  SELECT DISTINCT 'data_items' AS src, item_id::VARCHAR AS member, regexp_replace(upper(regexp_extract(copybook, '^\s*(\S+)', 1)), '\.CPY$', '') AS copybook FROM data_items
  UNION SELECT 'programs', program_id, regexp_replace(upper(regexp_extract(c, '^\s*(\S+)', 1)), '\.CPY$', '')
  FROM (SELECT program_id, unnest(copybooks) AS c FROM (SELECT * FROM programs QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY ingested_at DESC) = 1))),
counts AS (SELECT src, copybook, count(*) AS n FROM entries WHERE copybook <> '' GROUP BY 1, 2)
"""

ORACLE = {
    "p1_found": _PLACED + "SELECT hierarchy, node AS node_id, coalesce(root, -1)::BIGINT AS root_id, coalesce(depth, -1)::INT AS depth FROM placed WHERE depth >= 6 OR depth IS NULL",
    "p1_paths": _PLACED + "SELECT hierarchy, node AS node_id, root AS root_id, depth, path FROM placed",
    "p1_descendants": _PLACED
    + "SELECT hierarchy, split_part(path, '/', i::INT)::BIGINT AS ancestor, node AS descendant, (depth + 1 - i)::INT AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM placed WHERE depth > 0)",
    "p4_found": _ORPHANS + "SELECT call_id, status FROM orphans WHERE status IS NOT NULL",
    "p4_snapshots": _SNAPSHOTS + "SELECT as_of, referenced, strftime(extracted_at, '%Y-%m') AS month, status, count(*) AS calls FROM judged WHERE status IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p4_counts": _ORPHANS + "SELECT referenced, strftime(extracted_at, '%Y-%m') AS month, status, count(*) AS calls FROM orphans WHERE status IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": _COPYBOOKS + "SELECT src, copybook FROM counts QUALIFY n * 100 >= 3 * sum(n) OVER (PARTITION BY src)",
    "p5_counts": _COPYBOOKS + "SELECT copybook, coalesce(sum(n) FILTER (src = 'data_items'), 0)::BIGINT AS items, coalesce(sum(n) FILTER (src = 'programs'), 0)::BIGINT AS programs FROM counts GROUP BY 1",
}
