"""Queries of traversal, mutation, incremental, text and search operators over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, packing, recover, source
from ..functions.clean import tokens
from ..operators import incremental, repair, search, traverse, upsert
from ..session import durable, table
from ..sources import extraction
from ..streaming import streams
from .views import duck, run, view

#: Hops of a call chain unless the caller asks for more, of an impact analysis or a path, and the most of a chain.
CHAIN, IMPACT, MOST_CHAIN = 3, 5, 10


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(view(spark, sf_dir, "calls"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "program").select("id")


def pth01_call_chain(spark: SparkSession, sf_dir: str, hops: int = CHAIN) -> DataFrame:
    """Every program's callees (downstream) and callers (upstream) within three hops, or as many as asked for up to ten, with the least depth."""
    hops = CHAIN if hops < 1 else min(hops, MOST_CHAIN)
    met = traverse.reach(_calls(spark, sf_dir), _ids(spark, sf_dir).select(F.col("id").alias("key"), F.col("id").alias("node")), hops, paths=False).where("depth > 0")
    # whoever calls at a depth is called at that depth, so one traversal gives both directions
    way = lambda program, other, direction: met.select(F.col(program).alias("program"), F.col(other).alias("other"), "depth", F.lit(direction).alias("direction"))
    return way("key", "node", "downstream").unionByName(way("node", "key", "upstream"))


def pth02_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs within five hops down and up, a program on a cycle among its own, and the copybooks and files shared with another program.

    Files are the data sets of the job steps that run the program, for the orders that stand for files belong to parts.
    """
    ids = _ids(spark, sf_dir).select(F.col("id").alias("program"))
    met = traverse.reach(_calls(spark, sf_dir), ids.select(F.col("program").alias("key"), F.col("program").alias("node")), IMPACT, restart=True, paths=False)
    listed = lambda rows, program, other, name: rows.groupBy(F.col(program).alias("program")).agg(F.array_sort(F.collect_set(other)).alias(name))
    shared = lambda rows, other: rows.join(rows.groupBy(other).agg(F.count_distinct("program").alias("n")).where("n > 1").select(other), other)
    names = ["downstream", "upstream", "shared_copybooks", "shared_files"]
    parts = [listed(met, "key", "node", names[0]), listed(met, "node", "key", names[1])]
    parts += [listed(shared(rows, c), "program", c, name) for rows, c, name in ((view(spark, sf_dir, "includes"), "copybook", names[2]), (_step_files(spark, sf_dir), "dsname", names[3]))]
    out = ids
    for part in parts:
        out = out.join(part, "program", "left")
    out = out.select("program", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in names])
    n = lambda c: F.size(c).cast("long")
    return out.select("program", n("downstream").alias("down"), n("upstream").alias("up"), (n("downstream") + n("upstream")).alias("total"), *[F.array_join(c, ",").alias(c) for c in names])


def _step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, dsname): the data sets whose cards follow an EXEC card of the program, before the next one."""
    steps = table(spark, sf_dir, "documents").where("text like '% EXEC PGM=%'").select(F.explode(F.split("text", "(?=//[A-Z0-9]+ EXEC PGM=)")).alias("step"))
    cards = steps.select(F.regexp_extract("step", "^//[A-Z0-9]+ EXEC PGM=([A-Z0-9]+)", 1).alias("name"), F.explode(F.regexp_extract_all("step", F.lit("//[A-Z0-9]+ DD DSN=([A-Z0-9.]+)"), 1)).alias("dsname"))
    return cards.distinct().join(view(spark, sf_dir, "program").select("name", F.col("id").alias("program")), "name").select("program", "dsname").distinct()


def pth04_dead_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "paragraph").select(F.col("program").alias("key"), F.col("i").cast("long").alias("node"))
    edges = view(spark, sf_dir, "performs").select(F.col("program").alias("key"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return traverse.dead_nodes(nodes, edges).select(F.col("key").alias("program"), F.col("node").alias("paragraph"))


def pth06_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from every program to each callee within five hops; of several the smallest."""
    met = traverse.reach(_calls(spark, sf_dir), _ids(spark, sf_dir).select(F.col("id").alias("key"), F.col("id").alias("node")), IMPACT)
    return met.where("depth > 0").select(F.col("key").alias("program"), F.col("node").alias("callee"), F.array_join("path", " > ").alias("path"))


def pth07_migration_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traverse.layers(_ids(spark, sf_dir).select(F.col("id").alias("node")), _calls(spark, sf_dir))
    return out.select(F.col("node").alias("program"), "layer", "tier")


def src29_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All program rows folded into one per key, column by column."""
    return upsert.upsert(table(spark, sf_dir, "programs"), "program_id", "ingested_at", ["file_path", "source_language", "line_count", "execution_mode", "risk_score"])


def src30_shared_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copybooks with the codebases that use them."""
    rows = view(spark, sf_dir, "includes").join(view(spark, sf_dir, "program").select(F.col("id").alias("program"), "codebase"), "program").withColumn("seq", F.lit(0))
    return upsert.upsert(rows, "copybook", "seq", [], ["codebase"]).select("copybook", F.array_join("codebase", ",").alias("codebases"))


def src31_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT 'CALLS' AS type, c.src, c.dst, t.extracted_at AS seq, t.is_dynamic FROM called c JOIN call_targets t ON t.program_id = c.src AND split_part(upper(STRIP(t.target)), '::', -1) = split_part(c.dst, '::', -1)")
    nodes = _ids(spark, sf_dir).select(F.col("id").alias("node"))
    return upsert.upsert_edges(rows, nodes, nodes, "seq", ["is_dynamic"])


def src35_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.stubs(view(spark, sf_dir, "called"), _ids(spark, sf_dir).select(F.col("id").alias("node"))).select(F.col("node").alias("program"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "programs")
    whole = F.to_json(F.struct(*[c for c in rows.columns if c not in ("program_id", "ingested_at")]))
    rows = rows.select("program_id", "ingested_at", F.sha2(whole, 256).alias("hash"))
    pick = lambda f: rows.groupBy("program_id").agg(f("hash", "ingested_at").alias("hash"))
    return pick(F.max_by), pick(F.min_by)


def inc02_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs whose latest row differs from their first in any column but the time of ingestion."""
    now, then = _versions(spark, sf_dir)
    return incremental.changed(now, then, ["program_id"]).select("program_id")


def inc14_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.complete(view(spark, sf_dir, "chunk"), "file_name", "chunk_index", "chunk_total")


def jsn26_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "item").select("fqn", "item_id", "picture")
    return incremental.first_wins(rows, ["fqn"], ["item_id"])


def txt02_strip_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", source.strip_sequence(F.col("text")).alias("text"))


def txt09_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text like '%PROGRAM-ID.%'").select("doc_id", F.posexplode(source.paragraphs(F.coalesce(source.division(F.col("text"), "PROCEDURE"), F.col("text")))).alias("i", "p"))
    return docs.select("doc_id", "i", "p.name", F.length("p.body").alias("size"))


def txt31_data_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent of every counted data item."""
    from .problems import data_links

    return data_links(spark, sf_dir).select(F.col("key").alias("item_id"), F.col("parent").alias("parent_id"))


def txt32_pic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "item").where("coalesce(picture, '') <> ''").select("item_id", source.pic_types(F.col("picture"), F.col("usage")).alias("t"))
    return rows.select("item_id", "t.java", "t.sql", "t.storage", "t.bytes")


def txt34_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees with similar names."""
    rows = view(spark, sf_dir, "calls").select("src", "dst", source.fuzzy(F.substring_index("src", "::", -1), F.substring_index("dst", "::", -1)).alias("f"))
    return rows.where("f is not null").select("src", "dst", F.round("f.score", 6).alias("score"), "f.reason")


def txt44_tagged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps out of tagged JSON blocks in reports, recovered where the block is cut off; the first row of an id in a document wins."""
    block = F.regexp_extract("text", r"(?s)<gaps>(.*?)(?:</gaps>|\z)", 1)
    docs = table(spark, sf_dir, "documents").where("text like '%<gaps>%'").select("doc_id", recover.recovered(block).alias("json"))
    rows = docs.select("doc_id", F.posexplode(F.from_json("json", "array<struct<id:string,severity:string,title:string>>")).alias("at", "g")).select("doc_id", "at", "g.*")
    return incremental.first_wins(rows.where("id is not null"), ["doc_id", "id"], ["at"]).select("doc_id", "id", "severity", "title")


def fts01_search(spark: SparkSession, sf_dir: str, query: str = "claim reserve abend restart", limit: int = 100) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", query, top=limit)


QUERIES = {
    f.__name__: f
    for f in (
        pth01_call_chain, pth02_impact, pth04_dead_paragraphs, pth06_shortest_path, pth07_migration_sequence, src29_node_upsert, src30_shared_upsert, src31_edge_upsert,
        src35_stubs, inc02_changed, inc14_completion, jsn26_first_wins, txt02_strip_sequence, txt09_paragraphs, txt31_data_hierarchy, txt32_pic_types, txt34_fuzzy, txt44_tagged_gaps, fts01_search,
    )
}

_CHAIN = """WITH RECURSIVE walk(program, callee, depth, path) AS (SELECT src, dst, 1, src || ' > ' || dst FROM calls WHERE src <> dst
  UNION SELECT w.program, c.dst, w.depth + 1, w.path || ' > ' || c.dst FROM walk w JOIN calls c ON c.src = w.callee WHERE w.depth < 3 AND c.dst <> w.program) """
_DEAD = """WITH RECURSIVE entry_point AS (SELECT program, i FROM paragraph q WHERE NOT EXISTS (SELECT 1 FROM performs f WHERE f.program = q.program AND f.dst = q.i)),
  met AS (SELECT program, i FROM entry_point UNION SELECT m.program, f.dst FROM met m JOIN performs f ON f.program = m.program AND f.src = m.i),
  dead AS (SELECT q.program, q.i FROM paragraph q WHERE EXISTS (SELECT 1 FROM entry_point e WHERE e.program = q.program) AND NOT EXISTS (SELECT 1 FROM met m WHERE m.program = q.program AND m.i = q.i)) """
_RAW = {
    "pth06_shortest_path": _CHAIN.replace("w.depth < 3", "w.depth < 5").replace("src || ' > ' || dst", "[src, dst]").replace("w.path || ' > ' || c.dst", "list_append(w.path, c.dst)")
    + "SELECT program, callee, array_to_string(min(path), ' > ') AS path FROM (SELECT *, min(depth) OVER (PARTITION BY program, callee) AS least FROM walk) WHERE depth = least GROUP BY 1, 2",
    "txt02_strip_sequence": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN strlen(x) < 7 THEN x ELSE array_to_string(list_transform(
  list_filter(range(1, least(length(x), 72) + 1), lambda i: strlen(x[1:i - 1]) >= 6 AND strlen(x[1:i]) <= 72), lambda i: x[i]), '') END), chr(10)) AS text FROM documents WHERE text IS NOT NULL""",
    "txt09_paragraphs": r"""WITH body AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?ims)^[ \t0-9]{0,11}PROCEDURE[ \t]+DIVISION\b.*', 0), ''), text) AS t FROM documents WHERE text LIKE '%PROGRAM-ID.%'),
  line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM body),
  named AS (SELECT *, nullif(upper(regexp_extract(x, '(?i)^(?:[0-9]{6}[ \t]{1,4}|[ \t]{1,10})([A-Z0-9][A-Z0-9_-]*)(?:[ \t]+SECTION)?[.][ \t]*$', 1)), '') AS h FROM line),
  part AS (SELECT *, count(h) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM named),
  whole AS (SELECT doc_id, k, coalesce(max(h), 'PREAMBLE') AS name, coalesce(sum(length(x) + 1) FILTER (h IS NULL), 0) AS size, bool_or(h IS NULL AND regexp_matches(x, '\S')) AS filled FROM part GROUP BY 1, 2)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS i, name, size::INT AS size FROM whole WHERE k > 0 OR filled""",
    "pth01_call_chain": _CHAIN + """, least AS (SELECT program, callee, min(depth)::INT AS depth FROM walk GROUP BY 1, 2)
  SELECT program, callee AS other, depth, 'downstream' AS direction FROM least UNION ALL SELECT callee, program, depth, 'upstream' FROM least""",
    "pth02_impact": """WITH RECURSIVE walk(program, other, depth) AS (SELECT src, dst, 1 FROM calls UNION SELECT w.program, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.other WHERE w.depth < 5),
  met AS (SELECT DISTINCT program, other FROM walk), books AS (SELECT program, copybook FROM includes WHERE copybook IN (SELECT copybook FROM includes GROUP BY 1 HAVING count(*) > 1)),
  cards AS (SELECT regexp_extract(step, '^//[A-Z0-9]+ EXEC PGM=([A-Z0-9]+)', 1) AS name, unnest(regexp_extract_all(step, '//[A-Z0-9]+ DD DSN=([A-Z0-9.]+)', 1)) AS dsname FROM (
    SELECT unnest(regexp_extract_all(regexp_replace(text, '(//[A-Z0-9]+ EXEC PGM=)', chr(1) || '\\1', 'g'), chr(1) || '([^' || chr(1) || ']*)', 1)) AS step FROM documents WHERE contains(text, ' EXEC PGM='))),
  files AS (SELECT DISTINCT p.id AS program, dsname FROM cards c JOIN program p ON p.name = c.name), shared AS (SELECT program, dsname FROM files WHERE dsname IN (SELECT dsname FROM files GROUP BY 1 HAVING count(DISTINCT program) > 1))
  SELECT id AS program, (SELECT count(*) FROM met WHERE program = p.id) AS down, (SELECT count(*) FROM met WHERE other = p.id) AS up, (SELECT count(*) FROM met WHERE program = p.id) + (SELECT count(*) FROM met WHERE other = p.id) AS total,
    (SELECT TEXTS(other) FROM met WHERE program = p.id) AS downstream, (SELECT TEXTS(program) FROM met WHERE other = p.id) AS upstream, (SELECT TEXTS(copybook) FROM books b WHERE b.program = p.id) AS shared_copybooks, (SELECT TEXTS(dsname) FROM shared s WHERE s.program = p.id) AS shared_files FROM program p""",
    "pth04_dead_paragraphs": _DEAD + "SELECT program, i AS paragraph FROM dead",
    "src29_node_upsert": "SELECT program_id, "
    + ", ".join(f"arg_max({c}, ingested_at) FILTER ({c} IS NOT NULL) AS {c}" for c in ("file_path", "source_language", "line_count", "execution_mode", "risk_score"))
    + " FROM (SELECT DISTINCT * FROM programs) GROUP BY 1",
    "src30_shared_upsert": "SELECT i.copybook, TEXTS(p.codebase) AS codebases FROM includes i JOIN program p ON p.id = i.program GROUP BY 1",
    "src31_edge_upsert": """SELECT 'CALLS' AS type, c.src, c.dst, max(struct_pack(s := t.extracted_at, v := t.is_dynamic)) FILTER (t.is_dynamic IS NOT NULL).v AS is_dynamic FROM calls c
  JOIN call_targets t ON t.program_id = c.src AND split_part(upper(STRIP(t.target)), '::', -1) = split_part(c.dst, '::', -1) GROUP BY 2, 3""",
    "src35_stubs": "SELECT DISTINCT dst AS program FROM called WHERE dst NOT IN (SELECT id FROM program)",
    "inc02_changed": """SELECT program_id FROM (SELECT program_id, arg_max(r, r.ingested_at) AS a, arg_min(r, r.ingested_at) AS b FROM (SELECT program_id, programs AS r FROM programs) GROUP BY 1)
  WHERE struct_update(a, ingested_at := 0) IS DISTINCT FROM struct_update(b, ingested_at := 0)""",
    "inc14_completion": """SELECT file_name, count(DISTINCT CASE WHEN chunk_index >= 0 AND chunk_index < chunk_total THEN chunk_index END) AS parts, max(chunk_total) AS expected,
  coalesce(count(DISTINCT CASE WHEN chunk_index >= 0 AND chunk_index < chunk_total THEN chunk_index END) = max(chunk_total), false) AS complete FROM chunk WHERE file_name IS NOT NULL GROUP BY 1""",
    "jsn26_first_wins": "SELECT fqn, min(item_id) AS item_id, arg_min(struct_pack(p := picture), item_id).p AS picture FROM item GROUP BY 1",
    "txt31_data_hierarchy": """WITH counted AS (SELECT * FROM item WHERE level NOT IN (66, 77, 88) AND upper(name) <> 'FILLER')
  SELECT a.item_id, arg_max(b.item_id, b.line_no) AS parent_id FROM counted a LEFT JOIN counted b ON b.program = a.program AND b.line_no < a.line_no AND b.level < a.level GROUP BY 1""",
    "fts01_search": """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
  s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t), h AS (SELECT doc_id, len(ws) AS l, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM t) WHERE w IN ('claim', 'reserve', 'abend', 'restart') GROUP BY 1, 2, 3),
  d AS (SELECT w, count(*) AS df FROM h GROUP BY 1)
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score FROM h JOIN d USING (w), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 100""",
}
ORACLE = {k: duck(v) for k, v in _RAW.items()}


# --- repairs, classification and packing


def mut01_mark_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "program").select("id", "file_path", "language", "external")
    return repair.mark_external(rows, view(spark, sf_dir, "calls")).select("id", "language", "external")


def mut03_revive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted programs count as dead unless a job runs them or a sourced program calls them."""
    rows = view(spark, sf_dir, "program").select("id", "file_path", F.col("deleted_at").isNotNull().alias("dead"))
    runs = run(spark, sf_dir, "SELECT DISTINCT p.id AS program FROM exec_of e JOIN program p ON p.name = e.program")
    return repair.revive(rows, view(spark, sf_dir, "calls"), runs).select("id", "dead")


def mut05_link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = view(spark, sf_dir, "dd").select(F.concat_ws("/", "job", "step", "dsname").alias("dd"), F.lit("SYSUT1").alias("name"), "dsname").distinct()
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("file"))
    return repair.link_cards(cards, files)


def src07_content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", classify.by_content(F.col("text")).alias("kind"))


def jsn32_document_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "chunk").select("chunk_id", classify.document_kind(F.col("file_name")).alias("kind"))


def jsn21_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "program").select("id", classify.normal(F.col("mode"), "execution_mode").alias("mode"))


def txt26_packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middleware chunks packed into pieces of at most 500 tokens."""
    rows = view(spark, sf_dir, "chunk").where("content is not null").select("chunk_id", F.posexplode(packing.packed(500)(F.col("content"), classify.extension(F.col("file_name")))).alias("i", "piece"))
    return rows.select("chunk_id", "i", tokens(F.col("piece")).alias("tokens"))


def ext01_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type: the batch run of the streaming aggregation."""
    return streams.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")


QUERIES |= {f.__name__: f for f in (mut01_mark_external, mut03_revive, mut05_link_cards, src07_content_kind, jsn32_document_kind, jsn21_enum, txt26_packed_sections, ext01_event_windows)}
ORACLE |= {
    k: duck(v)
    for k, v in {
        "mut01_mark_external": """SELECT id, CASE WHEN file_path IS NULL AND id IN (SELECT dst FROM calls) THEN coalesce(language, 'EXTERNAL') ELSE language END AS language,
  external OR (file_path IS NULL AND id IN (SELECT dst FROM calls)) AS external FROM program""",
        "mut03_revive": """SELECT id, deleted_at IS NOT NULL AND id NOT IN (SELECT c.dst FROM calls c JOIN program p ON p.id = c.src WHERE p.file_path IS NOT NULL) AND name NOT IN (
  SELECT unnest(regexp_extract_all(text, '//[A-Z0-9]+ EXEC PGM=([A-Z0-9]+)', 1)) FROM documents WHERE text IS NOT NULL) AS dead FROM program""",
        "mut05_link_cards": "SELECT DISTINCT job || '/' || step || '/' || dsname AS dd, 'S' || s_suppkey AS file, 'dsname' AS method FROM dd JOIN supplier ON dsname = 'PROD.S' || s_suppkey",
        "jsn32_document_kind": "SELECT chunk_id, CASE lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'java' THEN 'Java' WHEN 'md' THEN 'Markdown' WHEN 'xml' THEN 'XML' ELSE 'Unknown' END AS kind FROM chunk",
        "jsn21_enum": "SELECT id, CASE WHEN upper(mode) IN ('BATCH', 'CICS', 'BATCH_AND_CICS', 'IDMS_DC', 'IDMS_BATCH') THEN upper(mode) ELSE 'UNKNOWN' END AS mode FROM program",
        "ext01_event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    }.items()
}


# --- extraction documents, written out of the programs and read back by the contract


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.transform("callees", lambda x: F.struct(x.alias("target"), F.lit(False).alias("isDynamic")))
    body = F.to_json(F.struct(F.col("id").alias("programId"), F.col("mode").alias("executionMode"), F.col("copybooks").alias("copyReferences"), targets.alias("callTargets")))
    return view(spark, sf_dir, "program").select(F.col("id").alias("key"), F.col("id").alias("program"), body.alias("json"))


def jsn05_copy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.frames(extraction.parse(_documents(spark, sf_dir), "structure"), "structure")
    return out["includes"].select("program", "copybook").distinct()


def jsn05_call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.frames(extraction.parse(_documents(spark, sf_dir), "structure"), "structure")
    return out["calls"].select("src", "dst", "is_dynamic").distinct()


def jsn29_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "program").select(F.col("id").alias("key"), "line_count")
    return extraction.completeness(extraction.parse(_documents(spark, sf_dir), "structure"), lines)


def txt13_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text like '%DIVISION%'").select("doc_id", source.preamble(F.col("text")).alias("preamble"))


def oth31_java_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "chunk").where("file_name like '%.java' and content is not null").select("chunk_id", source.java_outline(F.col("content")).alias("outline"))


def txt27_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ratio of tokens over a quarter of the characters, per kind of middleware file."""
    rows = view(spark, sf_dir, "chunk").where("content is not null").select("chunk_id", classify.extension(F.col("file_name")).alias("kind"), (F.length("content") / 4).alias("estimated"), tokens(F.col("content")).alias("actual"))
    return incremental.calibration(rows, "kind", "chunk_id", "estimated", "actual").select("chunk_id", F.round("factor", 6).alias("factor"))


QUERIES |= {f.__name__: f for f in (jsn05_copy_references, jsn05_call_targets, jsn29_completeness, txt13_preamble, oth31_java_outline, txt27_calibration)}
ORACLE |= {
    k: duck(v)
    for k, v in {
        "jsn05_copy_references": "SELECT DISTINCT upper(id) AS program, upper(trim(c)) AS copybook FROM (SELECT id, UNNEST(copybooks) AS c FROM program) WHERE trim(c) <> ''",
        "jsn05_call_targets": "SELECT DISTINCT upper(id) AS src, upper(trim(c)) AS dst, false AS is_dynamic FROM (SELECT id, UNNEST(callees) AS c FROM program) WHERE trim(c) <> ''",
        "txt27_calibration": """SELECT chunk_id, round(avg(CASE WHEN length(content) > 0 THEN (strlen(content) * 10 // 32) / (length(content) / 4.0::DOUBLE) END)
  OVER (PARTITION BY lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) ORDER BY chunk_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) AS factor FROM chunk WHERE content IS NOT NULL""",
    }.items()
}


# --- fields and paragraphs of program texts


def pth03_field_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that every moved field reaches within its program text in at most ten moves, with the least number of moves."""
    moves = durable(view(spark, sf_dir, "move"))
    keyed = moves.select(F.struct("doc_id", F.col("src").alias("field")).alias("key"), "src").distinct()
    # the traversal's key is (text, field); edges are scoped to the text by prefixing fields with it
    scoped = moves.select(F.concat_ws("|", "doc_id", "src").alias("src"), F.concat_ws("|", "doc_id", "dst").alias("dst"))
    seeds = keyed.select(F.concat_ws("|", "key.doc_id", "src").alias("key"), F.concat_ws("|", "key.doc_id", "src").alias("node"))
    met = traverse.reach(scoped, seeds, 10, restart=True)
    part = lambda c, n: F.split(F.col(c), "[|]", 2)[n]
    return met.select(part("key", 0).cast("long").alias("doc_id"), part("key", 1).alias("field"), part("node", 1).alias("reached"), "depth")


QUERIES |= {"pth03_field_impact": pth03_field_impact}
ORACLE |= {
    "pth03_field_impact": duck("""WITH RECURSIVE walk(doc_id, field, reached, depth) AS (SELECT doc_id, src, dst, 1 FROM move
  UNION SELECT w.doc_id, w.field, m.dst, w.depth + 1 FROM walk w JOIN move m ON m.doc_id = w.doc_id AND m.src = w.reached WHERE w.depth < 10)
  SELECT doc_id, field, reached, min(depth)::INT AS depth FROM walk GROUP BY 1, 2, 3""")
}

_COUNT = "coalesce(list_sum(list_transform(regexp_extract_all({part}, '{symbol}(?:\\((\\d+)\\))?', 1), lambda x: CASE WHEN coalesce(x, '') = '' THEN 1 ELSE x::INT END)), 0)"
ORACLE["txt32_pic_types"] = duck(
    """WITH c AS (SELECT item_id, regexp_replace(upper(trim(picture)), '^PIC\\s*', '') AS p, coalesce(usage, '') AS u FROM item WHERE coalesce(picture, '') <> ''),
  b AS (SELECT item_id, u, starts_with(p, 'S')::INT AS signed, regexp_replace(p, '^S', '') AS b FROM c),
  n AS (SELECT *, WHOLE + FRACTION AS digits, FRACTION AS fraction, CHARS AS chars, LETTERS AS letters, contains(b, 'X') AS x, contains(b, 'A') AND NOT contains(regexp_replace(b, '\\(\\d+\\)', '', 'g'), '9') AS a FROM b),
  k AS (SELECT *, CASE WHEN x OR a THEN 'S' WHEN u IN ('COMP-3', 'PACKED-DECIMAL') THEN 'P' WHEN u IN ('COMP', 'BINARY', 'COMP-4') THEN 'B' WHEN fraction > 0 THEN 'D' ELSE 'I' END AS kind FROM n)
  SELECT item_id, CASE kind WHEN 'S' THEN 'String' WHEN 'P' THEN 'BigDecimal' WHEN 'D' THEN 'BigDecimal' WHEN 'B' THEN CASE WHEN digits <= 4 THEN 'short' WHEN digits <= 9 THEN 'int' ELSE 'long' END ELSE CASE WHEN digits <= 9 THEN 'int' ELSE 'long' END END AS java,
    CASE kind WHEN 'S' THEN 'VARCHAR(' || CASE WHEN x THEN chars ELSE letters END || ')' WHEN 'B' THEN CASE WHEN digits <= 4 THEN 'SMALLINT' WHEN digits <= 9 THEN 'INTEGER' ELSE 'BIGINT' END WHEN 'I' THEN CASE WHEN digits <= 9 THEN 'INTEGER' ELSE 'BIGINT' END
      ELSE 'DECIMAL(' || digits || ',' || fraction || ')' END AS sql, CASE kind WHEN 'P' THEN 'PACKED_DECIMAL' WHEN 'B' THEN 'BINARY' ELSE 'DISPLAY' END AS storage,
    (CASE kind WHEN 'S' THEN CASE WHEN x THEN chars ELSE letters END WHEN 'P' THEN (digits + signed + 1) // 2 WHEN 'B' THEN CASE WHEN digits <= 4 THEN 2 WHEN digits <= 9 THEN 4 ELSE 8 END ELSE digits + signed END)::INT AS bytes FROM k"""
    .replace("WHOLE", _COUNT.format(part="split_part(b, 'V', 1)", symbol="9"))
    .replace("FRACTION", _COUNT.format(part="split_part(b, 'V', 2)", symbol="9"))
    .replace("CHARS", _COUNT.format(part="b", symbol="X"))
    .replace("LETTERS", _COUNT.format(part="b", symbol="A"))
)
