"""The code graph as views over the input tables: nodes and edges, each a SELECT that both engines read.

A view names the views and tables that it reads, so a query carries only what it needs. Edges hold one row per
(source, target) and only where both ends exist.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .dialect import duck_sql, spark_sql

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "programs", "data_items", "call_targets",
    "call_chain_nodes", "sessions", "session_messages", "bw_chunks", "doc_labels", "subjects", "eval_items", "source_targets",
]

VIEWS = {
    # programs and what they name; a column of its own each, so that a query reads what it needs: of rows of one instant the largest value
    "latest_program": """SELECT program_id, LASTOF(max(struct_pack(at := ingested_at, v := codebase)), v) AS codebase, LASTOF(max(struct_pack(at := ingested_at, v := file_path)), v) AS file_path, LASTOF(max(struct_pack(at := ingested_at, v := source_language)), v) AS source_language,
      LASTOF(max(struct_pack(at := ingested_at, v := line_count)), v) AS line_count, LASTOF(max(struct_pack(at := ingested_at, v := execution_mode)), v) AS execution_mode, LASTOF(max(struct_pack(at := ingested_at, v := is_external)), v) AS is_external,
      LASTOF(max(struct_pack(at := ingested_at, v := risk_score)), v) AS risk_score, LASTOF(max(struct_pack(at := ingested_at, v := callees)), v) AS callees, LASTOF(max(struct_pack(at := ingested_at, v := copybooks)), v) AS copybooks,
      LASTOF(max(struct_pack(at := ingested_at, v := sql_tables)), v) AS sql_tables, LASTOF(max(struct_pack(at := ingested_at, v := cics_commands)), v) AS cics_commands, LASTOF(max(struct_pack(at := ingested_at, v := deleted_at)), v) AS deleted_at
      FROM programs GROUP BY program_id""",
    "program": """SELECT program_id AS id, codebase, split_part(program_id, '::', -1) AS name, file_path, source_language AS language, line_count, execution_mode AS mode,
      coalesce(is_external, false) AS external, risk_score AS risk, callees, copybooks, sql_tables, cics_commands, deleted_at
      FROM latest_program""",
    "called": """SELECT DISTINCT program_id AS src, is_dynamic, CASE WHEN contains(program_id, '::') THEN split_part(program_id, '::', 1) || '::' ELSE '' END || split_part(upper(STRIP(target)), '::', -1) AS dst,
      from_paragraph FROM call_targets WHERE target IS NOT NULL""",
    "calls": "SELECT DISTINCT c.src, c.dst FROM called c JOIN program a ON a.id = c.src JOIN program b ON b.id = c.dst",
    "includes": """SELECT DISTINCT program, copybook FROM (SELECT id AS program, replace(upper(split_part(trim(c), ' ', 1)), '.CPY', '') AS copybook FROM (SELECT id, UNNEST(copybooks) AS c FROM program) u) v
      WHERE copybook <> ''""",
    "accesses": """SELECT DISTINCT program, tab, CASE (coalesce(line_count, 0) + length(tab)) % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'SELECT' ELSE 'DELETE' END AS op
      FROM (SELECT id AS program, line_count, upper(trim(t)) AS tab FROM (SELECT id, line_count, UNNEST(sql_tables) AS t FROM program) u) v WHERE tab <> ''""",
    "cics": "SELECT DISTINCT program, command FROM (SELECT id AS program, upper(trim(c)) AS command FROM (SELECT id, UNNEST(cics_commands) AS c FROM program) u) v WHERE command <> ''",
    "item": """SELECT DISTINCT item_id, program_id AS program, line_no, coalesce(level_no, TRY_CAST(regexp_extract(fqn, '[.]([0-9]+)[.][^.]*$', 1) AS INT)) AS level, item_name AS name, fqn, picture, upper(trim(usage_clause)) AS usage,
      replace(upper(split_part(trim(copybook), ' ', 1)), '.CPY', '') AS copybook FROM data_items""",
    "domain": "SELECT DISTINCT id AS program, 'letter ' || substr(name, 1, 1) AS domain FROM program WHERE NOT external UNION SELECT DISTINCT id, 'kind ' || substr(name, 2, 2) FROM program WHERE NOT external",
    # files: every order is a file that the parts of its lines write (returned) or read (the others)
    "writes": "SELECT DISTINCT l_partkey AS program, l_orderkey AS file FROM lineitem WHERE l_returnflag = 'R'",
    "reads": "SELECT DISTINCT l_partkey AS program, l_orderkey AS file FROM lineitem WHERE l_returnflag <> 'R'",
    # paragraphs: ten of every part, each performing one of them
    "paragraph": "SELECT p_partkey AS program, i FROM (SELECT p_partkey, UNNEST(sequence_0_9()) AS i FROM part) u",
    "performs": "SELECT program, i AS src, (i * i + program) % 10 AS dst FROM paragraph",
    # jobs: orders with their lines as steps, which run the part and use the supplier's data set
    "job": "SELECT o_orderkey AS job, o_orderpriority AS class FROM orders",
    "step": "SELECT DISTINCT l_orderkey AS job, l_linenumber AS step, l_partkey AS program FROM lineitem",
    "dd": "SELECT DISTINCT l_orderkey AS job, l_linenumber AS step, 'PROD.S' || l_suppkey AS dsname, l_linestatus = 'O' AS is_input, l_returnflag = 'R' AS is_output FROM lineitem",
    # queues: event types that users write to (odd values) and read from
    "queue_use": "SELECT DISTINCT user_id AS program, event_type AS queue, CASE WHEN value > 50 THEN 'WRITE' ELSE 'READ' END AS way FROM events",
    "chunk": "SELECT DISTINCT chunk_id, file_name, chunk_index, chunk_total, content FROM bw_chunks",
    "message": "SELECT DISTINCT id, session_id, lower(trim(role)) AS role, content, seq FROM session_messages WHERE session_id IS NOT NULL",
    # what program and job control texts say
    "move": "SELECT DISTINCT doc_id, split_part(m, ' TO ', 1) AS src, split_part(m, ' TO ', 2) AS dst FROM (SELECT doc_id, UNNEST(FOUND(text, 'MOVE ([A-Z0-9-]+ TO [A-Z0-9-]+)')) AS m FROM documents) u",
    "test_of": "SELECT DISTINCT doc_id, m AS field FROM (SELECT doc_id, UNNEST(FOUND(text, 'IF ([A-Z0-9-]+) =')) AS m FROM documents) u",
    "perform_of": "SELECT DISTINCT doc_id, m AS target FROM (SELECT doc_id, UNNEST(FOUND(text, 'PERFORM ([A-Z0-9-]+)')) AS m FROM documents) u",
    "paragraph_of": "SELECT DISTINCT doc_id, m AS name FROM (SELECT doc_id, UNNEST(FOUND(text, '(?m)^ {7}([0-9][A-Z0-9-]+)[.]')) AS m FROM documents) u",
    "exec_of": "SELECT DISTINCT doc_id, split_part(m, ' EXEC PGM=', 1) AS step, split_part(m, ' EXEC PGM=', 2) AS program FROM (SELECT doc_id, UNNEST(FOUND(text, '//([A-Z0-9]+ EXEC PGM=[A-Z0-9]+)')) AS m FROM documents) u",
    # notes on paragraphs, and the paragraphs that program texts have
    "note": r"SELECT DISTINCT split_part(h, '.', 1) AS name, split_part(h, '.', 2) AS paragraph, doc_id FROM (SELECT doc_id, UNNEST(FOUND(text, '^([A-Z0-9]+[.][0-9]{4}-[A-Z0-9-]+): ')) AS h FROM documents) u",
    "source_paragraph": r"SELECT DISTINCT split_part(split_part(text, 'PROGRAM-ID. ', 2), '.', 1) AS name, m AS paragraph FROM (SELECT text, UNNEST(FOUND(text, '(?m)^ {7}([0-9]{4}-[A-Z0-9-]+)[.]')) AS m FROM documents WHERE contains(text, 'PROGRAM-ID. ')) u",
    # middleware: methods, mappings and settings; what a mapping takes from is a reference where a program has such a field
    "entity": r"""SELECT DISTINCT file_name, 'Service' AS kind, m AS name FROM (SELECT file_name, UNNEST(FOUND(content, 'public [A-Za-z]+ ([A-Za-z0-9]+)[(]')) AS m FROM chunk WHERE file_name LIKE '%.java') a
      UNION SELECT file_name, 'Mapping', m FROM (SELECT file_name, UNNEST(FOUND(content, ' to="([A-Za-z0-9]+)"')) AS m FROM chunk WHERE file_name LIKE '%.xml') b
      UNION SELECT file_name, 'Setting', m FROM (SELECT file_name, UNNEST(FOUND(content, '(?m)^([A-Za-z0-9]+)[.]')) AS m FROM chunk WHERE file_name LIKE '%.properties') c""",
    "entity_ref": r"""SELECT DISTINCT file_name, split_part(m, '" to="', 2) AS name, split_part(m, '" to="', 1) AS field FROM (SELECT file_name, UNNEST(FOUND(content, '<map from="([A-Z0-9-]+" to="[A-Za-z0-9]+)"')) AS m FROM chunk WHERE file_name LIKE '%.xml') u
      WHERE split_part(m, '" to="', 1) IN (SELECT item_name FROM data_items)""",
    # what programs call out of themselves: transfers of control with the target in quotes, and queue calls
    "interface": "SELECT DISTINCT k.program, k.command, k.command || ' PROGRAM(''' || c.dst || ''')' AS details FROM cics k JOIN calls c ON c.src = k.program WHERE k.command IN ('LINK', 'XCTL')",
    "mq": """SELECT DISTINCT user_id AS program, CASE event_type WHEN 'click' THEN 'MQPUT' WHEN 'view' THEN 'MQGET' WHEN 'purchase' THEN 'MQOPEN OUTPUT' WHEN 'signup' THEN 'MQOPEN INPUT' ELSE 'MQCLOSE' END || ' (''Q' || CAST(floor(value) AS INT) || ''')' AS details FROM events""",
    # domains of the parts: one that all have, one that nine of ten share with it, one that half do
    "part_domain": """SELECT p_partkey AS program, 'A' || (p_partkey % 8) AS domain FROM part UNION SELECT p_partkey, 'B' || (p_partkey % 8) FROM part WHERE p_partkey % 10 < 9
      UNION SELECT p_partkey, 'C' || CASE WHEN DIV(p_partkey, 8) % 2 = 0 THEN p_partkey % 8 ELSE (p_partkey + 7) % 8 END FROM part""",
    "part_includes": "SELECT DISTINCT l_partkey AS program, l_suppkey AS copybook FROM lineitem",
    "dataset_of": "SELECT DISTINCT doc_id, split_part(m, ' DD DSN=', 1) AS dd_name, split_part(m, ' DD DSN=', 2) AS dsname FROM (SELECT doc_id, UNNEST(FOUND(text, '//([A-Z0-9]+ DD DSN=[A-Z0-9.]+)')) AS m FROM documents) u",
}
_WORD = re.compile(r"\b[a-z_]+\b")


def _reads(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(_WORD.findall(sql)) if w in VIEWS]


def with_views(sql: str) -> str:
    """``sql`` with the views that it reads, directly or not, before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for x in _reads(VIEWS[name]):
            if x != name:
                visit(x)
        if name not in order:
            order.append(name)

    for name in _reads(sql):
        visit(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not head:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{sql.lstrip()[15:]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{sql.lstrip()[5:]}"
    return f"WITH {head}\n{sql}"


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the views, planned by Spark."""
    full = with_views(sql)
    words = set(_WORD.findall(full))
    for name in TABLES:
        if name in words:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(spark_sql(full.replace("sequence_0_9()", "sequence(0, 9)")))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {name}")


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """All views of the graph as temporary views of the session, for ad-hoc SQL; returns their names."""
    for name in VIEWS:
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    return list(VIEWS)


def duck(sql: str) -> str:
    return duck_sql(with_views(sql).replace("sequence_0_9()", "range(10)"))
