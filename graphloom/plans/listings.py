"""Listings, point answers, joins, aggregations and named queries over the code graph, as SQL that both engines read."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .views import duck, run

SQL = {
    # --- listings
    "lst03_data_items": "SELECT program, level, name, picture, usage, copybook, item_id FROM item",
    "lst05_copybook_usage": "SELECT copybook, TEXTS(program) AS programs FROM includes GROUP BY copybook",
    "lst07_conditions": "SELECT program, name, line_no, item_id FROM item WHERE level = 88",
    "lst08_parameters": "SELECT program, name, level, item_id FROM item WHERE name LIKE 'LK-%'",
    "lst13_cics_commands": "SELECT program, command FROM cics",
    "lst14_paragraph_flow": "SELECT program, src, dst, 'PERFORMS' AS kind FROM performs UNION SELECT DISTINCT program_id_no, i, (i + 1) % 10, 'PERFORMS_THRU' FROM (SELECT program AS program_id_no, i FROM paragraph) q WHERE i < 3",
    "lst18_copybook_risks": "SELECT copybook, n, CASE WHEN n >= 100 THEN 'CRITICAL' WHEN n >= 30 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT copybook, BIG(count(*)) AS n FROM includes GROUP BY copybook) x",
    "lst20_risk_programs": "SELECT id, risk FROM program WHERE risk >= 0.5 AND file_path IS NOT NULL",
    "lst22_business_domains": "SELECT domain, BIG(count(*)) AS programs FROM domain GROUP BY domain",
    "lst23_business_domain": "SELECT domain, TEXTS(program) AS programs FROM domain GROUP BY domain",
    "lst24_jcl_jobs": "SELECT j.job, j.class, BIG(count(s.step)) AS steps FROM job j LEFT JOIN step s ON s.job = j.job GROUP BY j.job, j.class",
    "lst25_jcl_job_detail": "SELECT s.job, s.step, s.program, TEXTS(d.dsname) AS datasets FROM step s LEFT JOIN dd d ON d.job = s.job AND d.step = s.step GROUP BY s.job, s.step, s.program",
    "lst26_program_jcl": "SELECT program, TEXTS(job) AS jobs, LISTED(step) AS steps FROM step GROUP BY program",
    "lst27_dataset_usage": "SELECT dsname, is_input, is_output, BIG(count(DISTINCT job)) AS jobs, BIG(count(*)) AS steps FROM dd GROUP BY dsname, is_input, is_output",
    "lst29_table_usage": "SELECT tab, program, TEXTS(op) AS ops FROM accesses GROUP BY tab, program",
    "lst30_program_tables": "SELECT program, TEXTS(tab) AS tables, TEXTS(op) AS ops FROM accesses GROUP BY program",
    "lst35_codebases": "SELECT DISTINCT codebase FROM program WHERE codebase IS NOT NULL",
    "lst48_program_ids": "SELECT id FROM program",
    "lst49_domain_names": "SELECT DISTINCT domain FROM domain",
    "lst50_program_paths": "SELECT id, file_path FROM program WHERE file_path IS NOT NULL",
    "lst52_sessions": """SELECT s.id, max(s.title) AS title, max(s.updated_at) AS updated_at, BIG(count(DISTINCT m.id)) AS messages FROM (SELECT DISTINCT * FROM sessions) s LEFT JOIN message m ON m.session_id = s.id
      WHERE s.id IS NOT NULL GROUP BY s.id""",
    "lst53_session_prune": "SELECT id FROM (SELECT id, max(updated_at) AS updated_at FROM sessions GROUP BY id) x ORDER BY updated_at DESC NULLS LAST, id LIMIT 50",
    "lst09_conditional_logic": "SELECT doc_id, field FROM test_of",
    "lst12_sql_statements": "SELECT program, op, tab FROM accesses",
    "lst15_data_flow": "SELECT doc_id, src, dst FROM move",
    "lst21_volume_estimates": "SELECT id, CASE WHEN line_count >= 1500 THEN 'HIGH' WHEN line_count >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS volume FROM program WHERE line_count IS NOT NULL",
    "lst27_datasets_of_texts": "SELECT dsname, BIG(count(DISTINCT doc_id)) AS jobs, BIG(count(*)) AS cards FROM dataset_of GROUP BY dsname",
    # --- joins
    "joi13_missing_moves": "SELECT d.doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE text LIKE '%PROGRAM-ID.%') d WHERE NOT EXISTS (SELECT 1 FROM move m WHERE m.doc_id = d.doc_id)",
    "nq10_programs_without_job": "SELECT id FROM program p WHERE NOT external AND NOT EXISTS (SELECT 1 FROM exec_of e WHERE e.program = p.name)",
    "nq17_programs_by_risk": "SELECT id, risk FROM program WHERE risk > 0 ORDER BY risk DESC, id LIMIT 100",
    "joi01_shared_files": "SELECT w.program AS src, r.program AS dst, BIG(count(*)) AS files FROM writes w JOIN reads r ON r.file = w.file AND r.program <> w.program GROUP BY w.program, r.program",
    # a flow runs from every writer of a table to every reader: one row per end instead of one per pair
    "joi02_db2_flows": """SELECT DISTINCT a.tab, a.program, CASE WHEN a.op = 'SELECT' THEN 'reader' ELSE 'writer' END AS side, n.writers, n.readers FROM accesses a
      JOIN (SELECT tab, BIG(count(DISTINCT CASE WHEN op IN ('INSERT', 'UPDATE') THEN program END)) AS writers, BIG(count(DISTINCT CASE WHEN op = 'SELECT' THEN program END)) AS readers FROM accesses GROUP BY tab) n ON n.tab = a.tab
      WHERE a.op <> 'DELETE' AND n.writers > 0 AND n.readers > 0""",
    "joi03_dd_to_files": "SELECT DISTINCT d.dsname, s.s_suppkey AS file FROM dd d JOIN supplier s ON d.dsname = 'PROD.S' || s.s_suppkey",
    # one row per end, as in joi02; an end counts only where another program stands on the other side
    "joi05_queue_flows": """SELECT u.queue, u.program, CASE WHEN u.way = 'WRITE' THEN 'writer' ELSE 'reader' END AS side, n.writers, n.readers FROM queue_use u
      JOIN (SELECT queue, BIG(count(DISTINCT CASE WHEN way = 'WRITE' THEN program END)) AS writers, BIG(count(DISTINCT CASE WHEN way = 'READ' THEN program END)) AS readers FROM queue_use GROUP BY queue) n ON n.queue = u.queue
      LEFT JOIN (SELECT queue, program FROM queue_use GROUP BY queue, program HAVING count(DISTINCT way) = 2) b ON b.queue = u.queue AND b.program = u.program
      WHERE u.program IS NOT NULL AND CASE WHEN u.way = 'WRITE' THEN n.readers ELSE n.writers END > CASE WHEN b.program IS NULL THEN 0 ELSE 1 END""",
    "joi07_jcl_sequence": """SELECT DISTINCT a.job, a.step AS before_step, b.step AS after_step, a.dsname FROM dd a JOIN dd b ON b.job = a.job AND b.dsname = a.dsname AND a.step < b.step WHERE a.is_output AND b.is_input""",
    "joi09_call_pairs": """SELECT c.src, c.dst, coalesce(i.n, 0) AS caller_items, p.n AS callee_parameters FROM calls c JOIN (SELECT program, BIG(count(*)) AS n FROM item WHERE name LIKE 'LK-%' GROUP BY program) p ON p.program = c.dst
      LEFT JOIN (SELECT program, BIG(count(*)) AS n FROM item WHERE level IN (1, 77) GROUP BY program) i ON i.program = c.src""",
    "joi11_program_children": """SELECT p.id, coalesce(a.n, 0) AS items, coalesce(b.n, 0) AS copybooks, coalesce(c.n, 0) AS tables, coalesce(d.n, 0) AS commands FROM program p
      LEFT JOIN (SELECT program, BIG(count(*)) AS n FROM item GROUP BY program) a ON a.program = p.id LEFT JOIN (SELECT program, BIG(count(*)) AS n FROM includes GROUP BY program) b ON b.program = p.id
      LEFT JOIN (SELECT program, BIG(count(DISTINCT tab)) AS n FROM accesses GROUP BY program) c ON c.program = p.id LEFT JOIN (SELECT program, BIG(count(*)) AS n FROM cics GROUP BY program) d ON d.program = p.id""",
    "joi14_missing_calls": "SELECT id FROM program p WHERE EXISTS (SELECT 1 FROM called c WHERE c.src = p.id) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.src = p.id)",
    "joi15_orphan_programs": "SELECT id FROM program p WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = p.id)",
    "joi19_io_candidates": "SELECT DISTINCT program FROM cics UNION SELECT DISTINCT program FROM accesses",
    "joi20_cross_codebase_calls": """SELECT DISTINCT a.codebase AS src_codebase, b.codebase AS dst_codebase, a.id AS src, b.id AS dst FROM program a JOIN called c ON c.src = a.id JOIN program b ON b.name = split_part(c.dst, '::', -1)
      WHERE a.codebase <> b.codebase AND b.external AND NOT EXISTS (SELECT 1 FROM program q WHERE q.id = c.dst AND NOT q.external)""",
    "joi21_remaining_programs": "SELECT id FROM program p WHERE NOT EXISTS (SELECT 1 FROM cics c WHERE c.program = p.id) AND NOT EXISTS (SELECT 1 FROM accesses a WHERE a.program = p.id)",
    "joi22_field_mapping": """SELECT c.src, c.dst, a.name, BIG(count(*)) AS pairs FROM calls c JOIN (SELECT DISTINCT program, name FROM item) a ON a.program = c.src JOIN (SELECT DISTINCT program, name FROM item WHERE name LIKE 'LK-%') b ON b.program = c.dst AND b.name = a.name
      GROUP BY c.src, c.dst, a.name""",
    "joi23_neighbours": "SELECT DISTINCT src AS node, dst AS neighbour, 'CALLS' AS kind FROM calls UNION SELECT DISTINCT dst, src, 'CALLED BY' FROM calls UNION SELECT DISTINCT program, copybook, 'INCLUDES' FROM includes",
    "joi24_call_graph": "SELECT p.id, c.dst FROM program p LEFT JOIN calls c ON c.src = p.id",
    "joi25_full_graph": "SELECT 'program' AS label, id AS node FROM program UNION SELECT 'copybook', copybook FROM includes UNION SELECT 'table', tab FROM accesses UNION SELECT 'domain', domain FROM domain",
    # --- aggregations
    "agg02_hubs": "SELECT c.dst AS program, BIG(count(DISTINCT c.src)) AS callers FROM calls c GROUP BY c.dst HAVING count(DISTINCT c.src) >= 5",
    "agg03_copybook_clusters": "SELECT copybook, TEXTS(program) AS programs, BIG(count(*)) AS n FROM includes GROUP BY copybook HAVING count(*) > 1",
    "agg06_shared_channels": """SELECT w.file, BIG(count(DISTINCT w.program)) AS writers, BIG(count(DISTINCT r.program)) AS readers FROM writes w JOIN reads r ON r.file = w.file AND r.program <> w.program GROUP BY w.file""",
    "agg07_cross_program_flow": """SELECT program, way, BIG(count(*)) AS n FROM (SELECT DISTINCT w.program, r.program AS other, 'outbound' AS way FROM writes w JOIN reads r ON r.file = w.file AND r.program <> w.program
      UNION ALL SELECT DISTINCT r.program, w.program, 'inbound' FROM writes w JOIN reads r ON r.file = w.file AND r.program <> w.program) x GROUP BY program, way""",
    "agg08_file_accessors": """SELECT file, program, CASE WHEN max(w) = 1 AND max(r) = 1 THEN 'READS_WRITES' WHEN max(w) = 1 THEN 'WRITES' ELSE 'READS' END AS access
      FROM (SELECT file, program, 1 AS w, 0 AS r FROM writes UNION ALL SELECT file, program, 0, 1 FROM reads) x GROUP BY file, program""",
    "agg14_program_context": """SELECT p.id, BIG(count(DISTINCT i.item_id)) AS items, max(b.books) AS copybooks FROM program p LEFT JOIN item i ON i.program = p.id
      LEFT JOIN (SELECT program, TEXTS(copybook) AS books FROM includes GROUP BY program) b ON b.program = p.id GROUP BY p.id""",
    "agg15_program_slice": """SELECT p.id, p.mode, p.external, coalesce(b.x, '') AS copybooks, coalesce(t.x, '') AS tables, coalesce(c.x, '') AS callees, coalesce(k.x, '') AS commands FROM program p
      LEFT JOIN (SELECT program, TEXTS(copybook) AS x FROM includes GROUP BY program) b ON b.program = p.id LEFT JOIN (SELECT program, TEXTS(tab) AS x FROM accesses GROUP BY program) t ON t.program = p.id
      LEFT JOIN (SELECT src, TEXTS(dst) AS x FROM calls GROUP BY src) c ON c.src = p.id LEFT JOIN (SELECT program, TEXTS(command) AS x FROM cics GROUP BY program) k ON k.program = p.id""",
    "agg19_token_sums": "SELECT lower(split_part(file_name, '.', -1)) AS kind, BIG(count(*)) AS chunks, BIG(sum(DIV(BYTES(content) * 10, 32))) AS tokens FROM chunk WHERE content IS NOT NULL GROUP BY lower(split_part(file_name, '.', -1))",
    # --- named queries
    "nq01_top_by_risk": "SELECT p.id, p.risk, BIG(count(i.copybook)) AS copybooks FROM program p LEFT JOIN includes i ON i.program = p.id GROUP BY p.id, p.risk ORDER BY risk DESC NULLS FIRST, id LIMIT 100",
    "nq02_most_copybooks": "SELECT program, BIG(count(DISTINCT copybook)) AS n FROM includes GROUP BY program ORDER BY n DESC, program LIMIT 100",
    "nq03_copybooks_by_fields": "SELECT copybook, BIG(count(*)) AS fields FROM item WHERE copybook <> '' GROUP BY copybook ORDER BY fields DESC, copybook LIMIT 100",
    "nq04_paragraphs_by_fanin": "SELECT program, dst AS paragraph, BIG(count(DISTINCT src)) AS callers FROM performs GROUP BY program, dst ORDER BY callers DESC, program, paragraph LIMIT 100",
    "nq05_cross_domain_calls": "SELECT a.domain AS src_domain, b.domain AS dst_domain, BIG(count(*)) AS calls FROM calls c JOIN domain a ON a.program = c.src JOIN domain b ON b.program = c.dst WHERE a.domain <> b.domain GROUP BY a.domain, b.domain",
    "nq12_linkage_coverage": """SELECT i.program, i.name, BIG(count(a.src)) AS callers FROM (SELECT DISTINCT program, name FROM item WHERE level = 1) i
      LEFT JOIN (SELECT DISTINCT c.src, c.dst, x.name FROM calls c JOIN item x ON x.program = c.src) a ON a.dst = i.program AND a.name = i.name GROUP BY i.program, i.name""",
    "nq15_all_calls": "SELECT src, dst FROM calls ORDER BY src, dst LIMIT 100",
    "nq18_copybook_usage": "SELECT copybook, BIG(count(*)) AS programs FROM includes GROUP BY copybook ORDER BY programs DESC, copybook LIMIT 100",
    # --- text and source, as expressions
    "txt01_token_estimate": "SELECT doc_id, DIV(BYTES(text) * 10, 32) AS tokens FROM documents WHERE text IS NOT NULL",
    "txt17_collapse_blank_lines": r"SELECT chunk_id, RX(content, '\n{3,}', '\n\n') AS text FROM chunk".replace(r"'\n\n'", "chr(10) || chr(10)"),
    "txt21_strip_xml_comments": "SELECT chunk_id, RX(content, '(?s)<!--.*?-->', '') AS text FROM chunk WHERE file_name LIKE '%.xml'",
    "src02_extension": """SELECT id, CASE lower(split_part(file_path, '.', -1)) WHEN 'cbl' THEN 'COBOL' WHEN 'cob' THEN 'COBOL' WHEN 'cpy' THEN 'COPYBOOK' WHEN 'cpb' THEN 'COPYBOOK' WHEN 'jcl' THEN 'JCL' WHEN 'asm' THEN 'ASM' WHEN 'bms' THEN 'BMS'
      WHEN 'pli' THEN 'PLI' ELSE 'UNKNOWN' END AS kind FROM program WHERE file_path IS NOT NULL""",
    "src05_hash_and_lines": "SELECT doc_id, sha256_hex(text) AS sha256, BIG(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END) AS line_count FROM documents WHERE text IS NOT NULL",
    # a tag that isn't closed goes on to the end, a '>' outside of tags goes too; then white space off both ends
    "src25_strip_tags": r"SELECT chunk_id, RX(RX(content, '<[^>]*>?|>', ''), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z', '') AS text FROM chunk WHERE content IS NOT NULL",
    "txt39_context": "SELECT p.id, concat_ws('; ', 'program ' || p.id, 'mode ' || p.mode, 'uses ' || b.x) AS preamble FROM program p LEFT JOIN (SELECT program, TEXTS(copybook) AS x FROM includes GROUP BY program) b ON b.program = p.id",
    "oth13_edge_groups": "SELECT kind, BIG(count(*)) AS n FROM (SELECT 'CALLS' AS kind, src, dst FROM calls UNION ALL SELECT 'INCLUDES', program, copybook FROM includes UNION ALL SELECT 'ACCESSES', program, tab FROM accesses) e GROUP BY kind",
    "oth41_first_row_wins": "SELECT call_id, program_id, target FROM (SELECT call_id, program_id, target, row_number() OVER (PARTITION BY program_id, upper(STRIP(target)) ORDER BY call_id, from_paragraph) AS rn FROM call_targets) x WHERE rn = 1",
}


def _query(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, sql.replace("sha256_hex(text)", "sha2(text, 256)"))


#: The same in DuckDB where it is said another way.
OTHER = {
    "joi05_queue_flows": """SELECT DISTINCT a.queue, a.program, CASE a.way WHEN 'WRITE' THEN 'writer' ELSE 'reader' END AS side, (SELECT count(*) FROM queue_use w WHERE w.queue = a.queue AND way = 'WRITE') AS writers,
      (SELECT count(*) FROM queue_use r WHERE r.queue = a.queue AND way = 'READ') AS readers FROM queue_use a WHERE EXISTS (SELECT 1 FROM queue_use b WHERE b.queue = a.queue AND b.way <> a.way AND b.program <> a.program)""",
    "src25_strip_tags": r"SELECT chunk_id, regexp_replace(regexp_replace(content, '<[^>]*>?|>', '', 'g'), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z', '', 'g') AS text FROM chunk WHERE content IS NOT NULL",
}
QUERIES = {name: partial(_query, sql) for name, sql in SQL.items()}
ORACLE = {name: duck(OTHER.get(name, sql).replace("sha256_hex(text)", "sha256(text)")) for name, sql in SQL.items()}
