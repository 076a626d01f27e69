"""Flows, gaps, coverage, details and listings as DataFrame plans over the graph's views, each beside DuckDB SQL of its own.

Arguments of the tools are parameters of the query functions; what is registered runs with the defaults, over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repair, search
from ..operators.fuzzy import containing_pairs
from ..operators.incremental import first_wins
from ..session import durable, table
from ..sources import extraction
from .views import duck, view

def _n(name: str) -> Column:
    return F.count(F.lit(1)).cast("long").alias(name)


def _texts(c: str | Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string") if isinstance(c, str) else c)), ",")


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(_n(name))


# --- flows


def joi04_cics_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of control: the target in quotes is a program, another than the caller."""
    called = view(spark, sf_dir, "interface").select(F.col("program").alias("src"), F.regexp_extract("details", "'([^']*)'", 1).alias("dst"))
    return called.join(view(spark, sf_dir, "program").select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst", F.lit("CICS_COMMAREA").alias("channel")).distinct()


def queue_ends(calls: DataFrame) -> DataFrame:
    """(queue, program, side, writers, readers): both ends of every queue whose other end is another program.

    ``calls``: program, details. PUT and OPEN ... OUTPUT write, GET and OPEN ... INPUT read, in this order. A flow runs
    from every writer to every reader; one row per end says so without a row per pair.
    """
    verb = F.col("details")
    way = F.when(verb.contains("MQPUT") | (verb.contains("MQOPEN") & verb.contains("OUTPUT")), "writer").when(verb.contains("MQGET") | (verb.contains("MQOPEN") & verb.contains("INPUT")), "reader")
    ends = calls.where("program is not null").select(F.regexp_extract("details", "'([^']*)'", 1).alias("queue"), "program", way.alias("side")).where("side is not null and queue <> ''").distinct()
    n = lambda s: F.count(F.when(F.col("side") == s, 1)).cast("long")
    per = ends.groupBy("queue").agg(n("writer").alias("writers"), n("reader").alias("readers"))
    both = ends.groupBy("queue", "program").agg(_n("sides"))
    other = F.when(F.col("side") == "writer", F.col("readers")).otherwise(F.col("writers"))
    return ends.join(per, "queue").join(both, ["queue", "program"]).where(other > F.when(F.col("sides") == 2, 1).otherwise(0)).select("queue", "program", "side", "writers", "readers")


def joi06_mq_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_ends(view(spark, sf_dir, "mq"))


def joi08_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers and readers of a file that include the same copybook."""
    includes = view(spark, sf_dir, "part_includes")
    pairs = view(spark, sf_dir, "writes").withColumnRenamed("program", "writer").join(view(spark, sf_dir, "reads").withColumnRenamed("program", "reader"), "file").where("writer <> reader")
    mine = pairs.join(includes.withColumnRenamed("program", "writer"), "writer")
    return mine.join(includes.withColumnRenamed("program", "reader"), ["reader", "copybook"], "left_semi").select("writer", "reader", "file", "copybook").distinct()


def joi10_cics_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of control, to itself too, with the top-level items of both ends."""
    tops = _count(view(spark, sf_dir, "item").where("level in (1, 77)"), "program", "n")
    called = view(spark, sf_dir, "interface").select(F.col("program").alias("src"), F.regexp_extract("details", "'([^']*)'", 1).alias("dst")).distinct()
    known = called.join(view(spark, sf_dir, "program").select(F.col("id").alias("dst")), "dst", "left_semi")
    mine = known.join(tops.select(F.col("program").alias("src"), F.col("n").alias("caller_items")), "src", "left").join(tops.select(F.col("program").alias("dst"), F.col("n").alias("callee_items")), "dst", "left")
    return mine.select("src", "dst", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("caller_items", "callee_items")])


# --- what is missing


def joi12_missing_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with what they take from a copybook, where counted items come from it and none is a child of another of them."""
    from .problems import data_links

    items = view(spark, sf_dir, "item").where("copybook <> ''").select(F.col("item_id").alias("key"), "program", "copybook")
    links = data_links(spark, sf_dir).join(items, "key")
    inner = links.where("parent is not null").join(items.select(F.col("key").alias("parent"), F.col("copybook").alias("above")), "parent").where("above = copybook").select("program", "copybook")
    return links.select("program", "copybook").distinct().join(inner, ["program", "copybook"], "left_anti")


#: Kinds of entity that should refer to something (fixed values of this project's view).
LINKABLE = ["Service", "Mapping"]


def joi16_unlinked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linkable = view(spark, sf_dir, "entity").where(F.col("kind").isin(LINKABLE))
    return linkable.join(view(spark, sf_dir, "entity_ref"), ["file_name", "name"], "left_anti")


def joi17_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have entities of which none refers to anything, with their number."""
    return _count(view(spark, sf_dir, "entity").join(view(spark, sf_dir, "entity_ref"), "file_name", "left_anti"), "file_name", "entities")


def joi18_fuzzy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlinked entities and the fields whose name holds theirs, or stands in it, without suffix, case and hyphens."""
    bare = F.upper(F.regexp_replace("name", "(Service|Controller)$", ""))
    left = joi16_unlinked_entities(spark, sf_dir).select("name", bare.alias("text")).distinct()
    right = view(spark, sf_dir, "item").select(F.col("name").alias("field"), F.regexp_replace(F.upper("name"), "-", "").alias("text")).distinct()
    return containing_pairs(left, right, "name", "field", "text", least=4)


def agg09_unannotated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per program the paragraphs of its text that no note is about."""
    return view(spark, sf_dir, "source_paragraph").join(view(spark, sf_dir, "note"), ["name", "paragraph"], "left_anti").groupBy("name").agg(_texts("paragraph").alias("paragraphs"), _n("n"))


# --- domains


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "part_domain")
    size = _count(d, "domain", "n")
    pairs = d.select("program", F.col("domain").alias("domain_a")).join(d.select("program", F.col("domain").alias("domain_b")), "program").where("domain_a < domain_b")
    met = pairs.groupBy("domain_a", "domain_b").agg(_n("shared"), F.array_join(F.slice(F.array_sort(F.collect_set("program")), 1, 10).cast("array<string>"), ", ").alias("sample"))
    ends = [size.select(F.col("domain").alias(f"domain_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    return met.join(ends[0], "domain_a").join(ends[1], "domain_b").select("domain_a", "domain_b", "shared", F.least("n_a", "n_b").alias("smaller"), "sample")


def agg10_domain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with over four fifths of the smaller one in common."""
    return _overlaps(spark, sf_dir).where("shared * 10 > smaller * 8").drop("sample")


def agg11_domain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with two to four fifths of the smaller one in common, and ten programs of both."""
    return _overlaps(spark, sf_dir).where("shared * 10 >= smaller * 4 and shared * 10 < smaller * 8")


def mut06_merge_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains whose overlap is over four fifths of the smaller one become one."""
    pairs = durable(agg10_domain_overlap(spark, sf_dir)).select(F.col("domain_a").alias("a"), F.col("domain_b").alias("b"))
    return repair.merge_domains(view(spark, sf_dir, "part_domain"), pairs)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graphops import txt44_tagged_gaps

    return txt44_tagged_gaps(spark, sf_dir)


def agg12_gap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: domains (subjects), those that a mapping of the middleware stands in, the share, and gaps by severity."""
    total = table(spark, sf_dir, "subjects").select("subject").where("subject is not null").distinct()
    mapped = view(spark, sf_dir, "entity_ref").select(F.regexp_extract("file_name", "^bw/([^/]+)/", 1).alias("subject")).distinct().withColumn("hit", F.lit(1))
    domains = total.join(mapped, "subject", "left").agg(_n("domains"), F.count("hit").alias("covered"))
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    gaps = _gaps(spark, sf_dir).agg(_n("gaps"), n("high"), n("medium"), n("low"))
    return domains.withColumn("one", F.lit(1)).join(gaps.withColumn("one", F.lit(1)), "one").select("domains", "covered", F.round(F.col("covered") * 100 / F.col("domains"), 6).alias("pct"), "gaps", "high", "medium", "low")


def agg13_target_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the middleware: files, entities by kind, references, linked files, gaps, reports with gaps."""
    entity, refs, gaps = view(spark, sf_dir, "entity"), view(spark, sf_dir, "entity_ref"), durable(_gaps(spark, sf_dir))
    parts = [("files", view(spark, sf_dir, "chunk").select("file_name").where("file_name is not null").distinct()), *((f"kind {k}", entity.where(F.col("kind") == k)) for k in ("Service", "Mapping", "Setting"))]
    parts += [("references", refs), ("linked files", refs.select("file_name").distinct()), ("gaps", gaps), ("gap reports", gaps.select("doc_id").distinct())]
    out = None
    for name, df in parts:
        one = df.agg(_n("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- dead code by domain, levels


def nq09_dead_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead paragraphs per domain, and the first five of them."""
    from .graphops import pth04_dead_paragraphs

    # both grow with the parts, whatever the planner takes them for
    dead = pth04_dead_paragraphs(spark, sf_dir).join(view(spark, sf_dir, "part_domain").hint("merge"), "program")
    name = F.concat_ws(".", "program", "paragraph")
    first = dead.groupBy("domain").agg(_n("dead"), F.array_join(F.slice(F.array_sort(F.collect_set(name)), 1, 5), ",").alias("names"))
    return first


def nq16_dead_paragraphs(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    from .graphops import pth04_dead_paragraphs

    return pth04_dead_paragraphs(spark, sf_dir).orderBy("program", "paragraph").limit(limit)


def oth15_parent_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of the first item of a name in its program, which a hierarchy row of that parent name means."""
    rows = view(spark, sf_dir, "item").where("line_no is not null")
    return rows.groupBy("program", "name").agg(F.min(F.struct("line_no", "level")).alias("f")).select("program", "name", F.col("f.level").alias("level"))


# --- listings and details


def lst01_programs(spark: SparkSession, sf_dir: str, contains: str = "", page: int = 1, size: int | None = None) -> DataFrame:
    """Programs whose id holds ``contains``, by id, with the number of callees and of all that match; a ``size`` gives one page."""
    rows = view(spark, sf_dir, "program").where(F.contains("id", F.lit(contains))).select("id", "codebase", "language")
    total = rows.agg(_n("total"))
    out = rows.join(_count(view(spark, sf_dir, "calls"), "src", "callees").withColumnRenamed("src", "id"), "id", "left").withColumn("callees", F.coalesce("callees", F.lit(0)))
    out = out.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").drop("__one").orderBy("id")
    return out if size is None else out.offset((max(1, page) - 1) * size).limit(size)


def lst02_program_detail(spark: SparkSession, sf_dir: str, program: str | None = None) -> DataFrame:
    """A program with all that hangs on it, each list sorted; without ``program``, every program."""
    v = lambda name: view(spark, sf_dir, name)
    base = v("program").select("id", "name", "file_path", "codebase", "mode", "risk")
    base = base if program is None else base.where(F.col("id") == program)
    lists = [
        ("id", v("calls").groupBy(F.col("src").alias("id")).agg(_texts("dst").alias("callees"))),
        ("id", v("calls").groupBy(F.col("dst").alias("id")).agg(_texts("src").alias("callers"))),
        ("id", v("includes").groupBy(F.col("program").alias("id")).agg(_texts("copybook").alias("copybooks"))),
        ("name", v("source_paragraph").groupBy("name").agg(_texts("paragraph").alias("paragraphs"))),
        ("id", v("item").where("level = 1").groupBy(F.col("program").alias("id")).agg(_texts("name").alias("sections"))),
        ("id", v("accesses").groupBy(F.col("program").alias("id")).agg(_texts("tab").alias("tables"))),
        ("id", v("cics").groupBy(F.col("program").alias("id")).agg(_texts("command").alias("commands"))),
        ("id", v("domain").groupBy(F.col("program").alias("id")).agg(_texts("domain").alias("domains"))),
    ]
    out = base
    for key, part in lists:
        out = out.join(part, key, "left").withColumn(part.columns[1], F.coalesce(part.columns[1], F.lit("")))
    return out


def lst04_copybooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copybooks that programs include or items come from, with the number of programs, 0 too."""
    known = view(spark, sf_dir, "includes").select("copybook").union(view(spark, sf_dir, "item").select("copybook").where("copybook <> ''")).distinct()
    return known.join(_count(view(spark, sf_dir, "includes"), "copybook", "programs"), "copybook", "left").select("copybook", F.coalesce("programs", F.lit(0)).alias("programs"))


def lst06_copybook_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a copybook defines, by level and name."""
    return view(spark, sf_dir, "item").where("copybook <> ''").select("copybook", "level", "name", "picture", "usage", "item_id").orderBy("copybook", "level", "name", "item_id")


def lst10_error_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on paragraphs that tell of an error or an abend."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(view(spark, sf_dir, "note"), "doc_id")
    return docs.where(F.lower("text").rlike("error|abend")).select("name", "paragraph").distinct()


def lst11_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "interface").union(view(spark, sf_dir, "mq").select(F.col("program").cast("string"), F.split_part("details", F.lit(" ("), F.lit(1)), "details")).toDF("program", "command", "details")


def lst16_data_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child item with its parent, by name."""
    from .problems import data_links

    names = table(spark, sf_dir, "data_items").select("item_id", "program_id", "item_name").distinct()
    links = data_links(spark, sf_dir).where("parent is not null")
    return links.join(names.select(F.col("item_id").alias("key"), F.col("program_id").alias("program"), F.col("item_name").alias("child_name")), "key").join(names.select(F.col("item_id").alias("parent"), F.col("item_name").alias("parent_name")), "parent").select(
        "program", F.col("key").alias("child"), "child_name", "parent", "parent_name", F.lit("CHILD_OF").alias("kind")
    )


def lst17_bridge_programs(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Programs that call into at least so many domains."""
    met = view(spark, sf_dir, "calls").join(view(spark, sf_dir, "domain").select(F.col("program").alias("dst"), "domain"), "dst").select("src", "domain").distinct()
    return met.groupBy(F.col("src").alias("program")).agg(_texts("domain").alias("domains"), _n("n")).where(F.col("n") >= least)


def lst19_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with a source and a score, the highest first."""
    return view(spark, sf_dir, "program").where("risk is not null and file_path is not null").select("id", "risk", "line_count").orderBy(F.desc("risk"), "id")


def lst28_db_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables that any row of a program ever named, with the programs that name them now, 0 too."""
    cleaned = F.upper(F.trim("t"))
    ever = table(spark, sf_dir, "programs").select(F.explode("sql_tables").alias("t")).select(cleaned.alias("tab")).where("tab <> ''").distinct()
    now = view(spark, sf_dir, "accesses").groupBy("tab").agg(F.count_distinct("program").alias("programs"))
    return ever.join(now, "tab", "left").select("tab", F.coalesce("programs", F.lit(0)).alias("programs"))


def lst47_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "entity").orderBy("file_name", "name", "kind")


def src23_program_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program texts by the name that they give themselves, with newlines + 1 as their number of lines."""
    texts = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("PROGRAM-ID. ")))
    name = F.split_part(F.split_part("text", F.lit("PROGRAM-ID. "), F.lit(2)), F.lit("."), F.lit(1))
    return texts.select(name.alias("name"), "doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("line_count"))


# --- summaries


def agg01_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen counts over the graph."""
    v = lambda name: view(spark, sf_dir, name)
    programs, calls = v("program"), v("calls")
    distinct = lambda df, c: df.select(c).distinct()
    parts = {
        "programs": programs, "external": programs.where("external"), "orphans": programs.join(calls.select(F.col("dst").alias("id")), "id", "left_anti"), "calls": calls, "copybooks": distinct(v("includes"), "copybook"),
        "items": v("item"), "tables": distinct(v("accesses"), "tab"), "domains": distinct(v("domain"), "domain"), "jobs": v("job"), "steps": v("step"), "paragraphs": v("source_paragraph"), "notes": v("note"),
        "relationships": calls.unionByName(v("includes").toDF("src", "dst")).unionByName(v("accesses").select("program", "tab").distinct().toDF("src", "dst")), "commands": v("cics"), "codebases": distinct(programs.where("codebase is not null"), "codebase"),
        "entities": v("entity"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(_n("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def agg04_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted counts per program and the size class that they give."""
    v = lambda name: view(spark, sf_dir, name)
    counts = [
        ("id", _count(v("includes").withColumnRenamed("program", "id"), "id", "cb"), 3),
        ("id", v("interface").groupBy(F.col("program").alias("id")).agg(_n("ext")), 5),
        ("id", v("accesses").groupBy(F.col("program").alias("id")).agg(F.count_distinct("tab").alias("sql")), 3),
        ("id", _count(v("cics").withColumnRenamed("program", "id"), "id", "cics"), 4),
        ("name", _count(v("source_paragraph"), "name", "para"), 2),
    ]
    out, score = v("program").select("id", "name", "line_count"), F.expr("coalesce(line_count, 0) div 500")
    for key, part, weight in counts:
        out = out.join(part, key, "left")
        score = score + F.coalesce(part.columns[1], F.lit(0)) * weight
    size = F.when(F.col("score") > 120, "XL").when(F.col("score") > 60, "L").when(F.col("score") > 20, "M").otherwise("S")
    return out.select("id", score.cast("long").alias("score")).withColumn("size", size)


def agg05_dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and dead ones of the programs that have any."""
    from .graphops import pth04_dead_paragraphs

    total = _count(view(spark, sf_dir, "paragraph"), "program", "total")
    dead = _count(pth04_dead_paragraphs(spark, sf_dir), "program", "dead")
    return total.join(dead.hint("merge"), "program").orderBy(F.desc("dead"), "program")  # both grow with the parts; estimates fall short of either


def agg17_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten checks: how many cases, and the first ten of them."""
    v = lambda name: view(spark, sf_dir, name)
    programs, calls, called = v("program"), v("calls"), v("called")
    ids = programs.select("id")
    known = lambda df, c: df.select(F.col(c).alias("id"))
    checks = {
        "no_language": programs.where("language is null").select("id"),
        "no_risk": programs.where("risk is null").select("id"),
        "no_items": ids.join(known(v("item"), "program"), "id", "left_anti"),
        "no_calls": ids.join(known(called, "src"), "id", "left_semi").join(known(calls, "src"), "id", "left_anti"),
        "orphans": ids.join(known(calls, "dst"), "id", "left_anti"),
        "dangling_calls": known(called, "dst").distinct().join(ids, "id", "left_anti"),
        "no_domain": ids.join(known(v("domain"), "program"), "id", "left_anti"),
        "deleted": programs.where("deleted_at is not null").select("id"),
        "unannotated": known(v("source_paragraph").join(v("note"), ["name", "paragraph"], "left_anti"), "name").distinct(),
        "unlinked_entities": known(joi16_unlinked_entities(spark, sf_dir), "name").distinct(),
    }
    out = None
    for name, df in checks.items():
        # the ten first ids per partition, then of these: no list of all of them
        first = df.orderBy("id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"), F.lit(name).alias("name"))
        one = df.agg(_n("n"), F.lit(name).alias("name")).join(first, "name").select("name", "n", "sample")
        out = one if out is None else out.unionByName(one)
    return out


def fts02_programs(spark: SparkSession, sf_dir: str, query: str = "claims dump section", limit: int = 50) -> DataFrame:
    """Programs by id and path, paragraphs by name and note: each index gives at most ``limit`` rows."""
    programs = view(spark, sf_dir, "program").select("id", F.concat_ws(" ", "id", "file_path").alias("text"))
    notes = view(spark, sf_dir, "note").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.concat_ws(".", "name", "paragraph").alias("id"), "text").distinct()
    found = [search.bm25(df, "id", "text", query, top=limit).select(F.lit(kind).alias("kind"), "id", "score") for kind, df in (("program", programs), ("paragraph", notes.groupBy("id").agg(F.min("text").alias("text"))))]
    return found[0].unionByName(found[1])


# --- named queries with arguments


def nq06_programs_touching_table(spark: SparkSession, sf_dir: str, part: str = "ACCOUNT") -> DataFrame:
    """Programs whose tables' names hold ``part``, any case."""
    return view(spark, sf_dir, "accesses").where(F.contains(F.upper("tab"), F.lit(part.upper()))).select("tab", "program", "op")


def nq07_programs_using_copybook(spark: SparkSession, sf_dir: str, copybook: str = "STDHDR01") -> DataFrame:
    """Programs that include the copybook, with their domains."""
    users = view(spark, sf_dir, "includes").where(F.col("copybook") == copybook.upper())
    return users.join(view(spark, sf_dir, "domain"), "program", "left").select("program", "domain")


def nq11_text_search(spark: SparkSession, sf_dir: str, part: str = "CHECKPOINT RECORD") -> DataFrame:
    """Texts that hold ``part``, any case."""
    return table(spark, sf_dir, "documents").where(F.contains(F.upper("text"), F.lit(part.upper()))).select("doc_id", "n_chars")


# --- external tables and target services: documents, one per record, written out of the graph and read back by their contracts


def _external(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = lambda i: F.split_part("tab", F.lit("."), F.lit(i))
    tables = F.array(F.struct(part(2).alias("name"), part(1).alias("schema")))
    mappings = F.array(F.struct(F.col("tab").alias("cobolTable"), F.lower("tab").alias("externalTable"), F.lit(0.9).alias("confidence")))
    docs = view(spark, sf_dir, "accesses").select("tab").distinct().select(F.lit("Warehouse").alias("key"), F.lit(None).cast("string").alias("program"), F.to_json(F.struct(tables.alias("externalTables"), mappings.alias("mappings"))).alias("json"))
    return extraction.frames(extraction.parse(docs, "external"), "external")


def lst37_external_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _external(spark, sf_dir)["tables"].select("id", "name", "schema_name").distinct().orderBy("id")


def lst39_mappings(spark: SparkSession, sf_dir: str, tab: str | None = None) -> DataFrame:
    """Mappings of the tables of programs to external ones; of one table, or of all."""
    rows = _external(spark, sf_dir)["mappings"].select("tab", "external", "confidence").distinct()
    return rows if tab is None else rows.where(F.col("tab") == tab)


def nq14_external_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External tables with the programs that reach them through a mapped table."""
    uses = view(spark, sf_dir, "accesses").select("program", "tab").distinct()
    return uses.join(lst39_mappings(spark, sf_dir), "tab").groupBy("external").agg(F.count_distinct("program").alias("programs"))


def _target(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    service = F.struct("name", F.lit("http").alias("serviceType"), F.lit("Java").alias("language"), F.col("file_name").alias("basePath"))
    rows = view(spark, sf_dir, "entity").where("kind = 'Service'")
    docs = rows.select(F.regexp_extract("file_name", "^bw/([^/]+)/", 1).alias("key"), F.lit(None).cast("string").alias("program"), F.to_json(F.struct(F.array(service).alias("services"))).alias("json"))
    return extraction.frames(extraction.parse(docs, "target"), "target")


def lst43_target_services(spark: SparkSession, sf_dir: str, repo: str | None = None) -> DataFrame:
    """Services by repository, the first document of an id wins; of one repository, or of all."""
    rows = first_wins(_target(spark, sf_dir)["services"].select("id", "key", "name", "type", "language", "base_path"), ["id"], ["base_path"])
    out = rows.select("id", F.col("key").alias("repo"), "name", "type", "language", "base_path")
    return out if repo is None else out.where(F.col("repo") == repo)


def lst42_target_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lst43_target_services(spark, sf_dir).groupBy("repo").agg(_n("services"))


def agg16_slices(spark: SparkSession, sf_dir: str, offset: int = 0, size: int | None = None) -> DataFrame:
    """The slices of programs with a source, by id; a ``size`` gives that many from ``offset`` on."""
    from .listings import QUERIES as listed

    sourced = view(spark, sf_dir, "program").where("file_path is not null").select("id")
    out = listed["agg15_program_slice"](spark, sf_dir).join(sourced, "id", "left_semi").orderBy("id")
    return out if size is None else out.offset(offset).limit(size)


QUERIES = {
    f.__name__: f
    for f in (
        joi04_cics_flows, joi06_mq_flows, joi08_file_pairs, joi10_cics_pairs, joi12_missing_hierarchy, joi16_unlinked_entities, joi17_orphan_files, joi18_fuzzy_fields, agg09_unannotated_paragraphs, agg10_domain_overlap,
        agg11_domain_candidates, mut06_merge_domains, agg12_gap_coverage, agg13_target_dashboard, nq09_dead_by_domain, nq16_dead_paragraphs, oth15_parent_level, lst01_programs, lst02_program_detail, lst04_copybooks,
        lst06_copybook_structure, lst10_error_paragraphs, lst11_interfaces, lst16_data_hierarchy, lst17_bridge_programs, lst19_candidates, lst28_db_tables, lst47_entities, src23_program_source, agg01_dashboard, agg04_effort, agg05_dead_code_summary,
        agg17_validation, fts02_programs, lst37_external_tables, lst39_mappings, nq14_external_fanout, lst43_target_services, lst42_target_repos, agg16_slices,
        nq06_programs_touching_table, nq07_programs_using_copybook, nq11_text_search,
    )
}

_DEAD = """WITH RECURSIVE entry_point AS (SELECT program, i FROM paragraph q WHERE NOT EXISTS (SELECT 1 FROM performs f WHERE f.program = q.program AND f.dst = q.i)),
  met AS (SELECT program, i FROM entry_point UNION SELECT m.program, f.dst FROM met m JOIN performs f ON f.program = m.program AND f.src = m.i),
  dead AS (SELECT q.program, q.i FROM paragraph q WHERE EXISTS (SELECT 1 FROM entry_point e WHERE e.program = q.program) AND NOT EXISTS (SELECT 1 FROM met m WHERE m.program = q.program AND m.i = q.i)) """
_PARENTS = """WITH counted AS (SELECT DISTINCT item_id, program_id, line_no, item_name, coalesce(level_no, try_cast(regexp_extract(fqn, '\\.(\\d+)\\.[^.]*$', 1) AS INT)) AS lv FROM data_items),
  real AS (SELECT * FROM counted WHERE coalesce(lv, 0) NOT IN (66, 77, 88) AND coalesce(upper(trim(item_name)), '') <> 'FILLER'),
  up AS (SELECT a.item_id, a.program_id, a.item_name, arg_max(b.item_id, b.line_no) AS parent FROM real a LEFT JOIN real b ON a.program_id = b.program_id AND b.line_no < a.line_no AND b.lv < a.lv GROUP BY 1, 2, 3) """
_SHARED = """WITH sizes AS (SELECT domain, count(*) AS n FROM part_domain GROUP BY 1),
  met AS (SELECT a.domain AS domain_a, b.domain AS domain_b, count(*) AS shared, list_sort(list(a.program)) AS ps FROM part_domain a JOIN part_domain b USING (program) WHERE a.domain < b.domain GROUP BY 1, 2),
  rated AS (SELECT m.*, least(x.n, y.n) AS smaller FROM met m JOIN sizes x ON x.domain = domain_a JOIN sizes y ON y.domain = domain_b) """
_GAP = """gap AS (SELECT doc_id, g->>'id' AS id, arg_min(g->>'severity', pos) AS severity FROM (
  SELECT doc_id, unnest(from_json(regexp_extract(text, '<gaps>(.*?)</gaps>', 1, 's'), '["JSON"]')) AS g, unnest(range(json_array_length(regexp_extract(text, '<gaps>(.*?)</gaps>', 1, 's'))::BIGINT)) AS pos FROM documents WHERE contains(text, '<gaps>')) WHERE g->>'id' IS NOT NULL GROUP BY 1, 2)"""
_TARGET = "split_part(details, '''', 2)"

ORACLE = {
    k: duck(v)
    for k, v in {
        "joi04_cics_flows": f"SELECT DISTINCT program AS src, {_TARGET} AS dst, 'CICS_COMMAREA' AS channel FROM interface WHERE {_TARGET} IN (SELECT id FROM program) AND {_TARGET} <> program",
        "joi06_mq_flows": f"""WITH e AS (SELECT DISTINCT {_TARGET} AS queue, program, CASE WHEN details LIKE 'MQPUT%' OR details LIKE 'MQOPEN OUTPUT%' THEN 'writer' WHEN details LIKE 'MQGET%' OR details LIKE 'MQOPEN INPUT%' THEN 'reader' END AS side FROM mq WHERE program IS NOT NULL),
  s AS (SELECT * FROM e WHERE side IS NOT NULL) SELECT a.queue, a.program, a.side, (SELECT count(*) FROM s w WHERE w.queue = a.queue AND w.side = 'writer') AS writers, (SELECT count(*) FROM s r WHERE r.queue = a.queue AND r.side = 'reader') AS readers
  FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.queue = a.queue AND b.side <> a.side AND b.program <> a.program)""",
        "joi08_file_pairs": "SELECT DISTINCT w.program AS writer, r.program AS reader, w.file, x.copybook FROM writes w, reads r, part_includes x, part_includes y WHERE w.file = r.file AND w.program <> r.program AND x.program = w.program AND y.program = r.program AND x.copybook = y.copybook",
        "joi10_cics_pairs": f"""SELECT DISTINCT program AS src, {_TARGET} AS dst, (SELECT count(*) FROM item i WHERE i.program = f.program AND level IN (1, 77)) AS caller_items, (SELECT count(*) FROM item i WHERE i.program = {_TARGET} AND level IN (1, 77)) AS callee_items
  FROM interface f WHERE {_TARGET} IN (SELECT id FROM program)""",
        "joi12_missing_hierarchy": _PARENTS + """, own AS (SELECT u.item_id, u.parent, i.program, i.copybook FROM up u JOIN item i ON i.item_id = u.item_id WHERE i.copybook <> '')
  SELECT a.program, a.copybook FROM own a LEFT JOIN own b ON b.item_id = a.parent GROUP BY 1, 2 HAVING count(*) FILTER (b.copybook = a.copybook) = 0""",
        "joi16_unlinked_entities": "SELECT * FROM entity e WHERE kind <> 'Setting' AND (file_name, name) NOT IN (SELECT (file_name, name) FROM entity_ref)",
        "joi17_orphan_files": "SELECT e.file_name, count(DISTINCT (e.kind, e.name)) AS entities FROM entity e LEFT JOIN entity_ref r USING (file_name) GROUP BY 1 HAVING count(r.field) = 0",
        "joi18_fuzzy_fields": """WITH l AS (SELECT DISTINCT name, upper(regexp_replace(name, '(Service|Controller)$', '')) AS t FROM entity e WHERE kind <> 'Setting' AND NOT EXISTS (SELECT 1 FROM entity_ref r WHERE r.file_name = e.file_name AND r.name = e.name)),
  r AS (SELECT DISTINCT name AS field, replace(upper(name), '-', '') AS t FROM item)
  SELECT DISTINCT l.name, r.field FROM l, r WHERE length(l.t) >= 4 AND length(r.t) >= 4 AND (contains(l.t, r.t) OR contains(r.t, l.t))""",
        "agg09_unannotated_paragraphs": "SELECT s.name, string_agg(s.paragraph, ',' ORDER BY s.paragraph) AS paragraphs, count(*) AS n FROM source_paragraph s LEFT JOIN (SELECT DISTINCT name, paragraph FROM note) n ON n.name = s.name AND n.paragraph = s.paragraph WHERE n.name IS NULL GROUP BY 1",
        "agg10_domain_overlap": _SHARED + "SELECT domain_a, domain_b, shared, smaller FROM rated WHERE shared > 0.8 * smaller",
        "agg11_domain_candidates": _SHARED + "SELECT domain_a, domain_b, shared, smaller, array_to_string(ps[1:10], ', ') AS sample FROM rated WHERE shared >= 0.4 * smaller AND shared < 0.8 * smaller",
        "mut06_merge_domains": _SHARED.replace("WITH sizes", "WITH RECURSIVE sizes")
        + """, link AS (SELECT domain_a AS a, domain_b AS b FROM rated WHERE shared > 0.8 * smaller UNION SELECT domain_b, domain_a FROM rated WHERE shared > 0.8 * smaller),
  walk AS (SELECT a, b FROM link UNION SELECT w.a, l.b FROM walk w JOIN link l ON l.a = w.b),
  keep AS (SELECT a, arg_min(b, (-s.n, length(b), b)) AS kept FROM (SELECT a, b FROM walk UNION SELECT a, a FROM walk) JOIN sizes s ON s.domain = b GROUP BY 1)
  SELECT DISTINCT d.program, coalesce(k.kept, d.domain) AS domain FROM part_domain d LEFT JOIN keep k ON k.a = d.domain""",
        "agg12_gap_coverage": "WITH " + _GAP + """, hit AS (SELECT DISTINCT split_part(file_name, '/', 2) AS subject FROM entity_ref)
  SELECT d.n AS domains, d.c AS covered, round(d.c * 100.0::DOUBLE / d.n, 6) AS pct, count(*) AS gaps, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
  FROM gap, (SELECT count(DISTINCT subject) AS n, count(DISTINCT CASE WHEN subject IN (SELECT subject FROM hit) THEN subject END) AS c FROM subjects) d GROUP BY 1, 2, 3""",
        "agg13_target_dashboard": "WITH " + _GAP + """ SELECT 'files' AS what, count(DISTINCT file_name) AS n FROM chunk UNION ALL SELECT 'kind ' || kind, count(*) FROM entity GROUP BY kind UNION ALL SELECT 'references', count(*) FROM entity_ref
  UNION ALL SELECT 'linked files', count(DISTINCT file_name) FROM entity_ref UNION ALL SELECT 'gaps', count(*) FROM gap UNION ALL SELECT 'gap reports', count(DISTINCT doc_id) FROM gap""",
        "nq09_dead_by_domain": _DEAD + "SELECT domain, count(*) AS dead, array_to_string(list_sort(list(program || '.' || i))[1:5], ',') AS names FROM dead JOIN part_domain USING (program) GROUP BY 1",
        "nq16_dead_paragraphs": _DEAD + "SELECT program, i::BIGINT AS paragraph FROM dead ORDER BY 1, 2 LIMIT 100",
        "oth15_parent_level": "SELECT DISTINCT ON (program, name) program, name, level FROM item WHERE line_no IS NOT NULL ORDER BY program, name, line_no, level",
        "lst01_programs": "SELECT id, codebase, language, (SELECT count(*) FROM calls c WHERE c.src = p.id) AS callees, (SELECT count(*) FROM program) AS total FROM program p",
        "lst02_program_detail": """SELECT id, name, file_path, codebase, mode, risk, (SELECT TEXTS(dst) FROM calls WHERE src = p.id) AS callees, (SELECT TEXTS(src) FROM calls WHERE dst = p.id) AS callers, (SELECT TEXTS(copybook) FROM includes WHERE program = p.id) AS copybooks,
  (SELECT TEXTS(paragraph) FROM source_paragraph s WHERE s.name = p.name) AS paragraphs, (SELECT TEXTS(i.name) FROM item i WHERE i.program = p.id AND level = 1) AS sections, (SELECT TEXTS(tab) FROM accesses WHERE program = p.id) AS tables,
  (SELECT TEXTS(command) FROM cics WHERE program = p.id) AS commands, (SELECT TEXTS(domain) FROM domain WHERE program = p.id) AS domains FROM program p""",
        "lst04_copybooks": "SELECT copybook, count(DISTINCT program) FILTER (program IS NOT NULL) AS programs FROM (SELECT copybook, program FROM includes UNION ALL SELECT copybook, NULL FROM item WHERE copybook <> '') GROUP BY 1",
        "lst06_copybook_structure": "SELECT copybook, level, name, picture, usage, item_id FROM item WHERE copybook <> ''",
        "lst10_error_paragraphs": "SELECT DISTINCT name, paragraph FROM note n WHERE doc_id IN (SELECT doc_id FROM documents WHERE text ILIKE '%error%' OR text ILIKE '%abend%')",
        "lst11_interfaces": "SELECT program, command, details FROM interface UNION ALL SELECT program::VARCHAR, regexp_extract(details, '^(.*?) \\(', 1), details FROM mq",
        "lst16_data_hierarchy": _PARENTS + "SELECT u.program_id AS program, u.item_id AS child, u.item_name AS child_name, u.parent, p.item_name AS parent_name, 'CHILD_OF' AS kind FROM up u JOIN real p ON p.item_id = u.parent",
        "lst17_bridge_programs": "SELECT c.src AS program, TEXTS(d.domain) AS domains, count(DISTINCT d.domain) AS n FROM calls c, domain d WHERE d.program = c.dst GROUP BY 1 HAVING n >= 3",
        "lst19_candidates": "SELECT id, risk, line_count FROM program WHERE NOT (risk IS NULL OR file_path IS NULL)",
        "lst28_db_tables": "SELECT t AS tab, (SELECT count(DISTINCT program) FROM accesses a WHERE a.tab = t) AS programs FROM (SELECT DISTINCT upper(trim(t)) AS t FROM (SELECT unnest(sql_tables) AS t FROM programs)) WHERE t <> ''",
        "src23_program_source": "SELECT regexp_extract(text, 'PROGRAM-ID\\. ([^.]*)', 1) AS name, doc_id, text, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents WHERE contains(text, 'PROGRAM-ID. ')",
        "nq06_programs_touching_table": "SELECT tab, program, op FROM accesses WHERE tab ILIKE '%ACCOUNT%'",
        "nq07_programs_using_copybook": "SELECT i.program, d.domain FROM includes i LEFT JOIN domain d USING (program) WHERE i.copybook = 'STDHDR01'",
        "nq11_text_search": "SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%checkpoint record%'",
        "lst37_external_tables": "SELECT DISTINCT lower('warehouse.' || tab) AS id, split_part(tab, '.', 2) AS name, split_part(tab, '.', 1) AS schema_name FROM accesses",
        "lst39_mappings": "SELECT DISTINCT tab, lower(tab) AS external, 0.9::DOUBLE AS confidence FROM accesses",
        "nq14_external_fanout": "SELECT lower(tab) AS external, count(DISTINCT program) AS programs FROM accesses GROUP BY 1",
        "lst43_target_services": "SELECT split_part(file_name, '/', 2) || '::' || name AS id, split_part(file_name, '/', 2) AS repo, name, 'REST_API' AS type, 'Java' AS language, min(file_name) AS base_path FROM entity WHERE kind = 'Service' GROUP BY 1, 2, 3",
        "lst42_target_repos": "SELECT split_part(file_name, '/', 2) AS repo, count(DISTINCT name) AS services FROM entity WHERE kind = 'Service' GROUP BY 1",
        "agg16_slices": """SELECT p.id, p.mode, p.external, (SELECT TEXTS(copybook) FROM includes WHERE program = p.id) AS copybooks, (SELECT TEXTS(tab) FROM accesses WHERE program = p.id) AS tables, (SELECT TEXTS(dst) FROM calls WHERE src = p.id) AS callees,
  (SELECT TEXTS(command) FROM cics WHERE program = p.id) AS commands FROM program p WHERE file_path IS NOT NULL""",
        "lst47_entities": "SELECT file_name, kind, name FROM entity",
        "agg01_dashboard": """SELECT what, n FROM (SELECT count(*) AS programs, count(*) FILTER (external) AS external, count(*) FILTER (id NOT IN (SELECT dst FROM calls)) AS orphans, (SELECT count(*) FROM calls) AS calls, (SELECT count(DISTINCT copybook) FROM includes) AS copybooks,
  (SELECT count(*) FROM item) AS items, (SELECT count(DISTINCT tab) FROM accesses) AS tables, (SELECT count(DISTINCT domain) FROM domain) AS domains, (SELECT count(*) FROM job) AS jobs, (SELECT count(*) FROM step) AS steps, (SELECT count(*) FROM source_paragraph) AS paragraphs,
  (SELECT count(*) FROM note) AS notes, (SELECT count(*) FROM calls) + (SELECT count(*) FROM includes) + (SELECT count(DISTINCT (program, tab)) FROM accesses) AS relationships, (SELECT count(*) FROM cics) AS commands, count(DISTINCT codebase) AS codebases, (SELECT count(*) FROM entity) AS entities FROM program)
  UNPIVOT (n FOR what IN (COLUMNS(*)))""",
        "agg04_effort": """SELECT id, score, CASE WHEN score <= 20 THEN 'S' WHEN score <= 60 THEN 'M' WHEN score <= 120 THEN 'L' ELSE 'XL' END AS size FROM (SELECT id, 2 * (SELECT count(*) FROM source_paragraph s WHERE s.name = p.name) + 3 * (SELECT count(*) FROM includes WHERE program = p.id)
  + 5 * (SELECT count(*) FROM interface WHERE program = p.id) + 3 * (SELECT count(DISTINCT tab) FROM accesses WHERE program = p.id) + 4 * (SELECT count(*) FROM cics WHERE program = p.id) + coalesce(line_count, 0) // 500 AS score FROM program p)""",
        "agg05_dead_code_summary": _DEAD + "SELECT q.program, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM dead d WHERE d.program = q.program AND d.i = q.i)) AS dead FROM paragraph q WHERE q.program IN (SELECT program FROM dead) GROUP BY 1",
        "agg17_validation": """WITH bad AS (SELECT 'no_language' AS name, id FROM program WHERE language IS NULL UNION ALL SELECT 'no_risk', id FROM program WHERE risk IS NULL UNION ALL SELECT 'no_items', id FROM program WHERE id NOT IN (SELECT program FROM item WHERE program IS NOT NULL)
  UNION ALL SELECT 'no_calls', id FROM program WHERE id IN (SELECT src FROM called) AND id NOT IN (SELECT src FROM calls) UNION ALL SELECT 'orphans', id FROM program WHERE id NOT IN (SELECT dst FROM calls)
  UNION ALL SELECT DISTINCT 'dangling_calls', dst FROM called WHERE dst NOT IN (SELECT id FROM program) UNION ALL SELECT 'no_domain', id FROM program WHERE id NOT IN (SELECT program FROM domain) UNION ALL SELECT 'deleted', id FROM program WHERE deleted_at IS NOT NULL
  UNION ALL SELECT DISTINCT 'unannotated', s.name FROM source_paragraph s WHERE NOT EXISTS (SELECT 1 FROM note n WHERE n.name = s.name AND n.paragraph = s.paragraph)
  UNION ALL SELECT DISTINCT 'unlinked_entities', e.name FROM entity e WHERE kind <> 'Setting' AND NOT EXISTS (SELECT 1 FROM entity_ref r WHERE r.file_name = e.file_name AND r.name = e.name))
  SELECT c.name, count(bad.id) AS n, coalesce(array_to_string(list_sort(list(bad.id) FILTER (bad.id IS NOT NULL))[1:10], ','), '') AS sample FROM (SELECT unnest(['no_language', 'no_risk', 'no_items', 'no_calls', 'orphans', 'dangling_calls', 'no_domain', 'deleted', 'unannotated', 'unlinked_entities']) AS name) c
  LEFT JOIN bad ON bad.name = c.name GROUP BY 1""",
        "fts02_programs": """WITH d AS (SELECT 'program' AS kind, id, concat_ws(' ', id, file_path) AS text FROM program UNION ALL SELECT 'paragraph', n.name || '.' || n.paragraph, min(text) FROM note n JOIN documents x ON x.doc_id = n.doc_id GROUP BY 2),
  t AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM d),
  s AS (SELECT kind, count(*) AS n, avg(len(ws)) AS mean FROM t GROUP BY 1), h AS (SELECT kind, id, len(ws) AS l, w, count(*) AS tf FROM (SELECT kind, id, ws, unnest(ws) AS w FROM t) WHERE w IN ('claims', 'dump', 'section') GROUP BY 1, 2, 3, 4),
  f AS (SELECT kind, w, count(*) AS df FROM h GROUP BY 1, 2)
  SELECT kind, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score FROM h JOIN f USING (kind, w) JOIN s USING (kind) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= 50""",
        "txt44_tagged_gaps": "WITH " + _GAP.replace("arg_min(g->>'severity', pos) AS severity", "arg_min(g->>'severity', pos) AS severity, arg_min(g->>'title', pos) AS title") + " SELECT doc_id, id, severity, title FROM gap",
    }.items()
}
