"""What a file is, by name and by content; enumerations and their synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions, keywords and enumerations.
KINDS = {"cbl": "COBOL", "cob": "COBOL", "cpy": "COPYBOOK", "cpb": "COPYBOOK", "jcl": "JCL", "asm": "ASM", "bms": "BMS", "pli": "PLI"}
CONTENT_EXTENSIONS = ("txt", "dat", "src", "pds", "mem", "")
DOCUMENT_KINDS = {
    "java": "Java", "md": "Markdown", "xml": "XML", "bw": "Businessware", "txt": "Text", "vsdx": "Visio Diagram", "drawio": "DrawIO Diagram", "svg": "SVG Diagram", "puml": "PlantUML Diagram", "plantuml": "PlantUML Diagram",
}
PROGRAM_SIGNALS = (
    "IDENTIFICATION DIVISION", "PROGRAM-ID", "PROCEDURE DIVISION", "DATA DIVISION", "ENVIRONMENT DIVISION", "WORKING-STORAGE SECTION", "LINKAGE SECTION", "FILE SECTION", "EXEC SQL", "EXEC CICS", "PERFORM ", "MOVE ",
    "CALL '", "EVALUATE ", "GOBACK", "STOP RUN", "COPY ",
)
COPYBOOK_SIGNALS = (r"^\s*(0[1-9]|[1-4][0-9]|66|77|88)\s", r" PIC | PICTURE ", " REDEFINES ", " VALUE ", " OCCURS ", r"COMP-3| COMP ", " FILLER ")
JCL_SIGNAL = r"^//\w+\s+(JOB|EXEC|DD)\s"
ENUMS = {
    "execution_mode": (("BATCH", "CICS", "BATCH_AND_CICS", "IDMS_DC", "IDMS_BATCH", "UNKNOWN"), "UNKNOWN"),
    "category": (("INIT", "VALIDATION", "PROCESSING", "IO", "ERROR-HANDLING", "CLEANUP", "OTHER"), "OTHER"),
    "risk_type": (("hub", "external_dependencies", "complex_control_flow", "standard", "data_coupling", "dead_code"), "standard"),
    "copybook_risk": (("LOW", "MEDIUM", "HIGH", "CRITICAL"), "LOW"),
}
SYNONYMS = {
    "service": ({"REST_API": "REST_API", "REST": "REST_API", "HTTP": "REST_API", "GRPC": "GRPC", "MESSAGE_CONSUMER": "MESSAGE_CONSUMER", "CONSUMER": "MESSAGE_CONSUMER", "SUBSCRIBER": "MESSAGE_CONSUMER", "BATCH_JOB": "BATCH_JOB",
                 "BATCH": "BATCH_JOB", "JOB": "BATCH_JOB", "LIBRARY": "LIBRARY", "LIB": "LIBRARY", "UTIL": "LIBRARY", "UTILITY": "LIBRARY"}, "REST_API"),
    "integration": ({"DATABASE": "DATABASE", "DB": "DATABASE", "REST_CLIENT": "REST_CLIENT", "REST": "REST_CLIENT", "HTTP_CLIENT": "REST_CLIENT", "MESSAGE_QUEUE": "MESSAGE_QUEUE", "MQ": "MESSAGE_QUEUE", "QUEUE": "MESSAGE_QUEUE",
                     "KAFKA": "MESSAGE_QUEUE", "RABBITMQ": "MESSAGE_QUEUE", "SQS": "MESSAGE_QUEUE", "FILE_IO": "FILE_IO", "FILE": "FILE_IO", "FILESYSTEM": "FILE_IO", "CACHE": "CACHE", "REDIS": "CACHE", "MEMCACHE": "CACHE"}, "EXTERNAL_API"),
    "rule": ({"VALIDATION": "VALIDATION", "VALIDATE": "VALIDATION", "CALCULATION": "CALCULATION", "CALC": "CALCULATION", "COMPUTE": "CALCULATION", "AUTHORIZATION": "AUTHORIZATION", "AUTH": "AUTHORIZATION", "AUTHZ": "AUTHORIZATION",
              "WORKFLOW": "WORKFLOW", "FLOW": "WORKFLOW", "ORCHESTRATION": "WORKFLOW", "TRANSFORMATION": "TRANSFORMATION", "TRANSFORM": "TRANSFORMATION", "MAPPING": "TRANSFORMATION"}, "VALIDATION"),
    "error": ({"TRY_CATCH": "TRY_CATCH", "TRY/CATCH": "TRY_CATCH", "EXCEPTION": "TRY_CATCH", "ERROR_MIDDLEWARE": "ERROR_MIDDLEWARE", "MIDDLEWARE": "ERROR_MIDDLEWARE", "HANDLER": "ERROR_MIDDLEWARE", "CIRCUIT_BREAKER": "CIRCUIT_BREAKER",
               "CIRCUIT": "CIRCUIT_BREAKER", "RETRY": "RETRY", "FALLBACK": "FALLBACK", "DEFAULT": "FALLBACK"}, "TRY_CATCH"),
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def by_name(path: Column) -> Column:
    """The kind by extension, or by the one before it in names such as X.CBL.txt; null if neither tells."""
    kinds = _map(KINDS)
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.try_element_at(kinds, extension(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""))))


def content_eligible(path: Column) -> Column:
    """Whether the content may tell what the name doesn't."""
    return extension(path).isin(*CONTENT_EXTENSIONS)


def by_content(text: Column) -> Column:
    """JCL, COBOL or COPYBOOK by how many lines carry each kind's signals; null where no line carries any. Blanks at both
    ends of a line are no part of a signal, but for job control, which begins in the first column."""
    lines = F.split(text, "\n")
    bare = F.transform(lines, lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")))
    n = lambda pattern: F.size(F.filter(bare, lambda x: x.rlike(pattern)))
    exact = lambda word: F.size(F.filter(bare, lambda x: F.contains(x, F.lit(word))))
    program, copybook = sum((exact(w) for w in PROGRAM_SIGNALS), F.lit(0)), sum((n(p) for p in COPYBOOK_SIGNALS), F.lit(0))
    named = exact("PROGRAM-ID") > 0
    jcl = F.size(F.filter(lines, lambda x: x.rlike(JCL_SIGNAL)))
    return F.when(jcl >= 2, "JCL").when(named | (program >= 3), "COBOL").when((program >= 1) | (copybook >= 1), "COPYBOOK")


def name_hint(name: Column) -> Column:
    """What a member name suggests by its beginning; null if nothing."""
    bare = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when(bare.rlike("^(CPY|COPY)"), "COPYBOOK").when(bare.startswith("DCL"), "DCLGEN").when(bare.rlike("^(MAP|BMS)"), "BMS").when(bare.startswith("PROC"), "PROC").when(bare.rlike("^[A-Z@#$][A-Z0-9@#$]{0,7}$"), "MEMBER")


def document_kind(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DOCUMENT_KINDS), extension(path)), F.lit("Unknown"))


def normal(value: Column, enum: str) -> Column:
    """A value of the enumeration, whatever its case; the enumeration's fallback for any other, null or empty."""
    allowed, fallback = ENUMS[enum]
    return F.coalesce(F.try_element_at(_map({a.upper(): a for a in allowed}), F.upper(value)), F.lit(fallback))


def synonym(value: Column, family: str) -> Column:
    """The family's name for a value; the family's fallback for what it doesn't know."""
    known, fallback = SYNONYMS[family]
    return F.coalesce(F.try_element_at(_map(known), F.upper(F.trim(value))), F.lit(fallback))


def trim_comment_header(text: Column) -> Column:
    """Blank and comment lines off the beginning; a text of nothing else stays."""
    lines = F.split(text, "\n")
    first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x).rlike(r"^[^*]"), i)), lambda i: i.isNotNull()))
    return F.when(first.isNull(), text).otherwise(F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n"))


#: Extensions of archive entries that can be read (fixed values).
ANALYZABLE = ("java", "xml", "properties", "txt", "md", "json", "yml", "yaml", "cfg", "conf", "class")
#: What tells a repository's files apart: parts of a test's path, of a build file's, and extensions of schemas and settings (fixed values).
TEST_SIGNS = ("_test.", "test_", "/test/", "/tests/", "/spec/", "__test__", ".spec.", ".test.")
BUILD_SIGNS = (".gradle", "pom.xml", "makefile", "dockerfile", ".dockerfile", "docker-compose", ".sh", ".bat", ".cmd", "jenkinsfile", ".github")
SCHEMAS = ("graphql", "proto", "wsdl", "xsd", "avsc")
SETTINGS = ("yaml", "yml", "json", "xml", "toml", "ini", "properties", "env")
#: Languages of a repository's files by extension; markup doesn't count for the main one (fixed values).
LANGUAGES = {
    "java": "Java", "kt": "Kotlin", "scala": "Scala", "cs": "C#", "vb": "VB.NET", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "rb": "Ruby", "php": "PHP", "rs": "Rust",
    "swift": "Swift", "cpp": "C++", "cc": "C++", "c": "C", "xml": "XML", "yaml": "YAML", "yml": "YAML", "json": "JSON", "graphql": "GraphQL", "proto": "Protobuf",
}
MARKUP = ("XML", "YAML", "JSON")
#: Directives of a text diagram and what they draw, in the order they are looked for (fixed values).
DIAGRAMS = {
    "@startuml": "UML", "@startmindmap": "Mind Map", "@startwbs": "Work Breakdown Structure", "@startgantt": "Gantt Chart", "@startjson": "JSON", "@startyaml": "YAML", "@startditaa": "Ditaa", "@startsalt": "Salt (UI Wireframe)",
}


def _any_of(c: Column, signs: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in signs]), lambda x: F.contains(c, x))


def analyzable(entry: Column) -> Column:
    """Whether an archive's entry can be read; a manifest always."""
    return F.upper(entry).endswith("MANIFEST.MF") | extension(entry).isin(*ANALYZABLE)


def repo_category(path: Column) -> Column:
    """What a file of a repository is for: the first that fits of test, schema, build, config, source, other."""
    low, ext = F.lower(path), extension(path)
    return F.when(_any_of(low, TEST_SIGNS), "test").when(ext.isin(*SCHEMAS), "schema").when(_any_of(low, BUILD_SIGNS), "build").when(ext.isin(*SETTINGS), "config").when(ext.isin(*LANGUAGES), "source").otherwise("other")


def primary_language(files: DataFrame, path: str) -> DataFrame:
    """(language): what most files of a repository are in, markup left out; of several the last by name. No row without any."""
    named = files.select(F.try_element_at(_map(LANGUAGES), extension(F.col(path))).alias("language")).where(~F.col("language").isin(*MARKUP))
    return named.groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "language")).alias("m")).where("m is not null").select("m.language")


def repo_provider(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("github.com")), "github").when(_any_of(url, ("dev.azure.com", "visualstudio.com")), "azure_devops").otherwise("generic")


def repo_name(url: Column) -> Column:
    """The last part of the address's path, without .git; the address itself where it has no path."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(path, r"[.]git$", ""), "([^/]+)/*$", 1), F.lit("")), url)


def plantuml_kind(text: Column) -> Column:
    """What a text diagram draws, by the first directive of the list that it holds; empty without any."""
    out = F.lit("")
    for directive, kind in reversed(DIAGRAMS.items()):
        out = F.when(F.contains(F.lower(text), F.lit(directive)), kind).otherwise(out)
    return out
