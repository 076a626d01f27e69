"""Files as frames: directory scans, archives, class files and diagrams."""

from __future__ import annotations

import base64
import io
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify

NESTED = (".jar", ".war", ".ear", ".zip")
MOST_BYTES, MOST_DEPTH = 500 << 20, 3


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, sha256, size, line_count, text) of all files below ``root`` but empty ones and those in hidden folders.

    The kind comes from the name, else, where the name leaves it open, from the content. A newline at the end adds no
    line.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").rlike(r"/\.[^/]+/"))
    text = F.decode(F.col("content"), "ISO-8859-1")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) == 0) | text.endswith("\n"), 0).otherwise(1)
    kind = F.coalesce(classify.by_name(F.col("path")), F.when(classify.content_eligible(F.col("path")), classify.by_content(text)))
    return raw.select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), lines.cast("int").alias("line_count"), text.alias("text"))


def entries(name: str, data: bytes, depth: int = MOST_DEPTH, left: list[int] | None = None) -> Iterator[tuple[str, bytes]]:
    """(virtual path, bytes) of an archive's files, archives within it included; encrypted files and what exceeds the size budget are left out."""
    left = [MOST_BYTES] if left is None else left
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    for info in archive.infolist():
        if info.is_dir() or info.flag_bits & 1 or info.file_size > left[0]:
            continue
        body = archive.read(info)
        left[0] -= len(body)
        path = f"{name}!/{info.filename}"
        if info.filename.lower().endswith(NESTED):
            if depth > 1:
                yield from entries(path, body, depth - 1, left)
        else:
            yield path, body


def archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): the files of all archives below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p, b in entries(path, content):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([b], pa.binary())], ["path", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.where(F.lower("path").rlike(r"\.(jar|war|ear|zip)$")).select("path", "content").mapInArrow(run, "path string, content binary")


_PRIMITIVE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
_FLAGS = ((1, "public"), (2, "private"), (4, "protected"), (8, "static"), (16, "final"), (0x200, "interface"), (0x400, "abstract"))


def descriptor(d: str) -> list[str]:
    """Type names in a JVM descriptor, in order; ``[Ljava/lang/String;`` is String[]."""
    out, at = [], 0
    while at < len(d):
        if d[at] in "()":
            at += 1
            continue
        dims = 0
        while d[at] == "[":
            dims, at = dims + 1, at + 1
        if d[at] == "L":
            end = d.index(";", at)
            name, at = d[at + 1 : end].rsplit("/", 1)[-1], end + 1
        else:
            name, at = _PRIMITIVE[d[at]], at + 1
        out.append(name + "[]" * dims)
    return out


def class_text(data: bytes) -> str | None:
    """A class file as a few lines of source-like text; null for anything else."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        return None
    f = io.BytesIO(data[8:])
    take = lambda fmt: struct.unpack(">" + fmt, f.read(struct.calcsize(">" + fmt)))
    pool: dict[int, object] = {}
    (count,) = take("H")
    n = 1
    while n < count:
        (tag,) = take("B")
        if tag == 1:
            (size,) = take("H")
            pool[n] = f.read(size).decode("utf-8", "replace")
        elif tag in (7, 8, 16, 19, 20):
            pool[n] = take("H")[0]
        elif tag == 15:
            take("BH")
        elif tag in (5, 6):
            take("Q")
            n += 1
        else:
            take("I")
        n += 1
    name = lambda i: str(pool.get(pool.get(i, 0), "")).replace("/", ".")
    words = lambda flags, skip=(): [w for bit, w in _FLAGS if flags & bit and w not in skip]
    access, this, above, k = take("HHHH")
    faces = [name(i) for i in take(f"{k}H")] if k else []
    head = " ".join([*words(access), *([] if access & 0x200 else ["class"]), name(this)])
    lines = [head + (f" extends {name(above)}" if above else "") + (" implements " + ", ".join(faces) if faces else "")]
    for kind in ("field", "method"):
        for _ in range(take("H")[0]):
            flags, nm, ds, attributes = take("HHHH")
            for _ in range(attributes):
                _, size = take("HI")
                f.read(size)
            types = descriptor(str(pool[ds]))
            sign = f"{types[0]} {pool[nm]}" if kind == "field" else f"{types[-1]} {pool[nm]}({', '.join(types[:-1])})"
            lines.append("  " + " ".join([*words(flags, ("interface",)), sign]))
    return "\n".join(lines)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _plain(html: str | None) -> str:
    out, depth = [], 0
    for c in html or "":
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">" and depth > 0
    return "".join(out).strip()


def drawio_text(data: bytes) -> str:
    """Shapes and connections of a diagram; compressed pages are base64 over raw deflate over URL quoting."""
    lines = []
    for page in (e for e in ElementTree.fromstring(data).iter() if _tag(e) in ("diagram", "mxGraphModel")):
        if _tag(page) == "diagram":
            if len(page) or not (page.text or "").strip():
                continue
            page = ElementTree.fromstring(urllib.parse.unquote(zlib.decompress(base64.b64decode(page.text), -15).decode()))
        cells = [e for e in page.iter() if _tag(e) == "mxCell"]
        label = {c.get("id"): _plain(c.get("value")) for c in cells}
        lines += [f"shape: {label[c.get('id')]}" for c in cells if c.get("vertex") == "1" and label[c.get("id")]]
        lines += [f"{label.get(c.get('source')) or c.get('source')} -> {label.get(c.get('target')) or c.get('target')}" + (f": {label[c.get('id')]}" if label[c.get("id")] else "") for c in cells if c.get("edge") == "1"]
    return "\n".join(lines)


def svg_text(data: bytes) -> str:
    """Text, titles and descriptions, in order, each once."""
    found = [" ".join("".join(e.itertext()).split()) for e in ElementTree.fromstring(data).iter() if _tag(e) in ("text", "title", "desc")]
    return "\n".join(dict.fromkeys(x for x in found if x))


def visio_text(data: bytes) -> str:
    """Shape texts of all pages, and connections by the shapes they are glued to."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for page in sorted(n for n in z.namelist() if n.startswith("visio/pages/page") and n.endswith(".xml")):
            root = ElementTree.fromstring(z.read(page))
            texts = {e.get("ID"): " ".join("".join(t.itertext()).strip() for t in e if _tag(t) == "Text") for e in root.iter() if _tag(e) == "Shape"}
            ends: dict[str, dict[str, str]] = {}
            for e in root.iter():
                if _tag(e) == "Connect":
                    ends.setdefault(e.get("FromSheet"), {})[e.get("FromCell")] = e.get("ToSheet")
            lines += [f"shape: {t}" for i, t in texts.items() if t and i not in ends]
            lines += [f"{texts.get(x['BeginX']) or x['BeginX']} -> {texts.get(x['EndX']) or x['EndX']}" for x in ends.values() if {"BeginX", "EndX"} <= set(x)]
    return "\n".join(dict.fromkeys(lines))


def diagram_text(path: str, data: bytes) -> str | None:
    """The text of a diagram by its extension; null if it isn't one or can't be read."""
    ext = path.lower().rsplit(".", 1)[-1]
    try:
        if ext in ("puml", "plantuml"):
            return data.decode("utf-8", "replace")
        reader = {"drawio": drawio_text, "svg": svg_text, "vsdx": visio_text, "class": class_text}.get(ext)
        return reader(data) if reader else None
    except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, ValueError, struct.error, KeyError):
        return None


def texts_of(files: DataFrame) -> DataFrame:
    """(path, text) of ``files`` (path, content): what can be read out of diagrams and class files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([diagram_text(p, b) if b is not None else None for p, b in zip(paths, batch.column(1).to_pylist())], pa.string())], ["path", "text"])

    return files.select("path", "content").where("path is not null").mapInArrow(run, "path string, text string").where("text is not null")
