"""Translation interchange: XLIFF 1.2 documents and bundles, legacy .strings files, property lists, project files."""

from __future__ import annotations

import plistlib
import posixpath
import re
import xml.parsers.expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "document string, original string, source_language string, target_language string, id string, source string, target string, note string, state string, qualifier string, line int, message string"
_UNIT_NAMES = [c.split()[0] for c in UNIT.split(", ")]


def parse_xliff(document: str, data: bytes) -> list[dict]:
    """The trans-units of a document; one row with a message where it can't be read. Markup inside a source or target fails the document:
    dropping it silently would lose text."""
    out, file, unit, stack, text = [], {}, None, [], None
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True

    def start(name, attrs):
        nonlocal file, unit, text
        if stack and stack[-1] in ("source", "target") and unit is not None:
            raise ValueError(f"markup <{name}> inside <{stack[-1]}> on line {parser.CurrentLineNumber}")
        stack.append(name)
        if name == "file":
            file = attrs
        elif name == "trans-unit":
            if "id" not in attrs:
                raise ValueError(f"a trans-unit without an id on line {parser.CurrentLineNumber}")
            unit = {"id": attrs["id"], "line": parser.CurrentLineNumber}
        elif name in ("source", "target", "note") and unit is not None:
            text = []
            if name == "target":
                unit["state"], unit["qualifier"] = attrs.get("state"), attrs.get("state-qualifier")

    def end(name):
        nonlocal unit, text
        stack.pop()
        if name in ("source", "target", "note") and unit is not None and text is not None:
            unit.setdefault(name, "".join(text))
            text = None
        elif name == "trans-unit":
            out.append({**dict.fromkeys(_UNIT_NAMES), "document": document, "original": file.get("original"), "source_language": file.get("source-language"), "target_language": file.get("target-language"), **unit})
            unit = None

    def characters(data):
        if text is not None:
            text.append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(data, True)
    except (xml.parsers.expat.ExpatError, ValueError) as e:
        return [{**dict.fromkeys(_UNIT_NAMES), "document": document, "message": str(e)}]
    return out


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def _each_file(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        for b in batches:
            rows = [r for path, data in zip(b["path"], b["content"]) for r in parse(path, bytes(data))]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"line": "Int32"} if "line" in names else {})

    return files.mapInPandas(work, schema)


def read_xliff(spark: SparkSession, root: str) -> DataFrame:
    return _each_file(_files(spark, root, "*.xliff"), parse_xliff, UNIT)


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Units of all .xcloc bundles below root, with bundle and language: what contents.json says, else the documents, else the bundle's name."""
    of = F.regexp_extract("document", r"(.*/([^/]+)\.xcloc)/Localized%20Contents/|(.*/([^/]+)\.xcloc)/Localized Contents/", 0)
    units = read_xliff(spark, root).withColumn("bundle", F.regexp_extract("document", r"^(.*?\.xcloc)/", 1)).where(of != "")
    meta = _files(spark, root, "contents.json").select(F.regexp_extract("path", r"^(.*?\.xcloc)/contents\.json$", 1).alias("bundle"), F.get_json_object(F.decode("content", "utf-8"), "$.targetLocale").alias("declared")).where("bundle <> ''")
    said = units.groupBy("bundle").agg(F.min("target_language").alias("said"))
    return units.join(meta, "bundle", "left").join(said, "bundle", "left").withColumn("language", F.coalesce("declared", "said", F.regexp_extract("bundle", r"([^/]+)\.xcloc$", 1)))


_STRINGS = re.compile(r'/\*.*?\*/|//[^\n]*|"((?:[^"\\]|\\.)*)"|([\w.$-]+)|([=;])', re.S)
_UNESCAPE = re.compile(r'\\(U[0-9a-fA-F]{4}|.)', re.S)


def strings_keys(text: str) -> list[str]:
    """Keys of a .strings file: quoted or bare words before an equals sign, or alone before a semicolon."""
    out, last, state = [], None, "key"
    for m in _STRINGS.finditer(text):
        quoted, bare, mark = m.groups()
        if mark == "=" and state == "key" and last is not None:
            out.append(last)
            state = "value"
        elif mark == ";":
            if state == "key" and last is not None:
                out.append(last)
            last, state = None, "key"
        elif quoted is not None or bare is not None:
            if state == "key":
                last = bare if quoted is None else _UNESCAPE.sub(lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1]) or (chr(int(e[1][1:], 16)) if e[1][0] == "U" and len(e[1]) == 5 else e[1]), quoted)
    return out


def decode(data: bytes) -> str:
    for bom, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    return data.decode("utf-8", "replace")


def read_strings(spark: SparkSession, root: str) -> DataFrame:
    """(table, key) of legacy .strings files in Base and English folders; presence only."""
    files = _files(spark, root, "*.strings").where(F.lower("path").rlike(r"/(base|en|en[-_][^/]*)\.lproj/[^/]+$"))

    def parse(path, data):
        table = posixpath.splitext(posixpath.basename(path))[0]
        return [{"table": table, "key": k} for k in strings_keys(decode(data))]

    return _each_file(files, parse, "table string, key string").distinct()


def read_plists(spark: SparkSession, root: str) -> DataFrame:
    """(path, key, value) of the string entries of property lists; unreadable files give nothing."""

    def parse(path, data):
        try:
            root_ = plistlib.loads(data)
        except Exception:
            return []
        return [{"path": path, "key": k, "value": v} for k, v in root_.items() if isinstance(v, str)] if isinstance(root_, dict) else []

    return _each_file(_files(spark, root, "*.plist"), parse, "path string, key string, value string")


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of the files of a name pattern; text is null where a file isn't UTF-8."""
    content = F.col("content").cast("string")
    return _files(spark, root, pattern).select("path", F.when(F.is_valid_utf8(content), content).alias("text"))


def read_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(file, line, value) of such files, lines from 1."""
    lines = read_texts(spark, root, pattern).where("text is not null").select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\R")).alias("at", "value"))
    return lines.select("file", (F.col("at") + 1).alias("line"), "value")


def project_settings(lines: DataFrame) -> DataFrame:
    """lines(file, line, value) of project files: the property-list keys set in build settings, (file, line, key, value)."""
    pattern = r"INFOPLIST_KEY_(\w+)\"?\s*=\s*\"?(.*?)\"?;"
    return lines.where(F.col("value").contains("INFOPLIST_KEY_")).select("file", "line", F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value")).where("key <> ''")


def development_region(lines: DataFrame) -> DataFrame:
    """The first development region by file and line: one row (region), or none."""
    hit = lines.select("file", "line", F.regexp_extract("value", r"developmentRegion\s*=\s*\"?([\w-]+)\"?\s*;", 1).alias("region")).where("region <> ''")
    return hit.agg(F.min_by("region", F.struct("file", "line")).alias("region")).where("region is not null")
