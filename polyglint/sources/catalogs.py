"""String catalogs: nested JSON files as flat frames, and back.

read_catalogs() gives one frame of tagged rows, parsed once; entries(), units() and the others select
from it. A file that can't be read strictly becomes a diagnostics row instead of failing the scan.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .strict_json import dumps, loads

ROW = "catalog string, kind string, key string, language string, scope string, sub_name string, path string, state string, value string, comment string, extraction_state string, should_translate boolean, arg_num int, format_specifier string, source_language string, version string, message string"
_NAMES = [c.split()[0] for c in ROW.split(", ")]


def _row(**v) -> dict:
    return {n: v.get(n) for n in _NAMES}


def _leaves(node: dict, path: tuple[str, ...] = ()):
    """(path, unit or None) of every leaf of a variations tree."""
    for kind, cases in (node.get("variations") or {}).items():
        for case, inner in (cases or {}).items():
            here = (*path, kind, case)
            if "variations" in inner:
                yield from _leaves(inner, here)
            if "stringUnit" in inner or "variations" not in inner:
                yield ".".join(here), inner.get("stringUnit")


def flatten(catalog: str, data: bytes) -> list[dict]:
    """The rows of a catalog file."""
    try:
        root = loads(data)
        if not isinstance(root, dict) or not isinstance(root.get("strings"), dict):
            raise ValueError("no object of strings")
    except ValueError as e:
        return [_row(catalog=catalog, kind="diagnostic", message=str(e))]
    out = [_row(catalog=catalog, kind="catalog", source_language=root.get("sourceLanguage") or "en", version=root.get("version"))]
    for key, entry in root["strings"].items():
        entry = entry if isinstance(entry, dict) else {}
        should = entry.get("shouldTranslate")
        out.append(_row(catalog=catalog, kind="entry", key=key, comment=entry.get("comment"), extraction_state=entry.get("extractionState"), should_translate=True if should is None else should))
        for language, loc in (entry.get("localizations") or {}).items():
            base = {"catalog": catalog, "key": key, "language": language}
            unit = loc.get("stringUnit")
            shape = "+".join(n for n in ("stringUnit", "variations", "substitutions") if n in loc)
            out.append(_row(**base, kind="localization", value=shape))
            if unit is not None:
                out.append(_row(**base, kind="unit", scope="top", path="", state=unit.get("state"), value=unit.get("value")))
            for path, leaf in _leaves(loc):
                leaf = leaf or {}
                out.append(_row(**base, kind="unit", scope="top", path=path, state=leaf.get("state"), value=leaf.get("value")))
            for name, sub in (loc.get("substitutions") or {}).items():
                arg = sub.get("argNum")
                out.append(_row(**base, kind="substitution", sub_name=name, arg_num=None if arg is None else int(arg), format_specifier=sub.get("formatSpecifier")))
                for path, leaf in _leaves(sub):
                    leaf = leaf or {}
                    out.append(_row(**base, kind="unit", scope="sub", sub_name=name, path=path, state=leaf.get("state"), value=leaf.get("value")))
    return out


def read_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """Tagged rows of all catalogs below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xcstrings").load(root).select("path", "content")

    def parse(batches):
        for b in batches:
            rows = [r for path, data in zip(b["path"], b["content"]) for r in flatten(path, bytes(data))]
            if rows:
                yield pd.DataFrame(rows, columns=_NAMES)

    return files.mapInPandas(parse, ROW)


def _of(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(*columns)


def catalogs(rows: DataFrame) -> DataFrame:
    return _of(rows, "catalog", "catalog", "source_language", "version")


def entries(rows: DataFrame) -> DataFrame:
    return _of(rows, "entry", "catalog", "key", "comment", "extraction_state", "should_translate")


def localizations(rows: DataFrame) -> DataFrame:
    shape = F.col("value")
    return rows.where("kind = 'localization'").select("catalog", "key", "language", shape.contains("stringUnit").alias("has_unit"), shape.contains("variations").alias("has_variations"), shape.contains("substitutions").alias("has_substitutions"))


def units(rows: DataFrame) -> DataFrame:
    return _of(rows, "unit", "catalog", "key", "language", "scope", "sub_name", "path", "state", "value")


def substitutions(rows: DataFrame) -> DataFrame:
    return _of(rows, "substitution", "catalog", "key", "language", "sub_name", "arg_num", "format_specifier")


def diagnostics(rows: DataFrame) -> DataFrame:
    return _of(rows, "diagnostic", "catalog", "message")


def plural_slots(rows: DataFrame) -> DataFrame:
    """(catalog, key, language, node, category, has_text) of every plural node, those of substitutions under their name."""
    u = units(rows).where(F.col("path").rlike(r"(^|\.)plural\.[a-z]+$"))
    node = F.regexp_replace("path", "[a-z]+$", "")
    return u.select("catalog", "key", "language", F.when(F.col("scope") == "sub", F.concat("sub_name", F.lit(": "), node)).otherwise(node).alias("node"), F.substring_index("path", ".", -1).alias("category"), (F.coalesce("value", F.lit("")) != "").alias("has_text"))


def display_text(units_: DataFrame) -> DataFrame:
    """One text for each key and language: the flat one, else the lowest path ending in plural.other, else the lowest path."""
    rank = F.when(F.col("path") == "", 0).when(F.col("path").endswith("plural.other"), 1).otherwise(2)
    return units_.where("scope = 'top'").groupBy("catalog", "key", "language").agg(F.min_by("value", F.struct(rank, F.col("path"))).alias("text"))


def signature(units_: DataFrame) -> DataFrame:
    """All texts of a key and language as a map from path; substitutions' paths begin with their name."""
    path = F.when(F.col("scope") == "sub", F.concat_ws(".", F.lit("substitutions"), "sub_name", "path")).otherwise(F.col("path"))
    return units_.where("value is not null").groupBy("catalog", "key", "language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path.alias("path"), "value")))).alias("texts"))


def substitution_problems(units_: DataFrame, subs: DataFrame) -> DataFrame:
    """(catalog, key, language, sub_name, problem): referred to and not declared, or declared and not referred to."""
    from ..functions.formats import substitution_references

    on = ["catalog", "key", "language", "sub_name"]
    used = units_.where("scope = 'top'").select("catalog", "key", "language", F.explode(substitution_references(F.coalesce("value", F.lit("")))).alias("sub_name")).distinct()
    a = used.join(subs, on, "left_anti").withColumn("problem", F.lit("not declared"))
    return a.unionByName(subs.select(on).join(used, on, "left_anti").withColumn("problem", F.lit("not referred to")))


def merge_units(data: bytes, plan: list[dict], edits: list[dict] = ()) -> bytes:
    """A catalog file's bytes with units put in: rows key, language, path, value, state. All other fields stay as they are.

    A flat text takes the place of variations and substitutions (the plan refuses it unless flattening was asked for); a
    plural's or a device's takes that of a flat text; a substitution's goes into the substitution, which must be there.
    edits come first: rows action, key, value. 'remove' a key; 'rename' it to value, with all below it; set its
    'comment' to value; 'register' it, value being its extraction state or null, unless it is there.
    """
    root = loads(data)
    strings = root["strings"]
    for r in edits:
        key, value = r["key"], r["value"]
        if r["action"] == "register":
            strings.setdefault(key, {} if value is None else {"extractionState": value})
        elif r["action"] == "comment":
            strings.setdefault(key, {})["comment"] = value
        elif r["action"] == "remove":
            strings.pop(key, None)
        elif r["action"] == "rename":
            if value in strings and value != key:
                raise ValueError(f"the key {value!r} exists")
            if key in strings:
                root["strings"] = strings = {value if k == key else k: v for k, v in strings.items()}
                source = root.get("sourceLanguage")
                if source:  # a key that was its own text keeps that text
                    strings[value].setdefault("localizations", {}).setdefault(source, {"stringUnit": {"state": "translated", "value": key}})
        else:
            raise ValueError(f"unknown action {r['action']!r}")
    for r in plan:
        loc = strings.setdefault(r["key"], {}).setdefault("localizations", {}).setdefault(r["language"], {})
        unit = {"state": r["state"] or "translated", "value": r["value"]}
        if not r["path"]:
            loc.pop("variations", None)
            loc.pop("substitutions", None)
            loc["stringUnit"] = unit
            continue
        steps = r["path"].split(".")
        if steps[0] == "substitutions":
            made = loc.get("substitutions", {})
            if steps[1] not in made:
                raise ValueError(f"{r['key']!r} has no substitution {steps[1]!r} in {r['language']}")
            loc, steps = made[steps[1]], steps[2:]
        else:
            loc.pop("stringUnit", None)
        for kind, case in zip(steps[::2], steps[1::2]):
            loc = loc.setdefault("variations", {}).setdefault(kind, {}).setdefault(case, {})
        loc["stringUnit"] = unit
    return dumps(root).encode()


def save(spark: SparkSession, root: str, plan: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """(catalog, content) of the catalogs below root that the plan (catalog, key, language, path, value, state, action) or the
    edits (catalog, action, key, value) change; store() puts them in place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xcstrings").load(root).select(F.col("path").alias("catalog"), "content")
    lit = lambda c: F.lit(None).cast("string").alias(c)
    rows = plan.where("action in ('created', 'updated')").select("catalog", lit("action"), "key", "language", "path", "value", "state")
    if edits is not None:
        rows = rows.unionByName(edits.select("catalog", "action", "key", lit("language"), lit("path"), "value", lit("state")))

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"catalog": pd.Series([], dtype=str), "content": pd.Series([], dtype=object)})
        right = right.astype(object).where(right.notna(), None).sort_values(["key", "language", "path"], na_position="first")
        new = right["action"].isna()
        content = merge_units(bytes(left["content"][0]), right[new].to_dict("records"), right[~new].to_dict("records"))
        return pd.DataFrame({"catalog": [left["catalog"][0]], "content": [content]})

    return files.groupBy("catalog").cogroup(rows.groupBy("catalog")).applyInPandas(put, "catalog string, content binary")


def store(contents: DataFrame) -> int:
    """Write save()'s catalogs over the files they came from, each whole under another name first; how many."""

    def write(batches):
        from pyarrow import fs

        for b in batches:
            for path, content in zip(b["catalog"], b["content"]):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_output_stream(at + ".new") as out:
                    out.write(bytes(content))
                system.move(at + ".new", at)
            yield pd.DataFrame({"n": [len(b)]})

    return contents.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def owner(path: str) -> str:
    """The directory a catalog belongs to, its .lproj folder passed over."""
    folder = posixpath.dirname(path)
    return posixpath.dirname(folder) if folder.endswith(".lproj") else folder
