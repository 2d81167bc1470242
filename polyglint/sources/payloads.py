"""Edit payloads and project configuration: small JSON documents, read strictly on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.plural import ORDER
from .strict_json import Number, dumps, loads

STATES = ("new", "needs_review", "translated", "stale")
EDIT = "catalog string, key string, language string, path string, value string, state string, comment string"


def _is_text(x) -> bool:
    return isinstance(x, str) and not isinstance(x, Number)


def parse_payload(data: bytes | str, catalog: str | None = None, language: str | None = None) -> list[dict]:
    """Edits of a payload: an envelope {catalog?, language?, strings} or the strings alone. An entry is a text, {value, state?, comment?} or
    {plural: {category: text}}. Unknown categories and states, and entries of another shape, are errors."""
    root = loads(data)
    if not isinstance(root, dict):
        raise ValueError("a payload is an object")
    enveloped = isinstance(root.get("strings"), dict)
    strings = root["strings"] if enveloped else root
    catalog, language = (root.get("catalog") or catalog, root.get("language") or language) if enveloped else (catalog, language)
    out = []
    for key, entry in strings.items():
        base = {"catalog": catalog, "key": key, "language": language, "path": "", "state": "translated", "comment": None}
        if _is_text(entry):
            out.append({**base, "value": str(entry)})
        elif isinstance(entry, dict) and isinstance(entry.get("plural"), dict):
            for category, text in entry["plural"].items():
                if category not in ORDER:
                    raise ValueError(f"{key!r}: no plural category {category!r}")
                if not _is_text(text):
                    raise ValueError(f"{key!r}: the plural form {category} isn't a text")
                out.append({**base, "path": f"plural.{category}", "value": str(text), "comment": entry.get("comment")})
        elif isinstance(entry, dict) and _is_text(entry.get("value")):
            state = entry.get("state") or "translated"
            if state not in STATES:
                raise ValueError(f"{key!r}: no state {state!r}")
            out.append({**base, "value": str(entry["value"]), "state": state, "comment": entry.get("comment")})
        else:
            raise ValueError(f"{key!r}: neither a text, nor a value, nor plural forms")
    return out


def edits(spark: SparkSession, data: bytes | str, **where) -> DataFrame:
    return spark.createDataFrame(parse_payload(data, **where), EDIT)


NAME = ".polyglint.json"
REFERENCE_EXTENSIONS = ("plist", "strings", "stringsdict", "storyboard", "xib", "intentdefinition", "m", "mm", "h", "json", "yaml", "yml")  # searched before a key counts as orphaned


@dataclass
class Configuration:
    """Project settings. A list replaces the default; excludeAlso adds to it."""

    root: str = "."
    targets: list[dict] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    exclude: list[str] | None = None
    excludeAlso: list[str] = field(default_factory=list)
    excludePaths: list[str] = field(default_factory=list)
    ignoreStrings: list[str] = field(default_factory=list)
    ignoreSimilar: list[list[str]] = field(default_factory=list)
    localizableCalls: list[str] = field(default_factory=list)
    localizableModifiers: list[str] = field(default_factory=list)
    localizableParams: list[str] | None = None
    localizedAccessors: list[str] | None = None
    skipCalls: list[str] | None = None
    skipParams: list[str] | None = None
    referenceExtensions: list[str] | None = None
    similarityThreshold: int = 85
    scanPreviews: bool = False
    glossary: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def find(start: str) -> str | None:
        """The nearest configuration file at or above a folder."""
        at = os.path.abspath(start)
        while True:
            path = os.path.join(at, NAME)
            if os.path.isfile(path):
                return path
            up = os.path.dirname(at)
            if up == at:
                return None
            at = up

    @classmethod
    def load(cls, path: str) -> Configuration:
        with open(path, "rb") as f:
            root = loads(f.read())
        known = {k for k in cls.__dataclass_fields__ if k != "root"}
        if not isinstance(root, dict) or set(root) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(set(root) - known)) if isinstance(root, dict) else root!r}")
        if "similarityThreshold" in root:
            root["similarityThreshold"] = int(root["similarityThreshold"])
        c = cls(root=os.path.dirname(os.path.abspath(path)), **root)
        if not 50 <= c.similarityThreshold <= 99:
            raise ValueError("similarityThreshold is from 50 to 99")
        if any(len(p) != 2 for p in c.ignoreSimilar):
            raise ValueError("ignoreSimilar holds pairs")
        if any(not term or not isinstance(v, dict) or not all(v.values()) for term, v in c.glossary.items()):
            raise ValueError("a glossary maps terms to renderings by language")
        return c

    def save(self, path: str) -> None:
        """Write the settings that differ from the defaults."""
        plain = Configuration()
        body = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "root" and getattr(self, k) != getattr(plain, k)}
        with open(f"{path}.new", "w") as f:
            f.write(dumps(body, "plain") + "\n")
        os.replace(f"{path}.new", path)

    def scanner_options(self):
        from .swift_scanner import Options

        d = Options()
        pick = lambda mine, default: tuple(default if mine is None else mine)
        return Options(tuple(self.localizableCalls), tuple(self.localizableModifiers), pick(self.localizableParams, d.params), pick(self.localizedAccessors, d.accessors), pick(self.skipParams, d.skip_params), pick(self.skipCalls, d.skip_calls), tuple(self.ignoreStrings))

    def excluded(self) -> tuple[str, ...]:
        from .discovery import EXCLUDED

        return (*(EXCLUDED if self.exclude is None else self.exclude), *self.excludeAlso)

    def glossary_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, lang, r) for t, v in self.glossary.items() for lang, r in v.items()], "term string, language string, rendering string")
