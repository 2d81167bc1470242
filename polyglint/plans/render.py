"""Findings for people and machines: rule dictionary, JSON, SARIF, annotations, text, templates."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hygiene import LEVEL
from ..functions.plural import required_categories
from ..sources.strict_json import dumps

RULES = {
    "missing-translation": ("error", "No translation"), "empty-translation": ("error", "The translation is empty"), "needs-review": ("warning", "Marked for review"),
    "identical-to-source": ("warning", "The translation repeats the source"), "plural-incomplete": ("error", "A plural category that the language needs is missing"),
    "format-mismatch": ("error", "Format specifiers don't fit the source"), "glossary": ("error", "A term isn't rendered as the glossary says"),
    "sentence-key": ("warning", "The key is prose; editing it loses translations"), "case-collision": ("error", "Keys made by hand differ in case alone"),
    "case-variant": ("warning", "Keys differ in case alone"), "duplicate-source": ("warning", "Several keys share one source text"),
    "divergent-translation": ("warning", "One source text is rendered differently"), "near-duplicate": ("warning", "Source texts are nearly alike"), "stale-key": ("note", "The key is stale"),
    "info-plist-not-localized": ("warning", "A user-facing property-list key isn't localized"), "development-region-mismatch": ("warning", "Source language and development region differ"),
    "language-coverage-gap": ("warning", "A language that most catalogs have is absent"), "string-not-in-catalog": ("error", "A localized string isn't in any catalog"),
    "untranslated-string": ("error", "A string in use lacks a translation"), "localization-bypass": ("warning", "User-visible text is never localized"), "orphaned-key": ("warning", "Nothing refers to the key"),
    "unknown-key": ("warning", "The bundle has a key that the project lacks"), "unsupported-unit": ("warning", "A unit of a shape that isn't written"), "machine-translated": ("warning", "Translated by machine"),
    "bundle-metadata": ("error", "The bundle's metadata disagree"), "missing-from-bundle": ("warning", "The bundle lacks a key"), "configuration": ("error", "A file can't be read"),
    **{k: (v, k.replace("-", " ").capitalize()) for k, v in LEVEL.items()},
}


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, lv, d) for k, (lv, d) in sorted(RULES.items())], "rule string, level string, description string")


def report_json(findings: DataFrame) -> DataFrame:
    """One row, column value: counts and all findings, ordered, as JSON."""
    row = F.struct("rule", "level", "message", "file", "line", "key", "language")
    return findings.agg(F.to_json(F.struct(F.count_if(F.col("level") == "error").alias("failures"), F.count_if(F.col("level") != "error").alias("advisories"), F.array_sort(F.collect_list(row)).alias("findings"))).alias("value"))


def _escape(text, more: str = ""):
    for c in "%\r\n" + more:
        text = F.replace(text, F.lit(c), F.lit("%%%02X" % ord(c)))
    return text


def annotations(findings: DataFrame) -> DataFrame:
    """A CI annotation for each finding, column value."""
    level = F.when(F.col("level") == "error", "error").when(F.col("level") == "warning", "warning").otherwise("notice")
    place = F.concat_ws(",", F.when(F.col("file").isNotNull(), F.concat(F.lit("file="), _escape(F.col("file"), ":,"))), F.when(F.col("line") > 0, F.concat(F.lit("line="), F.col("line").cast("string"))), F.concat(F.lit("title="), _escape(F.col("rule"), ":,")))
    return findings.select(F.concat(F.lit("::"), level, F.lit(" "), place, F.lit("::"), _escape(F.col("message"))).alias("value"))


def uri(path: str) -> str:
    return ("file://" if path.startswith("/") else "") + quote(path)


def sarif(findings: DataFrame, tool: str = "polyglint") -> str:
    """SARIF 2.1.0 of the findings, a document for a person's tools: collected on the driver."""
    rows = [r.asDict() for r in findings.select("rule", "level", "message", "file", "line").orderBy("file", "line", "rule", "message").collect()]
    used = list(dict.fromkeys(r["rule"] for r in rows))
    results = []
    for r in rows:
        result = {"ruleId": r["rule"], "ruleIndex": used.index(r["rule"]), "level": r["level"], "message": {"text": r["message"]}}
        if r["file"]:
            at = {"artifactLocation": {"uri": uri(r["file"])}}
            if not r["file"].startswith("/"):
                at["artifactLocation"]["uriBaseId"] = "%SRCROOT%"
            if r["line"] and r["line"] > 0:
                at["region"] = {"startLine": r["line"]}
            result["locations"] = [{"physicalLocation": at}]
        results.append(result)
    described = [{"id": k, "shortDescription": {"text": RULES.get(k, ("warning", k))[1]}, "defaultConfiguration": {"level": RULES.get(k, ("warning", k))[0]}} for k in used]
    return dumps({"version": "2.1.0", "$schema": SCHEMA, "runs": [{"tool": {"driver": {"name": tool, "rules": described}}, "results": results}]}, "plain")


def text_report(findings: DataFrame, most: int = 50) -> str:
    """Findings by rule, `most` of each, and how many more there are."""
    lines = []
    for r in findings.groupBy("rule", "level").count().orderBy("level", "rule").collect():
        lines.append(f"{r['level']} {r['rule']} ({r['count']})")
        some = findings.where(F.col("rule") == r["rule"]).orderBy("file", "key", "language").limit(most).collect()
        lines += ["  " + " ".join(str(x) for x in (f["file"], f["key"], f["language"], f["message"]) if x).replace("\n", "\\n").replace("\t", "\\t") for f in some]
        if r["count"] > len(some):
            lines.append(f"  ... and {r['count'] - len(some)} more")
    return "\n".join(lines)


def templates(outstanding: DataFrame, sources: DataFrame) -> DataFrame:
    """outstanding(catalog, key, language, plural) with sources(catalog, key, text, comment) -> a fill-in payload for each catalog and language: (catalog, language, value)."""
    todo = F.when(F.col("plural"), F.to_json(F.map_from_entries(F.transform(required_categories(F.col("language")), lambda c: F.struct(c, F.lit("TODO"))))))
    row = F.struct("key", F.coalesce("text", "key").alias("source"), "comment", F.when(~F.col("plural"), "TODO").alias("value"), todo.alias("plural"))
    return outstanding.join(sources, ["catalog", "key"], "left").groupBy("catalog", "language").agg(F.to_json(F.struct(F.first("catalog").alias("catalog"), F.first("language").alias("language"), F.array_sort(F.collect_list(row)).alias("strings"))).alias("value"))


SCHEMA = "https://json.schemastore.org/" + "sarif-2.1.0.json"


class RunResult:
    """Failures and advisories of a run and its exit code: 0 clean, 1 findings, 2 couldn't run."""

    def __init__(self, failures: int, advisories: int, errors: int = 0):
        self.failures, self.advisories, self.errors = failures, advisories, errors

    def exit_code(self, strict: bool = False) -> int:
        return 2 if self.errors else int(bool(self.failures or (strict and self.advisories)))
