"""The engine's commands as functions: from a project's folder to findings.

findings: rule, level, message, file, line, key, language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, hygiene, text
from ..functions.plural import base_language, is_exact_count, required_categories
from ..operators import consistency, coverage, diff, languages, membership, resolve, writes
from ..sources import catalogs as C
from ..sources import swift_scanner as S
from ..sources.interchange import development_region, project_settings, read_bundles, read_lines, read_plists, read_strings, read_texts
from ..sources.payloads import REFERENCE_EXTENSIONS, Configuration
from .render import RULES

COLUMNS = ["rule", "level", "message", "file", "line", "key", "language"]


def finding(rows: DataFrame, rule, message, file="catalog", key="key", language=None, line=None) -> DataFrame:
    """Rows as findings; each argument is a column, a column's name, or (rule, message) a text."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    level = F.element_at(F.create_map(*[F.lit(x) for k, (lv, _) in RULES.items() for x in (k, lv)]), rule)
    col = lambda v, kind="string": F.lit(None).cast(kind) if v is None else F.col(v).cast(kind) if isinstance(v, str) else v.cast(kind)
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(rule.alias("rule"), F.coalesce(level, F.lit("error")).alias("level"), message.alias("message"), col(file).alias("file"), col(line, "int").alias("line"), col(key).alias("key"), col(language).alias("language"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pairs(units: DataFrame, sources: DataFrame, substitutions: bool) -> DataFrame:
    """(catalog, key, language, path, source, translation): texts beside the source language's of the same path; a flat one falls back to the key."""
    u = units if substitutions else units.where("scope = 'top'")
    u = u.withColumn("path", F.when(F.col("scope") == "sub", F.concat_ws(".", F.lit("substitutions"), "sub_name", "path")).otherwise(F.col("path"))).join(sources, "catalog")
    own = u.where("language = source_language").select("catalog", "key", "path", F.col("value").alias("source"))
    other = u.where("language <> source_language").select("catalog", "key", "language", "path", F.col("value").alias("translation"))
    return other.join(own, ["catalog", "key", "path"], "left").withColumn("source", F.coalesce("source", F.when(F.col("path") == "", F.col("key")))).where("source is not null and translation is not null")


def check(spark: SparkSession, root: str, config: Configuration | None = None, requested: list[str] | None = None) -> DataFrame:
    """Findings of all catalog checks below a folder."""
    c = config or Configuration(root=root)
    rows = C.read_catalogs(spark, root).cache()  # parsed once, read by every check
    sources, units, entries = C.catalogs(rows).select("catalog", "source_language"), C.units(rows), C.entries(rows)
    parted = coverage.key_partition(entries)
    keys = parted.where("class = 'translatable'").select("catalog", "key")
    mine = units.join(keys, ["catalog", "key"], "left_semi")
    wanted = languages.to_report(languages.present(units), sources, requested, c.languages)
    gaps = coverage.plural_gaps(C.plural_slots(rows)).join(keys, ["catalog", "key"], "left_semi")
    states = coverage.status(mine.where("scope = 'top'"), gaps)
    asked = keys.join(wanted, "catalog").join(sources, "catalog").where("language <> source_language").join(states, ["catalog", "key", "language"], "left")
    lacking = asked.where("status is null or (status = 'unit' and state in ('new', 'stale'))")
    beside = pairs(mine, sources, False).where(~is_exact_count(F.col("path")) & (F.col("source") != "") & (F.col("translation") != ""))
    wrong = beside.withColumn("problem", formats.mismatch(F.col("source"), F.col("translation"))).where("problem is not null").groupBy("catalog", "key", "language").agg(F.min_by("problem", "path").alias("problem"))
    dirty = hygiene.findings(pairs(mine, sources, True))
    shown = C.display_text(units).join(sources, "catalog").where("language = source_language").join(parted.where("class in ('translatable', 'do-not-translate')").select("catalog", "key"), ["catalog", "key"], "left_semi")
    texts = keys.join(shown.select("catalog", "key", "text"), ["catalog", "key"], "left").withColumn("text", F.coalesce("text", "key"))
    flat = mine.where("scope = 'top' and path = ''").join(sources, "catalog").where("language <> source_language").select("catalog", "key", "language", "value")
    doubles = consistency.duplicate_sources(texts)
    parts = [
        finding(C.diagnostics(rows), "configuration", F.col("message"), key=None),
        finding(lacking, "missing-translation", "no translation", language="language"),
        finding(asked.where("status = 'empty'"), "empty-translation", "the translation is empty", language="language"),
        finding(asked.where("status = 'unit' and state in ('new', 'needs_review')"), "needs-review", "awaits review", language="language"),
        finding(coverage.identical_to_source(mine.where("scope = 'top'"), sources), "identical-to-source", "repeats the source", language="language"),
        finding(coverage.new_gaps(gaps, sources), "plural-incomplete", F.concat_ws(" ", "language", F.array_join("missing", ", "))),
        finding(coverage.flat_where_plural(mine.where("scope = 'top'"), sources), "plural-incomplete", F.concat_ws(" ", "language", F.lit("has one text for all counts"))),
        finding(wrong, "format-mismatch", F.col("problem"), language="language"),
        finding(dirty, F.col("rule"), F.concat(F.col("rule"), F.when(F.col("path") != "", F.concat(F.lit(" at "), "path")).otherwise("")), language="language"),
        finding(parted.where("class = 'stale'"), "stale-key", "the key is stale"),
        finding(consistency.sentence_keys(keys, flat), "sentence-key", F.concat(F.col("at_risk").cast("string"), F.lit(" translations at risk"))),
        finding(consistency.case_duplicates(entries.select("catalog", "key", (F.coalesce("extraction_state", F.lit("")) == "manual").alias("manual"))), F.when(F.col("breaking"), "case-collision").otherwise("case-variant"), F.replace(F.col("keys"), F.lit("\n"), F.lit(", ")), key="lowered"),
        finding(doubles, "duplicate-source", F.concat(F.col("n").cast("string"), F.lit(" keys")), key="folded"),
        finding(consistency.divergent_renderings(texts, flat), "divergent-translation", F.concat(F.col("renderings").cast("string"), F.lit(" renderings")), key="folded", language="language"),
        finding(C.substitution_problems(units, C.substitutions(rows)), "format-mismatch", F.concat_ws(" ", "sub_name", "problem"), language="language"),
    ]
    for (catalog,) in [tuple(r) for r in sources.select("catalog").where(text.catalog_kind(F.col("catalog")) != "app-shortcuts").orderBy("catalog").collect()]:  # a project's few files
        near = consistency.near_duplicates(shown.where(F.col("catalog") == catalog).select("key", "text"), c.similarityThreshold)
        parts.append(finding(near.withColumn("catalog", F.lit(catalog)), "near-duplicate", F.concat_ws(" ", F.col("percent").cast("string"), F.lit("% like"), "b"), key="a"))
    if c.glossary:
        parts.append(finding(consistency.glossary_violations(pairs(mine, sources, False).select("key", "language", "source", "translation"), c.glossary_rows(spark)), "glossary", F.concat_ws(" ", "term", F.lit("is"), "rendering"), file=None, language="language"))
    lines = read_lines(spark, root, "*.pbxproj")
    declared = read_plists(spark, root).where(F.col("path").endswith("Info.plist")).select("key", "value").union(project_settings(lines).select("key", "value")).select(F.lit("project").alias("target"), "key", "value")
    localized = entries.where(text.catalog_kind(F.col("catalog")) == "info-plist").select(F.lit("project").alias("target"), "key")
    region = development_region(lines).where(F.length(base_language(F.col("region"))).isin(2, 3))
    named = languages.present(units)
    parts += [
        finding(texts.select("catalog", "key", F.explode(hygiene.source_rules(F.col("text"))).alias("rule")).join(sources, "catalog"), F.col("rule"), F.col("rule"), language="source_language"),
        finding(hygiene.same_plurals(mine.where("scope = 'top'"), required_categories(F.col("language"))), "same-plurals", "all plural forms are one text", language="language"),
        finding(membership.plist_not_localized(declared, localized), "info-plist-not-localized", F.col("detail"), file=None, key=None),
        finding(membership.region_mismatch(sources, region), "development-region-mismatch", F.concat_ws(" ", "source_language", F.lit("is not"), "region"), key=None),
    ]
    parts.append(finding(coverage.coverage_gaps(named), "language-coverage-gap", F.col("missing"), key=None))
    return _all(parts)


def scan(spark: SparkSession, root: str, config: Configuration | None = None) -> DataFrame:
    """Findings of the sources below a folder against its catalogs: one target that reaches all catalogs."""
    c = config or Configuration(root=root)
    rows, files = C.read_catalogs(spark, root).cache(), S.read_sources(spark, root)
    done = S.classify(S.literals(files), S.discoveries(files), c.scanner_options()).cache()
    found = S.found_strings(done, c.scanner_options(), c.scanPreviews).withColumn("target", F.lit("project"))
    entries = C.entries(rows)
    tables = C.catalogs(rows).select("catalog", text.catalog_table(F.col("catalog")).alias("table_name"))
    targets = spark.createDataFrame([("project", True)], "target string, inferred boolean")
    reach = resolve.reachable(spark.createDataFrame([], "target string, ord int, catalog string"), targets, tables)
    hit = resolve.resolve(found, reach, entries.select("catalog", "key"))
    bare = entries.where(formats.contains_specifier(F.col("key"))).select("key").distinct()
    by_pattern = resolve.resolve_patterns(found.where("is_format_key").select(F.col("format_pattern").alias("pattern"), "head"), bare)
    absent = hit.where("catalog is null").join(found.select("value", "format_pattern", "path", "line").distinct(), "value").join(by_pattern.select(F.col("pattern").alias("format_pattern")), "format_pattern", "left_anti")
    legacy = read_strings(spark, root).select(F.col("table").alias("table_name"), F.col("key").alias("value"))
    absent = absent.join(legacy, ["table_name", "value"], "left_anti")
    used = done.select("value").union(done.select(F.col("format_key").alias("value"))).union(by_pattern.select(F.col("key").alias("value")))
    mine = entries.where(text.catalog_kind(F.col("catalog")).isin("localizable", "table") & (F.coalesce("extraction_state", F.lit("")) != "stale") & text.is_translatable(F.col("key")) & ~text.is_interface_builder_key(F.col("key")) & ~formats.contains_specifier(F.col("key"))).select("catalog", "key")
    left = resolve.unreferenced(mine, used)
    others = read_texts(spark, root, "*.{%s}" % ",".join(REFERENCE_EXTENSIONS if c.referenceExtensions is None else c.referenceExtensions))
    texts = files.union(others).where("text is not null").select("text")
    # keys in use, by value or by pattern, and the languages of their catalog that lack them
    by_value = found.select("table_name", "value", "format_pattern", "path", "line").distinct().join(hit.where("catalog is not null").select("table_name", "value", "catalog").distinct(), ["table_name", "value"], "left")
    owner = entries.where(text.catalog_kind(F.col("catalog")).isin("localizable", "table")).groupBy("key").agg(F.min("catalog").alias("catalog"))
    patterned = by_value.where("catalog is null").drop("catalog").join(by_pattern.select(F.col("pattern").alias("format_pattern"), "key"), "format_pattern").join(owner, "key")
    present = by_value.where("catalog is not null").withColumn("key", F.col("value")).select("catalog", "key", "path", "line").union(patterned.select("catalog", "key", "path", "line"))
    units, sources = C.units(rows), C.catalogs(rows).select("catalog", "source_language")
    states = coverage.status(units.where("scope = 'top'"), coverage.plural_gaps(C.plural_slots(rows)))
    asked = present.join(entries.where(F.coalesce("should_translate", F.lit(True))).select("catalog", "key"), ["catalog", "key"]).join(languages.present(units), "catalog").join(sources, "catalog").where("language <> source_language")
    lacking = asked.join(states, ["catalog", "key", "language"], "left").where("status is null or status in ('empty', 'incomplete') or (status = 'unit' and state in ('new', 'stale'))")
    lacking = lacking.groupBy("catalog", "key", "language").agg(F.min(F.struct("path", "line")).alias("at")).select("catalog", "key", "language", "at.path", "at.line")
    orphan = left.join(resolve.orphans(left.select(F.col("key").alias("id"), "key").distinct(), texts).select(F.col("id").alias("key")), "key", "left_semi")
    return _all([
        finding(absent, "string-not-in-catalog", F.concat(F.lit("not in table "), "table_name"), file="path", key="value", line="line"),
        finding(lacking, "untranslated-string", F.concat_ws(" ", F.lit("no translation in"), "catalog"), file="path", language="language", line="line"),
        finding(S.bypasses(done), "localization-bypass", "never localized", file="path", key="value", line="line"),
        finding(orphan, "orphaned-key", "nothing refers to it"),
        finding(files.where("text is null"), "configuration", "not UTF-8", file="path", key=None),
    ])


def changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Findings between two folders with versions of the same catalogs: keys added and removed, source texts changed, translations they stranded."""
    out = []
    old, new = C.read_catalogs(spark, before), C.read_catalogs(spark, after)
    for rows, name in ((old, "a"), (new, "b")):
        u = C.units(rows).join(C.catalogs(rows).select("catalog", "source_language"), "catalog")
        path = F.when(F.col("scope") == "sub", F.concat_ws(".", F.lit("substitutions"), "sub_name", "path")).otherwise(F.col("path"))
        out.append(u.select(F.concat_ws("\u0001", text.catalog_table(F.col("catalog")), "key").alias("key"), F.when(F.col("language") == F.col("source_language"), "\u0001source").otherwise(F.col("language")).alias("language"), path.alias("path"), "value", "state"))
    a, b = out
    split = lambda f: f.withColumn("catalog", F.substring_index("key", "\u0001", 1)).withColumn("key", F.substring_index("key", "\u0001", -1))
    reviewed = b.where("state in ('new', 'needs_review')").select("key", "language").distinct()
    moved = split(diff.translations_of_changes(a, b, "\u0001source", reviewed).where("fate = 'stale'"))
    changed = split(diff.source_changes(a, b, "\u0001source"))
    keys = split(diff.key_changes(a, b))
    return _all([
        finding(keys, F.concat(F.lit("key-"), "change"), F.col("change")).withColumn("level", F.lit("note")),
        finding(changed, "source-language-changed", F.concat_ws(" ", "old", F.lit("->"), "new")).withColumn("level", F.lit("warning")),
        finding(moved, "stale-translation", "the source changed and this didn't", language="language"),
    ])


def bundle_edits(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(edits, refused) of the bundles below a folder: edits(catalog table as catalog, key, language, path, value, state) for plan_add, the last unit of a
    place wins; refused units with the reason."""
    u = read_bundles(spark, root).where("message is null").withColumn("c", text.unit_config(F.col("id")))
    path = F.when(F.col("c.kind") == "plural", F.concat(F.lit("plural."), "c.category")).when(F.col("c.kind") == "device", F.concat(F.lit("device."), "c.name")).when(F.col("c.kind") == "substitution", F.concat_ws(".", F.lit("substitutions"), "c.name", F.lit("plural"), "c.category")).otherwise("")
    full = u.select(text.xliff_table(F.col("original")).alias("catalog"), text.unit_key(F.col("id")).alias("key"), "language", path.alias("path"), F.col("target").alias("value"), text.catalog_state(F.col("state"), F.col("qualifier")).alias("state"), F.struct("document", "line").alias("at"), F.col("c.kind").alias("kind"))
    good = full.where("kind <> 'unsupported' and coalesce(value, '') <> ''")
    last = good.groupBy("catalog", "key", "language", "path").agg(F.max_by(F.struct("value", "state"), "at").alias("v")).select("catalog", "key", "language", "path", "v.value", "v.state")
    return last, full.where("kind = 'unsupported'").select("catalog", "key", "language", F.lit("unsupported-unit").alias("reason"))


def apply_bundles(spark: SparkSession, root: str, units: DataFrame, keys: DataFrame) -> DataFrame:
    """The plan of writing bundles into units and keys whose catalog is named by its table; keys the project doesn't know are refused."""
    edits, _ = bundle_edits(spark, root)
    known = edits.join(keys.select("catalog", "key").distinct(), ["catalog", "key"], "left_semi")
    unknown = edits.join(keys.select("catalog", "key").distinct(), ["catalog", "key"], "left_anti").withColumn("action", F.lit("refused: unknown-key"))
    plan = writes.plan_add(known, units, keys)
    return plan.unionByName(unknown.select(plan.columns))
