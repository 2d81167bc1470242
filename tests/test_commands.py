import json
import plistlib

import pytest

from polyglint.operators import languages
from polyglint.plans import commands
from polyglint.sources import catalogs, payloads
from test_sources import CATALOG, SWIFT, XLIFF, key, unit


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("p")
    (root / "Localizable.xcstrings").write_text(json.dumps(CATALOG, ensure_ascii=False))
    (root / "Bad.xcstrings").write_text("{")
    (root / "A.swift").write_text(SWIFT + '\nlet s = Text("Save")\n')
    bundle = root / "de.xcloc/Localized Contents"
    bundle.mkdir(parents=True)
    (bundle / "de.xliff").write_text(XLIFF)
    return root


def names(df):
    return {(r.rule, r.key, r.language) for r in df.collect()}


def test_check(spark, project):
    got = names(commands.check(spark, str(project)))
    assert ("needs-review", "Save", "de") in got and ("missing-translation", "Save", "pl") in got and ("plural-incomplete", "%lld items", None) in got
    assert any(rule == "configuration" for rule, *_ in got) and not any(k == "posts" and rule == "missing-translation" for rule, k, _ in got)
    only = names(commands.check(spark, str(project), requested=["de"]))
    assert ("missing-translation", "Save", "pl") not in only and ("needs-review", "Save", "de") in only
    with pytest.raises(ValueError, match="is it 'de'"):
        commands.check(spark, str(project), requested=["dee"])


def test_scan(spark, project):
    got = names(commands.scan(spark, str(project)))
    assert ("string-not-in-catalog", "cancel", None) in got and ("localization-bypass", "Set it", None) in got
    assert ("string-not-in-catalog", "Save", None) not in got and ("orphaned-key", "posts", None) in got and ("orphaned-key", "Save", None) not in got


@pytest.fixture(scope="module")
def whole(tmp_path_factory):
    root = tmp_path_factory.mktemp("w")
    same = {"variations": {"plural": {c: unit("x") for c in ("one", "few", "many", "other")}}}
    strings = {"Wait...": key(en=unit("Wait..."), de=unit("Warte")), "%@ of %@": key(en=unit("%@ of %@"), de=unit("%@ von %@")), "many": key(en=unit("many"), pl=same), "only.in.board": key(en=unit("a")), "only.in.note": key(en=unit("b")), "12": key(en=unit("12")), "Used": key(en=unit("Used"), de=unit("Benutzt"))}
    (root / "Localizable.xcstrings").write_text(json.dumps({"sourceLanguage": "en", "version": "1.0", "strings": strings}))
    (root / "A.swift").write_text('let s = Text("Used")\n')
    (root / "Main.storyboard").write_text('<label text="only.in.board"/>')
    (root / "n.note").write_text("only.in.note")
    (root / "Info.plist").write_bytes(plistlib.dumps({"NSCameraUsageDescription": "To scan", "CFBundleVersion": "1"}))
    (root / "project.pbxproj").write_text("x = 1;\n\tdevelopmentRegion = de;\n")
    return root


def test_check_source_side_and_project(spark, whole):
    got = names(commands.check(spark, str(whole)))
    assert {("ellipsis-style", "Wait...", "en"), ("unordered-specifiers", "%@ of %@", "en"), ("same-plurals", "many", "pl"), ("info-plist-not-localized", None, None), ("development-region-mismatch", None, None)} <= got
    assert not {("ellipsis-style", "Used", "en"), ("same-plurals", "Used", "de")} & got


def test_scan_other_files_and_untranslated(spark, whole):
    got = names(commands.scan(spark, str(whole)))
    assert {k for rule, k, _ in got if rule == "orphaned-key"} == {"Wait...", "many", "only.in.note"}
    assert ("untranslated-string", "Used", "pl") in got and ("untranslated-string", "Used", "de") not in got
    other = names(commands.scan(spark, str(whole), payloads.Configuration(root=str(whole), referenceExtensions=["note"])))
    assert {k for rule, k, _ in other if rule == "orphaned-key"} == {"Wait...", "many", "only.in.board"}


def test_changes(spark, project, tmp_path):
    new = json.loads(json.dumps(CATALOG))
    new["strings"]["Save"]["localizations"]["en"]["stringUnit"]["value"] = "Store"
    new["strings"]["Save"]["localizations"]["de"]["stringUnit"]["state"] = "translated"
    new["strings"]["Add"] = key(en=unit("Add"))
    del new["strings"]["posts"]
    (tmp_path / "Localizable.xcstrings").write_text(json.dumps(new))
    got = {(r.rule, r.key, r.level) for r in commands.changes(spark, str(project), str(tmp_path)).collect()}
    assert got == {("key-added", "Add", "note"), ("key-removed", "posts", "note"), ("source-language-changed", "Save", "warning"), ("stale-translation", "Save", "error")}


def test_bundles(spark, project):
    rows = catalogs.read_catalogs(spark, str(project))
    from polyglint.functions.text import catalog_table

    units = catalogs.units(rows).where("scope = 'top'").withColumn("catalog", catalog_table(rows.catalog))
    keys = catalogs.entries(rows).withColumn("catalog", catalog_table(rows.catalog))
    assert {(r.key, r.action) for r in commands.apply_bundles(spark, str(project), units, keys).collect()} == {("Save", "unchanged"), ("Two", "refused: unknown-key")}


def test_payloads(spark):
    rows = payloads.parse_payload('{"catalog": "c", "language": "de", "strings": {"a": "b", "p": {"plural": {"one": "x", "other": "y"}}, "v": {"value": "z", "state": "needs_review", "comment": "w"}}}')
    assert [(r["catalog"], r["key"], r["path"], r["value"], r["state"]) for r in rows] == [("c", "a", "", "b", "translated"), ("c", "p", "plural.one", "x", "translated"), ("c", "p", "plural.other", "y", "translated"), ("c", "v", "", "z", "needs_review")]
    assert payloads.edits(spark, '{"a": "b"}', catalog="c", language="fr").first().language == "fr"
    for bad in ('{"a": {"plural": {"lots": "x"}}}', '{"a": {"value": "x", "state": "odd"}}', '{"a": 1}', "[]", '{"a": "x", "a": "y"}'):
        with pytest.raises(ValueError):
            payloads.parse_payload(bad)


def test_configuration(spark, tmp_path):
    c = payloads.Configuration(excludeAlso=["gen"], similarityThreshold=70, glossary={"Loop": {"de": "Schleife"}}, localizableCalls=["Banner"])
    c.save(str(tmp_path / payloads.NAME))
    (tmp_path / "a/b").mkdir(parents=True)
    found = payloads.Configuration.find(str(tmp_path / "a/b"))
    again = payloads.Configuration.load(found)
    assert (again.similarityThreshold, again.glossary, again.root) == (70, c.glossary, str(tmp_path)) and "gen" in again.excluded() and ".git" in again.excluded()
    assert again.scanner_options().calls == ("Banner",) and again.glossary_rows(spark).count() == 1
    for bad in ('{"nope": 1}', '{"similarityThreshold": 40}', '{"ignoreSimilar": [["a"]]}', '{"glossary": {"a": {"de": ""}}}'):
        (tmp_path / payloads.NAME).write_text(bad)
        with pytest.raises(ValueError):
            payloads.Configuration.load(found)


def test_languages(spark):
    here = spark.createDataFrame([("c", "en"), ("c", "de"), ("d", "en")], "catalog string, language string")
    src = spark.createDataFrame([("c", "en"), ("d", "en")], "catalog string, source_language string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(languages.to_report(here, src)) == {("c", "de")} and rows(languages.to_report(here, src, ["all"], ["fr"])) == {("c", "en"), ("c", "de"), ("d", "en"), ("c", "fr"), ("d", "fr")}
    assert rows(languages.to_report(here, src, None, ["it"])) == {("c", "it"), ("d", "it")} and rows(languages.to_report(here, src, ["xx"], None, True)) == {("c", "xx"), ("d", "xx")}
    assert languages.to_write(here, ["de"]) == "de" and languages.closest(here.select("language"), "zz") is None
    for bad in ([], ["de", "en"], ["all"], ["zz"]):
        with pytest.raises(ValueError):
            languages.to_write(here, bad)
