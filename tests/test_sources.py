import json
import plistlib

import pytest
from pyspark.sql import functions as F

from polyglint.sources import catalogs, discovery, interchange, swift_scanner
from polyglint.sources.strict_json import Number, dumps, loads

def unit(value, state="translated"):
    return {"stringUnit": dict(state=state, value=value)}


def by(kind, **cases):
    return {"variations": {kind: cases}}


def key(**languages):
    return {"localizations": languages}


CATALOG = dict(
    version="1.0",
    sourceLanguage="en",
    strings={
        "Save": key(en=unit("Save"), de=unit("Sichern", "needs_review")),
        "%lld items": {"comment": "a count"} | key(
            en=by("plural", one=unit("%lld item"), other=unit("%lld items")),
            pl=by("device", iphone=by("plural", one=unit("x"), other=unit("")), other=unit("y", "new")),
        ),
        "posts": {"extractionState": "manual", "shouldTranslate": False} | key(en=unit("%#@count@ by %#@who@") | {"substitutions": {"unused": {}, "count": by("plural", other=unit("%arg posts")) | dict(formatSpecifier="lld", argNum=1)}}),
        "": {}, "a\n\t😀": key(fr={}),
    },
)


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"é":1,"e\\u0301":2}', '{"a":01}', '{"a":1.}', '{"a":+1}', '["\\ud800"]', '["a\nb"]', "[" * 300 + "]" * 300, '{"a":1} x', '{"a":1,}', "[1 2]", '"open', '["\\x"]', "nul"])
def test_strict_json_refuses(bad):
    with pytest.raises(ValueError):
        loads(bad)


def test_strict_json_reads():
    v = loads('﻿{"a": [1e3, -0.50, true, null, "\\ud83d\\ude00\\n"], "b": {}}'.encode("utf-8"))
    assert v == {"a": ["1e3", "-0.50", True, None, "😀\n"], "b": {}} and isinstance(v["a"][0], Number)
    with pytest.raises(ValueError, match="line 2, column 7"):
        loads('{"a": 1,\n "b": ?}')
    with pytest.raises(ValueError):
        loads(b'"\xff"')
    assert loads(dumps(v)) == v and loads(dumps(v, "compact")) == v
    assert dumps({"b": {}, "a": "x/y"}) == '{\n  "a" : "x\\/y",\n  "b" : {\n\n  }\n}'


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "App").mkdir()
    (root / "App/Localizable.xcstrings").write_text(json.dumps(CATALOG, ensure_ascii=False))
    (root / "App/Broken.xcstrings").write_text('{"strings": {"a": 1, "a": 2}}')
    (root / "App/NoStrings.xcstrings").write_text("{}")
    return root


def test_catalog_rows(spark, project):
    rows = catalogs.read_catalogs(spark, str(project)).cache()
    assert [tuple(r)[1:] for r in catalogs.catalogs(rows).collect()] == [("en", "1.0")]
    assert {m for _, m in map(tuple, catalogs.diagnostics(rows).collect())} == {"the key 'a' twice at line 1, column 22", "no object of strings"}
    units = {(r.key, r.language, r.scope, r.path): r.value for r in catalogs.units(rows).collect()}
    assert units["%lld items", "pl", "top", "device.iphone.plural.one"] == "x" and units["posts", "en", "sub", "plural.other"] == "%arg posts"
    assert len(units) == 9
    entries = {r.key: r for r in catalogs.entries(rows).collect()}
    assert set(entries) == set(CATALOG["strings"]) and entries["posts"].should_translate is False and entries[""].should_translate is True
    text = {(r.key, r.language): r.text for r in catalogs.display_text(catalogs.units(rows)).collect()}
    assert text["%lld items", "en"] == "%lld items" and text["%lld items", "pl"] == "" and text["Save", "de"] == "Sichern"
    problems = {(r.sub_name, r.problem) for r in catalogs.substitution_problems(catalogs.units(rows), catalogs.substitutions(rows)).collect()}
    assert problems == {("who", "not declared"), ("unused", "not referred to")}
    signature = {r.key: r.texts for r in catalogs.signature(catalogs.units(rows)).where("language = 'en'").collect()}
    assert signature["posts"]["substitutions.count.plural.other"] == "%arg posts"
    from polyglint.operators.coverage import plural_gaps

    gaps = {(r.key, r.language): r.missing for r in plural_gaps(catalogs.plural_slots(rows)).collect()}
    assert gaps["%lld items", "pl"] == ["device.iphone.plural.few", "device.iphone.plural.many", "device.iphone.plural.other (empty)"] and gaps["%lld items", "en"] == []


def test_catalog_write_keeps_the_rest(spark, project):
    rows = catalogs.read_catalogs(spark, str(project))
    path = catalogs.catalogs(rows).first().catalog
    plan = spark.createDataFrame([(path, "Save", "fr", "", "Sauver", "translated", "created"), (path, "%lld items", "de", "plural.one", "%lld Ding", "translated", "created"), (path, "Save", "de", "", "no", "translated", "refused: todo")], "catalog string, key string, language string, path string, value string, state string, action string")
    out = catalogs.save(spark, str(project), plan).collect()
    assert len(out) == 1
    written = loads(bytes(out[0].content))
    want = json.loads(json.dumps(CATALOG))
    want["strings"]["Save"]["localizations"]["fr"] = unit("Sauver")
    want["strings"]["%lld items"]["localizations"]["de"] = by("plural", one=unit("%lld Ding"))
    want["strings"]["posts"]["localizations"]["en"]["substitutions"]["count"]["argNum"] = "1"
    assert written == want


def test_catalog_writes_by_shape(spark, project, tmp_path):
    """A plan's file holds what the units hold: substitutions stay where they are, what a text replaces goes."""
    import shutil

    shutil.copytree(project, tmp_path / "p")
    root = str(tmp_path / "p")
    path = catalogs.catalogs(catalogs.read_catalogs(spark, root)).first().catalog
    rows = [("Save", "de", "device.mac", "Sichern!"), ("posts", "en", "substitutions.count.plural.one", "%arg post"), ("%lld items", "pl", "", "flat")]
    plan = spark.createDataFrame([(path, *r, "translated", "updated") for r in rows], "catalog string, key string, language string, path string, value string, state string, action string")
    edits = spark.createDataFrame([(path, "register", "New", "manual"), (path, "comment", "New", "why"), (path, "rename", "Save", "save.title"), (path, "remove", "", None)], "catalog string, action string, key string, value string")
    before = json.loads(json.dumps(CATALOG["strings"]))
    assert catalogs.store(catalogs.save(spark, root, plan.where("key <> 'Save'"), edits)) == 1
    after = catalogs.read_catalogs(spark, root)
    units = {(r.key, r.language, r.scope, r.path): r.value for r in catalogs.units(after).collect()}
    assert units["posts", "en", "sub", "plural.one"] == "%arg post" and units["posts", "en", "sub", "plural.other"] == "%arg posts"
    assert {k[3] for k in units if k[:2] == ("%lld items", "pl")} == {""} and units["%lld items", "pl", "top", ""] == "flat"
    assert units["save.title", "de", "top", ""] == "Sichern" and units["save.title", "en", "top", ""] == "Save"
    keys = {r.key: r for r in catalogs.entries(after).collect()}
    assert set(keys) == set(before) - {"Save", ""} | {"save.title", "New"} and keys["New"].comment == "why" and keys["New"].extraction_state == "manual"
    data = json.dumps({"sourceLanguage": "en", "version": "1.0", "strings": {"Save": before["Save"]}}).encode()
    device = loads(catalogs.merge_units(data, [dict(key="Save", language="de", path="device.mac", value="x", state=None)]))
    assert device["strings"]["Save"]["localizations"]["de"] == {"variations": {"device": {"mac": {"stringUnit": {"state": "translated", "value": "x"}}}}}
    with pytest.raises(ValueError):
        catalogs.merge_units(data, [dict(key="Save", language="de", path="substitutions.n.plural.one", value="x", state=None)])
    with pytest.raises(ValueError):
        catalogs.merge_units(data, [], [dict(action="rename", key="a", value="Save")])


def trans_unit(id, source, target="", note=""):
    return f"<trans-unit id='{id}'>\n<source>{source}</source>{target}{note}</trans-unit>"


UNITS = [
    trans_unit("Save", "Save", "<target state='translated'>Sichern</target>", "<note>n</note>"),
    trans_unit("Two", "Two &amp; more", "<target state-qualifier='leveraged-mt' state='final'> Zwei </target>"),
    trans_unit("None|==|plural.one", "x"),
]
XLIFF = "<?xml version='1.0'?>\n<xliff version='1.2'><file target-language='de' source-language='en' original='App/Localizable.xcstrings'>\n<body>" + "\n".join(UNITS) + "</body></file></xliff>"


def test_interchange(spark, tmp_path):
    folder = tmp_path / "de.xcloc/Localized Contents"
    folder.mkdir(parents=True)
    (folder / "de.xliff").write_text(XLIFF)
    (tmp_path / "de.xcloc/contents.json").write_text('{"targetLocale": "de-AT"}')
    (tmp_path / "bad.xliff").write_text(f"<xliff><file><body>{trans_unit('a', 'a <g>b</g>')}</body></file></xliff>")
    (tmp_path / "worse.xliff").write_text("<xliff><file>")
    rows = interchange.read_xliff(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.source, r.target, r.state, r.qualifier, r.line) for r in rows if r.id) == [("None|==|plural.one", "x", None, None, None, 7), ("Save", "Save", "Sichern", "translated", None, 3), ("Two", "Two & more", " Zwei ", "final", "leveraged-mt", 5)]
    assert sum("markup <g>" in (r.message or "") for r in rows) == 1 and sum(r.message is not None for r in rows) == 2
    bundle = interchange.read_bundles(spark, str(tmp_path)).collect()
    assert len(bundle) == 3 and {(r.language, r.said) for r in bundle} == {("de-AT", "de")}


def test_strings_plists_projects(spark, tmp_path):
    for lang, body in (("Base", '/* c */ "a" = "1"; // "no" = "x";\n"b\\n" = "2";\nbare = "3"; "alone";'), ("de", '"zz" = "1";')):
        (tmp_path / f"{lang}.lproj").mkdir()
        (tmp_path / f"{lang}.lproj/Menu.strings").write_bytes(body.encode("utf-16"))
    assert {tuple(r) for r in interchange.read_strings(spark, str(tmp_path)).collect()} == {("Menu", k) for k in ("a", "b\n", "bare", "alone")}
    (tmp_path / "Info.plist").write_bytes(plistlib.dumps({"NSCameraUsageDescription": "why", "CFBundleDisplayName": "$(NAME)", "Other": 3}))
    (tmp_path / "Broken.plist").write_text("nope")
    assert {(r.key, r.value) for r in interchange.read_plists(spark, str(tmp_path)).collect()} == {("NSCameraUsageDescription", "why"), ("CFBundleDisplayName", "$(NAME)")}
    lines = spark.createDataFrame([("p", 3, "developmentRegion = de;"), ("p", 1, "x"), ("p", 2, 'developmentRegion = "en-GB";'), ("p", 9, 'INFOPLIST_KEY_NSMicUsageDescription = "Say it";')], "file string, line int, value string")
    assert [tuple(r) for r in interchange.development_region(lines).collect()] == [("en-GB",)]
    assert [tuple(r)[2:] for r in interchange.project_settings(lines).collect()] == [("NSMicUsageDescription", "Say it")]
    assert interchange.development_region(lines.where("line = 1")).count() == 0


def test_discovery(spark):
    paths = ["App/Localizable.xcstrings", "App/en.lproj/InfoPlist.xcstrings", "Kit/Sub/T.xcstrings", "Root.xcstrings", "Pods/X.xcstrings", "de.xcloc/S/L.xcstrings", "App/a.swift", "Pods/b.swift", "c.swift", "Kit/x/d.swift", "gen/e.swift"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {(r.target, r.catalog, r.ord) for r in discovery.infer_targets(files).collect()} == {("App", paths[0], 1), ("App", paths[1], 2), ("Kit", paths[2], 1), ("root", paths[3], 1)}
    assert {r.directory for r in discovery.source_directories(files, globs=("gen/*",)).collect()} == {"App", "Kit"}


SWIFT = '''
import SwiftUI
// "comment" /* "x" */
struct Card { let title: LocalizedStringKey; let id: String; let sub: String
    init(_ title: LocalizedStringKey) { self.title = title }
    var body: some View { Text(LocalizedStringKey(sub)) } }
struct Plain { let title: String }
func tr(_ key: String) -> String { return NSLocalizedString(key, comment: "") }
let a = Text("Hello \\(name) 100%")
let b = Button("cancel") { print("debug me") }
let c = Text(verbatim: "As it is")
label.text = "Not localized"
let d = "Quit now".localized
let e = String(localized: "Keyed", table: "Menu", comment: "why")
let f = Card("First one")
let g = Card(sub: "Sub text")
let h = Plain(title: "An identifier")
let i = tr("Wrapped text")
let j = view.navigationTitle("Title here")
let k = Unknown(title: "Guessed title", systemImage: "star")
let l = logEvent(message: "Recorded text")
let m = Text("""
    Two
    lines
    """)
let n = Text(flag ? "Yes please" : #"No "thanks""#)
let o = Text("Skip me") // polyglint:ignore
let p = Text("a" + "Added part")
let q = Text("Value \\(String(localized: "Nested key"))")
button.setTitle("Set it")
#Preview { Text("Preview text") }
let r = Text("caf\\u{E9} au lait")
'''


def test_scanner(spark):
    files = spark.createDataFrame([("App/A.swift", SWIFT), ("App/B.swift", None), ("App/C.swift", "")], "path string, text string")
    lits, found = swift_scanner.literals(files), swift_scanner.discoveries(files)
    assert {tuple(r) for r in found.collect()} == {("type", "Card", None), ("type", "Plain", None), ("parameter", "title", "Card"), ("parameter", "sub", "Card"), ("initializer", "Card", None), ("function", "tr", None)}
    done = swift_scanner.classify(lits, found).cache()
    role = {r.value: (r.role, r.confidence) for r in done.collect()}
    assert role["As it is"][0] == "bypass" and role["Not localized"][0] == "bypass" and role["Set it"][0] == "bypass"
    assert role["debug me"][0] == "ignored" and role["star"][0] == "ignored" and role["An identifier"][0] == "ignored" and role["Recorded text"][0] == "ignored" and role["why"][0] == "ignored"
    got = {r.value: r for r in swift_scanner.found_strings(done).collect()}
    assert set(got) == {"Hello %@ 100%%", "cancel", "Quit now", "Keyed", "First one", "Sub text", "Wrapped text", "Title here", "Guessed title", "Two\nlines", "Yes please", 'No "thanks"', "Value %@", "café au lait"}
    assert got["Keyed"].table_name == "Menu" and got["cancel"].table_name == "Localizable"
    assert got["Hello %@ 100%%"].is_format_key and got["Hello %@ 100%%"].head == "Hello "
    keys = spark.createDataFrame([("Hello %@ 100%%",), ("Hello %1$@ 100%%",), ("Hello x",), ("Value %@",)], "key string")
    from polyglint.operators.resolve import resolve_patterns

    patterns = swift_scanner.found_strings(done).where("is_format_key").select(F.col("format_pattern").alias("pattern"), "head")
    assert {r.key for r in resolve_patterns(patterns, keys).collect()} == {"Hello %1$@ 100%%", "Value %@"}
    assert {r.value for r in swift_scanner.bypasses(done).collect()} == {"As it is", "Not localized", "Set it"}
    line = {r.value: r.line for r in done.collect()}
    assert line["cancel"] == 10 and line["Skip me"] == 27
    data = SWIFT.encode()
    spans = {r.value: (r.start, r.stop) for r in done.collect()}
    assert data[slice(*spans["café au lait"])].decode() == '"caf\\u{E9} au lait"'


def test_line_breaks_of_all_kinds(spark):
    files = spark.createDataFrame([("a", 'let a = 1\r\nlet b = Text("One two")\r\n')], "path string, text string")
    assert [r.line for r in swift_scanner.literals(files).collect()] == [2]
