import pytest
from pyspark.sql import functions as F

from polyglint.operators import baseline, consistency, coverage, diff, membership, resolve, writes
from polyglint.plans import render
from polyglint.sources.strict_json import dumps
from test_sources import key, unit

UNITS = "catalog string, key string, language string, path string, value string, state string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coverage_counts(spark):
    u = spark.createDataFrame([("c", "Save", "en", "", "Save", "new"), ("c", "Save", "de", "", "Sichern", "translated"), ("c", "Open", "de", "", "", "translated"), ("c", "Undo", "de", "", "Zurück", "new"), ("c", "Copy", "de", "", "Kopie", "needs_review"), ("c", "Cut", "de", "", "x", "odd")], UNITS)
    keys = spark.createDataFrame([("c", k) for k in ("Save", "Open", "Undo", "Copy", "Cut", "Gone")], "catalog string, key string")
    gaps = spark.createDataFrame([("c", "Gone", "de", ["plural.few"])], "catalog string, key string, language string, missing array<string>")
    src = spark.createDataFrame([("c", "en")], "catalog string, source_language string")
    langs = spark.createDataFrame([("c", "en"), ("c", "de")], "catalog string, language string")
    got = {r.language: r for r in coverage.coverage(keys, langs, coverage.status(u, gaps), src).collect()}
    # new counts as missing and as awaiting review; incomplete plurals are neither missing nor translated
    assert (got["de"].translatable, got["de"].translated, got["de"].missing, got["de"].empty, got["de"].needs_review, got["de"].percent) == (6, 2, 2, 1, 3, 33)
    assert (got["en"].translated, got["en"].percent) == (6, 100)
    assert rows(coverage.identical_to_source(spark.createDataFrame([("c", "Name", "en", "", "Name", ""), ("c", "Name", "de", "", "Name", ""), ("c", "OK", "en", "", "OK", ""), ("c", "OK", "de", "", "OK", "")], UNITS), src)) == [("c", "Name", "de")]


def test_partition_and_plurals(spark):
    e = spark.createDataFrame([("c", "a b", "stale", True), ("c", "x y", None, False), ("c", "%@", None, None), ("c", "Hi all", None, None)], "catalog string, key string, extraction_state string, should_translate boolean")
    assert {r.key: r["class"] for r in coverage.key_partition(e).collect()} == {"a b": "stale", "x y": "do-not-translate", "%@": "untranslatable", "Hi all": "translatable"}
    src = spark.createDataFrame([("c", "pl")], "catalog string, source_language string")
    g = spark.createDataFrame([("c", "k", "pl", ["plural.many"]), ("c", "k", "ru", ["plural.few", "plural.many"]), ("c", "k", "uk", ["plural.many"])], "catalog string, key string, language string, missing array<string>")
    assert rows(coverage.new_gaps(g, src)) == [("c", "k", "ru", ["plural.few"])]
    u = spark.createDataFrame([("c", "k", "pl", "plural.one", "x", ""), ("c", "k", "de", "", "y", ""), ("c", "k", "ja", "", "z", "")], UNITS)
    assert rows(coverage.flat_where_plural(u, src)) == [("c", "k", "de")]


def test_ignored_pairs(spark):
    t = spark.createDataFrame([("c", "a", "Same text"), ("c", "b", "Same text "), ("c", "d", "Same text"), ("c", "e", "Other"), ("c", "f", "Other")], "catalog string, key string, text string")
    ignored = spark.createDataFrame([("c", "e", "f"), ("c", "a", "b")], "catalog string, a string, b string")
    assert rows(consistency.duplicate_sources(t, ignored)) == [("c", "Same text", 3)]


@pytest.mark.parametrize("threshold", [60, 75, 85, 95])
def test_near_duplicates_against_all_pairs(spark, threshold):
    import random

    rng = random.Random(threshold)
    base = ["Open the settings page", "Delete this message", "Share with friends", "Turn notifications off", "Synchronise everything now"]
    texts = set(base)
    for b in base:
        for _ in range(14):
            s = list(b)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "xq", "t"])
            texts.add("".join(s))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def half_up(x):
        return int(x + 0.5)

    def unrelated(a, b):
        x, y = a.lower().split(), b.lower().split()
        d = [(p, q) for p, q in zip(x, y) if p != q]
        return len(x) == len(y) > 1 and len(d) == 1 and half_up((max(map(len, d[0])) - distance(*d[0])) * 100 / max(map(len, d[0]))) < 60

    want = {}
    ordered = sorted(texts, key=lambda t: (len(t), t))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if len(b) <= len(a) * 100 // threshold and a.strip() != b.strip() and not unrelated(a, b):
                d = distance(a.lower(), b.lower())
                p = half_up((len(b) - d) * 100 / len(b))
                if d <= half_up(len(b) * (100 - threshold) / 100) and p >= threshold:
                    want[a, b] = p
    frame = spark.createDataFrame([(t, t) for t in texts], "key string, text string")
    assert {(r.a, r.b): r.percent for r in consistency.near_duplicates(frame, threshold).collect()} == want and want


def test_glossary(spark):
    g = spark.createDataFrame([("Loop", "de", "Schleife"), ("Loop", "*", "Loop"), ("温泉", "en", "hot spring"), ("Loop", "de-AT", "Runde")], "term string, language string, rendering string")
    p = spark.createDataFrame([("1", "de", "A Loop here", "Eine Runde"), ("2", "de-AT", "A Loop here", "Eine Runde"), ("3", "fr", "Looping", "x"), ("4", "fr", "my LOOP", "ma boucle"), ("5", "en", "新しい温泉だ", "new spa"), ("6", "de-CH", "Loop", "Schleife"), ("7", "de", "Loop", "")], "key string, language string, source string, translation string")
    assert rows(consistency.glossary_violations(p, g)) == [("1", "de", "Loop", "Schleife"), ("4", "fr", "Loop", "Loop"), ("5", "en", "温泉", "hot spring")]


def test_diff(spark):
    s = "key string, language string, path string, value string"
    a = spark.createDataFrame([("k", "en", "", "Old"), ("k", "be", "", "st"), ("k", "de", "", "alt"), ("k", "fr", "", "vieux"), ("gone", "en", "", "x"), ("p", "en", "device.mac", "Mac"), ("p", "en", "device.other", "Other")], s)
    b = spark.createDataFrame([("k", "en", "", "New"), ("k", "be", "", "st"), ("k", "de", "", "neu"), ("k", "fr", "", "vieux"), ("new", "en", "", "y"), ("p", "en", "device.mac", "Desktop"), ("p", "en", "device.other", "Other")], s)
    assert rows(diff.key_changes(a, b)) == [("gone", "removed"), ("new", "added")]
    assert rows(diff.source_changes(a, b, "en")) == [("k", "", "Old", "New"), ("p", "device.mac", "Mac", "Desktop")]
    reviewed = spark.createDataFrame([("k", "fr")], "key string, language string")
    assert rows(diff.translations_of_changes(a, b, "en", reviewed)) == [("k", "be", "stale"), ("k", "de", "updated")]


def test_baseline(spark):
    s = "rule string, file string, key string, language string, line int, level string, message string"
    f = spark.createDataFrame([("r", "f", "k", None, 1, "error", "m"), ("r", "f", "k", None, 9, "warning", "other"), ("r", "f", "new", "de", 1, "error", "m")], s)
    b = spark.createDataFrame([("r", "f", "k", None), ("r", None, "old", None)], "rule string, file string, key string, language string")
    assert baseline.suppressed(f, b).count() == 2 and rows(baseline.reported(f, b).select("key")) == [("new",)] and rows(baseline.stale(f, b)) == [("r", "", "old", "")]
    assert tuple(baseline.severity(f).first()) == (2, 1) and baseline.entries(f).count() == 2


def test_resolution(spark):
    tc = spark.createDataFrame([("App", 1, "a"), ("App", 2, "b"), ("Kit", 1, "c")], "target string, ord int, catalog string")
    targets = spark.createDataFrame([("App", False), ("Kit", True)], "target string, inferred boolean")
    tables = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T")], "catalog string, table_name string")
    keys = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("a", "z")], "catalog string, key string")
    found = spark.createDataFrame([("App", "T", "x"), ("App", "T", "y"), ("Kit", "T", "z"), ("Kit", "T", "none")], "target string, table_name string, value string")
    got = {(r.target, r.value): r.catalog for r in resolve.resolve(found, resolve.reachable(tc, targets, tables), keys).collect()}
    assert got == {("App", "x"): "a", ("App", "y"): None, ("Kit", "z"): "a", ("Kit", "none"): None}


def test_orphans_and_lines(spark):
    keys = spark.createDataFrame([(1, "short"), (2, "two words here"), (3, "not anywhere in it"), (4, "x"), (5, "nope")], "id int, key string")
    texts = spark.createDataFrame([("a two words here b",), ("cutshorter x",)], "text string")
    assert {r.id for r in resolve.orphans(keys, texts).collect()} == {3, 5}
    files = spark.createDataFrame([("f", 'a\r\n    "k" : {\n    "j" : {\r    "k" : {')], "file string, text string")
    index = resolve.line_index(files, r'^    "(.*)" : \{')
    assert rows(index) == [("f", "j", 3), ("f", "k", 2)]
    findings = spark.createDataFrame([("f", "k", None), ("f", "z", None), ("f", "j", 9)], "file string, key string, line int")
    assert {r.key: r.line for r in resolve.locate(findings, index).collect()} == {"k": 2, "z": None, "j": 9}
    occ = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, "a")], "file string, line int, value string")
    lit = spark.createDataFrame([("f", 1, "a", 5, 8), ("f", 2, "a", 1, 4), ("f", 2, "a", 6, 9)], "file string, line int, value string, start int, stop int")
    assert {r.line: (r.start, r.skipped) for r in resolve.rename_sites(occ, lit).collect()} == {1: (5, None), 2: (None, "ambiguous"), 3: (None, "missing")}
    spliced = writes.splice(spark.createDataFrame([("f", 'é "a" and "a"')], "file string, text string"), spark.createDataFrame([("f", 3, 6, '"bb"'), ("f", 11, 14, '"c"')], "file string, start int, stop int, replacement string"))
    assert spliced.first().text == 'é "bb" and "c"'


def test_membership(spark):
    d = spark.createDataFrame([("App", "CFBundleDisplayName", "My"), ("App", "NSCameraUsageDescription", "why"), ("App", "Other", "x"), ("Kit", "NSAUsageDescription", "a"), *[("Kit", f"NS{c}UsageDescription", "v") for c in "BCDEF"], ("Kit", "NSZUsageDescription", "$(Z)")], "target string, key string, value string")
    p = spark.createDataFrame([("App", "CFBundleDisplayName")], "target string, key string")
    assert {r.target: r.detail for r in membership.plist_not_localized(d, p).collect()} == {"App": "NSCameraUsageDescription", "Kit": "NSAUsageDescription, NSBUsageDescription, NSCUsageDescription, NSDUsageDescription and 2 more"}
    c = spark.createDataFrame([("a", "en"), ("b", "en-GB"), ("c", "de")], "catalog string, source_language string")
    assert [r.catalog for r in membership.region_mismatch(c, spark.createDataFrame([("en-US",)], "region string")).collect()] == ["c"]
    b = spark.createDataFrame([("x", "de", "de"), ("y", "de", "fr"), ("z", "de", None)], "bundle string, expected string, declared string")
    assert [r.bundle for r in membership.bundle_languages(b).collect()] == ["y"]


def test_guarded_writes(spark):
    u = spark.createDataFrame([("c", "Save", "de", "", "Sichern", "translated"), ("c", "n", "de", "plural.one", "eins", "translated"), ("c", "n", "de", "plural.other", "x", "translated")], UNITS)
    keys = spark.createDataFrame([("c", "Save"), ("c", "n"), ("c", "new")], "catalog string, key string")
    e = spark.createDataFrame([("c", "Save", "de", "", "Speichern"), ("c", "save", "de", "", "x"), ("c", "n", "de", "", "flat"), ("c", "Save", "fr", "", "Sauver"), ("c", "new", "de", "", "TODO"), ("c", "Zed", "de", "", "a"), ("c", "zed", "de", "", "b"), ("c", "Save", "es", "plural.one", "u")], "catalog string, key string, language string, path string, value string")
    plan = writes.plan_add(e, u, keys).cache()
    got = {(r.key, r.language, r.path): r.action for r in plan.collect()}
    assert got == {("Save", "de", ""): "updated", ("save", "de", ""): "refused: case-conflict", ("n", "de", ""): "refused: has-variations", ("Save", "fr", ""): "created", ("new", "de", ""): "refused: todo", ("Zed", "de", ""): "created", ("zed", "de", ""): "refused: case-conflict", ("Save", "es", "plural.one"): "created"}
    after = {(r.key, r.language, r.path): r.value for r in writes.apply_plan(u, plan).collect()}
    assert after["Save", "de", ""] == "Speichern" and after["n", "de", "plural.other"] == "x" and ("zed", "de", "") not in after
    flat = writes.plan_add(e.where("key = 'n'"), u, keys, flatten=True)
    assert {(r.key, r.path): r.value for r in writes.apply_plan(u, flat).collect()} == {("Save", ""): "Sichern", ("n", ""): "flat"}
    subs = spark.createDataFrame([("c", "n", "fr", "count")], "catalog string, key string, language string, sub_name string")
    e = spark.createDataFrame([("c", "Save", "de", "device.mac", "M"), ("c", "n", "fr", "substitutions.count.plural.one", "u"), ("c", "new", "fr", "substitutions.count.plural.one", "u"), ("c", "n", "fr", "", "x")], "catalog string, key string, language string, path string, value string")
    more = writes.plan_add(e.where("path <> ''"), u, keys, subs)
    assert {(r.key, r.path): r.action for r in more.collect()} == {("Save", "device.mac"): "created", ("n", "substitutions.count.plural.one"): "created", ("new", "substitutions.count.plural.one"): "refused: no-substitution"}
    assert {r.path: r.value for r in writes.apply_plan(u, more).where("key = 'Save'").collect()} == {"device.mac": "M"}
    assert writes.plan_add(e.where("path = ''"), u, keys, subs).first().action == "refused: has-substitutions"
    src = spark.createDataFrame([("c", "en")], "catalog string, source_language string")
    renamed = {(r.key, r.language): r.value for r in writes.rename(u, "Save", "Store", src).collect()}
    assert renamed["Store", "en"] == "Save" and renamed["Store", "de"] == "Sichern" and ("Save", "de") not in renamed
    with pytest.raises(ValueError):
        writes.rename(u, "Save", "N", src)
    k = spark.createDataFrame([("c", str(i)) for i in range(10)], "catalog string, key string")
    assert writes.prune(k, k.limit(2)).count() == 8 and writes.prune(k, k.limit(3)).count() == 10


def test_rendering(spark):
    s = "rule string, level string, message string, file string, line int, key string, language string"
    f = spark.createDataFrame([("orphaned-key", "warning", "no, use: 5%\n", "a b/c,d.swift", 3, "k", None), ("odd", "error", "m", "/abs/x", None, None, None), ("odd", "error", "n", None, 0, "q", "de")], s)
    assert [r.value for r in render.annotations(f).collect()][0] == "::warning file=a b/c%2Cd.swift,line=3,title=orphaned-key::no, use: 5%25%0A"
    from polyglint.sources.strict_json import loads

    doc = loads(render.sarif(f))["runs"][0]
    assert [r["id"] for r in doc["tool"]["driver"]["rules"]] == ["odd", "orphaned-key"]
    at = {r["message"]["text"]: r.get("locations", [{}])[0].get("physicalLocation") for r in doc["results"]}
    assert at["n"] is None and at["m"]["artifactLocation"] == {"uri": "file:///abs/x"} and at["no, use: 5%\n"] == dict(region={"startLine": "3"}, artifactLocation=dict(uriBaseId="%SRCROOT%", uri="a%20b/c%2Cd.swift"))
    assert "... and 1 more" in render.text_report(f, 1) and '"failures":2' in render.report_json(f).first().value
    assert render.RunResult(0, 2).exit_code() == 0 and render.RunResult(0, 2).exit_code(True) == 1 and render.RunResult(0, 0, 1).exit_code() == 2
    assert render.rules(spark).count() == len(render.RULES)
    o = spark.createDataFrame([("c", "k", "pl", True), ("c", "j", "pl", False)], "catalog string, key string, language string, plural boolean")
    t = spark.createDataFrame([("c", "k", "Text", "why")], "catalog string, key string, text string, comment string")
    made = loads(render.templates(o, t).first().value)
    assert made["language"] == "pl" and loads(made["strings"][1]["plural"]) == {c: "TODO" for c in ("one", "few", "many", "other")}


def test_stream(spark, tmp_path):
    from polyglint.sources import catalogs
    from polyglint.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.xcstrings").write_text(dumps({"strings": {"k": key(de=unit("v", "new"))}}))
    go = lambda: watch.watch(spark, str(tmp_path / "in"), catalogs.units, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert go()
    (tmp_path / "in/B.xcstrings").write_text(dumps({"strings": {"j": key(fr=unit("w"))}}))
    assert go()
    assert {r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"k", "j"}
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("key").isNull()).count() == 0
