import pytest
from pyspark.sql import functions as F

from polyglint.functions import formats, hygiene, plural, text

NBSP = "\u00a0"


def one(spark, expr, **values):
    frame = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return frame.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "source,translation,language,rules",
    [
        ("Server:", "Server", "de", {"end-punctuation"}), ("Saved.", "保存しました。", "ja", set()), ("Delete?", "Διαγραφή;", "el", set()), ("Loading…", "Wird geladen...", "de", set()),
        ("Save", "Speichern.", "de", set()), ("One\nTwo\nThree", "Eins\nZwei Drei", "de", {"newline-count"}), ("Block", "Bac​", "ga", {"invisible-character"}), ("Name", "‮abc", "ar", {"bidi-control"}),
        ("Name", "‫abc", "ar", {"bidi-control"}), ("Name", "‫abc‬", "ar", set()), ("Caf", "Caf�", "de", {"replacement-character"}), ("Delete?", "Supprimer ?", "fr", {"punctuation-spacing"}),
        ("Delete?", f"Supprimer{NBSP}?", "fr", set()), ("Delete?", "Supprimer ?", "fr-CA", set()), ("12:30", "12:30", "fr", set()), ("Always", "luôn luôn", "vi", set()),
        ("Open the file", "Öffne die die Datei", "de", {"doubled-word"}), ("Detail Detail", "Detail detail", "cs", set()), ("No updates available.", "-", "ar", {"placeholder-translation"}), ("—", "—", "de", set()),
        ("Read [this page](https://example.org/a) now", "Ver", "es", {"markdown"}), ("**Bold** text", "**Fett text", "de", {"markdown"}), ("a *b* c", "a *b c", "de", {"markdown"}), ("", "x", "de", set()), ("x", None, "de", set()),
        (" Edge", "Kante", "de", {"edge-whitespace"}), ("One two", "Eins  zwei", "de", {"double-space"}), ("^[x](inflect: true)", "y", "es", {"inflection-dropped"}), ("%1$@ of %2$@", "%@ von %@", "de", {"dropped-specifier-position"}),
        ("Line\r\nbreak", "Zeile\r\nUmbruch", "de", set()), ("He had had it", "er hatte hatte es", "de", {"doubled-word"}),
    ],
)
def test_hygiene(spark, source, translation, language, rules):
    assert set(one(spark, hygiene.rules(F.col("s"), F.col("t"), F.col("l")), s=source, t=translation, l=language)) == rules


def test_source_rules(spark):
    assert one(spark, hygiene.source_rules(F.col("s")), s="%@ and %lld...") == ["ellipsis-style", "unordered-specifiers"]
    assert one(spark, hygiene.source_rules(F.col("s")), s="%1$@ and %2$lld…") == []


@pytest.mark.parametrize("conversion,kind", [("@", "object"), *[(c, "integer") for c in "dDiuUxXoO"], *[(c, "float") for c in "fFeEgG"], ("c", "character"), ("S", "cstring")])
def test_conversions(spark, conversion, kind):
    assert [r.kind for r in one(spark, formats.specifiers(F.col("t")), t=f"a %{conversion} b")] == [kind]


@pytest.mark.parametrize("t,n", [("%ld %hhd %lld %qd %zd %jd %Lf", 7), ("%-5d %+d %05d %'d %#x %.2f %10.3f", 7), ("%p %a %A %n", 0), ("50% of it", 0), ("100% done", 0), ("%%d %arg %#@x@", 0), ("%1$@ %2$lld", 2)])
def test_specifiers(spark, t, n):
    assert len(one(spark, formats.raw_specifiers(F.col("t")), t=t)) == n


@pytest.mark.parametrize(
    "source,translation,bad",
    [("%lld by %@", "%2$@ — %1$lld", False), ("%lld by %@", "%2$lld — %1$@", True), ("%lf°", "%f度", False), ("%lf°", "%lld度", True), ("%lld followers", "%#@followers@", False), ("none", "none", False),
     ("%@", "", True), ("%@ %@", "%1$@ %@", True), ("%@", "%2$@", True), ("%d", "%u", False)],
)
def test_mismatch(spark, source, translation, bad):
    assert (one(spark, formats.mismatch(F.col("s"), F.col("t")), s=source, t=translation) is not None) is bad


def test_expansion_and_references(spark):
    assert one(spark, formats.substitution_references(F.col("t")), t="%#@a@ %%#@b@ %#@c_1@") == ["a", "c_1"]
    assert one(spark, formats.expand(F.col("t"), F.create_map(F.lit("a"), F.lit("lld"))), t="%#@a@ x %#@b@") == "%lld x %#@b@"


@pytest.mark.parametrize("code,base,required", [("ja", "ja", ["other"]), ("en-US", "en", ["one", "other"]), ("pt_BR", "pt", ["one", "other"]), ("ars", "ars", list(plural.ORDER)), ("PL", "pl", "one few many other".split()), ("qq", "qq", ["other"]), ("-fr", "fr", ["one", "other"]), ("cs", "cs", ["one", "few", "other"])])
def test_plurals(spark, code, base, required):
    assert one(spark, plural.base_language(F.col("c")), c=code) == base
    assert one(spark, plural.required_categories(F.col("c")), c=code) == required
    assert one(spark, plural.is_known_language(F.col("c")), c=code) is (code != "qq")


def test_plural_table(spark):
    rows = {r.base_language: r for r in plural.plural_rules(spark).collect()}
    assert len(rows) > 150 and rows["fr"].optional == ["many"] and all("other" in r.required for r in rows.values())
    assert one(spark, plural.is_exact_count(F.col("p")), p="device.iphone.plural.two") and not one(spark, plural.is_exact_count(F.col("p")), p="plural.other")


@pytest.mark.parametrize("t,ok", [("Save", True), ("%@", False), ("%lld/%lld", False), ("—", False), ("12", False), ("", False), ("OK", True), ("%lld items", True), ("%#@count@", False), ("é", True), ("1a", False), ("100% a", True)])
def test_translatable(spark, t, ok):
    assert one(spark, text.is_translatable(F.col("t")), t=t) is ok


def test_text_rules(spark):
    c = F.col
    assert one(spark, text.folded(c("t")), t=f" Don’t{NBSP}stop ") == "Don't stop"
    assert one(spark, text.is_interface_builder_key(c("t")), t="3aJ-8X-AqP.title") and not one(spark, text.is_interface_builder_key(c("t")), t="3aJ-8X.title")
    assert one(spark, text.is_sentence(c("t")), t="one two three four five") and not one(spark, text.is_sentence(c("t")), t="one two three four")
    assert one(spark, text.differ_only_in_digits(c("a"), c("b")), a="Step 1", b="Step 12")
    assert one(spark, text.differ_by_one_unrelated_word(c("a"), c("b")), a="Max Temperature", b="Min Temperature") and not one(spark, text.differ_by_one_unrelated_word(c("a"), c("b")), a="Open colour", b="Open color")
    assert one(spark, text.graphemes(c("t")), t="👩‍👩‍👧 é") == 3
    for term, t, hit in (("loop", "Looping", False), ("loop", "a Loop.", True), ("温泉", "新しい温泉セッション", True), ("Furolog", "Furologを開く", True), ("c++", "use C++ now", True)):
        assert one(spark, text.contains_term(c("t"), c("w")), t=t, w=term) is hit, term
    assert one(spark, text.catalog_kind(c("p")), p="a/b/InfoPlist.xcstrings") == "info-plist" and one(spark, text.catalog_table(c("p")), p="a/Menu.xcstrings") == "Menu"


@pytest.mark.parametrize("state,qualifier,want", [("translated", None, "translated"), (None, None, "translated"), ("final", "leveraged-mt", "needs_review"), ("needs-l10n", None, "needs_review"), ("new", None, "new"), ("needs-translation", None, "new"), ("odd", None, "needs_review")])
def test_states(spark, state, qualifier, want):
    assert one(spark, text.catalog_state(F.col("s"), F.col("q")), s=state, q=qualifier) == want


@pytest.mark.parametrize("unit,key,want", [("Save", "Save", ("simple", None, None)), ("%lld items|==|plural.one", "%lld items", ("plural", None, "one")), ("K|==|device.mac", "K", ("device", "mac", None)), ("K|==|substitutions.n.plural.few", "K", ("substitution", "n", "few")), ("K|==|n.plural.few", "K", ("substitution", "n", "few")), ("K|==|plural.lots", "K", ("unsupported", None, None)), ("a\nb|==|plural.two", "a\nb", ("plural", None, "two"))])
def test_unit_ids(spark, unit, key, want):
    assert one(spark, text.unit_key(F.col("i")), i=unit) == key and tuple(one(spark, text.unit_config(F.col("i")), i=unit)) == want
