"""Scalar rules on keys and texts, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import TOKEN
from .plural import ORDER

# scripts that put no space between words
_UNSEGMENTED = r"\x{AC00}-\x{D7FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}\x{E00}-\x{EFF}\x{F00}-\x{FFF}\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}\x{1780}-\x{17FF}"
WORD = rf"[\p{{L}}\p{{N}}&&[^{_UNSEGMENTED}]]"
_TRIM = r"^(?U)\s+|(?U)\s+$"


def graphemes(text: Column) -> Column:
    """Length in grapheme clusters, what a reader counts as characters."""
    return F.regexp_count(text, F.lit(r"\X"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def is_translatable(text: Column) -> Column:
    """Has a letter beside its specifiers; one or two characters must begin with one."""
    bare, letter = trimmed(text), r"[\p{L}\p{M}]"
    short = (graphemes(bare) <= 2) & ~bare.rlike(r"^\p{L}")
    return F.coalesce((bare != "") & ~short & F.regexp_replace(bare, f"(?!%%|%arg){TOKEN}", "").rlike(letter), F.lit(False))


def is_interface_builder_key(key: Column) -> Column:
    return key.rlike(r"^[\p{L}\p{N}]{3}-[\p{L}\p{N}]{2}-[\p{L}\p{N}]{3}\.(?s:.)+")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_sentence(key: Column) -> Column:
    """A key that is prose: five words or more."""
    return F.size(words(key)) >= 5


def is_user_facing_plist_key(key: Column) -> Column:
    return key.endswith("UsageDescription") | (key == "CFBundleDisplayName")


def is_build_setting(value: Column) -> Column:
    return value.startswith("$(") | value.startswith("${")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 100 where there is nothing to count."""
    return F.when(whole == 0, 100).otherwise(F.round(100.0 * part / whole).cast("int"))


def folded(text: Column) -> Column:
    """For equality of source texts: trimmed, no-break spaces plain, apostrophes straight."""
    return F.translate(trimmed(text), "\u00a0\u202f\u2019\u2018", "  ''")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\u0001", F.least(a, b), F.greatest(a, b))


def differ_only_in_digits(a: Column, b: Column) -> Column:
    return (a != b) & (F.regexp_replace(a, r"\p{N}", "") == F.regexp_replace(b, r"\p{N}", ""))


def similarity(a: Column, b: Column) -> Column:
    """Whole percent of the longer text that needs no edit."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 100).otherwise(F.round((longest - F.levenshtein(a, b)) * 100.0 / longest).cast("int"))


def distance_limit(longest: Column, threshold: Column | int) -> Column:
    return F.round(longest * (100 - threshold) / 100.0).cast("int")


def differ_by_one_unrelated_word(a: Column, b: Column) -> Column:
    """Equal but for one word, and the two words are less than 60 % alike."""
    x, y = (F.filter(F.split(F.lower(t), " "), lambda w: w != "") for t in (a, b))
    differing = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: ~z["p"].eqNullSafe(z["q"]))
    one = F.try_element_at(differing, F.lit(1))
    return (F.size(x) == F.size(y)) & (F.size(x) > 1) & (F.size(differing) == 1) & (similarity(one["p"], one["q"]) < 60)


def term_pattern(term: Column) -> Column:
    """A regular expression that finds the term, lower-cased, where it isn't inside a word."""
    quoted = F.regexp_replace(F.lower(term), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit(f"(?<!{WORD})"), quoted, F.lit(f"(?!{WORD})"))


def contains_term(text: Column, term: Column) -> Column:
    """Case-insensitive, bounded by words in scripts that have bounds."""
    return F.contains(F.lower(text), F.lower(term)) & F.call_function("rlike", F.lower(text), term_pattern(term))


def catalog_kind(path: Column) -> Column:
    """localizable, info-plist, app-shortcuts or table, from the file's name."""
    stem = catalog_table(path)
    return F.when(stem == "Localizable", "localizable").when(stem == "InfoPlist", "info-plist").when(stem == "AppShortcuts", "app-shortcuts").otherwise("table")


def catalog_table(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.xcstrings)?$", 1)


def xliff_table(original: Column) -> Column:
    return F.regexp_replace(F.substring_index(original, "/", -1), r"\.(strings|stringsdict|xcstrings)$", "")


def catalog_state(state: Column, qualifier: Column) -> Column:
    """An interchange state as a catalog's. Machine output needs review whatever its state; no state means translated; an unknown one needs review."""
    return (
        F.when(F.coalesce(qualifier.contains("mt"), F.lit(False)), "needs_review")
        .when(state.isNull() | state.isin("final", "signed-off", "translated"), "translated")
        .when(state.isin("needs-translation", "new"), "new")
        .otherwise("needs_review")
    )


def unit_key(unit_id: Column) -> Column:
    """The catalog key of an interchange unit's id: what stands before its |==| part."""
    return F.substring_index(unit_id, "|==|", 1)


def unit_config(unit_id: Column) -> Column:
    """struct<kind, name, category> from what follows |==|; kind: simple, plural, device, substitution or unsupported."""
    p = F.filter(F.split(F.regexp_extract(unit_id, r"(?s)^.*?\|==\|(.*)$", 1), r"\."), lambda x: x != "")
    at = lambda k: F.try_element_at(p, F.lit(k))
    count = lambda x: F.coalesce(x.isin(*ORDER), F.lit(False))
    none = F.lit(None).cast("string")
    made = lambda kind, name=none, category=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), category.alias("category"))
    n = F.size(p)
    return (
        F.when(~unit_id.contains("|==|"), made("simple"))
        .when((n == 2) & (at(1) == "plural") & count(at(2)), made("plural", none, at(2)))
        .when((n == 2) & (at(1) == "device"), made("device", at(2)))
        .when((n == 3) & (at(2) == "plural") & count(at(3)), made("substitution", at(1), at(3)))
        .when((n == 4) & (at(1) == "substitutions") & (at(3) == "plural") & count(at(4)), made("substitution", at(2), at(4)))
        .otherwise(made("unsupported"))
    )
