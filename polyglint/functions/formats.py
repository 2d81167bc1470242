"""printf-style specifiers in localized text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# every token that starts with a percent sign; only the last alternative is a specifier
_FLAGS, _WIDTH, _LENGTH, _LETTER = r"['0#+-]*", r"\d*(?:[.]\d+)?", r"[hljLqtz]|hh|ll", "[@CDEFGOSUXcdefgiosux]"
TOKEN = rf"%(?:%|arg|#@[A-Za-z_]\w*@|(?:\d+[$])?{_FLAGS}{_WIDTH}(?:{_LENGTH})?{_LETTER})"
SPECIFIER = rf"^%(?:(\d+)[$])?{_FLAGS}{_WIDTH}({_LENGTH})?({_LETTER})$"
KINDS = {"object": "@", "integer": "dDiuUxXoO", "float": "fFeEgG", "character": "cC", "cstring": "sS"}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def raw_specifiers(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.rlike(SPECIFIER))


def conversion_class(raw: Column) -> Column:
    letter, out = F.right(raw, F.lit(1)), None
    for kind, letters in KINDS.items():
        hit = letter.isin(*letters)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(letter)


def position(raw: Column) -> Column:
    """The explicit argument number, null where there is none."""
    return F.when(F.regexp_extract(raw, SPECIFIER, 1) != "", F.regexp_extract(raw, SPECIFIER, 1)).cast("int")


def specifiers(text: Column) -> Column:
    """array<struct<raw, position, length, kind>> in order of appearance."""
    return F.transform(raw_specifiers(text), lambda t: F.struct(t.alias("raw"), position(t).alias("position"), F.regexp_extract(t, SPECIFIER, 2).alias("length"), conversion_class(t).alias("kind")))


def contains_specifier(text: Column) -> Column:
    return F.size(raw_specifiers(text)) > 0


def substitution_references(text: Column) -> Column:
    """Names in %#@name@, in order; %%#@name@ is no reference."""
    return F.transform(F.filter(tokens(text), lambda t: t.startswith("%#@")), lambda t: F.regexp_replace(t, "^%#@|@$", ""))


def expand(text: Column, declared: Column) -> Column:
    """Put % and the declared specifier in place of each %#@name@. declared: map<string, string>."""
    return F.aggregate(F.map_entries(F.coalesce(declared, F.create_map().cast("map<string,string>"))), text, lambda t, e: F.replace(t, F.concat(F.lit("%#@"), e["key"], F.lit("@")), F.concat(F.lit("%"), e["value"])))


def mismatch(source: Column, translation: Column) -> Column:
    """What is wrong with the translation's specifiers, null where nothing is.

    A text that refers to a substitution isn't judged. A translation with numbered specifiers is held
    against the source's arguments by number, else by order.
    """
    s, t = specifiers(source), specifiers(translation)
    n, m = F.size(s), F.size(t)

    def by_number(x: Column) -> Column:
        asked = F.try_element_at(s, F.greatest(F.lit(1), F.coalesce(x["position"], F.lit(1))))
        return (
            F.when(x["position"].isNull(), "numbered and unnumbered specifiers together")
            .when((x["position"] < 1) | (x["position"] > n), F.concat(F.lit("argument "), x["position"].cast("string"), F.lit(" of "), n.cast("string")))
            .when(asked["kind"] != x["kind"], F.concat(F.lit("argument "), x["position"].cast("string"), F.lit(": "), asked["raw"], F.lit(" became "), x["raw"]))
        )

    numbered = F.try_element_at(F.filter(F.transform(t, by_number), lambda p: p.isNotNull()), F.lit(1))
    zipped = F.zip_with(s, t, lambda a, b: F.when(a["kind"] != b["kind"], F.concat(a["raw"], F.lit(" became "), b["raw"])))
    ordered = F.try_element_at(F.filter(zipped, lambda p: p.isNotNull()), F.lit(1))
    return (
        F.when((n == 0) & (m == 0), None)
        .when((F.size(substitution_references(source)) > 0) | (F.size(substitution_references(translation)) > 0), None)
        .when(F.exists(t, lambda x: x["position"].isNotNull()), numbered)
        .when(n != m, F.concat(m.cast("string"), F.lit(" specifiers, the source has "), n.cast("string")))
        .otherwise(ordered)
    )


def drops_numbers(source: Column, translation: Column) -> Column:
    """The source numbers all of several specifiers and the translation, with several, leaves one unnumbered."""
    s, t = specifiers(source), specifiers(translation)
    return (F.size(s) > 1) & F.forall(s, lambda x: x["position"].isNotNull()) & (F.size(t) > 1) & F.exists(t, lambda x: x["position"].isNull())


def unordered(text: Column) -> Column:
    return F.size(F.filter(specifiers(text), lambda x: x["position"].isNull())) > 1
