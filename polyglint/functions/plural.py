"""CLDR plural categories by base language, as a small dimension table and as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = tuple("zero one two few many other".split())
# categories that integers need -> languages; letters: z o t f m x, capitals mark the optional ones
_SPELLED = dict(zip("zotfmx", ORDER))
_BY_SHAPE = {
    "x": "bo dz id ig ii ja jv kde kea km ko lkt lo ms my nqo sah ses sg su th to vi wo yo yue za zh",
    "ox": "af am an as az bg bn brx ca ceb chr ckb da de ee el en eo es et eu fa fi fil fo gl gsw gu ha haw hi hu hy is it ka kab kk kmr kn kok ku ky lb mas mk ml mn mr nb nd ne nl nn no nr nso ny oc om or os pa pap ps rm rof rwk saq sd seh si sn so sq ss ssy st sv sw syr ta te teo tig tk tl tn tr ts tzm ur uz ve vo vun wae xh xog yi zu",
    "oMx": "fr pt",
    "ofmx": "be pl ru uk",
    "ofMx": "cs lt sk",
    "ofx": "bs hr mo ro sh shi sr",
    "zox": "ksh lag lv",
    "otfx": "dsb gd hsb sl",
    "otMx": "he iw",
    "zotfmx": "ar ars cy kw",
    "otfmx": "br ga gv mt",
    "otx": "naq se sma smj smn sms",
}
REQUIRED = {lang: tuple(_SPELLED[c] for c in shape if c.islower()) for shape, langs in _BY_SHAPE.items() for lang in langs.split()}
OPTIONAL = {lang: tuple(_SPELLED[c.lower()] for c in shape if c.isupper()) for shape, langs in _BY_SHAPE.items() for lang in langs.split()}


def plural_rules(spark: SparkSession) -> DataFrame:
    """plural_rules(base_language, required, optional): about 160 rows, fixed."""
    rows = [(k, list(v), list(OPTIONAL[k])) for k, v in sorted(REQUIRED.items())]
    return spark.createDataFrame(rows, "base_language string, required array<string>, optional array<string>")


def base_language(code: Column) -> Column:
    """pt-BR, pt_BR, PT -> pt; empty parts are passed over, a code without any is ''."""
    parts = F.filter(F.split(F.lower(F.translate(code, "_", "-")), "-"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.when(code.isNotNull(), F.lit("")))


def _by_language(table: dict[str, tuple[str, ...]], code: Column) -> Column:
    shapes: dict[tuple[str, ...], list[str]] = {}
    for lang, cats in table.items():
        shapes.setdefault(cats, []).append(lang)
    base, out = base_language(code), None
    for cats, langs in sorted(shapes.items()):
        value = F.array(*[F.lit(c) for c in cats]) if cats else F.array().cast("array<string>")
        out = F.when(base.isin(*langs), value) if out is None else out.when(base.isin(*langs), value)
    return out


def required_categories(code: Column) -> Column:
    """Categories that the language's integers need; an unknown language needs 'other'."""
    return F.coalesce(_by_language(REQUIRED, code), F.array(F.lit("other")))


def optional_categories(code: Column) -> Column:
    return F.coalesce(_by_language(OPTIONAL, code), F.array().cast("array<string>"))


def is_known_language(code: Column) -> Column:
    return base_language(code).isin(*REQUIRED)


def is_exact_count(path: Column) -> Column:
    """A path below plural whose last part is a count word (zero, one, two): its text may drop the number."""
    return path.contains("plural.") & F.substring_index(path, ".", -1).isin("zero", "one", "two")
