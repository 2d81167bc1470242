import re

from conftest_corpus import corpus as corpus_rows  # noqa: F401


def tokens(text):
    return [x for x in (re.sub(r"[\W_]+", "", w) for w in text.lower().split()) if x]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
