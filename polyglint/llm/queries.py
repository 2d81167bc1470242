"""The queries of this subpackage: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from . import crf, decontam, exact, jaccard, license, lm, lpf, mixing, recompress, warc


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_ngram_jaccard_join": lambda s, d: jaccard.ngram_jaccard_join(_table(s, d, "documents")),
    "op2_quality_classifier": lambda s, d: crf.classify(_table(s, d, "documents"), _table(s, d, "labels")),
    "op3_source_mixing": lambda s, d: mixing.mix_sources(_table(s, d, "documents")),
    "op4_benchmark_decontamination": lambda s, d: decontam.find(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op5_recompression_repeats": lambda s, d: recompress.find_repeats(_table(s, d, "documents")),
    "op6_suffix_array_copies": lambda s, d: lpf.find_copies(_table(s, d, "documents")),
    "op7_warc_derivatives": lambda s, d: warc.build(_table(s, d, "pages")),
    "op8_license_scan": lambda s, d: license.scan(_table(s, d, "documents")),
    "op9_exact_dedup": lambda s, d: exact.two_loads(_table(s, d, "documents")),
    "op10_lm_scores": lambda s, d: lm.score(_table(s, d, "documents")),
}

# the tokens of a text, as common.tokenize makes them
_WORDS = r"list_filter(list_transform(string_split_regex(lower({0}), '\s+'), lambda w: regexp_replace(w, '[^\pL\pN]+', '', 'g')), lambda w: w <> '')"

_SHINGLES = f"""
words as (select doc_id, {_WORDS.format('text')} as w from documents where doc_id is not null and text is not null),
grams as (select distinct doc_id, unnest(case when len(w) >= {jaccard.N}
    then list_transform(generate_series(1, len(w) - {jaccard.N - 1}), lambda i: array_to_string(w[i:i + {jaccard.N - 1}], ' '))
    else [array_to_string(w, ' ')] end) as g from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as overlap from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)"""
JACCARD_SQL = f"""with recursive {_SHINGLES},
pairs as (select doc_a, doc_b from shared join sizes x on x.doc_id = doc_a join sizes y on y.doc_id = doc_b where overlap >= {jaccard.THRESHOLD} * (x.n + y.n - overlap)),
links as (select doc_a as a, doc_b as b from pairs union all select doc_b, doc_a from pairs),
reach(a, b) as (select distinct a, a from links union select reach.a, links.b from reach join links on links.a = reach.b),
classes as (select a, min(b) as class_id from reach group by a),
degrees as (select a, count(*) as n_links from links group by a)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links
from (select distinct doc_id from documents where doc_id is not null) left join classes c on c.a = doc_id left join degrees d on d.a = doc_id"""

DECONTAM_SQL = f"""with
d as (select doc_id, {_WORDS.format('text')} as w from documents where doc_id is not null and text is not null),
b as (select item_id, {_WORDS.format('text')} as w from benchmark where item_id is not null and text is not null),
dt as (select doc_id, unnest(w) as t, unnest(generate_series(0, len(w) - 1)) as p from d where len(w) > 0),
bt as (select item_id, unnest(w) as t, unnest(generate_series(0, len(w) - 1)) as j, len(w) as n from b where len(w) > 0),
hit as (select distinct doc_id, item_id, n, j, p - j as g from dt join bt using (t)),
enough as (select doc_id, item_id from hit group by 1, 2, n having count(distinct j) >= ceil({decontam.COVERAGE} * n - 1e-9)),
near as (select doc_id, item_id, n, j, g, unnest(generate_series(g - {decontam.SLACK}, g + {decontam.SLACK})) as s from hit semi join enough using (doc_id, item_id)),
starts as (select doc_id, item_id, n, s, count(distinct j) as met, count(distinct case when g = s then j end) as placed from near group by 1, 2, 3, 4),
ranked as (select *, row_number() over (partition by doc_id, item_id order by placed = n desc, met desc, s) as r from starts where met >= ceil({decontam.COVERAGE} * n - 1e-9))
select doc_id, item_id, case when placed = n then 'exact' else 'proximity' end as kind, s as start, met, n as n_tokens from ranked where r = 1"""

REPEATS_SQL = f"""with
w as (select doc_id, {_WORDS.format('text')} as w from documents where doc_id is not null and text is not null),
windows as (select doc_id, unnest(generate_series(0, len(w) - {recompress.K})) as p, unnest(list_transform(generate_series(1, len(w) - {recompress.K - 1}), lambda i: array_to_string(w[i:i + {recompress.K - 1}], ' '))) as t from w where len(w) >= {recompress.K}),
placed as (select doc_id, p, min(struct_pack(d := doc_id, p := p)) over (partition by t) as f from windows),
later as (select *, p - lag(p) over (partition by doc_id order by p) as gap from placed where f.d <> doc_id or f.p <> p),
marked as (select *, sum(case when gap <= {recompress.K} then 0 else 1 end) over (partition by doc_id order by p rows unbounded preceding) as island from later)
select doc_id, min(p) as start, max(p) + {recompress.K} - min(p) as n_tokens, arg_min(f, p).d as first_doc_id, arg_min(f, p).p as first_start from marked group by doc_id, island"""


def _license_sql() -> str:
    each = " union all ".join(
        f"select doc_id, '{name}' as license, regexp_extract(t, '^(.*?)(?:{p})', 1) as before, regexp_extract_all(t, '{p}') as found from norm where regexp_matches(t, '{p}')"
        for name, p in ((name, license.as_regex(text)) for name, text in license.SQL_TEMPLATES.items())
    )
    return f"""with norm as (select doc_id, ' ' || array_to_string({_WORDS.format('text')}, '  ') || ' ' as t from documents where doc_id is not null and text is not null),
found as ({each})
select doc_id, license, (len(before) - len(replace(before, ' ', ''))) // 2 as first_token, (len(found[1]) - len(replace(found[1], ' ', ''))) // 2 as n_tokens, len(found) as n_places from found"""


EXACT_SQL = """with rows_ as (select doc_id, text, case when coalesce(((doc_id % 2) + 2) % 2 = 1, false) then 1 else 2 end as load from documents where text is not null)
select load, min(doc_id) as doc_id, sha256(text) as digest, count(*) as n_copies from rows_ r
where load = 1 or text not in (select text from rows_ where load = 1) group by load, text"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": JACCARD_SQL,
    "op4_benchmark_decontamination": DECONTAM_SQL,
    "op5_recompression_repeats": REPEATS_SQL,
    "op6_suffix_array_copies": REPEATS_SQL,
    "op8_license_scan": _license_sql(),
    "op9_exact_dedup": EXACT_SQL,
}
