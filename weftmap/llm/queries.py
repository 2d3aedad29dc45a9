"""The registered queries of this subpackage, one per operator, over whole tables.

Each hands its table to its operator with production parameters; what nulls, empty and long texts, ties, repeated rows, empty tables and further
columns give is told by the operator's docstring and holds for the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_groups

    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digest

    return token_file_digest(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which item holds a longest match is left out: of several with it the operator names one."""
    from .decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest_item", "longest_item_start")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embeddings, op2_simhash, op3_personal_data, op4_packing, op5_token_files, op6_decontamination, op7_license_scan, op8_token_counts, op9_lm_score, op10_quality)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

_OP1_SQL = """
with recursive e as (select vec_id, [x::double for x in embedding] v from embeddings),
ok as (select vec_id, v from e where len(v) > 0 and len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x <> 0]) > 0),
l as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9),
n as (select a, count(*) n from l group by 1),
r(v, m) as (select vec_id, vec_id from e union select l.a, r.m from r join l on l.b = r.v),
c as (select v, min(m) m from r group by 1)
select vec_id, coalesce(n, 0) n_links, m component_id, vec_id = m kept from e join c on c.v = vec_id left join n on a = vec_id
"""

_OP6_SQL = f"""
with t as (select doc_id, {_WORDS.format("text")} w from documents),
i as (select item_id, {_WORDS.format("text")} w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[k + 1:k + n], ' ') s from (select item_id, w, least(len(w), 10) n, unnest(range(0, len(w) - least(len(w), 10) + 1)) k from i where len(w) > 0)),
p as (select doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') s from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) k from t, (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, k, n, item_id from p join iw using (n, s)),
hit as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(k, k + n)) pos from h) group by 1),
io as (select item, n, k, array_to_string(w[k + 1:k + n], ' ') s from (select item, w, least(len(w), 10) n, unnest(range(0, len(w) - least(len(w), 10) + 1)) k from (select row_number() over () item, w from i) where len(w) > 0)),
d as (select doc_id, item, p.n, p.k pos, p.k - io.k diagonal from p join io using (n, s)),
r as (select doc_id, min(pos) pos, count(*) + n - 1 len from (select *, pos - row_number() over (partition by doc_id, item, n, diagonal order by pos) run from d) group by doc_id, item, n, diagonal, run),
m as (select doc_id, max(len)::bigint longest, arg_min(pos, (-len, pos))::bigint longest_start from r group by 1),
it as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, item_id::varchar x from h) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
coalesce(longest, 0) longest, longest_start
from t left join hit using (doc_id) left join it using (doc_id) left join m using (doc_id)
"""


def _op7_sql() -> str:
    from .license_scan import SHINGLE_WORDS, SIMILARITY, TEMPLATES

    texts = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    k = SHINGLE_WORDS
    cut = f"[array_to_string(w[i + 1:i + {k}], ' ') for i in range(0, len(w) - {k} + 1)]"
    return f"""
with t as (select name, list_distinct({cut}) s from (select name, {_WORDS.format("text")} w from (values {texts}) x(name, text))),
q as (select name, s, len(s) n, greatest(1, len(s) // 2) step from t),
d as (select doc_id, {cut} s from (select doc_id, {_WORDS.format("text")} w from documents) where len(w) >= {k}),
near as (select doc_id, d.s ds, q.* from d join q on list_has_any(d.s, q.s)),
win as (select doc_id, name, n, s, step * unnest(range(0, greatest(0, ceil((len(ds) - n - step) / step)::bigint) + 1)) pos, ds, step from near),
sc as (select doc_id, name, pos, len(list_intersect(s, ds[pos + 1:pos + n + step])) / n::double share from win)
select doc_id, name license, count(*) n_windows, max(share) containment, arg_min(pos, (-share, pos))::bigint start_word from sc where share >= {SIMILARITY} group by 1, 2
"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints, byte-pair ids, spans and hashed models can't be told in SQL; tests compare those with brute force."""
    return {"op1_embeddings": _OP1_SQL, "op6_decontamination": _OP6_SQL, "op7_license_scan": _op7_sql()}
