"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed_dedup, html_extract, langid, simhash, spm, substring_dedup, suffix_dedup, toxicity
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of conversations."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; a quarter of them, by crc32, is held out of learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 4, 2).alias("held_out"))
    model = langid.train(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), window=13, columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), length=50, columns=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42).select("doc_id", "fingerprint", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, columns=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text again."""
    return spm.encode(_table(spark, sf_dir, "documents"), columns=["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a fifth of them, by crc32, is held out of learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", fold("doc_id", 5, 0).alias("held_out"))
    net = toxicity.train(docs.where("not held_out"), _table(spark, sf_dir, "labels").where(~fold("doc_id", 5, 0)))
    return toxicity.score(docs, net, columns=["doc_id", "held_out"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_language_id,
        op3_substring_dedup,
        op4_suffix_dedup,
        op5_embedding_dedup,
        op6_html_extraction,
        op7_simhash_dedup,
        op8_decontamination,
        op9_sentencepiece,
        op10_toxicity,
    )
}

_OP3 = r"""
with t as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, p, array_to_string(w[p : p + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from t)),
lo as (select s, min(doc_id) as lo from win group by s),
hit as (select doc_id, p from win join lo using (s) where doc_id > lo),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as p from hit),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from t),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from word anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join kept using (doc_id)
"""

_OP4 = r"""
with t as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
win as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from t)),
lo as (select s, min(doc_id) as lo from win group by s),
hit as (select doc_id, p from win join lo using (s) where doc_id > lo),
edge as (select doc_id, p, coalesce(p > 50 + lag(p) over (partition by doc_id order by p), true) as new from hit),
numbered as (select doc_id, p, sum(new::int) over (partition by doc_id order by p) as k from edge),
span as (select doc_id, k, min(p) as a, max(p) + 50 as b from numbered group by doc_id, k),
gap as (
  select doc_id, h, coalesce(lag(b) over w, 0) as a, a as b from (select doc_id, h, a, b from span join t using (doc_id)) window w as (partition by doc_id order by a)
  union all
  select doc_id, h, coalesce(m, 0), len(h) // 2 from t left join (select doc_id, max(b) as m from span group by doc_id) using (doc_id)
),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as kept from gap group by doc_id),
n as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from span group by doc_id)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from t left join kept using (doc_id) left join n using (doc_id)
"""

_OP5 = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
),
reach as (select vec_id as id, vec_id as c from embeddings union select link.b, reach.c from reach join link on link.a = reach.id),
comp as (select id, min(c) as component_id from reach group by id),
n as (select a as id, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join comp on comp.id = vec_id left join n on n.id = vec_id
"""

_OP8 = r"""
with words as (
  select 'd' as kind, doc_id as id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
  union all
  select 'i', item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) from benchmark
),
items as (select id, w, least(13, len(w)) as n from words where kind = 'i' and len(w) > 0),
iwin as (select distinct id as item_id, n, array_to_string(w[p : p + n - 1], ' ') as s from (select id, w, n, unnest(range(1, len(w) - n + 2)) as p from items)),
sizes as (select distinct n from iwin),
dwin as (select id as doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as s from (select id, w, n, unnest(range(1, len(w) - n + 2)) as p from words, sizes where kind = 'd')),
found as (select doc_id, p, n, item_id from dwin join iwin using (n, s)),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit on hit.doc_id = id left join named on named.doc_id = id where kind = 'd'
"""

ORACLE_SQL = {"op3_substring_dedup": _OP3, "op4_suffix_dedup": _OP4, "op5_embedding_dedup": _OP5, "op8_decontamination": _OP8}
