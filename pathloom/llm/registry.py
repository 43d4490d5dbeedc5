"""The queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filteraudit, fingerprint, langid, mixing, neardup, packing, quality, secrets, sharding, tokencount, toxicity, warc, whitening
from .shared import table, tokenizer_path


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), min_bytes=0))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_warc, op4_near_duplicates, op5_fingerprints, op6_quality, op7_token_counts, op8_mixing, op9_packing, op10_language, op11_whitening, op12_sharding, op13_filter_audit)}
    return found | {"pipeline": corpus_pipeline.run}


#: Of the operators that SQL can express; the others are tested against brute-force versions.
OP3_SQL = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
g as (select h, max(page_id) top, count(*) n from p group by 1),
d as (select p.*, g.top, g.n, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
   lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(p.h, i * 5 + 1, 5))::int >> k) & 31) + 1, 1)), '')), '') digest from p join g using (h))
select page_id, strlen(html)::bigint payload_bytes, digest payload_digest, case when n = 1 or page_id = top then 'response' else 'revisit' end record_type,
   case when n > 1 and page_id <> top then top end refers_to from d"""

OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh from w),
e as (select doc_id, unnest(sh) g from s),
p as (select a.doc_id u, b.doc_id v, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select u, v from p join s x on x.doc_id = u join s y on y.doc_id = v where 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
b as (select u, v from l union select v, u from l),
r(u, v) as (select u, v from b union select r.u, b.v from r join b on b.u = r.v)
select s.doc_id, len(sh)::bigint n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) component_id, s.doc_id <= coalesce(m, s.doc_id) kept from s left join (select u, min(v) m from r group by 1) t on t.u = s.doc_id"""

OP13_SQL = r"""
with recursive t as (select doc_id, coalesce(source, '') part, coalesce(text, '') x from documents),
w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by x) least from t),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
m as materialized (select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::int
      + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int mask, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from w left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
o(filter_order) as (select a.c || b.c || c.c || d.c || e.c from f a, f b, f c, f d, f e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, k step, 1 << (instr('ABCDE', filter_order[k]) - 1) bit, list_sum(list_transform(range(1, k), lambda i: 1 << (instr('ABCDE', filter_order[i:i]) - 1))) before from o, unnest(range(1, 6)) r(k)),
p as (select filter_order, step, bit, coalesce(before, 0)::int before from s)
select part, filter_order, step::int step, sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint kept, sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint removed,
   sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint redundant, sum(case when mask = bit then n else 0 end)::bigint unique_fails,
   sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint good_lost, sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end)::bigint toxic_lost,
   sum(case when mask & bit > 0 then n * (120 // bit_count(mask)) else 0 end)::bigint shapley from m, p group by all"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op13_filter_audit": OP13_SQL}
