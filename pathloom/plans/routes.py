"""Queries over announcements: paths, profiles, fingerprints, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import links as L
from ..operators import paths as P
from ..operators import profiles as R
from ..operators import simhash as S
from ..sources import fixtures as X
from .registered import query


def _text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), " ")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_links(X.announcements(spark, d)).select("rec_id", "prefix_id", "ts", "origin", "source", "is_blackhole", "from_as", "to_as")


@query("select rec_id, pos::int - 1 pos, from_as, to_as from links", X.ANN)
def path_links(spark, d):
    return X.announcements(spark, d).select("rec_id", F.explode(P.path_links(F.col("path"))).alias("x")).select("rec_id", "x.*")


@query("select rec_id, array_to_string(path, ' ') path, len(raw_path)::bigint raw_hops, len(path)::bigint hops, origin, len(list_distinct(path)) < len(path) has_loop from ann", X.ANN)
def path_dedup_linearize(spark, d):
    a = X.announcements(spark, d)
    return a.select("rec_id", _text(F.col("path")).alias("path"), F.size("raw_path").cast("long").alias("raw_hops"), F.size("path").cast("long").alias("hops"), "origin", (F.size(F.array_distinct("path")) < F.size("path")).alias("has_loop"))


@query(
    """select l_orderkey rec_id, len(segments)::bigint n_segments, len(list_filter(segments, lambda s: len(s) > 1)) = 0 is_strict, array_to_string(flatten(segments), ' ') flat,
       coalesce(list_sum(list_transform(range(1, len(segments)), lambda i: case when segments[i] = segments[i + 1] then 0 else len(segments[i]) * len(segments[i + 1]) end)), 0)::bigint n_links from segs""",
    X.SEGMENTS,
)
def strict_paths(spark, d):
    s = X.segments(spark, d)
    return s.select("rec_id", F.size("segments").cast("long").alias("n_segments"), P.is_strict(F.col("segments")).alias("is_strict"), _text(F.flatten("segments")).alias("flat"), F.coalesce(F.size(P.set_links(F.col("segments"))), F.lit(0)).cast("long").alias("n_links"))


@query("select prefix_id, count(distinct path)::bigint routes from ann group by 1", X.ANN)
def distinct_routes(spark, d):
    return P.distinct_routes(X.announcements(spark, d)).groupBy("prefix_id").agg(F.count("*").alias("routes"))


@query("select source, count(*)::bigint rows, count(distinct prefix_id)::bigint prefixes from (select * from ann where source = 'RIB' union all select * from ann where source = 'UPD') group by 1", X.ANN)
def rib_upd_union(spark, d):
    a = X.announcements(spark, d)
    return a.where("source = 'RIB'").unionByName(a.where("source = 'UPD'")).groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("prefix_id").alias("prefixes"))


@query(
    "select prefix_id, array_to_string(path, ' ') path from (select distinct prefix_id, path from ann where source = 'UPD' except select prefix_id, path from ann where source = 'RIB')",
    X.ANN,
)
def upd_not_in_rib(spark, d):
    return P.updates_not_in_snapshot(X.announcements(spark, d)).select("prefix_id", _text(F.col("path")).alias("path"))


@query("select rec_id, prefix_id from ann, (select max(ts) l from ann where source = 'RIB') where ts between l - interval 14 days and l", X.ANN)
def lookback_filter(spark, d):
    return P.look_back(X.announcements(spark, d)).select("rec_id", "prefix_id")


HOPS = """
each as (select prefix_id, source, unnest(path) asn, len(path) - generate_subscripts(path, 1) hop from ann where len(path) > 1),
hops as (select prefix_id, asn, coalesce(min(hop) filter (source = 'RIB'), min(hop))::int hop, bool_or(source = 'RIB') from_rib from each group by all)"""


@query("select prefix_id, asn, hop, from_rib from hops", X.ANN, HOPS)
def prefix_min_hop(spark, d):
    return R.min_hops(X.announcements(spark, d))


@query("select prefix_id, string_agg(asn || ':' || hop, ' ' order by asn) signature, count(*)::bigint networks from hops group by 1", X.ANN, HOPS)
def profile_signatures(spark, d):
    s = R.signatures(R.min_hops(X.announcements(spark, d)))
    return s.select("prefix_id", F.array_join(F.transform("signature", lambda x: F.concat_ws(":", x["asn"].cast("string"), x["hop"].cast("string"))), " ").alias("signature"), F.size("signature").cast("long").alias("networks"))


def _short_signed(spark, d):
    s = R.signatures(X.short_hops(spark, d))
    return s.select("prefix_id", F.array_join(F.transform("signature", lambda x: F.concat_ws(":", x["asn"].cast("string"), x["hop"].cast("string"))), " ").alias("signature"))


@query("select dense_rank() over (order by signature) - 1 profile_id, signature, prefixes from (select signature, count(*)::bigint prefixes from signatures group by 1)", X.SHORT)
def profile_compression(spark, d):
    return R.profiles(_short_signed(spark, d)).select("profile_id", "signature", "prefixes").withColumn("profile_id", F.col("profile_id").cast("long"))


@query("select prefix_id, asn, hop, case when from_rib then 1.0::double else 0.2::double end weight from hops", X.ANN, HOPS)
def profile_triplets(spark, d):
    h = R.min_hops(X.announcements(spark, d))
    return R.triplets(h, h.select("prefix_id", F.col("prefix_id").alias("profile")).distinct()).select(F.col("profile").alias("prefix_id"), "asn", "hop", "weight")


@query("select signature, asn, hop, 1.0::double weight from short_hops join signatures using (prefix_id) group by all", X.SHORT)
def shared_profile_triplets(spark, d):
    h = X.short_hops(spark, d).withColumn("from_rib", F.lit(True))
    members = _short_signed(spark, d).select("prefix_id", F.col("signature").alias("profile"))
    return R.triplets(h, members).select(F.col("profile").alias("signature"), "asn", "hop", "weight")


@query("select asn, count(*)::bigint prefixes, min(hop) least_hop, max(hop) most_hop from hops group by 1", X.ANN, HOPS)
def profile_degree(spark, d):
    return R.min_hops(X.announcements(spark, d)).groupBy("asn").agg(F.count("*").alias("prefixes"), F.min("hop").alias("least_hop"), F.max("hop").alias("most_hop"))


@query(
    "select (select count(distinct prefix_id) from hops)::bigint prefixes, (select count(distinct asn) from hops)::bigint networks, (select count(*) from hops)::bigint triplets, (select count(*) from hops where from_rib)::bigint from_rib",
    X.ANN,
    HOPS,
)
def dataset_meta(spark, d):
    h = R.min_hops(X.announcements(spark, d))
    return h.agg(F.countDistinct("prefix_id").alias("prefixes"), F.countDistinct("asn").alias("networks"), F.count("*").alias("triplets"), F.count_if("from_rib").cast("long").alias("from_rib"))


M64 = "18446744073709551616::uhugeint"
WORDS = f"""
edges as (select distinct from_as u, to_as v from links),
words as (select u, v, ((u::uhugeint * {bits.U1}::uhugeint) % {M64} + (v::uhugeint * {bits.V1}::uhugeint) % {M64}) % {M64} w1,
   ((xor(u::ubigint, {bits.UX}::ubigint)::uhugeint * {bits.UM}::uhugeint) % {M64} + (xor(v::ubigint, {bits.VX}::ubigint)::uhugeint * {bits.VM}::uhugeint) % {M64}) % {M64} w2 from edges)"""
SIGNED = "case when {0} >= 9223372036854775808::uhugeint then ({0}::hugeint - 18446744073709551616::hugeint)::bigint else {0}::bigint end"


@query(f"select u, v, {SIGNED.format('w1')} h1, {SIGNED.format('w2')} h2 from words", X.ANN, WORDS)
def edge_hash_words(spark, d):
    e = _links(spark, d).select(F.col("from_as").alias("u"), F.col("to_as").alias("v")).distinct()
    return bits.edge_words(e)


PRINTS = """
es as (select prefix_id, path[pos + 1] u, path[pos] v, len(path) - 1 - pos depth, count(*) n from (select prefix_id, path, unnest(range(1, len(path))) pos from ann) group by all),
votes as (select prefix_id, b.range bit, depth, sum(case when ((case when b.range < 64 then w1 else w2 end) >> (b.range % 64)::uhugeint) & 1::uhugeint = 1::uhugeint then n else -n end) votes
          from es join words using (u, v), range(128) b group by all),
totals as (select prefix_id, bit, list_sum(list(votes * exp(depth * -0.5) order by depth)) t from votes group by all),
prints as (select prefix_id, bit_or(case when bit < 64 and t > 0 then 1::uhugeint << bit::uhugeint else 0::uhugeint end) lo, bit_or(case when bit >= 64 and t > 0 then 1::uhugeint << (bit - 64)::uhugeint else 0::uhugeint end) hi from totals group by 1)"""


@query(f"select prefix_id, {SIGNED.format('lo::uhugeint')} fp_lo, {SIGNED.format('hi::uhugeint')} fp_hi from prints", X.ANN, WORDS, PRINTS)
def profile_simhash(spark, d):
    return S.simhash(R.edges(X.announcements(spark, d)))


def _neighbor_prints(spark, d):
    p = S.simhash(R.edges(X.announcements(spark, d)))
    q = p.select((F.col("prefix_id") - 1).alias("prefix_id"), F.col("fp_lo").alias("lo2"), F.col("fp_hi").alias("hi2"))
    return p.join(q, "prefix_id").select("prefix_id", bits.hamming(F.col("fp_lo"), F.col("fp_hi"), F.col("lo2"), F.col("hi2")).alias("h"))


HAM = """
ham as (select a.prefix_id, (bit_count(xor(a.lo::ubigint, b.lo::ubigint)::bit) + bit_count(xor(a.hi::ubigint, b.hi::ubigint)::bit))::int h from prints a join prints b on b.prefix_id = a.prefix_id + 1)"""


@query("select prefix_id, h from ham", X.ANN, WORDS, PRINTS, HAM)
def simhash_hamming_pairs(spark, d):
    return _neighbor_prints(spark, d)


@query(
    "select prefix_id, round(greatest(0, least(1, 1 - h / 128.0::double)), 6) affinity, round(greatest(0, least(1, (greatest(0, least(1, 1 - h / 128.0::double)) - 0.5) / 0.5)), 6) recalibrated, h <= 31 matches from ham",
    X.ANN, WORDS, PRINTS, HAM,
)
def affinity_recalibrated(spark, d):
    h = F.col("h")
    return _neighbor_prints(spark, d).select("prefix_id", F.round(bits.affinity(h), 6).alias("affinity"), F.round(bits.recalibrated(h), 6).alias("recalibrated"), (h <= bits.MATCH_DISTANCE).alias("matches"))


@query(
    "select (select count(distinct a) from (select unnest(path) a from ann))::bigint networks, (select count(*) from (select distinct least(from_as, to_as), greatest(from_as, to_as) from links))::bigint edges, (select count(*) from ann)::bigint paths",
    X.ANN,
)
def graph_summary(spark, d):
    a = X.announcements(spark, d)
    n = a.select(F.explode("path").alias("a")).agg(F.countDistinct("a").alias("networks"))
    l = P.explode_links(a).agg(F.countDistinct(F.least("from_as", "to_as"), F.greatest("from_as", "to_as")).alias("edges"))  # noqa: E741
    return n.join(F.broadcast(l)).join(F.broadcast(a.agg(F.count("*").alias("paths"))))  # one row each


@query("select prefix_id, count(*)::bigint edges, min(a) least, max(b) most from (select distinct prefix_id, least(from_as, to_as) a, greatest(from_as, to_as) b from links where from_as <> to_as) group by 1", X.ANN)
def undirected_edges(spark, d):
    return R.undirected(_links(spark, d)).groupBy("prefix_id").agg(F.count("*").alias("edges"), F.min("a").alias("least"), F.max("b").alias("most"))


@query(
    """select prefix_id, array_to_string(case when len(roots) > 0 then roots else [first] end, ' ') origins from (
       select prefix_id, list_sort(list_filter(list_distinct(list(from_as)), lambda x: not list_contains(list(to_as), x))) roots, min_by(from_as, (from_as, to_as)) first from links group by 1)""",
    X.ANN,
)
def profile_origins(spark, d):
    return R.inferred_origins(_links(spark, d)).select("prefix_id", _text(F.col("origins")).alias("origins"))


@query(
    "select asn, count(*)::bigint n_neighbors, min(o) least, max(o) most from (select distinct from_as asn, to_as o from links where from_as <> to_as union select to_as, from_as from links where from_as <> to_as) group by 1",
    X.ANN,
)
def as_neighbors(spark, d):
    return R.neighbors(_links(spark, d))


@query("select prefix_id, from_as, to_as, epoch(max(ts))::bigint ts, min(origin) filter (ts = m) origin from (select *, max(ts) over (partition by prefix_id, from_as, to_as) m from links) group by 1, 2, 3", X.ANN)
def latest_link_state(spark, d):
    return L.latest_state(_links(spark, d)).withColumn("ts", F.unix_seconds("ts"))


NEW = """
fresh as (select * from links l where source = 'UPD' and not exists (select 1 from links b where b.source = 'RIB' and b.prefix_id = l.prefix_id and b.from_as = l.from_as and b.to_as = l.to_as))"""


def _new(spark, d):
    l = _links(spark, d)  # noqa: E741
    return L.new_links(l.where("source = 'UPD'"), l.where("source = 'RIB'"))


@query("select distinct prefix_id, from_as, to_as from fresh", X.ANN, NEW)
def new_links(spark, d):
    return _new(spark, d).select(*L.LINK).distinct()


@query("select prefix_id, from_as, to_as, epoch(t)::bigint ts, origin, seen from (select prefix_id, from_as, to_as, min(ts) t, min(origin) filter (ts = m) origin, count(*)::bigint seen from (select *, min(ts) over (partition by prefix_id, from_as, to_as) m from fresh) group by 1, 2, 3)", X.ANN, NEW)
def earliest_trigger(spark, d):
    """The flagship: announcements, links, anti join against the baseline, first trigger of each new link."""
    return L.earliest_trigger(_new(spark, d)).withColumn("ts", F.unix_seconds("ts"))


@query("select prefix_id, (epoch(ts)::bigint // 2592000) * 2592000 start, count(*)::bigint routes, max(is_blackhole::int) blackhole from ann group by 1, 2", X.ANN)
def interval_flags(spark, d):
    return L.interval_flags(X.announcements(spark, d), "30 days").withColumn("start", F.unix_seconds("start"))


@query(
    """select distinct prefix_id, from_as, to_as from links u where source = 'UPD' and ts >= timestamp '1999-03-01' and not exists (select 1 from links b where b.prefix_id = u.prefix_id and b.from_as = u.from_as
       and b.to_as = u.to_as and (b.source = 'RIB' or (b.source = 'UPD' and b.ts >= timestamp '1999-03-01' - interval 480 hours and b.ts < timestamp '1999-03-01')))""",
    X.ANN,
)
def warm_up_absorbed(spark, d):
    l, start = _links(spark, d), F.lit("1999-03-01").cast("timestamp")  # noqa: E741
    upd = l.where("source = 'UPD'")
    base = L.absorb(l.where("source = 'RIB'"), upd, start, 480)
    return L.new_links(upd.where(F.col("ts") >= start), base).select(*L.LINK).distinct()
