"""Views over the star-schema tables that stand for routing data (see FIXTURES.md), and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import v4_parse
from ..operators.paths import drop_repeats
from .readers import read_table

ANN = """
hop as (select l_orderkey, l_suppkey, lag(l_suppkey) over w prev, row_number() over w rn
        from lineitem window w as (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey)),
raw as (select l_orderkey, list(l_suppkey + 1 order by rn) raw_path from hop group by 1),
p as (select l_orderkey, list(l_suppkey + 1 order by rn) path from hop where prev is null or prev <> l_suppkey group by 1),
ann as (select o_orderkey rec_id, o_custkey prefix_id, o_custkey % 16 + 1 peer, o_orderdate ts, raw_path, path, path[-1] origin,
        case when o_orderdate < timestamp '1999-01-01' then 'RIB' else 'UPD' end source, o_orderpriority = '1-URGENT' is_blackhole
        from orders join p on o_orderkey = l_orderkey join raw using (l_orderkey)),
links as (select rec_id, prefix_id, ts, origin, source, i pos, path[i + 1] from_as, path[i] to_as
          from (select *, unnest(range(1, len(path))) i from ann))"""


def announcements(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, prefix_id, peer, ts, raw_path, path, origin, source, is_blackhole."""
    line = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    hops = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("h"))
    raw = F.transform("h", lambda x: x["l_suppkey"] + 1)
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    a = orders.join(hops, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("rec_id"),
        F.col("o_custkey").alias("prefix_id"),
        (F.col("o_custkey") % 16 + 1).alias("peer"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        raw.alias("raw_path"),
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "RIB").otherwise("UPD").alias("source"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_blackhole"),
    )
    return a.withColumn("path", drop_repeats(F.col("raw_path"))).withColumn("origin", F.element_at("path", -1))


SEGMENTS = """
seg as (select l_orderkey, l_linenumber, list(distinct l_suppkey + 1 order by l_suppkey + 1) s from lineitem group by all),
segs as (select l_orderkey, list(s order by l_linenumber) segments from seg group by 1)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, segments: lines of one number are a set of networks."""
    s = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set(F.col("l_suppkey") + 1)).alias("s"))
    g = s.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "s"))).alias("x"))
    return g.select(F.col("l_orderkey").alias("rec_id"), F.transform("x", lambda x: x["s"]).alias("segments"))


DAG = """
dag as (select o_orderkey rec_id, o_custkey prefix_id, list(distinct l_suppkey + 1 order by l_suppkey + 1 desc) path
        from orders join lineitem on o_orderkey = l_orderkey group by all),
dag_links as (select distinct prefix_id, path[i + 1] from_as, path[i] to_as from (select *, unnest(range(1, len(path))) i from dag))"""


def acyclic(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, prefix_id, path of different networks in descending order: links never close a cycle."""
    line = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey") + 1), False).alias("path"))
    return read_table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("prefix_id"), "path")


SHORT = """
sh as (select l_orderkey prefix_id, s_nationkey + 1 asn, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) rn,
       count(*) over (partition by l_orderkey) n from lineitem join supplier on l_suppkey = s_suppkey),
short_hops as (select prefix_id, asn::bigint asn, min(n - rn)::int hop from sh group by all),
signatures as (select prefix_id, string_agg(asn || ':' || hop, ' ' order by asn) signature from short_hops group by 1)"""


def short_hops(spark: SparkSession, d: str) -> DataFrame:
    """prefix_id, asn, hop: few networks, so that prefixes share profiles."""
    s = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("long").alias("asn"))
    line = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    h = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "asn"))).alias("h"))
    each = h.select(F.col("l_orderkey").alias("prefix_id"), F.size("h").alias("n"), F.posexplode("h").alias("i", "x"))
    return each.groupBy("prefix_id", F.col("x.asn").alias("asn")).agg(F.min(F.col("n") - 1 - F.col("i")).cast("int").alias("hop"))


LEASE = """
lease as (select event_id rec_id, user_id prefix_id, event_id % 2 + 1 peer, ts,
          case when event_type in ('error', 'signup') then 'W' else 'A' end event, cast(json_extract(props, '$.k') as bigint) % 20 + 1 origin from events)"""


def lease_events(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, prefix_id, peer, ts, event, origin."""
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("rec_id"),
        F.col("user_id").alias("prefix_id"),
        (F.col("event_id") % 2 + 1).alias("peer"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("error", "signup"), "W").otherwise("A").alias("event"),
        (F.get_json_object("props", "$.k").cast("bigint") % 20 + 1).alias("origin"),
    )


MONITOR = """
mon as (select event_id rec_id, user_id prefix_id, event_id % 2 + 1 peer, epoch_us(ts) // 1000000 sec, case when event_type in ('error', 'signup') then 'W' else 'A' end event,
   cast(json_extract(props, '$.k') as bigint) % 20 + 1 origin, event_type = 'view' and event_id % 7 = 0 is_blackhole, event_id % 2 + 101 near, 30 + event_id * 31 % 17 mid from events),
mon_links as (select rec_id, prefix_id, sec, origin, mid from_as, near to_as from mon where event = 'A' union all select rec_id, prefix_id, sec, origin, origin, mid from mon where event = 'A'),
bases as (select * from (values (1704412800, 0), (1705017600, 1), (1705622400, 2)) v(version, k)),
base_links as (select distinct version, prefix_id, from_as, to_as from mon_links join bases on rec_id % 4 = k)"""
#: Seconds of the baselines above; the first is where detection begins.
VERSIONS = (1704412800, 1705017600, 1705622400)


def monitor_updates(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, prefix_id, peer, sec, event, origin, is_blackhole, path of three networks."""
    e = F.col("event_id")
    origin = F.get_json_object("props", "$.k").cast("bigint") % 20 + 1
    return read_table(spark, d, "events").select(
        e.alias("rec_id"), F.col("user_id").alias("prefix_id"), (e % 2 + 1).alias("peer"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), F.when(F.col("event_type").isin("error", "signup"), "W").otherwise("A").alias("event"),
        origin.alias("origin"), ((F.col("event_type") == "view") & (e % 7 == 0)).alias("is_blackhole"), F.array(e % 2 + 101, e * 31 % 17 + 30, origin).alias("path"),
    )


def monitor_baselines(spark: SparkSession, d: str) -> DataFrame:
    """version, prefix_id, from_as, to_as: three snapshots, each with the links of a quarter of the announcements of all times."""
    rows = monitor_updates(spark, d).where("event = 'A'")
    links = rows.select("rec_id", "prefix_id", F.explode(F.array(F.struct(F.get("path", F.lit(1)).alias("a"), F.get("path", F.lit(0)).alias("b")), F.struct(F.get("path", F.lit(2)).alias("a"), F.get("path", F.lit(1)).alias("b")))).alias("x"))
    version = F.get(F.array(*map(F.lit, VERSIONS)), (F.col("rec_id") % 4).cast("int")).cast("long")
    return links.select(version.alias("version"), "prefix_id", F.col("x.a").alias("from_as"), F.col("x.b").alias("to_as")).where("version is not null").distinct()


EMB = """
en as materialized (select count(*) n from embeddings),
as_keys as materialized (select s_suppkey + 1 asn, (s_suppkey + 1) * 7 % n i, 0.70 + 0.029 * ((s_suppkey + 1) % 10) scale from supplier, en),
as_emb as materialized (select k.asn, list_transform(e.embedding, lambda x: x::double * k.scale) vec from as_keys k join embeddings e on e.vec_id = k.i),
profile_keys as materialized (select c_custkey pid, c_custkey * 2 % n i, (c_custkey * 2 + 1) % n j, c_custkey + 3 ahead from customer, en),
profile_emb as materialized (select k.pid, k.ahead, list_transform(a.embedding, lambda x: x::double * 0.30) h1, list_transform(b.embedding, lambda x: x::double * 0.30) h2
           from profile_keys k join embeddings a on a.vec_id = k.i join embeddings b on b.vec_id = k.j)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e, e.count()


def as_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """asn, vec: norms 0.70 to 0.961."""
    e, n = _vectors(spark, d)
    s = read_table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("asn"))
    scale = 0.70 + 0.029 * (F.col("asn") % 10)
    return s.join(e, F.col("asn") * 7 % n == F.col("vec_id")).select("asn", F.transform("v", lambda x: x * scale).alias("vec"))


def profile_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """pid, heads: two vectors of norm 0.30."""
    e, n = _vectors(spark, d)
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("pid"))
    a, b = e.select(F.col("vec_id").alias("i"), F.col("v").alias("a")), e.select(F.col("vec_id").alias("j"), F.col("v").alias("b"))
    both = c.join(a, F.col("pid") * 2 % n == F.col("i")).join(b, (F.col("pid") * 2 + 1) % n == F.col("j"))
    return both.select("pid", F.array(F.transform("a", lambda x: x * 0.30), F.transform("b", lambda x: x * 0.30)).alias("heads"))


CAND = """
cand as (select rec_id, ts, prefix_id, case when prefix_id % 11 <> 0 then prefix_id end pid, path[1] asn, origin,
         case when path[1] % 13 <> 0 then path[1] end as_id, case when origin % 17 <> 0 then origin end origin_id, path[1] = origin is_source,
         is_blackhole from ann where source = 'UPD')"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows with unknown profiles, networks and origins among them (ids null)."""
    a = announcements(spark, d).where("source = 'UPD'")
    asn = F.element_at("path", 1)
    return a.select(
        "rec_id", "ts", "prefix_id", F.when(F.col("prefix_id") % 11 != 0, F.col("prefix_id")).alias("pid"), asn.alias("asn"), "origin",
        F.when(asn % 13 != 0, asn).alias("as_id"), F.when(F.col("origin") % 17 != 0, F.col("origin")).alias("origin_id"), (asn == F.col("origin")).alias("is_source"), "is_blackhole",
    )


INFO = """
as_info as (select s_suppkey + 1 asn, s_nationkey::bigint org_id, n_name || ' & Co. Holdings' org_name,
            row_number() over (order by s_acctbal desc, s_suppkey) rank from supplier join nation on s_nationkey = n_nationkey)"""


def as_info(spark: SparkSession, d: str) -> DataFrame:
    """asn, org_id, org_name, rank."""
    from pyspark.sql import Window

    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    j = s.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey"))  # a table of networks, not of routes
    return j.select((F.col("s_suppkey") + 1).alias("asn"), F.col("s_nationkey").cast("long").alias("org_id"), F.concat("n_name", F.lit(" & Co. Holdings")).alias("org_name"), rank.cast("long").alias("rank"))


MANIFEST = """
manifest as (select o_orderkey sample_id, 42 + o_orderkey % 5 repeat_seed, (o_orderstatus = 'F')::int label,
   case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'hijack' when o_orderpriority = '3-MEDIUM' then 'leak' else 'forge' end scenario,
   case when o_totalprice < 100000 then 'A' when o_totalprice < 200000 then 'B' when o_totalprice < 300000 then 'C' else 'D' end rank_tier,
   (o_orderkey % 5)::int depth, o_totalprice > 200000 geometry, o_custkey % 3 = 0 anchor, o_custkey % 5 = 0 org_id, o_custkey % 5 in (0, 1) and o_custkey % 5 <> 0 org_name, o_custkey % 11 = 0 missing
   from orders),
policies as (select *, geometry and not anchor prediction, geometry and not anchor and not org_id archived, geometry and not anchor and not org_id and not org_name aligned from manifest)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows with flags and policies."""
    o = read_table(spark, d, "orders")
    k, c, price, pr = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    return o.select(
        k.alias("sample_id"), (k % 5 + 42).alias("repeat_seed"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "hijack").when(pr == "3-MEDIUM", "leak").otherwise("forge").alias("scenario"),
        F.when(price < 100000, "A").when(price < 200000, "B").when(price < 300000, "C").otherwise("D").alias("rank_tier"),
        (k % 5).cast("int").alias("depth"), (price > 200000).alias("geometry"), (c % 3 == 0).alias("anchor"), (c % 5 == 0).alias("org_id"), (c % 5 == 1).alias("org_name"), (c % 11 == 0).alias("missing"),
    )


COLLECT = """
collected as (select distinct time_bucket(interval '5 minutes', ts) slot, case when user_id % 2 = 0 then 'ris' else 'rv' end source, user_id % 23 collector from events)"""


def collected(spark: SparkSession, d: str) -> DataFrame:
    """slot, source, collector: what has arrived."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300)
    return read_table(spark, d, "events").select(slot.alias("slot"), F.when(F.col("user_id") % 2 == 0, "ris").otherwise("rv").alias("source"), (F.col("user_id") % 23).alias("collector")).distinct()


def archive_pages(spark: SparkSession, d: str) -> DataFrame:
    """page, html: listing pages of both families with the slots of ``collected``; one row for each month, collector and folder."""
    c = collected(spark, d)
    minute, hour = F.minute("slot"), F.hour("slot")
    kind = F.explode(F.array_compact(F.array(
        F.when((F.col("source") == "ris") | (minute % 15 == 0), F.lit("updates")), F.when((minute == 0) & (hour % 2 == 0) & (F.col("source") == "rv"), F.lit("rib")), F.when((minute == 0) & (hour % 8 == 0) & (F.col("source") == "ris"), F.lit("bview")),
    )))
    c = c.withColumn("kind", kind)
    month = F.date_format("slot", "yyyy.MM")
    page = F.when(F.col("source") == "ris", F.concat(F.lit("ris/rrc"), F.col("collector"), F.lit("/"), month)).otherwise(F.concat(F.lit("rv/c"), F.col("collector"), F.lit("/bgpdata/"), month, F.when(F.col("kind") == "rib", "/RIBS").otherwise("/UPDATES")))
    link = F.concat(F.lit('<a href="'), F.col("kind"), F.date_format("slot", ".yyyyMMdd.HHmm"), F.when(F.col("source") == "ris", ".gz").otherwise(".bz2"), F.lit('">x</a>'))
    return c.groupBy(page.alias("page")).agg(F.array_join(F.sort_array(F.collect_list(link)), "\n").alias("html"))


PREFIXES = """
table_prefixes as (
  select 167772160 + c_custkey * 256 net, 24 len, c_custkey pid from customer where c_custkey % 3 = 0
  union all select distinct 167772160 + (c_custkey // 4096) * 1048576, 12, -(c_custkey // 4096) - 2 from customer where (c_custkey // 4096) % 2 = 0
  union all select distinct 167772160 + (c_custkey // 16) * 4096, 20, 1000000 + c_custkey // 16 from customer where (c_custkey // 16) % 3 = 1
  union all select 167772160, 8, -1),
query_prefixes as (select o_orderkey rec_id, 167772160 + o_custkey * 256 + o_orderkey % 256 ip, (16 + o_orderkey % 17)::int len from orders),
masked as (select rec_id, ip - ip % (2 ** (32 - len))::bigint net, len from query_prefixes)"""


def table_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """net, len, pid: nested prefixes of three lengths under one."""
    c, base = F.col("c_custkey"), 167772160
    t = read_table(spark, d, "customer").select("c_custkey")
    part = lambda cond, net, n, pid: t.where(cond).select((base + net).alias("net"), F.lit(n).alias("len"), pid.cast("long").alias("pid")).distinct()
    k, m = F.floor(c / 4096), F.floor(c / 16)
    whole = spark.range(1).select(F.lit(base).cast("long").alias("net"), F.lit(8).alias("len"), F.lit(-1).cast("long").alias("pid"))
    return part(c % 3 == 0, c * 256, 24, c).unionByName(part(k % 2 == 0, k * 1048576, 12, -k - 2)).unionByName(part(m % 3 == 1, m * 4096, 20, 1000000 + m)).unionByName(whole)


def query_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, ip, len."""
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(k.alias("rec_id"), (167772160 + F.col("o_custkey") * 256 + k % 256).alias("ip"), (16 + k % 17).cast("int").alias("len"))


V6 = """
v6 as (select o_orderkey rec_id, o_custkey c, o_orderkey % 4 k from orders),
v6_text as (select rec_id, c, k, '2001:db8' || case when c = 0 and k = 0 then '' when k = 0 then ':' || printf('%x', c) else ':' || printf('%x', c) || ':' || printf('%x', k) end || '::/64' prefix from v6)"""


V6_HIGH = 0x0DB8


def _v6_groups(c: Column) -> tuple[Column, Column]:
    """The second and third group of a customer's network: keys of more than 16 bits go on in the second."""
    return F.floor(c / 65536) + V6_HIGH, c % 65536


def v6_queries(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, prefix: IPv6 text with capitals, leading zeros and host bits."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("rec_id"), F.format_string("2001:%04X:%04X:%X::1/64", *_v6_groups(F.col("o_custkey")), F.col("o_orderkey") % 4).alias("prefix"))


def v6_table(spark: SparkSession, d: str) -> DataFrame:
    """prefix, profile_id: nested prefixes of two lengths under one for each 65536 keys."""
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("c"))
    long = c.where("c % 3 = 0").select(F.format_string("2001:%x:%x::/48", *_v6_groups(F.col("c"))).alias("prefix"), F.col("c").alias("profile_id"))
    group = c.select(F.floor(F.col("c") / 256).alias("g")).distinct().where("g % 2 = 0")
    mid = group.select(F.format_string("2001:%x:%x::/40", *_v6_groups(F.col("g") * 256)).alias("prefix"), (-F.col("g") - 2).alias("profile_id"))
    whole = c.select(_v6_groups(F.col("c"))[0].alias("h")).distinct()
    return long.unionByName(mid).unionByName(whole.select(F.format_string("2001:%X::/32", "h").alias("prefix"), F.lit(-1).cast("long").alias("profile_id")))


def v6_label(prefix: Column) -> Column:
    """A canonical prefix of the queries as the SQL writes it: the whole key, however many digits it has, as one group."""
    head = F.split(F.split_part(prefix, F.lit("::"), F.lit(1)), ":")
    part = lambda i: F.conv(F.coalesce(F.get(head, F.lit(i)), F.lit("0")), 16, 10).cast("long")
    key, k = (part(1) - V6_HIGH) * 65536 + part(2), part(3)
    groups = F.when((key == 0) & (k == 0), "").otherwise(F.concat(F.lit(":"), F.lower(F.hex(key)), F.when(k == 0, "").otherwise(F.concat(F.lit(":"), F.lower(F.hex(k))))))
    return F.concat(F.lit("2001:db8"), groups, F.lit("::/"), F.split_part(prefix, F.lit("/"), F.lit(-1)))


def prefix_label(prefix: Column) -> Column:
    """The IPv4 prefix of a prefix_id as the SQL writes it, where the second part is no octet: 10.<id div 256>.<id mod 256>.0/24."""
    k = F.floor((v4_parse(prefix)["net"] - 167772160) / 256)
    return F.concat(F.lit("10."), F.floor(k / 256).cast("string"), F.lit("."), (k % 256).cast("string"), F.lit(".0/24"))
