"""Explicit schemas of the tables that the engine reads and writes."""

from __future__ import annotations

ROUTE_RECORD = (
    "rec_id long, ts timestamp, prefix string, family tinyint, peer_asn long, event string, source string, as_path array<long>, "
    "path_is_strict boolean, origin_asn long, is_blackhole boolean, collector string"
)
LINKS = "prefix string, from_as long, to_as long, ts timestamp, origin_asn long, source string"
TRIPLETS = "profile_id long, as_id long, hop short, weight float"
CANDIDATES = (
    "ts timestamp, prefix string, asn long, level int, topology_level int, origin long, is_origin_asn boolean, "
    "is_blackhole_route boolean, is_ip_leasing boolean, upstream_asns array<long>, affected_asns array<long>"
)
#: The candidate file keeps lists as colon-joined text.
CANDIDATES_CSV = (
    "timestamp long, prefix string, asn long, level int, topology_level int, origin long, is_origin_asn int, "
    "is_blackhole_route int, is_ip_leasing int, upstream_asns string, affected_asns string"
)
AS_INFO = (
    "asn string, asnName string, rank int, organization struct<orgId:string,orgName:string>, cliqueMember boolean, seen boolean, "
    "longitude double, latitude double, cone struct<numberAsns:long,numberPrefixes:long,numberAddresses:long>, "
    "country struct<iso:string,name:string>, asnDegree struct<provider:int,peer:int,customer:int,total:int,transit:int,sibling:int>, "
    "announcing struct<numberPrefixes:long,numberAddresses:long>"
)
MANIFEST = "sample_id long, repeat_seed long, label int, scenario string, rank_tier string, depth int, prefix string, asn long, origin long"
DONE_MARKER = (
    "timestamp string, data_type string, completed_sources array<string>, required_sources array<string>, forced_sources array<string>, "
    "missing_collectors_by_source map<string,array<string>>"
)
