"""Names, lists, file names, slots and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: legal forms that organisation names lose
LEGAL = r"\b(inc|llc|ltd|limited|corp|corporation|company|co|holdings|group)\b"
# fixed values: normalised and legacy archive names
NORMAL_NAME = r"^(rib|upd)\.(ris|rv|ripe)\.(\d{8})\.(\d{4})\.(.+?)(\.gz|\.bz2)?$"
LEGACY_NAME = r"^(bview|updates)\.(\d{8})\.(\d{4})-(.+?)(\.gz|\.bz2)?$"
REJECTED = r"\.(done|tmp|part)$"


def normalize_org(name: Column) -> Column:
    """Lower-case words of letters and digits without legal forms; null if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(name)), "&", " and ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", " "), LEGAL, " "), r"\s+", " ")
    return F.nullif(F.trim(t), F.lit(""))


def list_text(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), ":")


def text_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda x: x != "").cast("array<bigint>")


def reason_text(*reasons: Column) -> Column:
    return F.concat_ws("; ", *reasons)


def has_reason(text: Column, start: str) -> Column:
    return F.exists(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.startswith(F.trim(x), F.lit(start)))


def path_numbers(text: Column) -> Column:
    """Numbers of a path in text: commas or blanks between them, an optional AS before each."""
    return F.transform(F.filter(F.split(F.trim(text), r"[,\s]+"), lambda x: x != ""), lambda x: F.regexp_replace(x, "(?i)^AS", "").try_cast("bigint"))


def archive_name(name: Column) -> Column:
    """struct(type, source, ts, collector) of an archive's file name, or null."""
    pick = lambda p, i: F.regexp_extract(name, p, i)
    when = lambda d, t: F.try_to_timestamp(F.concat(d, t), F.lit("yyyyMMddHHmm"))
    normal = F.struct(pick(NORMAL_NAME, 1).alias("type"), pick(NORMAL_NAME, 2).alias("source"), when(pick(NORMAL_NAME, 3), pick(NORMAL_NAME, 4)).alias("ts"), pick(NORMAL_NAME, 5).alias("collector"))
    legacy = F.struct(
        F.when(pick(LEGACY_NAME, 1) == "bview", "rib").otherwise("upd").alias("type"),
        F.lit("ris").alias("source"),
        when(pick(LEGACY_NAME, 2), pick(LEGACY_NAME, 3)).alias("ts"),
        pick(LEGACY_NAME, 4).alias("collector"),
    )
    return F.when(F.regexp_like(name, F.lit(REJECTED)), None).when(F.regexp_like(name, F.lit(NORMAL_NAME)), normal).when(F.regexp_like(name, F.lit(LEGACY_NAME)), legacy)


def time_argument(text: Column) -> Column:
    """Epoch seconds, Y-m-d with or without a time, or ISO with Z."""
    epoch = F.when(F.regexp_like(text, F.lit(r"^\d{9,11}$")), F.timestamp_seconds(text.try_cast("bigint")))
    formats = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(epoch, *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def slot_rule(rule: Column, ts: Column) -> Column:
    """Whether a named rule expects data in the slot; unknown rules never do."""
    minute, hour = F.minute(ts), F.hour(ts)
    return (
        F.when(rule == "always", True)
        .when(rule == "minute_mod_5", minute % 5 == 0)
        .when(rule == "minute_mod_15", minute % 15 == 0)
        .when(rule == "hour_mod_4", (minute == 0) & (hour % 4 == 0))
        .when(rule == "hour_mod_8", (minute == 0) & (hour % 8 == 0))
        .otherwise(False)
    )


def aligned_floor(ts: Column, seconds: int = 8 * 3600) -> Column:
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


#: Tier edges: upper bounds and labels, the last for everything above. Three schemes.
# fixed values: bounds and names of the tiers
TIERS = {
    "simulation": ((500, "1-500"), (2000, "501-2000"), (5000, "2001-5000"), (15000, "5001-15000"), (None, ">15000")),
    "dispersion": ((500, "0-500"), (1500, "501-1500"), (5000, "1501-5000"), (15000, "5001-15000"), (None, "15000+")),
    "plot": ((1000, "Top 1000"), (5000, "1k - 5k"), (15000, "5k - 15k"), (None, "15k+")),
}


def rank_tier(rank: Column, scheme: str = "simulation") -> Column:
    out = F.when(rank.isNull() | (rank <= 0), "Unknown")
    for bound, label in TIERS[scheme]:
        out = out.otherwise(label) if bound is None else out.when(rank <= bound, label)
    return out
