"""Column expressions on addresses, ports, flags and packet times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetmill.schemas import BLOCK_TTL_HOURS, TTL_TAG_PREFIX

# Well-known destination ports and the service each stands for.
SERVICE_PORTS = {
    20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain_u",
    80: "http", 110: "private", 143: "private", 443: "private", 445: "private",
    3306: "private", 3389: "private", 8080: "http",
}

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def service_of(protocol: Column, dst_port: Column) -> Column:
    """Service of a flow from the initiator's destination port; only tcp is mapped."""
    pairs = [F.lit(x) for kv in SERVICE_PORTS.items() for x in kv]
    named = F.element_at(F.create_map(*pairs), dst_port.cast("int"))
    return F.when(protocol == "tcp", F.coalesce(named, F.lit("private"))).otherwise("other")


# --- flag letters of one packet -------------------------------------------

def is_syn(flags: Column) -> Column:
    f = F.upper(flags)
    return f.contains("S") & ~f.contains("F") & ~f.contains("A")


def is_synack(flags: Column) -> Column:
    f = F.upper(flags)
    return f.contains("S") & f.contains("A")


def has_letter(flags: Column, letter: str) -> Column:
    return F.upper(flags).contains(letter)


# --- state of a whole connection ------------------------------------------

def connection_flag(syn: Column, synack: Column, rst: Column) -> Column:
    return (
        F.when(rst & ~synack, "REJ")
        .when(syn & ~synack, "S0")
        .when(rst, "RSTO")
        .otherwise("SF")
    )


def syn_error(syn: Column, synack: Column, rst: Column) -> Column:
    return (rst | syn) & ~synack


# --- connection key ---------------------------------------------------------

def from_first_endpoint(src_ip, src_port, dst_ip, dst_port) -> Column:
    """True when the sender is the smaller endpoint by (ip as text, port as number)."""
    return (src_ip < dst_ip) | ((src_ip == dst_ip) & (src_port <= dst_port))


def connection_key(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """Direction-agnostic key text ``ipA:pA|ipB:pB|protocol``.

    Never null, so joins on it add no null test that would evaluate the text twice.
    """
    src = F.concat(src_ip, F.lit(":"), src_port.cast("string"))
    dst = F.concat(dst_ip, F.lit(":"), dst_port.cast("string"))
    ahead = from_first_endpoint(src_ip, src_port, dst_ip, dst_port)
    text = F.concat(
        F.when(ahead, src).otherwise(dst), F.lit("|"),
        F.when(ahead, dst).otherwise(src), F.lit("|"), protocol,
    )
    return F.coalesce(text, F.lit(""))


def epoch_millis_text(us: Column) -> Column:
    """Seconds with three decimals, as a C-style ``%.3f`` of the double us/1e6 prints.

    The double nearest to a tie such as x.xxx500 lies above or below it. For the
    epoch seconds of 2004-2038 a double times 2**22 is a whole number, so the side is
    decided by exact integer arithmetic; elsewhere a tie goes to the even millisecond.
    """
    whole = F.floor(us / F.lit(1000)).cast("long")
    rest = us - whole * 1000
    secs = us / F.lit(1_000_000.0)
    scaled = (secs * F.lit(4194304.0)).cast("long")
    lhs = scaled.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(10,0)")
    rhs = us.cast("decimal(20,0)") * F.lit(4_194_304).cast("decimal(10,0)")
    exact_range = (secs >= F.lit(1073741824.0)) & (secs < F.lit(2147483648.0))
    even = whole + F.pmod(whole, F.lit(2))
    tie = (
        F.when(exact_range & (lhs > rhs), whole + 1)
        .when(exact_range & (lhs < rhs), whole)
        .otherwise(even)
    )
    ms = F.when(rest > 500, whole + 1).when(rest < 500, whole).otherwise(tie)
    sec = F.floor(ms / F.lit(1000)).cast("long")
    return F.concat(sec.cast("string"), F.lit("."),
                    F.lpad((ms - sec * 1000).cast("string"), 3, "0"))


def record_flow_id(conn_key: Column, start_us: Column) -> Column:
    return F.md5(F.concat(conn_key, F.lit("|"), epoch_millis_text(start_us)))


def iso_utc(us: Column) -> Column:
    """ISO-8601 UTC text; the fraction appears only when it is not zero."""
    ts = F.timestamp_micros(us)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.pmod(us, F.lit(1_000_000))
    return F.when(frac == 0, F.concat(base, F.lit("+00:00"))).otherwise(
        F.concat(base, F.lit("."), F.lpad(frac.cast("string"), 6, "0"), F.lit("+00:00")))


# --- block entries and their time-to-live tags ---------------------------------

def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def cidr_of(ip: Column) -> Column:
    return F.concat(ip, F.lit("/32"))


def ttl_tag_of(ip: Column, prefix: str = TTL_TAG_PREFIX) -> Column:
    return F.concat(F.lit(prefix), ip)


def ip_of_ttl_tag(tag: Column, prefix: str = TTL_TAG_PREFIX) -> Column:
    """Address carried by a tag key; null for foreign keys and bad addresses."""
    ip = F.substring(tag, len(prefix) + 1, 64)
    return F.when(tag.startswith(prefix) & is_ipv4(ip), ip)


def ttl_epoch(now_epoch: Column, hours: int = BLOCK_TTL_HOURS) -> Column:
    return (now_epoch + F.lit(max(1, hours) * 3600)).cast("long")
