"""Scalar building blocks: every one is a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four risk ladders, highest level first. "gt" means strictly above the edge.
LADDERS = {
    "ensemble": ("gt", [("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.3)], "LOW"),
    "detect": ("ge", [("CRITICAL", 0.85), ("HIGH", 0.65), ("MEDIUM", 0.40)], "LOW"),
    "rule": ("ge", [("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.35)], "LOW"),
    "profile": ("gt", [("CRITICAL", 0.8), ("HIGH", 0.5)], "MEDIUM"),
}
# Protocols that are not anomalous.
COMMON_PROTOCOLS = ["TCP", "UDP", "ICMP", "tcp", "udp", "icmp", "6", "17", "1"]
# Ports of ordinary traffic in the rule score.
NORMAL_PORTS = [80, 443, 53, 123]


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(value), F.lit(low)), F.lit(high))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double, 0 when the denominator is 0."""
    part, whole = _c(part), _c(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"))


def risk_level(score: Column | str, ladder: str = "detect") -> Column:
    rule, steps, default = LADDERS[ladder]
    score = _c(score)
    chain = F
    for level, edge in steps:
        chain = chain.when(score > edge if rule == "gt" else score >= edge, F.lit(level))
    return chain.otherwise(F.lit(default))


def number_or(value: Column | str, default: float = 0.0) -> Column:
    """Tolerant numeric read: text that is not a finite number becomes ``default``."""
    parsed = F.expr("try_cast(NULL as double)") if value is None else _c(value).try_cast("double")
    bad = F.isnan(parsed) | (F.abs(parsed) == float("inf"))
    return F.coalesce(F.when(~bad, parsed), F.lit(default))


def attack_label(label: Column | str) -> Column:
    return (F.upper(F.trim(_c(label))) != "BENIGN").cast("int")


def packet_rate(packets: Column | str, duration: Column | str) -> Column:
    """Packets per second; a flow without duration counts as one burst."""
    packets = F.coalesce(_c(packets), F.lit(0)).cast("double")
    duration = F.coalesce(_c(duration), F.lit(0.0))
    return F.when(duration <= 0, F.greatest(packets, F.lit(0.0))).otherwise(packets / F.nullif(duration, F.lit(0.0)))


def derived_rate(packets: Column | str, duration: Column | str) -> Column:
    """Training-set rate: a zero duration is read as one millisecond."""
    return _c(packets).cast("double") / F.when(_c(duration) == 0, F.lit(0.001)).otherwise(_c(duration))


def two_port_entropy(dest: Column | str, src: Column | str) -> Column:
    """Entropy of the pair of ports of one flow: 1 bit when they differ, else 0."""
    return F.when(_c(dest) != _c(src), F.lit(1.0)).otherwise(F.lit(0.0))


def session_heuristic(duration: Column | str, sent: Column | str) -> Column:
    duration, sent = F.coalesce(_c(duration), F.lit(0.0)), F.coalesce(_c(sent), F.lit(0))
    return (
        F.when((duration < 1.0) & (sent > 50_000), F.lit(0.95))
        .when((duration < 5.0) & (sent > 20_000), F.lit(0.70))
        .otherwise(F.lit(0.15))
    )


def protocol_anomaly(protocol: Column | str) -> Column:
    known = F.coalesce(_c(protocol), F.lit("TCP")).isin(COMMON_PROTOCOLS)
    return F.when(known, F.lit(0.0)).otherwise(F.lit(1.0))


def time_of_day(ts: Column | str) -> Column:
    """Hour scaled to [0, 1]; 0.5 when the time is missing or unreadable text."""
    return F.coalesce(F.hour(_c(ts).try_cast("timestamp")) / F.lit(23.0), F.lit(0.5))


def off_hours(ts: Column | str) -> Column:
    return F.hour(_c(ts)).between(2, 6)


def seconds_left(deadline: Column | str, as_of: Column | str) -> Column:
    return F.greatest(F.lit(0), F.unix_seconds(_c(deadline)) - F.unix_seconds(_c(as_of)))


def pattern_title(name: Column | str) -> Column:
    return F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def verdict_from_text(text: Column | str) -> Column:
    text = _c(text)
    return (
        F.when(text.contains("NEUTRALIZE"), "NEUTRALIZE")
        .when(text.contains("ESCALATE"), "ESCALATE")
        .when(text.contains("SAFE"), "SAFE")
        .otherwise("MONITOR")
    )


# --- IP addresses -------------------------------------------------------------------------

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ipv4_number(ip: Column | str) -> Column:
    """Dotted IPv4 as BIGINT; null when the text is not a valid address."""
    ip = _c(ip)
    part = F.split(ip, r"\.")
    value = sum((F.get(part, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(part, F.lit(0)).try_cast("bigint") * F.lit(256**3))
    return F.when(ip.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), value)


def ipv4_network(number: Column | str, prefix: Column | str) -> Column:
    """Clear the host bits of an address number."""
    host = F.lit(32) - _c(prefix)
    return F.call_function("shiftleft", F.call_function("shiftright", _c(number), host), host)


def ipv6_groups(ip: Column | str) -> Column:
    """The eight 16-bit groups of an IPv6 text as ARRAY<BIGINT>; null when not valid."""
    ip = F.lower(_c(ip))
    halves = F.split(ip, "::")
    groups = lambda text: F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = F.lit(8) - F.size(head) - F.size(tail)
    parts = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    valid = (
        ip.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$")
        & ~ip.contains(":::")
        & (F.size(halves) <= 2)
        & F.forall(parts, lambda g: F.length(g) <= 4)
        & F.when(F.size(halves) == 2, missing >= 1).otherwise((missing == 0) & ~ip.rlike("^:|:$"))
    )
    return F.when(valid, F.transform(parts, lambda g: F.conv(g, 16, 10).cast("bigint")))


def ipv6_network(groups: Column, prefix: Column) -> Column:
    """Network of an IPv6 prefix as text of eight masked groups, usable as a join key."""
    masked = F.transform(
        groups,
        lambda g, i: (lambda drop: F.call_function("shiftleft", F.call_function("shiftright", g, drop), drop))(
            F.lit(16) - F.least(F.greatest(prefix - i * 16, F.lit(0)), F.lit(16))
        ),
    )
    return F.array_join(masked.cast("array<string>"), ":")


def register(spark) -> None:
    """Expose the scalar helpers to SQL as session functions."""
    ladder = ", ".join(f"'{n}'" for n in LADDERS)
    cases = " ".join(
        f"when ladder = '{name}' then case "
        + " ".join(f"when score {'>' if rule == 'gt' else '>='} {edge}e0 then '{level}'" for level, edge in steps)
        + f" else '{default}' end"
        for name, (rule, steps, default) in LADDERS.items()
    )
    spark.sql(
        f"create or replace temporary function risk_level(score double, ladder string) returns string "
        f"return case {cases} else raise_error('ladder must be one of {ladder.replace(chr(39), '')}') end"
    )
    spark.sql(
        "create or replace temporary function packet_rate(packets bigint, duration double) returns double "
        "return case when coalesce(duration, 0e0) <= 0e0 then cast(greatest(coalesce(packets, 0), 0) as double) "
        "else coalesce(packets, 0) / duration end"
    )
    spark.sql(
        "create or replace temporary function ipv4_number(ip string) returns bigint "
        f"return case when ip rlike '^{_OCTET}([.]{_OCTET}){{3}}$' then "
        "cast(split(ip, '[.]')[0] as bigint) * 16777216 + cast(split(ip, '[.]')[1] as bigint) * 65536 "
        "+ cast(split(ip, '[.]')[2] as bigint) * 256 + cast(split(ip, '[.]')[3] as bigint) end"
    )
