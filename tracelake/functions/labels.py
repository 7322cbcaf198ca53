"""Text labels: symbols, paths, process fields, endpoints, flows, lock frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "<unknown>"
# Names that stand for "no name".
BLANK_NAMES = ("", "unknown", "<unknown>", "nan")
# Process ids that stand for "no process".
PID_SENTINELS = (0, -1, 4294967295)


def is_blank_name(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)), F.lit("")).isin(*BLANK_NAMES)


def is_known_pid(pid: Column) -> Column:
    return F.coalesce(~pid.isin(*PID_SENTINELS), F.lit(False))


def known_name(name: Column) -> Column:
    """The name, or null where it is blank."""
    return F.when(~is_blank_name(name), name)


def symbol_module(label: Column) -> Column:
    """Module of ``module!function+0x1f``; ``module+0x1f`` is a bare module."""
    bare = F.regexp_replace(label, r"\+0x[0-9A-Fa-f]+$", "")
    return F.when(label.contains("!"), F.split_part(label, F.lit("!"), F.lit(1))).otherwise(bare)


def symbol_function(label: Column) -> Column:
    tail = F.regexp_extract(label, r"^[^!]*!(.*)$", 1)
    return F.when(
        label.contains("!"), F.regexp_replace(tail, r"\+0x[0-9A-Fa-f]+$", "")
    ).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    """Lower-case last part of a path with either separator, NULs removed."""
    return F.regexp_extract(F.lower(F.translate(path, "\0", "")), r"([^\\/]+)$", 1)


def process_field_name(field: Column) -> Column:
    """Name in ``name (pid)``; the whole field where it has another form."""
    clean = F.trim(field)
    form = r'^"?([^"]*)"?\s*\(\s*(-?\d+)\s*\)'
    return F.when(clean.rlike(form), F.trim(F.regexp_extract(clean, form, 1))).otherwise(clean)


def process_field_pid(field: Column) -> Column:
    text = F.regexp_extract(F.trim(field), r'^"?([^"]*)"?\s*\(\s*(-?\d+)\s*\)', 2)
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def endpoint_address(text: Column) -> Column:
    """Address in ``ip:port`` or ``[v6]:port``; text without a port is an address."""
    clean = F.trim(text)
    bracket = F.regexp_extract(clean, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(clean, r"^([^:]*):(\d+)$", 1)
    return (
        F.when(clean.startswith("["), bracket)
        .when(clean.rlike(r"^[^:]*:\d+$"), plain)
        .otherwise(clean)
    )


def endpoint_port(text: Column) -> Column:
    clean = F.trim(text)
    port = F.coalesce(
        F.nullif(F.regexp_extract(clean, r"^\[[^\]]*\]:(\d+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(clean, r"^[^:\[]*:(\d+)$", 1), F.lit("")),
    )
    return F.coalesce(port.try_cast("bigint"), F.lit(0).cast("bigint"))


def socket_address(raw: Column) -> Column:
    """``ip`` of a binary socket address (family 2 or 23, little endian family)."""
    text = F.hex(raw)
    family = F.substring(text, 1, 4)
    quad = F.concat_ws(
        ".", *[F.conv(F.substring(text, 9 + 2 * i, 2), 16, 10) for i in range(4)]
    )
    return F.when(family == "0200", quad).when(family == "1700", ipv6_text(F.substring(text, 17, 32)))


def socket_port(raw: Column) -> Column:
    return F.conv(F.substring(F.hex(raw), 5, 4), 16, 10).cast("int")


def ipv6_groups(hex32: Column) -> Column:
    """32 hex digits as ``:g:g:g:g:g:g:g:g:``, lower case and without leading zeros."""
    cut = F.concat(F.lit(":"), F.regexp_replace(F.lower(hex32), "(.{4})", "$1:"))
    return F.regexp_replace(cut, "(?<![0-9a-f])0{1,3}(?=[0-9a-f])", "")


def ipv6_squeezed(guarded: Column) -> Column:
    """IPv6 text of :func:`ipv6_groups`: the first longest run of at least two zero groups
    becomes ``::``."""
    text = F.regexp_replace(guarded, r"^(.*?):((?:0:){2,}+)(?!.*:\2(?:0:))", "$1::")
    return F.regexp_replace(text, "^:(?!:)|(?<!:):$", "")


def ipv6_text(hex32: Column) -> Column:
    """32 hex digits as IPv6 text; embedded IPv4 addresses keep their dotted form."""
    quad = F.concat_ws(
        ".", *[F.conv(F.substring(hex32, F.lit(25 + 2 * i), F.lit(2)), 16, 10) for i in range(4)]
    )
    mapped = F.lower(hex32).startswith("0" * 20 + "ffff")
    embedded = hex32.startswith("0" * 24) & (F.substring(hex32, 25, 4) != "0000")
    return F.when(
        F.length(hex32) == 32,
        F.when(mapped, F.concat(F.lit("::ffff:"), quad))
        .when(embedded, F.concat(F.lit("::"), quad))
        .otherwise(ipv6_squeezed(ipv6_groups(hex32))),
    )


def flow_label(local: Column, local_port: Column, remote: Column, remote_port: Column) -> Column:
    """Connection label ``local:port <-> remote:port``."""
    return F.concat(local, F.lit(":"), local_port, F.lit(" <-> "), remote, F.lit(":"), remote_port)


def packet_flow_label(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    known = (F.coalesce(src, F.lit("")) != "") & (F.coalesce(dst, F.lit("")) != "")
    text = F.concat(
        src, F.lit(":"), sport.cast("string"), F.lit(" -> "), dst, F.lit(":"),
        dport.cast("string"), F.lit("/"), proto,
    )
    return F.when(known, text).otherwise(F.lit("undecoded"))


# Lock functions looked for in waking stacks.
LOCK_PATTERNS = (
    "KeAcquireInStackQueuedSpinLock",
    "KeAcquireSpinLock",
    "KeTryToAcquireSpinLock",
    "ExAcquireResourceExclusiveLite",
    "ExAcquireResourceSharedLite",
    "ExAcquireFastMutex",
)
# Lock functions that name a contention site.
LOCK_SITES = (
    "KeAcquireInStackQueuedSpinLock",
    "KeAcquireSpinLock",
    "ExAcquireResourceExclusiveLite",
    "ExAcquireFastMutex",
)


def mentions_lock(stack_text: Column) -> Column:
    return F.coalesce(stack_text.rlike("(?i)" + "|".join(LOCK_PATTERNS)), F.lit(False))


def contention_site(stack_text: Column) -> Column:
    """``lock frame <- caller`` for the first lock frame, else the first frame; a lone frame as it is."""
    frames = F.transform(F.split(stack_text, r" / |\n| <- "), lambda frame: F.trim(frame))
    # the last frame has no caller
    calls = F.zip_with(frames, F.slice(frames, 2, F.size(frames)), lambda frame, caller: F.struct(frame.alias("frame"), F.coalesce(caller, F.lit("?")).alias("caller")))
    lock = F.get(F.filter(calls, lambda call: call["frame"].rlike("(?i)" + "|".join(LOCK_SITES))), 0)
    return F.when(F.size(frames) == 1, stack_text).otherwise(
        F.coalesce(F.concat(lock["frame"], F.lit(" <- "), lock["caller"]), F.get(frames, 0)))
