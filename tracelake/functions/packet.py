"""Frame header decoding on hex text, as column expressions.

Ethernet (with one VLAN tag), IPv4, IPv6 without extension headers, TCP, UDP, ICMP and ICMPv6.
``truncated_at`` names the layer at which a frame ended early.

Headers are read as words of 8 bytes, one number each, and fields are shifts and masks of them. The
steps are plain projections, so the optimiser drops the words and fields that nobody wants; one
generator above them keeps filters on a result from being copied down into every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import ipv6_text, packet_flow_label

VLAN, IPV4, IPV6 = 0x8100, 0x0800, 0x86DD
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
# Names of the TCP flag bits.
TCP_FLAGS = (
    (0x01, "FIN"), (0x02, "SYN"), (0x04, "RST"), (0x08, "PSH"),
    (0x10, "ACK"), (0x20, "URG"), (0x40, "ECE"), (0x80, "CWR"),
)

DECODED = (
    "eth_dst", "eth_src", "ethertype", "vlan_ethertype", "ip_version", "ip_header_len", "ip_id",
    "ip_ttl", "ip_proto", "ip_length", "ip_src", "ip_dst", "src_port", "dst_port", "tcp_seq",
    "tcp_ack", "tcp_header_len", "tcp_flags", "tcp_window", "udp_length", "icmp_type",
    "icmp_code", "truncated_at",
)


# what can be asked for beside the decoded fields
DERIVED = ("proto", "flow", "fingerprint", "match")


def clean_hex(text: Column) -> Column:
    """Packet bytes text without quotes, ``0x`` and byte separators; blank if not whole bytes."""
    low = F.lower(text)
    bare = F.translate(F.trim(low), "\"' :-", "")
    bare = F.when(bare.startswith("0x"), F.substring(bare, F.lit(3), F.length(bare))).otherwise(bare)

    def whole(digits: Column) -> Column:
        return (F.length(digits) % 2 == 0) & F.unhex(digits).isNotNull()

    # plain digits, the usual case, need no cleaning
    return F.when(whole(low), low).when(whole(bare), bare).otherwise(F.lit(""))


def _word(frame: Column, at: Column | int, size: int) -> Column:
    """``size`` bytes of the frame as the bits of a number."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.substring(frame, at * 2 + 1, F.lit(size * 2))
    return F.conv(digits, 16, -10).cast("bigint")


def _bits(word: Column, shift: int, mask: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND(F.lit(mask))


def _mac(frame: Column, at: int) -> Column:
    return F.concat_ws(":", *[F.substring(frame, (at + i) * 2 + 1, 2) for i in range(6)])


def _quad(word: Column) -> Column:
    return F.concat_ws(".", *[_bits(word, shift, 255).cast("string") for shift in (24, 16, 8, 0)])


def _ipv6(digits: Column) -> Column:
    """Its long expression inside a lambda, so that the code generated for all frames stays small enough to be compiled."""
    return F.get(F.transform(F.array(digits), ipv6_text), 0)


def tcp_flag_names(flags: Column) -> Column:
    return F.filter(
        F.array(*[F.when(flags.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in TCP_FLAGS]),
        lambda name: name.isNotNull(),
    )


def decode_packets(
    df: DataFrame, packet_hex: str = "packet_hex", *, fields: Sequence[str] = DECODED, size: Column | None = None,
) -> DataFrame:
    """Add the wanted ``fields`` for the frame in ``packet_hex``: those in ``DECODED`` and ``DERIVED``.

    ``proto`` and ``flow`` name the transport and the flow, ports being 0 where absent;
    ``fingerprint`` and ``match`` are the keys of :func:`fingerprint` and :func:`match_key`, the first from ``size``
    (default the column of that name).
    """
    unknown = set(fields) - {*DECODED, *DERIVED}
    if unknown:
        raise ValueError(f"not fields of a packet: {sorted(unknown)}")
    given = [c for c in df.columns if c not in fields]
    p, n = F.col("_p"), F.col("_n")
    d = df.select(*given, F.col(packet_hex).alias("_hex"), *([size.alias("_size")] if size is not None else []))
    d = d.withColumns({"_p": clean_hex(F.coalesce("_hex", F.lit("")))})
    d = d.withColumns({"_n": (F.length("_p") / 2).cast("int"), "_et": F.when(F.length("_p") >= 28, _word(p, 12, 2))})
    tagged = F.coalesce(F.col("_et") == VLAN, F.lit(False))
    d = d.withColumns({
        "_eth_dst": F.when(n >= 14, _mac(p, 0)), "_eth_src": F.when(n >= 14, _mac(p, 6)),
        "_vlan": F.when(tagged & (n >= 18), _word(p, 16, 2)), "_tagged": tagged, "_ip": F.when(tagged, F.lit(18)).otherwise(F.lit(14)),
    })
    ip = F.col("_ip")
    l3 = F.when(F.col("_tagged"), F.col("_vlan")).otherwise(F.col("_et"))
    has_ip = n >= ip + 20
    d = d.withColumns({
        "_l3": l3, "_q0": F.when(has_ip, _word(p, ip, 8)), "_q1": F.when(has_ip, _word(p, ip + 8, 8)),
    })
    q0, q1 = F.col("_q0"), F.col("_q1")
    d = d.withColumns({
        "_v4": F.coalesce(F.col("_l3") == IPV4, F.lit(False)), "_v6": F.coalesce(F.col("_l3") == IPV6, F.lit(False)),
        "_hl": (_bits(q0, 56, 15) * 4).cast("int"), "_vn": _bits(q0, 60, 15).cast("int"),
    })
    v4, v6, hl = F.col("_v4"), F.col("_v6"), F.col("_hl")
    d = d.withColumns({
        "_ok4": F.coalesce(v4 & (F.col("_vn") == 4) & (hl >= 20) & (n >= ip + hl), F.lit(False)), "_ok6": v6 & (n >= ip + 40),
    })
    ok4, ok6 = F.col("_ok4"), F.col("_ok6")

    def either(four: Column, six: Column) -> Column:
        return F.when(ok4, four).when(ok6, six)

    d = d.withColumns({
        "_proto": either(_bits(q1, 48, 255), _bits(q0, 8, 255)).cast("int"), "_l4": either(ip + hl, ip + 40).cast("int"),
        "_d4": F.when(ok4, _word(p, ip + 16, 4)),
    })
    l4, proto = F.col("_l4"), F.col("_proto")
    d = d.withColumns({
        "_src": F.when(ok4, _quad(q1)).when(ok6, _ipv6(F.substring(p, (ip + 8) * 2 + 1, F.lit(32)))),
        "_dst": F.when(ok4, _quad(F.col("_d4"))).when(ok6, _ipv6(F.substring(p, (ip + 24) * 2 + 1, F.lit(32)))),
        "_is_tcp": F.coalesce(proto == TCP, F.lit(False)), "_is_udp": F.coalesce(proto == UDP, F.lit(False)),
        "_is_icmp": F.coalesce(proto.isin(ICMP, ICMPV6), F.lit(False)),
    })
    d = d.withColumns({
        "_has_tcp": F.col("_is_tcp") & (n >= l4 + 20), "_has_udp": F.col("_is_udp") & (n >= l4 + 8), "_has_icmp": F.col("_is_icmp") & (n >= l4 + 4),
    })
    has_tcp, has_udp, has_icmp = F.col("_has_tcp"), F.col("_has_udp"), F.col("_has_icmp")
    d = d.withColumns({
        "_t0": F.when(has_tcp | has_udp, _word(p, l4, 8)), "_t1": F.when(has_tcp, _word(p, l4 + 8, 8)), "_i0": F.when(has_icmp, _word(p, l4, 2)),
    })
    t0, t1, i0 = F.col("_t0"), F.col("_t1"), F.col("_i0")
    d = d.withColumns({"_thl": _bits(t1, 28, 15) * 4})
    real = F.coalesce(F.col("_thl") >= 20, F.lit(False))
    d = d.withColumns({"_real": real, "_full": real & F.coalesce(n >= l4 + F.col("_thl"), F.lit(False))})
    real, full, ports = F.col("_real"), F.col("_full"), has_tcp | has_udp
    found = {
        "eth_dst": F.col("_eth_dst"), "eth_src": F.col("_eth_src"), "ethertype": F.col("_et"), "vlan_ethertype": F.col("_vlan"),
        "ip_version": F.when(v4 & q0.isNotNull(), F.col("_vn")).when(ok6, F.lit(6)), "ip_header_len": F.when(ok4, hl),
        "ip_id": F.when(ok4, _bits(q0, 16, 0xFFFF)), "ip_ttl": either(_bits(q1, 56, 255), _bits(q0, 0, 255)).cast("int"), "ip_proto": proto,
        "ip_length": either(_bits(q0, 32, 0xFFFF), _bits(q0, 16, 0xFFFF)), "ip_src": F.col("_src"), "ip_dst": F.col("_dst"),
        "src_port": F.when(ports, _bits(t0, 48, 0xFFFF)), "dst_port": F.when(ports, _bits(t0, 32, 0xFFFF)),
        "tcp_seq": F.when(real, _bits(t0, 0, 0xFFFFFFFF)), "tcp_ack": F.when(real, _bits(t1, 32, 0xFFFFFFFF)), "tcp_header_len": F.when(full, F.col("_thl")),
        "tcp_flags": F.when(real, _bits(t1, 16, 0x1FF)), "tcp_window": F.when(full, _bits(t1, 0, 0xFFFF)),
        "udp_length": F.when(has_udp, _bits(t0, 16, 0xFFFF)),
        "icmp_type": F.when(has_icmp, _bits(i0, 8, 255)), "icmp_code": F.when(has_icmp, _bits(i0, 0, 255)),
        "truncated_at": F.when(~(n >= 14), F.lit("eth"))
        .when(F.col("_tagged") & (n < 18), F.lit("vlan"))
        .when((v4 & ~ok4) | (v6 & ~ok6), F.lit("ip"))
        .when(F.col("_is_tcp") & ~full, F.lit("tcp"))
        .when(F.col("_is_udp") & ~has_udp, F.lit("udp"))
        .when(F.col("_is_icmp") & ~has_icmp, F.when(proto == ICMP, F.lit("icmp")).otherwise(F.lit("icmpv6"))),
    }
    d = d.select(*given, *(["_size"] if size is not None else []), *[found[c].alias(c) for c in DECODED])
    d = d.withColumns({"proto": protocol_name()})
    zero = F.lit(0).cast("bigint")
    d = d.withColumns({
        "flow": packet_flow_label(F.col("ip_src"), F.coalesce("src_port", zero), F.col("ip_dst"), F.coalesce("dst_port", zero), F.col("proto")),
        **({"fingerprint": fingerprint(F.col("size" if size is None else "_size"))} if "fingerprint" in fields else {}), "match": match_key(),
    })
    return d.select(*given, F.inline(F.array(F.struct(*fields)))) if fields else d.select(*given)


def protocol_name() -> Column:
    """Transport of a decoded packet; ``proto-N`` for other numbers, ``other`` where there is none."""
    number = F.col("ip_proto")
    return (
        F.when(number == TCP, F.lit("tcp")).when(number == UDP, F.lit("udp"))
        .when(number == ICMP, F.lit("icmp")).when(number == ICMPV6, F.lit("icmpv6"))
        .when(number.isNotNull(), F.concat(F.lit("proto-"), number.cast("string"))).otherwise(F.lit("other"))
    )


def ip_payload_length() -> Column:
    four = F.greatest(F.lit(0), F.coalesce("ip_length", F.lit(0)) - F.coalesce("ip_header_len", F.lit(0)))
    return F.when(F.col("ip_version") == 4, four).when(
        F.col("ip_version") == 6, F.coalesce("ip_length", F.lit(0))
    ).otherwise(F.lit(0))


def fingerprint(size: Column) -> Column:
    """Text key that identifies the same packet at several capture points; null if undecoded."""
    ip_id = F.when(F.coalesce("ip_id", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("ip_id"))
    payload = ip_payload_length()
    tcp_payload = F.greatest(F.lit(0), payload - F.coalesce("tcp_header_len", F.lit(0)))

    def key(*parts: Column) -> Column:
        return F.concat_ws("|", *[part.cast("string") for part in parts])

    zero = F.lit(0)
    ends = (F.col("ip_src"), F.col("ip_dst"))
    ports = (F.col("src_port"), F.col("dst_port"))
    has_ports = F.col("src_port").isNotNull()
    return F.when(
        F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull() & F.col("ip_proto").isNotNull(),
        F.when(
            (F.col("ip_proto") == TCP) & has_ports,
            key(F.lit("tcp"), *ends, *ports, F.coalesce("tcp_seq", zero), F.coalesce("tcp_ack", zero),
                F.coalesce("tcp_flags", zero), tcp_payload, ip_id, size),
        )
        .when(
            (F.col("ip_proto") == UDP) & has_ports,
            key(F.lit("udp"), *ends, *ports, F.coalesce("udp_length", zero), ip_id, size),
        )
        .otherwise(key(F.lit("ip"), *ends, F.col("ip_proto"), ip_id, payload, size)),
    )


def match_key() -> Column:
    """Text key that pairs a sent packet with its receipt: sequence for TCP, IP id for UDP."""
    ends = (F.col("ip_src"), F.col("ip_dst"), F.col("src_port").cast("string"), F.col("dst_port").cast("string"))
    return F.when(
        F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull(),
        F.when(
            (F.col("ip_proto") == TCP) & F.col("tcp_seq").isNotNull(),
            F.concat_ws("|", F.lit("tcp"), *ends, F.col("tcp_seq").cast("string")),
        ).when(
            (F.col("ip_proto") == UDP) & F.col("ip_id").isNotNull() & F.col("src_port").isNotNull(),
            F.concat_ws("|", F.lit("udp"), *ends, F.col("ip_id").cast("string")),
        ),
    )
