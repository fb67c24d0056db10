"""Screening of webhook URLs before an alert may name them."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .text import truthy
from .urls import ipv6_pattern, with_url_parts

# Hosts that hand out cloud credentials.
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.azure.com")
SCHEMES = ("http", "https")

_DOTTED = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"


# IPv4 networks that are private, local, multicast, reserved or
# for documentation, and the two addresses inside them that are public.
BLOCKED_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
PUBLIC_IPV4 = ("192.0.0.9", "192.0.0.10")


# Of the IPv6 space only 2000::/3 is global unicast; inside it these networks are for special purposes, as
# ranges of the first two groups of an address, and these parts of them are public after all.
GLOBAL_IPV6 = (0x2000, 0x3FFF)
SPECIAL_IPV6 = (
    (0x2001_0000, 0x2001_01FF),  # protocol assignments
    (0x2001_0DB8, 0x2001_0DB8),  # documentation
    (0x2002_0000, 0x2002_FFFF),  # relayed IPv4
    (0x3FFF_0000, 0x3FFF_0FFF),  # documentation
)
PUBLIC_IPV6 = ((0x2001_0003, 0x2001_0003), (0x2001_0020, 0x2001_003F))


def _groups(host: Column) -> Column:
    """The eight 16-bit numbers of a well-formed IPv6 address; a zone (``%eth0``) is left out."""
    bare = F.substring_index(host, "%", 1)
    tail = F.split(F.regexp_extract(bare, r"([0-9.]+)$", 1), r"\.")
    byte = lambda i: F.lpad(F.hex(F.try_element_at(tail, F.lit(i)).cast("int")), 2, "0")
    dotted = F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), byte(1), byte(2), F.lit(":"), byte(3), byte(4))
    plain = F.when(F.contains(bare, F.lit(".")), dotted).otherwise(bare)
    part = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left = part(F.substring_index(plain, "::", 1))
    right = F.when(F.contains(plain, F.lit("::")), part(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.conv(g, 16, 10).cast("bigint"))


def with_webhook_reason(
    df: DataFrame, url: str, out: str = "reason", allow_http: bool = False
) -> DataFrame:
    """Add why a webhook is refused, null when it is accepted.

    Host names pass: only literal addresses are judged. IPv4 addresses inside
    IPv6 ones (``::ffff:10.0.0.1``) are judged as what they stand for.
    """
    ranges = [
        (int(net.network_address), int(net.broadcast_address))
        for net in map(ipaddress.IPv4Network, BLOCKED_IPV4)
    ]
    parts = {name: f"__hook_{name}" for name in ("scheme", "host", "valid")}
    scheme, host, valid = (F.col(name) for name in parts.values())

    public = [int(ipaddress.IPv4Address(a)) for a in PUBLIC_IPV4]

    def judged(v):
        number = F.when(v("mapped"), v("tail")).otherwise(v("number"))
        in_range = reduce(or_, [number.between(low, high) for low, high in ranges])
        v4_blocked = F.coalesce(in_range & ~number.isin(*public), F.lit(False))
        within = lambda spans: reduce(or_, [v("head").between(low, high) for low, high in spans])
        outside = ~F.shiftright(v("head"), 16).between(*GLOBAL_IPV6)
        v6_blocked = F.coalesce(~v("mapped") & (outside | within(SPECIAL_IPV6) & ~within(PUBLIC_IPV6)), F.lit(False))
        return {
            "reason": F.when(truthy(F.col(url)).isNull(), F.lit("empty"))
            .when(~valid, F.lit("malformed"))
            .when(~scheme.isin(*SCHEMES), F.lit("scheme"))
            .when((scheme == "http") & F.lit(not allow_http), F.lit("https required"))
            .when(host == "", F.lit("no host"))
            .when(host.isin(*METADATA_HOSTS), F.lit("metadata host"))
            .when(v4_blocked | v6_blocked, F.lit("blocked address"))
        }

    screened = staged(
        with_url_parts(df, url, parts),
        "__addr_",
        lambda v: {
            "octets": F.when(host.rlike(_DOTTED), F.split(host, r"\.")),
            "v6": F.when(host.rlike(rf"^{ipv6_pattern()}(?:%[^%]+)?$"), host),
        },
        lambda v: {
            "number": reduce(
                lambda total, i: total * 256 + F.try_element_at(v("octets"), F.lit(i)).cast("bigint"),
                range(1, 5),
                F.lit(0).cast("bigint"),
            ),
            "groups": _groups(v("v6")),
        },
        lambda v: {
            "head": v("groups")[0] * 65536 + v("groups")[1],
            "tail": v("groups")[6] * 65536 + v("groups")[7],
            "mapped": F.coalesce((F.array_max(F.slice(v("groups"), 1, 5)) == 0) & (v("groups")[5] == 0xFFFF), F.lit(False)),
        },
        judged,
        keep={"reason": out},
    )
    return screened.drop(*parts.values())
