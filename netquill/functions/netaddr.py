"""Private-address test for IPv4 and IPv6 text, as a small JVM-side expression.

"Private" follows the IANA special-purpose registries (not globally reachable), plus
loopback and link-local. Text that is not an address is not private. The address blocks
are patterns over the text, so no parsing, lambda or Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquill.functions.scalars import strip

_O = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"  # one decimal octet
_G = r"[0-9a-f]{1,4}"  # one hexadecimal group

# Private IPv4 blocks, as patterns over dotted text.
_V4_BLOCKS = [
    rf"(?:0|10|127|24\d|25[0-5])(?:\.{_O}){{3}}",  # 0/8, 10/8, 127/8, 240/4
    rf"169\.254(?:\.{_O}){{2}}",
    rf"172\.(?:1[6-9]|2\d|3[01])(?:\.{_O}){{2}}",  # 172.16/12
    rf"192\.0\.0\.(?!9$|10$){_O}",  # 192.0.0/24 without .9 and .10
    rf"192\.0\.2\.{_O}",
    rf"192\.168(?:\.{_O}){{2}}",
    rf"198\.1[89](?:\.{_O}){{2}}",  # 198.18/15
    rf"198\.51\.100\.{_O}",
    rf"203\.0\.113\.{_O}",
]

# The same blocks as the last two groups of an IPv4-mapped address.
_MAPPED_BLOCKS = [
    r"0*[0-9a-f]{1,2}:.*",
    r"0?a[0-9a-f]{2}:.*",
    r"7f[0-9a-f]{2}:.*",
    r"f[0-9a-f]{3}:.*",
    r"a9fe:.*",
    r"ac1[0-9a-f]:.*",
    r"c000:(?!0*[9a]$)0*[0-9a-f]{1,2}",
    r"c000:0?2[0-9a-f]{2}",
    r"c0a8:.*",
    r"c61[23]:.*",
    r"c633:64[0-9a-f]{2}",
    r"cb00:71[0-9a-f]{2}",
]

# Private IPv6 blocks and exceptions, over eight unpadded groups.
_V6_BLOCKS = [
    r"(?:0+:){7}0*[01]",  # ::/128 and ::1/128
    r"(?:0+:){5}ffff:(?:" + "|".join(_MAPPED_BLOCKS) + ")",
    r"0*64:ff9b:0*1:.*",  # 64:ff9b:1::/48
    r"0*100:0+:0+:0+:.*",  # 100::/64
    r"2001:0*1?[0-9a-f]{1,2}:.*",  # 2001::/23
    r"2001:0*db8:.*",
    r"2002:.*",
    r"f[cd][0-9a-f]{2}:.*",  # fc00::/7
    r"fe[89ab][0-9a-f]:.*",  # fe80::/10
]
_V6_EXCEPTIONS = [
    r"2001:0*1:(?:0+:){5}0*[12]",
    r"2001:0*3:.*",
    r"2001:0*4:0*112:.*",
    r"2001:0*2[0-9a-f]:.*",
    r"2001:0*3[0-9a-f]:.*",
]

_V4_PRIVATE = "^(?:" + "|".join(_V4_BLOCKS) + ")$"
_V6_PRIVATE = "^(?!(?:" + "|".join(_V6_EXCEPTIONS) + ")$)(?:" + "|".join(_V6_BLOCKS) + ")$"
_GROUPS = rf"{_G}(?::{_G})*"
_V6_TEXT = rf"^(?:{_G}(?::{_G}){{7}}|(?:{_GROUPS})?::(?:{_GROUPS})?)$"
_DOTTED_TAIL = rf":({_O})\.({_O})\.({_O})\.({_O})$"


def _dotted_tail_as_hex(text: Column) -> Column:
    octet = lambda i: F.regexp_extract(text, _DOTTED_TAIL, i).try_cast("int")
    group = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
    return F.concat(F.regexp_extract(text, "^(.*:)", 1), group(1), F.lit(":"), group(3))


def ipv6_groups(text: Column) -> Column:
    """IPv6 text (zone and dotted tail allowed) -> eight ``:``-separated groups, else null."""
    bare = F.regexp_replace(F.lower(text), "%[^%]+$", "")
    plain = F.when(bare.contains("."), _dotted_tail_as_hex(bare)).otherwise(bare)
    count = F.length(F.regexp_replace(F.regexp_replace(plain, "[^:]+", "x"), ":", ""))
    filled = F.replace(plain, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - count)))
    return F.when(plain.rlike(_V6_TEXT) & (~plain.contains("::") | (count <= 7)), F.btrim(filled, F.lit(":")))


def is_private_ip(ip: Column) -> Column:
    """True for private, loopback and link-local addresses; never null.

    The literal ``0.0.0.0`` is treated as "no address". The IPv6 branch is only
    evaluated for text containing a colon.
    """
    text = strip(ip)
    verdict = (
        F.when(ip == "0.0.0.0", F.lit(False))
        .when(text.contains(":"), ipv6_groups(text).rlike(_V6_PRIVATE))
        .otherwise(text.rlike(_V4_PRIVATE))
    )
    return F.coalesce(verdict, F.lit(False))
