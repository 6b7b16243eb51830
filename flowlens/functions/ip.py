"""IP address expressions.  On flow rows they are built-in functions without lambdas,
so they stay in codegen; tables of networks and of distinct addresses are parsed
by an Arrow function.

* ``ip_key``: address text -> 32 hex digits that sort as the address does; IPv4
  is held as its mapped form (``::ffff:a.b.c.d``), as Go's ``net.ParseIP`` does.
* ``is_private`` / ``is_external`` / ``cidr_match`` match the text (or the key) with one pattern
  made of a short parameter list of networks; a large network *table* goes through ``flowlens.operators.rangejoin``.
* ``with_cidr`` / ``mask_key``: network text -> prefix length and masked key.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OCT = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"
_V6_FULL = r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
#: Key digits before the 32 bits of an IPv4 address.
MAPPED = "0" * 20 + "ffff"

# fixed values: private networks of the connection audit (is_external)
AUDIT_PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                 "::1/128", "fc00::/7"]
# fixed values: private networks of the threat scorer / geo lookup
SCORER_PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8",
                  "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10"]
# fixed values: prefix patterns used inside the reference SQL (LIKE form)
LIKE_PRIVATE_PREFIXES = ["10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2",
                         "172.30.", "172.31.", "192.168.", "127."]


_GROUP = "[0-9a-f]{1,4}"
_MAPPED_TEXT = "(?:(?:::|(?:0{1,4}:){5})ffff:)?"


def _address_pattern() -> str:
    """All spellings of an address in lower case: dotted, eight groups, groups around
    one run of zeros, and the dotted mapped form."""
    forms = [IPV4_RE[1:-1], f"{_GROUP}(?::{_GROUP}){{7}}", _MAPPED_TEXT[:-1] + IPV4_RE[1:-1]]
    for n in range(8):  # groups before the zeros
        left = f"{_GROUP}(?::{_GROUP}){{{n - 1}}}" if n else ""
        right = f"(?:{_GROUP}(?::{_GROUP}){{0,{6 - n}}})?" if n < 7 else ""
        forms.append(f"{left}::{right}")
    return "^(?:" + "|".join(forms) + ")$"


ADDRESS_RE = _address_pattern()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_to_long(ip) -> Column:
    ip = _c(ip)
    parts = F.split(ip, r"\.")
    val = (parts.getItem(0).cast("bigint") * 16777216 + parts.getItem(1).cast("bigint") * 65536
           + parts.getItem(2).cast("bigint") * 256 + parts.getItem(3).cast("bigint"))
    return F.when(ip.rlike(IPV4_RE), val)


def _hex8(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 8, "0"))


_PAD = r"(?<![0-9a-f])([0-9a-f]{1,3})(?![0-9a-f])"


def _v6_key(t: Column) -> Column:
    """Key of lower-case hex groups; null when they aren't an IPv6 address.

    A run of zeros is written out by the number of colons; what isn't eight
    groups of one to four digits then fails the pattern.
    """
    colons = F.length(t) - F.length(F.replace(t, F.lit(":")))
    more = F.lit(7) - colons + t.startswith("::").cast("int") + t.endswith("::").cast("int")
    spread = F.trim(F.replace(t, F.lit("::"), F.concat(F.lit(":0"), F.repeat(F.lit(":0"), more), F.lit(":"))), F.lit(":"))
    padded = F.when(t.contains("::"), spread).otherwise(t)
    for _ in range(3):  # a leading zero to each group of less than four digits
        padded = F.regexp_replace(padded, _PAD, "0$1")
    key = F.regexp_extract(padded, "^" + ":".join(["([0-9a-f]{4})"] * 8) + "$", 0)
    return F.when(F.length(key) == 39, F.replace(key, F.lit(":")))


_DOTTED = r"^(?:::|(?:0{1,4}:){5})ffff:[0-9.]+$"


def ip_key(ip) -> Column:
    """32 hex digits of an address, null when the text is none.  IPv4 (the common
    case) never enters the IPv6 branches; of dotted forms the mapped one counts."""
    ip = _c(ip)
    low = F.lower(ip)
    v4 = _hex8(ipv4_to_long(F.when(low.rlike(_DOTTED), F.substring_index(ip, ":", -1)).otherwise(ip)))
    return F.when(ip.contains(":") & ~ip.contains("."), _v6_key(low)).otherwise(F.concat(F.lit(MAPPED), v4))


def is_v4_key(key: Column) -> Column:
    return key.startswith(MAPPED)


def _net_pattern(cidr: str) -> str:
    """Regular expression for the keys of a network parameter; an IPv6 network holds
    no IPv4 address."""
    net = ipaddress.ip_network(cidr, strict=False)
    bits = net.prefixlen + (96 if net.version == 4 else 0)
    first = (MAPPED if net.version == 4 else "") + f"{int(net.network_address):0{8 if net.version == 4 else 32}x}"
    whole, part = divmod(bits, 4)
    text = first[:whole]
    if part:
        low = int(first[whole], 16)
        text += "[" + "".join(f"{d:x}" for d in range(low, low + (1 << (4 - part)))) + "]"
    return text if net.version == 4 or bits >= 96 else f"(?!{MAPPED}){text}"


def key_in_networks(key: Column, cidrs: list[str]) -> Column:
    """True if the key lies in any of ``cidrs``; null for a null key.  The key stands
    here once."""
    return key.rlike("^(?:" + "|".join(map(_net_pattern, cidrs)) + ")")


def _text_pattern(cidr: str) -> str | None:
    """Pattern over the lower-case text of valid addresses for a network parameter;
    None where the text has too many forms (an IPv6 network within its groups)."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        whole, part = divmod(net.prefixlen, 8)
        octets = net.network_address.packed
        text = "".join(f"{o}\\." for o in octets[:whole])
        if part:
            text += "(?:" + "|".join(map(str, range(octets[whole], octets[whole] + (1 << (8 - part))))) + ")(?:\\.|$)"
        return _MAPPED_TEXT + (text if whole < 4 else text[:-2] + "$")
    if int(net.network_address) == 1 and net.prefixlen == 128:
        return "[0:]*:0{0,3}1$"
    first = f"{int(net.network_address) >> 112:04x}"
    whole, part = divmod(net.prefixlen, 4)
    if first[0] == "0" or net.prefixlen > 16 or not net.prefixlen:
        return None
    low = int(first[whole], 16) if part else 0
    some = "[" + "".join(f"{d:x}" for d in range(low, low + (1 << (4 - part)))) + "]" if part else ""
    return f"{first[:whole]}{some}[0-9a-f]{{{4 - whole - bool(part)}}}:"


def in_networks(ip, cidrs: list[str]) -> Column:
    """True if ``ip`` lies in any of ``cidrs``; null when ``ip`` is not an address.
    Networks whose text has a plain form are matched on the text, the others on
    the key."""
    low = F.lower(_c(ip))
    plain = [p for p in map(_text_pattern, cidrs) if p]
    other = [c for c in cidrs if not _text_pattern(c)]
    inside = low.rlike("^(?:" + "|".join(plain) + ")") if plain else F.lit(False)
    if other:
        inside = inside | F.coalesce(key_in_networks(ip_key(ip), other), F.lit(False))
    return F.when(low.rlike(ADDRESS_RE), inside)


def is_valid_ip(ip) -> Column:
    return F.coalesce(F.lower(_c(ip)).rlike(ADDRESS_RE), F.lit(False))


def is_private(ip, cidrs: list[str] = SCORER_PRIVATE) -> Column:
    """Private per the scorer list; invalid -> False."""
    return F.coalesce(in_networks(ip, cidrs), F.lit(False))


def is_external(ip, cidrs: list[str] = AUDIT_PRIVATE) -> Column:
    """Valid and not private; invalid -> False (as in the audit handler)."""
    return F.coalesce(~in_networks(ip, cidrs), F.lit(False))


def is_external_like(ip) -> Column:
    """The prefix-LIKE test embedded in the reference SQL (keeps its quirks:
    '172.2' also hides public 172.2.x and 172.200+)."""
    ip = _c(ip)
    hit = F.lit(False)
    for p in LIKE_PRIVATE_PREFIXES:
        hit = hit | ip.startswith(p)
    return ~hit


def cidr_match(ip, cidrs: list[str]) -> Column:
    return F.coalesce(in_networks(ip, cidrs), F.lit(False))


_DIGITS = "0123456789abcdef"
#: A hex digit with its lower bits cleared, by the number of bits kept.
_CLEARED = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}


def mask_key(key: Column, bits: Column) -> Column:
    """Key with all but its first ``bits`` (0 to 128) cleared."""
    whole, part = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    digit = F.substring(key, whole + 1, F.lit(1))
    masked = F.when(part == 0, "")
    for n, to in _CLEARED.items():
        masked = masked.when(part == n, F.translate(digit, _DIGITS, to))
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole), masked), 32, "0")


def _key_of(address) -> str:
    return f"{int(address):032x}" if address.version == 6 else f"{MAPPED}{int(address):08x}"


def _address(text: str):
    try:
        return None if "%" in text else ipaddress.ip_address(text)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def address_key(text: pd.Series) -> pd.Series:
    """``ip_key`` for tables of distinct addresses: all spellings, one Arrow call a batch."""
    return text.map(lambda t: _key_of(a) if t and (a := _address(t)) else None).astype(object)


_BOUNDS = T.StructType([T.StructField("lo", T.StringType()), T.StructField("hi", T.StringType()),
                        T.StructField("bits", T.IntegerType())])


@F.pandas_udf(_BOUNDS)
def cidr_bounds(text: pd.Series) -> pd.DataFrame:
    """Key bounds and key prefix length of CIDR or bare address text; nulls when it is
    neither.  IPv4 prefixes count from the mapped form, so /24 is 120."""
    def parse(t: str | None):
        address, slash, length = (t or "").strip().partition("/")
        a = _address(address)
        if a is None or (slash and not (length.isascii() and length.isdigit() and int(length) <= a.max_prefixlen)):
            return None, None, None
        net = ipaddress.ip_network((a, int(length) if slash else a.max_prefixlen), strict=False)
        return _key_of(net.network_address), _key_of(net.broadcast_address), net.prefixlen + 128 - net.max_prefixlen
    out = pd.DataFrame([parse(t) for t in text], columns=["lo", "hi", "bits"], dtype=object)
    return out.astype({"bits": "Int32"})


def with_cidr(df, col: str, prefix: str = ""):
    """Add ``<prefix>lo``, ``hi`` and ``bits`` of a column of network text (rules, lists)."""
    out = df.withColumn("_cidr", cidr_bounds(col))
    return out.withColumns({f"{prefix}{n}": F.col(f"_cidr.{n}") for n in ("lo", "hi", "bits")}).drop("_cidr")


# ---- DuckDB text of the same tests, for oracle SQL ---------------------------

def duck_ipv4_long(e: str) -> str:
    return (f"(CASE WHEN regexp_full_match({e}, '{IPV4_RE[1:-1]}') THEN "
            f"CAST(split_part({e}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({e}, '.', 2) AS BIGINT) * 65536"
            f" + CAST(split_part({e}, '.', 3) AS BIGINT) * 256 + CAST(split_part({e}, '.', 4) AS BIGINT) END)")


def duck_in_v4(e: str, cidrs: list[str]) -> str:
    """IPv4-only DuckDB test (the test tables carry IPv4 addresses only)."""
    tests = []
    for c in cidrs:
        net = ipaddress.ip_network(c, strict=False)
        if net.version == 4:
            tests.append(f"{duck_ipv4_long(e)} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}")
    return "(" + " OR ".join(tests) + ")"


def duck_is_private(e: str, cidrs: list[str] = SCORER_PRIVATE) -> str:
    return f"COALESCE({duck_in_v4(e, cidrs)}, FALSE)"


def duck_is_external(e: str, cidrs: list[str] = AUDIT_PRIVATE) -> str:
    return f"COALESCE(NOT {duck_in_v4(e, cidrs)}, FALSE)"


def duck_is_external_like(e: str) -> str:
    return "NOT (" + " OR ".join(f"{e} LIKE '{p}%'" for p in LIKE_PRIVATE_PREFIXES) + ")"
