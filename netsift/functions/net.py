"""Address and port predicates as Columns, so they stay inside generated code."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_WORD = "[0-9a-fA-F]{1,4}"
_V6_FULL = rf"^{_WORD}(?::{_WORD}){{7}}\z"
_V6_SHORT = rf"^(?:{_WORD}(?::{_WORD})*)?::(?:{_WORD}(?::{_WORD})*)?\z"
_MAPPED = "0" * 20 + "ffff"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def ipv4_number(col: Column | str) -> Column:
    """Dotted quad as BIGINT, null for anything else."""
    ip = _c(col)
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")
    value = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    return F.when(ip.rlike(_V4), value)


def _ipv6_groups(col: Column | str) -> Column:
    """The eight 16-bit groups of an IPv6 address as hex words, null for anything else."""
    ip = F.lower(_c(col))
    tail = F.substring_index(ip, ":", -1)
    quad = lambda i: F.split_part(tail, F.lit("."), F.lit(i)).cast("bigint")
    pair = lambda i: F.hex(quad(i) * 256 + quad(i + 1))
    head = F.left(ip, F.length(ip) - F.length(tail))
    dotted = ip.contains(":") & tail.rlike(_V4)
    plain = F.when(dotted, F.lower(F.concat(head, pair(1), F.lit(":"), pair(3)))).otherwise(ip)
    words = lambda text: F.filter(F.split(text, ":"), lambda w: w != "")

    def groups(plain: Column) -> Column:
        sides = F.split(plain, "::")
        missing = F.lit(8) - F.size(words(plain))
        filled = F.concat(
            words(F.get(sides, F.lit(0))),
            F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))),
            words(F.get(sides, F.lit(1))),
        )
        return F.when(plain.rlike(_V6_FULL), F.split(plain, ":")).when(
            plain.rlike(_V6_SHORT) & (missing > 0), filled
        )

    return F.when(ip.contains(":"), _let(plain, groups))


def _joined(groups: Column, shown: Callable[[Column], Column]) -> Column:
    """The groups put together, null without groups."""
    return F.array_join(F.transform(groups, shown), "")


def ipv6_hex(col: Column | str) -> Column:
    """IPv6 text as 32 lower-case hex digits, null for anything else."""
    return _joined(_ipv6_groups(col), lambda w: F.lpad(w, 4, "0"))


def ip_bits(col: Column | str) -> Column:
    """Address family and bit string, e.g. ``4:00001010…``; a prefix of it is a network."""
    bits = lambda w: F.lpad(F.bin(F.conv(w, 16, 10).cast("bigint")), 16, "0")
    four = F.concat(F.lit("4:"), F.lpad(F.bin(ipv4_number(col)), 32, "0"))
    return F.coalesce(four, F.concat(F.lit("6:"), _joined(_ipv6_groups(col), bits)))


def _networks(cidrs: Iterable[str]) -> list:
    return [ipaddress.ip_network(c, strict=False) for c in cidrs]


def number_in_cidrs(number: Column, cidrs: Iterable[str]) -> Column:
    """Whether an IPv4 number lies in any of the IPv4 networks (one shift and compare for each)."""
    four = [n for n in _networks(cidrs) if n.version == 4]
    tests = (
        F.shiftright(number, 32 - n.prefixlen) == int(n.network_address) >> (32 - n.prefixlen)
        for n in four
    )
    return F.coalesce(any_of(tests), F.lit(False))


def ip_in_cidrs(col: Column | str, cidrs: Iterable[str]) -> Column:
    """True when the address lies in any network. Host bits are masked; families never mix."""
    cidrs = list(cidrs)
    six = [n for n in _networks(cidrs) if n.version == 6]
    result = F.lit(False)
    if len(six) < len(cidrs):
        result = number_in_cidrs(ipv4_number(col), cidrs)
    if six:
        inside = lambda x: any_of(
            x.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}")
            for n in six
        )
        result = result | F.coalesce(F.exists(F.array(ipv6_hex(col)), inside), F.lit(False))
    return result


def same_ip(left: Column | str, value: str) -> Column:
    """Address equality by value, so equal spellings of one IPv6 address match."""
    return ip_in_cidrs(left, [str(ipaddress.ip_address(value))])


def _either(side: str | None, make) -> Column:
    if side not in (None, "src", "dst"):
        raise ValueError("side must be 'src', 'dst' or None")
    names = {"src": ["source"], "dst": ["destination"], None: ["source", "destination"]}[side]
    return any_of(F.coalesce(make(n), F.lit(False)) for n in names)


def host(address: str, side: str | None = None) -> Column:
    return _either(side, lambda n: same_ip(f"{n}_ip", address))


def net(cidr: str, side: str | None = None) -> Column:
    if "/" not in cidr:
        raise ValueError("a network needs CIDR notation")
    return _either(side, lambda n: ip_in_cidrs(f"{n}_ip", [cidr]))


def port(number: int, side: str | None = None) -> Column:
    return portrange(number, number, side)


def portrange(low: int, high: int, side: str | None = None) -> Column:
    if not 1 <= low <= high <= 65535:
        raise ValueError("invalid port range")
    return _either(side, lambda n: F.col(f"{n}_port").between(low, high))


def ip_version(col: Column | str = "source_ip") -> Column:
    return F.when(_c(col).contains(":"), 6).otherwise(4)


def _ipv4_text(number: Column) -> Column:
    octet = lambda n: F.shiftright(number, n).bitwiseAND(F.lit(255)).cast("string")
    dot = F.lit(".")
    return F.concat(octet(24), dot, octet(16), dot, octet(8), dot, octet(0))


def _ipv6_text(digits: Column) -> Column:
    """Shortest text of 32 hex digits: the first longest run of two or more zero groups becomes
    ``::``, and an IPv4-mapped address ends in dotted form."""
    part = lambda d, i: F.regexp_replace(F.substring(d, 4 * i + 1, 4), "^0{1,3}", "")
    inner = lambda x, end: F.substring(x, F.lit(2), F.length(x) - end)

    def short(text: Column) -> Column:
        result = inner(text, 2)
        for n in range(2, 9):  # the longest run is asked last, so it wins
            run = ":0" * n + ":"
            at = F.instr(text, run)
            rest = F.substring(text, at + len(run), F.lit(64))
            cut = F.concat(inner(F.left(text, at - 1), 1), F.lit("::"), F.left(rest, F.length(rest) - 1))
            result = F.when(at > 0, cut).otherwise(result)
        return result

    def shown(d: Column) -> Column:
        low = F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint")
        text = F.concat(F.lit(":"), F.concat_ws(":", *[part(d, i) for i in range(8)]), F.lit(":"))
        return F.when(d.startswith(_MAPPED), F.concat(F.lit("::ffff:"), _ipv4_text(low))).when(
            d.isNotNull(), _let(text, short)
        )

    return _let(digits, shown)


def canonical_ip(col: Column | str) -> Column:
    """Canonical address text, null when invalid. A zone (``%eth0``) of an IPv6 address is kept."""
    ip = _c(col)
    address = F.substring_index(ip, "%", 1)
    zone = F.substring(ip, F.length(address) + 1, F.length(ip))
    six = F.when((zone == "") | zone.rlike(r"(?s)^%[^%]+\z"), F.concat(_ipv6_text(ipv6_hex(address)), zone))
    return F.when(ip.rlike(_V4), ip).otherwise(six)


def canonical_cidr(col: Column | str) -> Column:
    """Canonical network text with host bits masked, null when invalid or with a zone.

    Without a prefix the network is the one address. IPv4 also takes a netmask or host mask.
    """
    text = _c(col)
    address = F.substring_index(text, "/", 1)
    given = F.when(text.contains("/"), F.substring(text, F.length(address) + 2, F.length(text)))
    digits = F.when(given.rlike(r"^[0-9]+\z"), F.regexp_replace(given, "^0+(?=.)", ""))
    size = F.when(F.length(digits) <= 3, digits.cast("int"))
    mask = ipv4_number(given)
    host = F.lit(0xFFFFFFFF).cast("bigint") - mask
    ones = lambda n: n.bitwiseAND(n + 1) == 0
    masked = F.when(ones(host), 32 - F.bit_count(host)).when(ones(mask), 32 - F.bit_count(mask))
    step = lambda bits: F.pow(F.lit(2.0), bits).cast("bigint")

    four = F.when(given.isNull(), 32).otherwise(F.coalesce(size, masked))
    number = ipv4_number(address)
    v4 = lambda n, bits: F.concat(_ipv4_text(n - n % step(32 - bits)), F.lit("/"), bits.cast("string"))

    six = F.when(given.isNull(), 128).otherwise(size)

    def group(word: Column, i: Column, bits: Column) -> Column:
        value = F.conv(word, 16, 10).cast("bigint")
        kept = F.greatest(F.least(bits - 16 * i, F.lit(16)), F.lit(0))
        return F.lpad(F.lower(F.hex(value - value % step(16 - kept))), 4, "0")

    def v6(bits: Column) -> Column:
        cut = F.array_join(F.transform(_ipv6_groups(address), lambda w, i: group(w, i, bits)), "")
        return F.concat(_ipv6_text(cut), F.lit("/"), bits.cast("string"))

    return F.coalesce(
        F.when(four.between(0, 32), _let(number, lambda n: _let(four, lambda bits: v4(n, bits)))),
        F.when(six.between(0, 128), _let(six, v6)),
    )
