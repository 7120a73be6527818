"""Addresses in text: endpoints, one spelling for one address, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def endpoint_host(endpoint: Column) -> Column:
    """The address part of ip:port or [ip]:port as it is written; null for null or if there is no address."""
    bare = r"^(?:\[(?=[^\]]*\]))?((?<=\[)[^\]]*|[^:\[]*(?=:[^:]*$)|[^:\[]*$|[^\[]*:[^\[]*:.*$)"
    return F.nullif(F.regexp_extract(F.trim(endpoint), bare, 1), F.lit(""))


def endpoint_port(endpoint: Column) -> Column:
    """The port as INT; null where there is none or it is no number."""
    return F.regexp_extract(F.trim(endpoint), r"(?:\]|^[^:]*):(\d+)$", 1).try_cast("int")


def ipv4_number(text: Column) -> Column:
    """A dotted IPv4 address as BIGINT; null for any other text."""
    p = F.split(text, r"\.")
    n = sum((F.element_at(p, i + 1).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(text.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), n)


def ipv4_text(number: Column) -> Column:
    """The dotted form of an IPv4 number."""
    part = lambda s: F.shiftright(number, s).bitwiseAND(255).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: without it, an expression used k times in one used k times grows as k * k."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ipv6(t: Column) -> Column:
    """Lower-case IPv6 text with leading zeros dropped and the first longest run of zero groups written as ::."""
    none = F.array().cast("array<string>")
    side = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def groups(halves: Column) -> Column:
        cut = F.size(halves) > 1
        left, right = side(F.element_at(halves, 1)), F.when(cut, side(F.get(halves, F.lit(1)))).otherwise(none)
        fill = F.when(cut, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))).otherwise(none)
        return F.transform(F.concat(left, fill, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))

    def shorten(full: Column) -> Column:
        short = full
        for k in range(2, 9):  # the longest run is asked for first
            run = r"(?:^|:)0(?::0){%d}(?::|$)" % (k - 1)
            cut = F.concat(F.regexp_extract(full, f"^(.*?){run}", 1), F.lit("::"), F.regexp_extract(full, f"^.*?{run}(.*)$", 1))
            short = F.when(full.rlike(run), cut).otherwise(short)
        return F.when(full.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), short)

    return F.coalesce(_let(F.array_join(_let(F.split(t, "::"), groups), ":"), shorten), t)


def _mapped(six: Column) -> Column:
    """Dotted IPv4 for compressed IPv4-mapped IPv6, else the text as it is."""
    form = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    part = lambda i: F.conv(F.regexp_extract(six, form, i), 16, 10).cast("bigint")
    return F.when(six.rlike(form), _let(part(1) * 65536 + part(2), ipv4_text)).otherwise(six)


def canonical_address(host: Column) -> Column:
    """One spelling of an address: dotted IPv4 also for IPv4-mapped IPv6, IPv6 in lower case and compressed.

    Text that is no address is returned trimmed and in lower case, null stays null.
    """
    dotted = r"^(?:0{0,4}:){1,5}:?ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"

    def spelled(t: Column) -> Column:
        return F.when(t.rlike(dotted), F.regexp_extract(t, dotted, 1)).otherwise(_let(_ipv6(t), _mapped))

    t = F.lower(F.trim(host))
    return F.when(t.contains(":"), _let(t, spelled)).otherwise(t)


def endpoint_address(endpoint: Column) -> Column:
    """The address of an endpoint without its port, in one spelling."""
    return canonical_address(endpoint_host(endpoint))


def ip_bytes(address: Column) -> Column:
    """4 or 16 bytes of a canonical address; null for other text."""

    def six(t: Column) -> Column:
        halves = F.split(t, "::")
        side = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
        left = side(F.element_at(halves, 1))
        right = F.coalesce(side(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        return F.when((F.length(digits) == 32) & digits.rlike("^[0-9a-f]+$"), F.unhex(digits))

    return F.when(address.contains(":"), _let(address, six)).otherwise(F.unhex(F.lpad(F.hex(ipv4_number(address)), 8, "0")))
