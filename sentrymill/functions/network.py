"""Expressions on IPv4 addresses and feed text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill.functions.text import strip

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def is_ipv4(c: Column) -> Column:
    """Dotted quad, 0-255 each, no leading zeros; blanks around it are ignored."""
    return strip(c).rlike(_IPV4)


def is_public(ip: Column, rfc1918: bool = False) -> Column:
    """False for the private prefixes. `rfc1918` covers all of 172.16.0.0/12, where
    the default knows 172.16. only."""
    private = reduce(lambda a, b: a | b, [ip.startswith(p) for p in D.PRIVATE_PREFIXES])
    if rfc1918:
        private = private | ip.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\.")
    return ~private


def network16(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 2), F.lit(".0.0/16"))


def host_name(ip: Column) -> Column:
    return F.concat(F.lit("host-"), F.translate(ip, ".", "-"), F.lit(".example.net"))


def asn_of(org: Column) -> Column:
    """First word of an organisation text; empty when there is none."""
    return F.coalesce(F.split_part(org, F.lit(" "), F.lit(1)), F.lit(""))


def engine_total(*counts: Column) -> Column:
    """Sum of the engine counts, the default panel size when the sum is 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts])
    return F.coalesce(F.nullif(total, F.lit(0)), F.lit(D.DEFAULT_ENGINES)).cast("long")


def undetected(total: Column, *counts: Column) -> Column:
    return F.greatest(reduce(lambda a, b: a - b, counts, total), F.lit(0))
