"""Hosts of external boundaries."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def _is_shortest_ipv6(hosts: pd.Series) -> pd.Series:
    def ok(host: str | None) -> bool:
        try:
            return ipaddress.IPv6Address(host).compressed == host and "%" not in host
        except ValueError:
            return False

    return hosts.map(ok)


def is_host_name(host: Column) -> Column:
    """Lower-case ASCII labels of 1 to 63 characters, 253 in all, without a last dot; dotted IPv4 addresses are among them."""
    return F.coalesce((F.char_length(host) <= 253) & host.rlike(rf"^{LABEL}(?:\.{LABEL})*\z"), F.lit(False))


def is_external_host(host: Column) -> Column:
    """A host name, or an IPv6 address in its shortest form."""
    return is_host_name(host) | F.pandas_udf(_is_shortest_ipv6, BooleanType())(host)
