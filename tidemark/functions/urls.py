"""Url expressions: source types, shown hosts, safe links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import host

#: Second-level labels under which names are registered as under a top-level one.
SECOND_LEVELS = "ac co com edu gov net org".split()
LONGEST_URL = 2048
#: Endings of hosts that name no public site; numbers, brackets and hosts of one label name none either.
PRIVATE_HOST = r"^[0-9.]+$|^\[|(^|\.)(localhost|local|localdomain|internal|intranet|lan|home|corp|home\.arpa|onion|test|invalid|example)$|^[^.]*$"


def registrable(url: Column) -> Column:
    """The last two labels of the host; three under a country's second-level label."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    country = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n > 1, -2).otherwise(-1)).isin(*SECOND_LEVELS)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(country, 2).otherwise(1)), F.lit(3)), ".")


def shown_domain(url: Column) -> Column:
    """The host without its last label."""
    return F.regexp_replace(host(url), r"\.[^.]*$", "")


def public_https(url: Column) -> Column:
    """A url that is safe to show and to follow: https, no credentials, port, fragment or private host; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^http://", "https://"), "#.*$", "")
    authority = F.regexp_extract(plain, "(?i)^https://([^/?]*)", 1)
    hidden = plain.rlike(r"[\p{Cc}\p{Cf}\p{Z}]")  # controls, invisible characters and spaces of any kind
    name = F.regexp_replace(F.lower(authority), r"\.+$", "")  # a host's last dot says nothing
    odd = authority.contains("@") | authority.contains(":") | name.rlike(PRIVATE_HOST) | (name == "")
    return F.when(plain.rlike("(?i)^https://") & ~hidden & ~odd & (F.length(plain) <= LONGEST_URL), plain)


def web_url(url: Column) -> Column:
    """The trimmed url if it is an absolute http or https one; else null."""
    return F.when(F.trim(url).rlike(r"(?i)^https?://[^/\s]+"), F.trim(url))
