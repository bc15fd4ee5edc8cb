"""Canonical URLs under a source's policy.

The URL is split by regular expressions, never by a parser that keeps host case
or dot segments. The result is a struct of the canonical URL and, where it is
refused, a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower

_SPLIT = r"^([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def normalize_host(host: Column) -> Column:
    """Trimmed, without dots at the end, lower case for A-Z."""
    return ascii_lower(F.regexp_replace(F.trim(host), r"\.+$", ""))


def host_is_allowed(host: Column, allowed: Column, include_subdomains: Column) -> Column:
    """Whether a normalised host is listed, or lies under a listed one at a dot if subdomains count."""

    def fits(entry: Column) -> Column:
        name = normalize_host(entry)
        under = F.endswith(host, F.concat(F.lit("."), name)) & (F.char_length(host) > F.char_length(name) + 1)
        return (host == name) | (include_subdomains & under)

    return F.exists(allowed, fits)


def path_is_allowed(path: Column, prefixes: Column) -> Column:
    """Whether a path is a listed prefix or goes on from it at a slash; / allows all."""

    def fits(entry: Column) -> Column:
        base = F.regexp_replace(entry, "/+$", "")
        return (entry == "/") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))

    return F.exists(prefixes, fits)


def _encoded(c: Column, also: str) -> Column:
    """Percent-encodes blanks, controls, the characters ``also`` and all beyond ASCII."""
    unsafe = r"[\x00-\x20\x7f" + also + r"]|[^\x00-\x7f]"

    def one(x: Column) -> Column:
        return F.when(x.rlike(unsafe), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")).otherwise(x)

    return F.when(c.rlike(unsafe), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments resolved."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        low = ascii_lower(part)
        up = low.isin("..", ".%2e", "%2e.", "%2e%2e")
        here = low.isin(".", "%2e")
        shorter = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(empty)
        return F.when(up, shorter).when(here, done).otherwise(F.concat(done, F.array(part)))

    last = ascii_lower(F.element_at(parts, -1))
    tail = F.when(last.isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e"), F.array(F.lit(""))).otherwise(empty)
    has_dots = F.exists(parts, lambda p: ascii_lower(p).isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e"))
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, empty, step), tail), "/"))
    return F.when(has_dots, resolved).otherwise(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def with_canonical_url(
    df: DataFrame, out: str, url: Column, allowed_hosts: Column, include_subdomains: Column, path_prefixes: Column
) -> DataFrame:
    """``df`` with ``out``, a struct (canonical, reject_reason) of the URL under a policy; one of the two is null.

    Kept: the query, an unusual port, a dot at the host's end. Dropped: the
    fragment, the scheme's own port. Lower-cased: scheme and host. Resolved: dot
    segments. An empty path becomes /. Steps are columns of their own on the way,
    so that what several steps use is computed once.
    """
    steps: list[str] = []

    def step(name: str, value: Column) -> Column:
        nonlocal df
        column = f"__{out}_{name}"
        df = df.withColumn(column, value)
        steps.append(column)
        return F.col(column)

    raw = step("raw", F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""))
    scheme = step("scheme", ascii_lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    rest = step("all", F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*", ""))
    # Backslashes before the query count as slashes.
    head = step("head", F.translate(F.regexp_extract(rest, r"^([^?#]*)", 1), "\\", "/"))
    rest = step("rest", F.concat(head, F.substring(rest, F.char_length(head) + 1, F.char_length(rest))))
    authority = step("authority", F.regexp_extract(rest, _SPLIT, 1))
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    place = step("place", F.regexp_replace(authority, r"^.*@", ""))
    shown = step("shown", ascii_lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)))
    port = step("port", F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1))
    number = F.regexp_replace(port, r"^0+(?=\d)", "")
    host = step("host", normalize_host(shown))
    label = F.element_at(F.split(host, r"\."), -1)
    address = F.startswith(shown, F.lit("[")) | label.rlike(r"^(\d+|0x[0-9a-f]*)$")
    plain = step("plain", F.regexp_extract(rest, _SPLIT, 2))
    path = step("path", _encoded(step("resolved", _without_dots(plain)), r"\"<>`{}^"))
    query = _encoded(step("query", F.regexp_extract(rest, _SPLIT, 3)), r"\"<>'")
    own_port = F.when(scheme == "http", DEFAULT_PORTS["http"]).otherwise(DEFAULT_PORTS["https"])
    bad_port = ~port.rlike(r"^\d*$") | (F.char_length(number) > 5) | (F.expr(f"try_cast(`__{out}_port` AS BIGINT)") > 65535)
    reason = (
        F.when(url.isNull() | (scheme == ""), "invalid_url")
        .when(~scheme.isin(*DEFAULT_PORTS), "scheme_not_allowed")
        .when(shown == "", "invalid_url")
        .when(F.coalesce(bad_port, F.lit(False)), "invalid_url")
        .when(~F.startswith(shown, F.lit("[")) & shown.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|]"), "invalid_url")
        .when(F.regexp_replace(user, "^:$", "") != "", "credentials")
        .when(address, "ip_literal")
        .when((host == "localhost") | ~F.contains(host, F.lit(".")), "not_public_host")
        .when(~F.coalesce(host_is_allowed(host, allowed_hosts, include_subdomains), F.lit(False)), "host_not_allowed")
        .when(~F.coalesce(path_is_allowed(path, path_prefixes), F.lit(False)), "path_not_allowed")
    )
    reason = step("reason", reason)
    with_port = F.when((port == "") | (number == own_port), F.lit("")).otherwise(F.concat(F.lit(":"), number))
    whole = step("whole", F.concat(scheme, F.lit("://"), shown, with_port, path, query))
    found = F.struct(F.when(reason.isNull(), whole).alias("canonical"), reason.alias("reject_reason"))
    return df.withColumn(out, found).drop(*steps)
