"""Identifiers and identity hashes that depend on keys alone, so that a rerun gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_of(kind: int, n: Column) -> Column:
    """A readable UUID for a numbered row of a kind."""
    return F.concat(F.lit(f"00000000-0000-0000-{kind:04d}-"), F.lpad(n.cast("string"), 12, "0"))


def derived_uuid(*keys: Column) -> Column:
    """A UUID from the first 128 bits of the SHA-256 of the keys as a JSON array."""
    digest = F.sha2(F.to_json(F.array(*[k.cast("string") for k in keys])), 256)
    return F.concat_ws(
        "-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def match_key(
    tenant: Column, rule: Column, rule_revision: Column, page_revision: Column, content_sha256: Column,
    model: Column, version: Column, dimensions: Column, normalization: Column,
) -> Column:
    """SHA-256 of the nine identity fields as a compact JSON array of strings in this order."""
    fields = (tenant, rule, rule_revision, page_revision, content_sha256, model, version, dimensions, normalization)
    return F.sha2(F.to_json(F.array(*[f.cast("string") for f in fields])), 256)
