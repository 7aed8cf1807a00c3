"""Scalar functions of the catalog formats as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from basalt.plans.limits import BUCKETS, ROUTE_DOMAIN


def canonical_json(struct: Column) -> Column:
    """Canonical text of a struct whose fields are declared in sorted order.

    Integers, strings, booleans, nulls, and arrays and structs of them; doubles
    print otherwise than the canonical form asks, so cast them first.
    """
    return F.to_json(struct, {"ignoreNullFields": "false"})


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def route_text(kind: Column, identity: Column, domain: str = ROUTE_DOMAIN) -> Column:
    return F.to_json(F.array(F.lit(domain), kind, identity))


def route_hash(kind: Column, identity: Column, domain: str = ROUTE_DOMAIN) -> Column:
    """Where a record lies: the digest of its routing text."""
    return sha256(route_text(kind, identity, domain))


def bucket(identity: Column, buckets: int = BUCKETS) -> Column:
    """The leading bits of the digest's first byte, for 2, 4, ... 256 buckets."""
    return F.floor(F.conv(F.substring(sha256(identity), 1, 2), 16, 10).cast("int") / F.lit(256 // buckets)).cast("int")


def base64url(data: Column) -> Column:
    """Unpadded, in one line."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))  # Spark may break lines


def base64url_bytes(text: Column) -> Column:
    """Strictly: alphabet, length and unused bits must be canonical, else null."""
    fine = text.rlike(r"^[A-Za-z0-9_-]*(?![\s\S])") & (F.length(text) % 4 != 1)
    size = (F.ceil(F.length(text) / 4) * 4).cast("int")
    data = F.when(fine, F.unbase64(F.rpad(F.translate(text, "-_", "+/"), size, F.lit("="))))
    return F.when(base64url(data) == text, data)


def label_id(label: Column) -> Column:
    """The 32-byte identifier of a label."""
    return base64url(F.unhex(sha256(label)))


def hex_successor(digits: Column) -> Column:
    """The next number of as many hex digits; null after ``ff...f``."""
    head = F.regexp_replace(digits, "f+$", "")
    last = F.call_function("instr", F.lit("0123456789abcdef"), F.right(head, F.lit(1)))
    bumped = F.concat(F.left(head, F.length(head) - 1), F.substring(F.lit("0123456789abcdef"), last + 1, F.lit(1)))
    return F.when(head != "", F.rpad(bumped, F.length(digits), F.lit("0")))


def size_of(text: Column) -> Column:
    """A decimal size without leading zeros, up to 16 digits; null for anything else."""
    return F.when(text.rlike(r"^(0|[1-9]\d{0,15})(?![\s\S])"), text.cast("bigint"))


def scopes(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def headers(pairs: Column) -> Column:
    """array<struct<name, values array<string>>> as a map of lower-case names to joined values."""
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(p["name"]).alias("key"), F.array_join(p["values"], ", ").alias("value"))))


def bounded(text: Column, most: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def canonical_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """https and a known host only; no query, fragment or trailing slash. Null otherwise."""
    host = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    path = F.rtrim(F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return F.when(host.isin(*hosts), F.concat(F.lit("https://"), host, path))


def is_file_id(text: Column, most: int = 128) -> Column:
    return F.coalesce(text.rlike(rf"^[A-Za-z0-9_-]{{1,{most}}}(?![\s\S])"), F.lit(False))


def classify_status(status: Column, reason: Column, creating: Column) -> Column:
    """Code of a failed request of a store."""
    return (
        F.when(status == 401, "auth")
        .when((status == 403) & (reason == "storageQuotaExceeded"), "quota")
        .when(status == 403, "auth")
        .when((status >= 300) & (status < 400), "redirect")
        .when(creating & (status >= 500), "incomplete")
        .when(creating, "create")
        .otherwise("readback")
    )


def selected_identity(kind: Column, package: Column, event: Column, receipt: Column, observation: Column) -> Column:
    return (
        F.when(kind == "snapshot", package)
        .when(kind == "tombstone", event)
        .when(kind == "root-update-receipt", receipt)
        .when(kind == "observation", observation)
    )


def utf16_order(text: Column) -> Column:
    """A binary sort key that orders as UTF-16 code units do."""
    return F.encode(text, "UTF-16BE")
