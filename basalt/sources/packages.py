"""Sealed packages: a canonical header in the clear, authenticated with what it seals, and a key of its own for each.

A wire is JSON of header, ciphertext and tag. The key comes from the secret of the header's epoch, by way
of its salt, scope and record; AES-GCM has the header's canonical text as additional
data, so no byte of either can change unseen. Each package is a row and so is each failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions import crypto, scalars as fn, strict_json as sj
from basalt.operators.records import ID16, ID32, Choice, Members, Number, Text
from basalt.operators.validate import at_most, violations
from basalt.plans.limits import HEADER_BYTES, KEY_DOMAIN, PACKAGE_BYTES, PACKAGE_FORMAT, PACKAGE_KINDS, PACKAGE_SUITE, PLAINTEXT_BYTES, V2

# The members of a header.
NONCE = Text(r"^[A-Za-z0-9_-]{16}(?![\s\S])")
HEADER = Members(
    {
        "format": ("header", Choice((PACKAGE_FORMAT,))),
        "version": ("version", Number(1, 1)),
        "suite": ("header", Choice((PACKAGE_SUITE,))),
        "vaultId": ("header ids", ID16),
        "vaultSalt": ("header ids", ID32),
        "rootEpoch": ("header ids", ID16),
        "scopeId": ("header ids", ID32),
        "recordId": ("header ids", ID32),
        "generationId": ("header ids", ID32),
        "kind": ("header", Choice(PACKAGE_KINDS)),
        "nonce": ("nonce", NONCE),
    }
)
WIRE = f"struct<ciphertext:string,header:{HEADER.type},tag:string>"


def package_keys(rows: DataFrame, secret: str, header: str) -> DataFrame:
    """``rows`` with ``key``: 32 bytes derived from ``secret`` and the members of the struct ``header``."""
    h = lambda f: F.col(f"{header}.{f}")
    context = lambda *words: F.encode(F.to_json(F.array(*(F.lit(d) for d in KEY_DOMAIN), *words)), "UTF-8")
    root = crypto.extract_key(fn.base64url_bytes(h("vaultSalt")), F.col(secret))
    scope = crypto.expand_key(root, context(F.lit("scope"), h("vaultId"), h("rootEpoch"), h("scopeId")))
    return rows.withColumn("key", crypto.expand_key(scope, context(F.lit("object"), h("kind"), h("recordId"), h("generationId"))))


def parse_packages(wires: DataFrame, most: int = PACKAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(packages: name, sha256, header, header_text, ciphertext, tag; violations: rule, identity) of wires (name, wire binary).

    Packages are those without a violation. The version must be written as a number that is exactly 1.
    """
    own = wires.select("name", "wire", F.col("wire").cast("string").alias("text")).withColumn("refusal", sj.json_refusal("wire", most))
    fine = own.where("refusal IS NULL").withColumn("canonical", sj.json_canonical("wire")).withColumn("w", F.from_json("canonical", WIRE))
    fine = fine.withColumns({"ciphertext": fn.base64url_bytes(F.col("w.ciphertext")), "tag": fn.base64url_bytes(F.col("w.tag")), "header_text": fn.canonical_json(F.col("w.header"))})
    rules = [
        ("closed", F.col("canonical") == fn.canonical_json(F.col("w"))),
        *HEADER.rules(F.col("w.header")),
        ("version token", sj.decimal_one(sj.version_token(F.col("text")))),
        ("header size", F.octet_length("header_text") <= HEADER_BYTES),
        ("ciphertext", F.octet_length("ciphertext") <= PLAINTEXT_BYTES),
        ("tag", F.octet_length("tag") == 16),
    ]
    judged = fine.withColumn("broken", F.size(_broken(rules)))
    found = violations(fine, F.col("name"), rules).union(own.where("refusal IS NOT NULL").select(F.concat(F.lit("json: "), "refusal"), "name"))
    kept = judged.where("broken = 0").select("name", F.sha2("wire", 256).alias("sha256"), F.col("w.header").alias("header"), "header_text", "ciphertext", "tag")
    return kept, found


def _broken(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))


def open_packages(packages: DataFrame, epochs: DataFrame) -> DataFrame:
    """(name, sha256, header, payload, failure) of parsed packages; epochs: epoch, secret (32 bytes), at most as many as the format allows.

    ``failure`` is ``epoch`` for one that isn't known, ``authentication`` where anything was changed, and ``payload``
    for what isn't canonical JSON; the payload is null then, and the failure is null for what was opened.
    """
    known = at_most(epochs, V2["epochs"]).select(F.col("epoch").alias("_epoch"), F.col("secret").alias("_secret"))
    own = packages.join(F.broadcast(known), F.col("header.rootEpoch") == F.col("_epoch"), "left")  # at most that many rows
    # a secret in place of a missing one opens nothing, and spares a second plan
    own = package_keys(own.withColumn("_some", F.coalesce("_secret", F.lit(b"\x00" * 32))), "_some", "header")
    sealed = F.concat(fn.base64url_bytes(F.col("header.nonce")), "ciphertext", "tag")
    own = own.withColumn("_plain", F.when(F.col("_secret").isNotNull(), crypto.unseal(sealed, F.col("key"), F.encode("header_text", "UTF-8"))))
    own = own.withColumn("_canonical", sj.json_canonical(F.coalesce("_plain", F.lit(b""))))
    same = F.coalesce(F.col("_canonical") == F.col("_plain").cast("string"), F.lit(False))
    failure = F.when(F.col("_secret").isNull(), "epoch").when(F.col("_plain").isNull(), "authentication").when(~same, "payload")
    return own.select("name", "sha256", "header", F.when(same, F.col("_plain")).alias("payload"), failure.alias("failure"))


def seal_packages(payloads: DataFrame) -> DataFrame:
    """(name, wire, sha256) of payloads: name, payload (canonical JSON, binary), header (its members but format, version and suite), secret.

    A nonce must not come twice with one key: generations have keys of their own, and
    ``crypto.random_bytes`` makes nonces, to be written before they are used.
    """
    given = {"format": F.lit(PACKAGE_FORMAT), "version": F.lit(1).cast("bigint"), "suite": F.lit(PACKAGE_SUITE)}
    header = F.struct(*((given.get(f) if f in given else F.col(f"header.{f}")).alias(f) for f in sorted(HEADER.of)))
    own = package_keys(payloads.withColumn("header", header), "secret", "header").withColumn("text", fn.canonical_json(F.col("header")))
    sealed = crypto.seal(F.col("payload"), F.col("key"), fn.base64url_bytes(F.col("header.nonce")), F.encode("text", "UTF-8"))
    own = own.withColumn("sealed", sealed)
    n = F.octet_length("sealed")
    ciphertext, tag = F.substring(F.col("sealed"), F.lit(13), n - 28), F.substring(F.col("sealed"), n - 15, F.lit(16))
    text = F.concat(F.lit('{"ciphertext":"'), fn.base64url(ciphertext), F.lit('","header":'), "text", F.lit(',"tag":"'), fn.base64url(tag), F.lit('"}'))
    wire = F.encode(text, "UTF-8")
    return own.select("name", wire.alias("wire")).withColumn("sha256", F.sha2("wire", 256))
