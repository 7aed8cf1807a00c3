"""Limits of the catalog formats; every operator takes the ones it uses as parameters."""

# Limits that the formats set.
KIB, MIB = 1 << 10, 1 << 20
JSON_DEPTH = 32
PLAINTEXT_BYTES, PACKAGE_BYTES = 16 * MIB, 24 * MIB
ROOT_RECORD_BYTES, RECOVERY_BYTES = 64 * KIB, 96 * KIB
HEADER_BYTES, METADATA_BYTES = 4 * KIB, 64 * KIB
V1 = {"inputs": 16, "parents": 16, "entries": 1000, "observations": 4000, "locators": 16, "result_bytes": 16 * MIB, "record_overhead": 64}
V2 = {
    "root_bytes": 4 * MIB, "root_wire_bytes": 8 * MIB, "shard_bytes": MIB, "shard_wire_bytes": 2 * MIB, "shard_target": 256 * KIB,
    "total_shard_bytes": 64 * MIB, "plan_bytes": 64 * MIB, "entries": 10_000, "observations": 40_000, "records": 50_000,
    "references": 1024, "parents": 16, "locators": 4, "depth": 64, "epochs": 256, "records_per_leaf": 1024, "live_bytes": 512 * MIB,
}
BUCKETS, PACK_TARGET, JOURNAL_ENTRIES = 64, 4 * MIB, 10_000
EMPTY_SHARD = '{"nodeType":"shard","partitionVersion":1,"payloadVersion":2,"prefix":"","records":[]}'
ROUTE_DOMAIN = "WPP/catalog-route/v2"
PACKAGE_FORMAT, PACKAGE_SUITE, PACKAGE_KINDS, KEY_DOMAIN = "wpp-witness-package", "HKDF-SHA256+A256GCM", ("snapshot", "catalog"), ("WPP", "1")
KINDS = ("snapshot", "tombstone", "root-update-receipt", "observation")
