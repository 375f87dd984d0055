"""Hashes: deterministic assignment and sampling ranks, canonical JSON, checksums."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mhqa.schemas import CODES


def unsigned_mod(text: Column, modulus: int) -> Column:
    """The first eight bytes of the SHA-256 of ``text``, as an unsigned number, modulo ``modulus``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def assign_language(source_id: Column, unit_id: Column, seed: int) -> Column:
    """The language of a unit of a source, by hash."""
    return F.element_at(F.array(*map(F.lit, CODES)), unsigned_mod(F.concat_ws("\x1f", F.lit(str(seed)), source_id, unit_id), len(CODES)) + 1)


def train_view(source_id: Column, prefix: str) -> Column:
    """The one of 24 views of a training source that a public release shows; ``prefix`` names the release in the hashed text."""
    return unsigned_mod(F.concat(F.lit(prefix), source_id), len(CODES))


def sample_rank(seed: int, stratum: Column, identity: Column) -> Column:
    """The hexadecimal rank by which samples are drawn."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), stratum, identity), 256)


def dumps(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else dumps(json.loads(t)) for t in texts.to_pylist()], pa.string())


def canonical_text(text: Column) -> Column:
    """JSON text in canonical form."""
    return _canonical(text)


def canonical_json(record: Column) -> Column:
    """JSON of a struct or map with sorted keys, compact, not escaped to ASCII, nulls kept."""
    return _canonical(F.to_json(record, {"ignoreNullFields": "false"}))


@F.arrow_udf(T.StringType())
def _semantic(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is None:
            out.append(None)
            continue
        record = json.loads(t)
        record["checksum"] = ""
        provenance = record.get("provenance") or {}
        for volatile, empty in (("created_at", ""), ("retry_count", 0), ("validation_status", "")):
            if volatile in provenance:
                provenance[volatile] = empty
        if not provenance.get("assignment_manifest_sha256"):
            provenance.pop("assignment_manifest_sha256", None)
        if "decoding" in provenance:  # JSON text; nothing counts as no parameters
            provenance["decoding"] = json.loads(provenance["decoding"] or "{}")
        out.append(dumps(record))
    return pa.array(out, pa.string())


def checksum(record: Column) -> Column:
    """SHA-256 of a record's canonical JSON with its checksum and what changes when it is merely made again emptied."""
    return F.sha2(_semantic(F.to_json(record, {"ignoreNullFields": "false"})), 256)


def record_hash(record: Column, own: str, *, emptied: bool = False) -> Column:
    """SHA-256 of a record's canonical JSON without its field ``own``, or with that field emptied."""
    return F.sha2(canonical_json(record.withField(own, F.lit("")) if emptied else record.dropFields(own)), 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
