"""Validators of catalog rows: every row keeps, in order, the codes of the rules that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import row_errors

#: What the fields of a catalog may hold.
STATUSES = ["classified", "deferred", "failed"]
OPERATIONS = "read compute create edit delete transform save import export select navigate display invoke event lifecycle unknown".split()
EVIDENCE = ["member_name", "signature", "source_code", "documentation", "runtime_probe", "human_review"]
PROVING = ["runtime_probe", "human_review"]
CANDIDATES = ["proposed", "verified", "rejected"]
PROCESSORS = ["rule", "agent", "human"]
DIRECTIONS = ["in", "out", "ref", "return"]
VERSION = "1.0"


def _empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def _outside(c: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(c.isin(allowed), F.lit(False))


def _repeats(c: str) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def _share(c: Column) -> Column:
    """Whether a number is no share (null, no number, below 0 or above 1)."""
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 1)


def wrong_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has other keys than exactly these (a text that is no object has)."""
    return ~F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def atom_id(surface: Column, key: Column) -> Column:
    return F.concat(F.lit("cap:"), surface, F.lit(":"), F.substring(F.sha2(key, 256), 1, 24))


def validate_atoms(atoms: DataFrame, artifacts: DataFrame, inventory_id: str, surface: str, host: str, kinds: list[str]) -> DataFrame:
    """``atoms`` with ``errors``, against the manifest of their inventory (its id, surface, host) and its ``artifacts``
    (artifact_id, kind, name, version, sha256; unique).

    atoms: schema_version, inventory_id, atom_id, canonical_key, surface, atom_kind, observed_host_ids, source_artifact
    (struct as ``artifacts``), member (struct name, signature, parameters array of (position, direction), is_static),
    source_locator (map). The stored id must be the one its surface and key give; positions count from 0.
    """
    theirs = artifacts.select(F.col("artifact_id").alias("_artifact"), F.struct("artifact_id", "kind", "name", "version", "sha256").alias("_known"))
    met = atoms.join(theirs, F.col("source_artifact.artifact_id") == F.col("_artifact"), "left")
    hosts, parameters = F.col("observed_host_ids"), F.col("member.parameters")
    fields = ["artifact_id", "kind", "name", "version", "sha256"]
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"source_artifact.{f}").eqNullSafe(F.col(f"_known.{f}"))
    rules = {
        "schema_version": ~F.col("schema_version").eqNullSafe(F.lit(VERSION)),
        "inventory_mismatch": ~F.col("inventory_id").eqNullSafe(F.lit(inventory_id)),
        "surface_mismatch": ~F.col("surface").eqNullSafe(F.lit(surface)),
        "atom_kind": _outside(F.col("atom_kind"), kinds),
        "canonical_key_empty": _empty("canonical_key"),
        "atom_id": ~F.col("atom_id").eqNullSafe(atom_id(F.col("surface"), F.col("canonical_key"))),
        "hosts_empty": F.coalesce(F.size(hosts), F.lit(0)) <= 0,
        "hosts_repeat": _repeats("observed_host_ids"),
        "host_not_observed": ~F.coalesce(F.array_contains(hosts, host), F.lit(False)),
        "artifact_unknown": F.col("_known").isNull(),
        "artifact_differs": F.col("_known").isNotNull() & ~same,
        "member_name_empty": _empty("member.name"),
        "member_signature_empty": _empty("member.signature"),
        "parameter_positions": F.exists(F.transform(parameters, lambda p, i: ~p["position"].eqNullSafe(i)), lambda x: x),
        "parameter_direction": F.exists(parameters, lambda p: _outside(p["direction"], DIRECTIONS)),
        "is_static_missing": F.col("member.is_static").isNull(),
        "source_locator_empty": F.coalesce(F.size("source_locator"), F.lit(0)) <= 0,
    }
    return row_errors(met, rules).drop("_artifact", "_known")


def validate_enrichments(rows: DataFrame, atoms: DataFrame, inventory_id: str) -> DataFrame:
    """``rows`` with ``errors``; atoms: atom_id.

    rows: schema_version, inventory_id, atom_id, status, operation_kinds, domain_tags, summary, classification_confidence,
    evidence (array of (kind, ref, claim)), semantic_candidates (array of (confidence, status)), processor_kind, notes. A
    verified candidate needs evidence of a probe or a person; classified rows need operations, a summary and evidence, others notes.
    """
    known = atoms.select(F.col("atom_id").alias("_atom")).distinct()
    met = rows.join(known, F.col("atom_id") == F.col("_atom"), "left")
    classified = F.col("status") == "classified"
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    proven = F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["kind"].isin(PROVING), F.lit(False))), F.lit(False))
    rules = {
        "schema_version": ~F.col("schema_version").eqNullSafe(F.lit(VERSION)),
        "inventory_mismatch": ~F.col("inventory_id").eqNullSafe(F.lit(inventory_id)),
        "atom_unknown": F.col("_atom").isNull(),
        "status": _outside(F.col("status"), STATUSES),
        "operations_repeat": _repeats("operation_kinds"),
        "operation_unknown": F.exists("operation_kinds", lambda k: _outside(k, OPERATIONS)),
        "tags_repeat": _repeats("domain_tags"),
        "tag_empty": F.exists("domain_tags", _empty),
        "confidence": _share(F.col("classification_confidence")),
        "evidence_kind": F.exists("evidence", lambda e: _outside(e["kind"], EVIDENCE)),
        "evidence_empty_field": F.exists("evidence", lambda e: _empty(e["ref"]) | _empty(e["claim"])),
        "candidate_status": F.exists("semantic_candidates", lambda c: _outside(c["status"], CANDIDATES)),
        "candidate_confidence": F.exists("semantic_candidates", lambda c: _share(c["confidence"])),
        "verified_without_proof": F.exists("semantic_candidates", lambda c: c["status"] == "verified") & ~proven,
        "processor": _outside(F.col("processor_kind"), PROCESSORS),
        "classified_without_operations": classified & none("operation_kinds"),
        "classified_without_summary": classified & blank("summary"),
        "classified_without_evidence": classified & none("evidence"),
        "notes_missing": ~F.coalesce(classified, F.lit(False)) & blank("notes"),
    }
    return row_errors(met, rules).drop("_atom")
