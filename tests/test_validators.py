"""Catalog validators on rows with nulls, clashes and every kind of fault."""

from pyspark.sql import functions as F

from tarn.operators import validators as V

ARTIFACT = "struct<artifact_id: string, kind: string, name: string, version: string, sha256: string>"
ATOM = f"schema_version string, inventory_id string, atom_id string, canonical_key string, surface string, atom_kind string, observed_host_ids array<string>, source_artifact {ARTIFACT}, member struct<name: string, signature: string, parameters: array<struct<position: int, direction: string>>, is_static: boolean>, source_locator map<string, string>, errors string"


def test_atoms(spark):
    x = ("x", "dll", "n", None, "f")
    good = ["1.0", "i", None, "k", "cad", "method", ["h"], x, ("m", "m()", [(0, "in"), (1, "ref")], False), {"a": "b"}, "old"]
    bad = ["2", None, "cap:cad:1", "", None, None, [], ("y", None, None, None, None), ("", None, [(1, None)], None), {}, None]
    differs = [*good[:7], ("x", "dll", "n", "2", "f"), *good[8:]]
    rows = spark.createDataFrame([good, bad, [None] * 11, differs], ATOM)
    rows = rows.withColumn("atom_id", F.coalesce("atom_id", V.atom_id(F.col("surface"), F.col("canonical_key"))))
    artifacts = spark.createDataFrame([x, ("z", "dll", "n", "1", "f")], "artifact_id string, kind string, name string, version string, sha256 string")
    out = V.validate_atoms(rows, artifacts, "i", "cad", "h", ["method"])
    assert out.columns == rows.columns
    got = sorted((r["canonical_key"] or "", r["errors"]) for r in out.collect())
    everything = ["schema_version", "inventory_mismatch", "surface_mismatch", "atom_kind", "canonical_key_empty", "atom_id", "hosts_empty", "host_not_observed", "artifact_unknown", "member_name_empty", "member_signature_empty"]
    assert ("k", []) in got and ("k", ["artifact_differs"]) in got
    assert ("", [*everything, "parameter_positions", "parameter_direction", "is_static_missing", "source_locator_empty"]) in got
    assert any(e[: len(everything)] == [c for c in everything] or "atom_id" not in e for k, e in got if k == "")
    assert V.validate_atoms(rows.limit(0), artifacts, "i", "cad", "h", ["method"]).count() == 0


def test_enrichments(spark):
    schema = "schema_version string, inventory_id string, atom_id string, status string, operation_kinds array<string>, domain_tags array<string>, summary string, classification_confidence double, evidence array<struct<kind: string, ref: string, claim: string>>, semantic_candidates array<struct<confidence: double, status: string>>, processor_kind string, notes string"
    good = ["1.0", "i", "a", "classified", ["read"], ["t"], "s", 1.0, [("human_review", "r", "c")], [(0.0, "verified")], "agent", None]
    odd = ["1.0", "i", "b", "failed", ["read", "read", "dance"], ["t", "t", None], None, float("nan"), [("signature", "r", None), ("guess", "r", "c")], [(1.5, "verified"), (0.1, "maybe")], "robot", " "]
    rows = spark.createDataFrame([good, odd, [None] * 12], schema)
    atoms = spark.createDataFrame([("a",), ("a",), (None,)], "atom_id string")
    got = {r["atom_id"]: r["errors"] for r in V.validate_enrichments(rows, atoms, "i").collect()}
    assert got["a"] == []
    assert got["b"] == ["atom_unknown", "operations_repeat", "operation_unknown", "tags_repeat", "tag_empty", "confidence", "evidence_kind", "evidence_empty_field", "candidate_status", "candidate_confidence", "verified_without_proof", "processor", "notes_missing"]
    assert got[None] == ["schema_version", "inventory_mismatch", "atom_unknown", "status", "confidence", "processor", "notes_missing"]


def test_exact_keys(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": 2}',), ('{"a": 1}',), ('{"a": 1, "b": 2, "c": 3}',), ("[1]",), ("no",), (None,)], "j string")
    assert [r[0] for r in rows.select(V.wrong_keys(F.col("j"), ["a", "b"])).collect()] == [False, True, True, True, True, True]
