"""A history as a bundle of narrow tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields
from dataclasses import replace as _replace

from pyspark.sql import DataFrame, SparkSession

from .storage import swap

# The data model's columns.
_DERIVATION = "struct<kind:string,kind_label:string,`by`:string,decoder_version:string,params:map<string,string>,confidence:int>"
STATUS = f"struct<base:string,derivation:{_DERIVATION},layers:array<struct<step:int,changed:array<string>>>>"
_TEXT = "struct<bytes:binary,encoding:string>"
_TIME = "struct<seconds:bigint,offset_minutes:smallint>"
_IDENTITY = f"struct<name:{_TEXT},email:{_TEXT}>"
_SOURCE = "struct<kind:string,kind_label:string,repo_id:binary,id:binary>"
SCHEMAS = {
    "atoms": f"atom_id binary, atom_idx bigint, source {_SOURCE}, author {_IDENTITY}, author_time {_TIME}, committer {_IDENTITY}, commit_time {_TIME}, message {_TEXT}, status {STATUS}",
    "parents": "atom_id binary, pos int, parent_id binary",
    "ops": f"atom_id binary, path string, op string, blob_id binary, mode int, status {STATUS}",
    "copies": f"atom_id binary, `from` string, from_atom binary, `to` string, status {STATUS}",
    "refs": f"name string, kind string, kind_label string, target binary, source {_SOURCE}, annotation struct<message:{_TEXT},tagger:{_IDENTITY},time:{_TIME}>, status {STATUS}",
    "blobs": "blob_id binary, length bigint, content binary",
    "drops": "class string, what string, reason string, step int",
    "flags": "kind string, what string, count bigint, reason string",
    "provenance": "source_kind string, tool_version string, decoder_version string, repo_id binary, params map<string,string>",
    "transforms": "step int, name string, version string, params map<string,string>",
}
CONTRACT = (0, 3)


@dataclass(frozen=True)
class History:
    atoms: DataFrame
    parents: DataFrame
    ops: DataFrame
    copies: DataFrame
    refs: DataFrame
    blobs: DataFrame
    drops: DataFrame
    flags: DataFrame
    provenance: DataFrame
    transforms: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **rows) -> History:
        """From rows or tables; what is not given is empty.  Unknown tables and columns are refused."""
        unknown = set(rows) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"a history has no tables {sorted(unknown)}")
        made = {n: rows[n] if isinstance(rows.get(n), DataFrame) else spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}
        for n, df in made.items():
            want = spark.createDataFrame([], SCHEMAS[n]).columns
            if df.columns != want:
                raise ValueError(f"{n} has columns {df.columns}; the contract is {want}")
        return cls(**made)

    def replace(self, **tables: DataFrame) -> History:
        return _replace(self, **tables)

    def write(self, path: str) -> None:
        """Parquet, one folder a table, all or nothing; contents are ordered by path of first use, so that versions lie together.

        The tables go to a folder of their own, and the manifest that readers follow is swapped when all are there; a
        write that fails leaves the history before it readable.
        """
        from .operators.asof import first_use_order

        version = f"v-{uuid.uuid4().hex}"
        for f in fields(self):
            df = getattr(self, f.name)
            if f.name == "blobs":
                uses = self.ops.filter("blob_id is not null").join(self.atoms.select("atom_id", "atom_idx"), "atom_id").selectExpr("blob_id as blob", "atom_idx", "path")
                order = first_use_order(uses).selectExpr("blob as blob_id", "path as _p", "atom_idx as _i")
                df = df.join(order, "blob_id", "left").repartitionByRange("_p", "_i").sortWithinPartitions("_p", "_i").drop("_p", "_i")
            df.write.parquet(f"{path}/{version}/{f.name}")
        swap(self.atoms.sparkSession, f"{path}/manifest", version)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> History:
        """The history that the manifest names."""
        version = spark.read.text(f"{path}/manifest").first()[0]
        return cls.of(spark, **{n: spark.read.parquet(f"{path}/{version}/{n}") for n in SCHEMAS})

    def store(self) -> History:
        """Contents deduplicated by id, unused ones left out."""
        used = self.ops.select("blob_id").distinct()
        return self.replace(blobs=self.blobs.dropDuplicates(["blob_id"]).join(used, "blob_id", "left_semi"))

    def report(self) -> DataFrame:
        from .operators.report import fidelity

        return fidelity(self.atoms, self.ops, self.copies, self.refs, self.drops, self.flags, self.blobs)
