"""Edits of a history and the check that keeps them honest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import written


def remap(rows: DataFrame, lines: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with their parts replaced where all old parts match exactly (null equals null); the first line wins.

    lines: line_no and the old and new columns named in parts ({column: (old, new)}).  The map is joined on its keys;
    Spark broadcasts it when its measured size allows that.
    """
    first = lines.withColumn("_k", F.row_number().over(W.partitionBy(*[old for old, _ in parts.values()]).orderBy("line_no"))).filter("_k = 1")
    keep = first.select(*[F.col(old).alias(f"_old_{c}") for c, (old, _) in parts.items()], *[F.col(new).alias(f"_new_{c}") for c, (_, new) in parts.items()], F.lit(True).alias("_hit"))
    on = F.lit(True)
    for c in parts:
        on = on & rows[c].eqNullSafe(keep[f"_old_{c}"])
    met = rows.join(keep, on, "left")
    return met.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in parts else F.col(c) for c in rows.columns])


def identity_side(side: Column) -> Column:
    """(name, email) of `Name <email>`: cut at the last `<` and the last `>` behind it; null where there is no such pair or no name."""
    found = F.regexp_extract(side, r"^(.*)<([^<]*)>[^<>]*$", 2), F.trim(F.regexp_extract(side, r"^(.*)<([^<]*)>[^<>]*$", 1))
    return F.when(side.rlike(r"^.*<[^<]*>[^<>]*$"), F.struct(found[1].alias("name"), F.trim(found[0]).alias("email")))


def author_map(lines: DataFrame) -> DataFrame:
    """line_no, old_name, old_email, new_name, new_email of the lines (line_no, line) of a map file, `old = new` a line.

    Blank lines and those that start with # are passed over; any other line that is no pair of identities is refused.
    """
    rows = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    cut = F.instr("line", "=")
    sides = rows.select("line_no", "line", identity_side(F.trim(F.expr("substring(line, 1, instr(line, '=') - 1)"))).alias("old"), identity_side(F.trim(F.expr("substring(line, instr(line, '=') + 1)"))).alias("new"), (cut > 0).alias("pair"))
    wrong = sides.filter(~F.col("pair") | F.col("old").isNull() | F.col("new").isNull()).orderBy("line_no").limit(1).collect()
    if wrong:
        raise ValueError(f"line {wrong[0]['line_no']} maps no identity to another")
    return sides.select("line_no", F.col("old.name").alias("old_name"), F.col("old.email").alias("old_email"), F.col("new.name").alias("new_name"), F.col("new.email").alias("new_email"))


def changed_part_violations(before: DataFrame, after: DataFrame, parts: list[str], dropped: DataFrame) -> DataFrame:
    """node, violation, detail of a dishonest edit.

    before and after: node and the parts; after also `changed`, the array of marked part names.  Nodes may vanish only
    with a drop record, none may be invented, and the marks must name exactly the parts that differ (nulls compare
    equal).
    """
    b = before.select("node", F.lit(True).alias("_was"), *[F.col(p).alias(f"_b_{p}") for p in parts])
    a = after.select("node", F.lit(True).alias("_is"), "changed", *[F.col(p).alias(f"_a_{p}") for p in parts])
    j = b.join(a, "node", "full_outer").join(dropped.select("node", F.lit(True).alias("_dropped")), "node", "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_b_{p}").eqNullSafe(F.col(f"_a_{p}")), F.lit(p)) for p in parts]))
    j = j.withColumn("_differs", differs).withColumn("_unmarked", F.array_except("_differs", "changed")).withColumn("_idle", F.array_except("changed", "_differs"))
    kind = (
        F.when(F.col("_was").isNull(), "invented-atom")
        .when(F.col("_is").isNull() & F.col("_dropped").isNull(), "missing-atom")
        .when(F.col("_is").isNotNull() & F.col("_dropped").isNotNull(), "drop-of-surviving-atom")
        .when(F.col("_is").isNotNull() & (F.size("_unmarked") > 0), "unmarked-change")
        .when(F.col("_is").isNotNull() & (F.size("_idle") > 0), "mark-without-change")
    )
    return j.withColumn("violation", kind).filter("violation is not null").select("node", "violation", F.array_join(F.concat(F.coalesce("_unmarked", F.array()), F.coalesce("_idle", F.array())), ",").alias("detail"))


class Edit:
    """An edit of a history bundle: changes are made on its tables, recorded by marks and drops, and checked at the end."""

    def __init__(self, history, name: str, version: str, params: dict[str, str] | None = None) -> None:
        from ..functions.scalars import is_transform_name

        spark = history.atoms.sparkSession
        if not spark.range(1).select(is_transform_name(F.lit(name)).alias("ok")).first()[0]:
            raise ValueError(f"not a transform name: {name}")
        self.input, self.out, self.name, self.version, self.params = history, history, name, version, dict(params or {})
        self.drops = []  # the records of this edit, one table a call
        self.step = int(history.transforms.agg(F.coalesce(F.max("step"), F.lit(0))).first()[0]) + 1
        if self.step > 64:
            raise ValueError("a history carries at most 64 transforms")

    def _atoms(self, part: str, value, where) -> Edit:
        atoms = self.out.atoms
        hit = where & ~F.col(part).eqNullSafe(value)
        marks = F.when(hit, F.array_union(F.col("changed"), F.array(F.lit(part)))).otherwise(F.col("changed")) if "changed" in atoms.columns else F.when(hit, F.array(F.lit(part))).otherwise(F.array().cast("array<string>"))
        self.out = self.out.replace(atoms=atoms.withColumn("changed", F.array_sort(marks)).withColumn(part, F.when(hit, value).otherwise(F.col(part))))
        return self

    def set_author(self, value, where) -> Edit:
        return self._atoms("author", value, where)

    def set_author_time(self, value, where) -> Edit:
        return self._atoms("author_time", value, where)

    def set_committer(self, value, where) -> Edit:
        return self._atoms("committer", value, where)

    def set_commit_time(self, value, where) -> Edit:
        return self._atoms("commit_time", value, where)

    def set_message(self, value, where) -> Edit:
        return self._atoms("message", value, where)

    def set_op(self, part: str, value, where) -> Edit:
        """Blob, mode or path of the ops that satisfy `where`; a new path moves the op."""
        if part not in ("blob_id", "mode", "path"):
            raise ValueError(f"ops have no part {part}")
        self.out = self.out.replace(ops=self.out.ops.withColumn(part, F.when(where, value).otherwise(F.col(part))))
        return self

    def _dropped(self, kind: str, name: Column, of: DataFrame, reason: str) -> None:
        rows = of.select(F.lit("transform").alias("class"), F.concat(F.lit(f"{kind} "), name).alias("what"), F.lit(reason).alias("reason"), F.lit(self.step).alias("step"))
        self.drops.append((kind, rows))
        self.out = self.out.replace(drops=self.out.drops.unionByName(rows))

    def remove_ops(self, where, reason: str) -> Edit:
        gone = self.out.ops.filter(where)
        self._dropped("op", F.concat(F.lower(F.hex("atom_id")), F.lit(" "), F.col("path")), gone, reason)
        self.out = self.out.replace(ops=self.out.ops.filter(~F.coalesce(where, F.lit(False))))
        return self

    def remove_copies(self, where, reason: str) -> Edit:
        gone = self.out.copies.filter(where)
        self._dropped("copy", F.concat(F.lower(F.hex("atom_id")), F.lit(" "), F.col("to")), gone, reason)
        self.out = self.out.replace(copies=self.out.copies.filter(~F.coalesce(where, F.lit(False))))
        return self

    def remove_atoms(self, where, reason: str) -> Edit:
        """Removes revisions; their children are hung under their nearest kept ancestors."""
        from .graph import remapped_parents

        gone = self.out.atoms.filter(where).select("atom_id")
        gone = written(gone, "removed-atoms")
        self._dropped("atom", F.lower(F.hex("atom_id")), gone, reason)
        edges = self.out.parents.select(F.col("atom_id").alias("node"), "pos", F.col("parent_id").alias("parent"))
        kept = remapped_parents(edges, gone.select(F.col("atom_id").alias("node")))
        parents = kept.select(F.col("node").alias("atom_id"), F.posexplode("parents").alias("pos", "parent_id"))
        drop = {t: getattr(self.out, t).join(gone, "atom_id", "left_anti") for t in ("atoms", "ops", "copies")}
        self.out = self.out.replace(parents=parents, **drop)
        return self

    def rename_ref(self, kind: str, name: str, new: str) -> Edit:
        hit = (F.col("kind") == kind) & (F.col("name") == name)
        self.out = self.out.replace(refs=self.out.refs.withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name"))))
        return self

    def set_ref_annotation(self, kind: str, name: str, value) -> Edit:
        hit = (F.col("kind") == kind) & (F.col("name") == name)
        self.out = self.out.replace(refs=self.out.refs.withColumn("annotation", F.when(hit, value).otherwise(F.col("annotation"))))
        return self

    def remove_ref(self, kind: str, name: str, reason: str) -> Edit:
        hit = (F.col("kind") == kind) & (F.col("name") == name)
        self._dropped("ref", F.concat("kind", F.lit(" "), "name"), self.out.refs.filter(hit), reason)
        self.out = self.out.replace(refs=self.out.refs.filter(~hit))
        return self

    def finish(self):
        """The edited history with its record; raises if the change is not what the marks and drops say."""
        spark = self.input.atoms.sparkSession
        record = spark.createDataFrame([(self.step, self.name, self.version, self.params)], "step int, name string, version string, params map<string,string>")
        parts = ["author", "author_time", "committer", "commit_time", "message"]
        before = self.input.atoms.select(F.col("atom_id").alias("node"), *parts)
        after = self.out.atoms
        if "changed" not in after.columns:
            after = after.withColumn("changed", F.array().cast("array<string>"))
        # only records of atoms are read: those of ops and copies name no revision that is gone, and cost a pass over all ops
        gone = before.select("node").limit(0)
        for kind, rows in self.drops:
            if kind == "atom":
                gone = gone.unionAll(rows.select(F.unhex(F.substring("what", 6, 64)).alias("node")))
        wrong = changed_part_violations(before, after.select(F.col("atom_id").alias("node"), "changed", *parts), parts, gone)
        found = wrong.limit(5).collect()
        if found:
            raise ValueError(f"the edit is not what it records: {found}")
        layer = F.struct(F.lit(self.step).alias("step"), F.col("changed").alias("changed"))
        status = F.when(F.size("changed") > 0, F.col("status").withField("layers", F.concat(F.array(layer), F.col("status.layers")))).otherwise(F.col("status"))
        return self.out.replace(atoms=after.withColumn("status", status).drop("changed"), transforms=self.input.transforms.unionByName(record))


_registry: dict[str, dict[str, Callable]] = {"transform": {}, "encode": {}}


def register(kind: str, name: str, f: Callable) -> bool:
    """Makes a transform (History -> History) or an encoder (History, path -> None) known; False where one has the name."""
    if name in _registry[kind]:
        return False
    _registry[kind][name] = f
    return True


def listed(kind: str) -> list[str]:
    return sorted(_registry[kind])


def run(kind: str, name: str, history, *args):
    """Checks the history, runs the registered callable, and checks a transform's result."""
    from .verify import verdict

    if name not in _registry[kind]:
        raise KeyError(f"no {kind} named {name}; known: {listed(kind)}")
    if verdict(history)[0] == "fail":
        raise ValueError("the history does not verify")
    out = _registry[kind][name](history, *args)
    if kind == "transform" and verdict(out)[0] == "fail":
        raise ValueError("the transformed history does not verify")
    return out
