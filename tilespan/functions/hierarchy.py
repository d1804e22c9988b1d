"""Label trees as edge tables (feature_set, child, parent), their closure, and class roles over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import cut

NOVEL = "novel"


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("feature_set", F.explode(F.array("child", "parent")).alias("node")).distinct()


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select("feature_set", F.col("child").alias("node")).distinct().join(edges.select("feature_set", F.col("parent").alias("node")), ["feature_set", "node"], "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select("feature_set", F.col("parent").alias("node")).distinct().join(edges.select("feature_set", F.col("child").alias("node")), ["feature_set", "node"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """feature_set, node, ancestor (itself too), distance. Each round doubles the distance that is known, until no path is as long; a cycle is an error."""
    jump = cut(edges.select("feature_set", F.col("child").alias("node"), F.col("parent").alias("ancestor")))
    known = nodes(edges).select("feature_set", "node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    n, reach = known.count(), 1  # jump goes reach steps up, known holds all shorter paths
    while not jump.isEmpty():
        if reach > n:
            raise ValueError("the hierarchy has a cycle")
        on = jump.select("feature_set", F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"))
        further = known.join(on, ["feature_set", "ancestor"]).select("feature_set", "node", F.col("_up").alias("ancestor"), (F.col("distance") + reach).alias("distance"))
        known = cut(known.union(further))
        jump = cut(jump.join(on, ["feature_set", "ancestor"]).select("feature_set", "node", F.col("_up").alias("ancestor")).distinct())
        reach *= 2
    return known


def depths(closed: DataFrame) -> DataFrame:
    """feature_set, node, depth (0 at a root)."""
    return closed.groupBy("feature_set", "node").agg(F.max("distance").alias("depth"))


def descendants(closed: DataFrame, feature_set: str, root: str, include_root: bool = False) -> DataFrame:
    found = closed.where((F.col("feature_set") == feature_set) & (F.col("ancestor") == root))
    return (found if include_root else found.where("distance > 0")).select("node")


def unknown_labels(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (feature_set, feature) that no tree of their featureset holds; only novel may be absent."""
    return rows.select("feature_set", "feature").distinct().where(F.col("feature") != NOVEL).join(nodes(edges).withColumnRenamed("node", "feature"), ["feature_set", "feature"], "left_anti")


def classes_of(edges: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], set[str]]:
    """(feature_set, node): its labels, itself too, of a tree given as plain (feature_set, child, parent) triples."""
    below: dict[tuple[str, str], set[str]] = {}
    for fs, child, parent in edges:
        below.setdefault((fs, parent), set()).add(child)
        below.setdefault((fs, child), set())
    out = {}
    for fs, node in below:
        seen, todo = set(), [node]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += below[fs, x]
        out[fs, node] = seen
    return out


class Roles:
    """Named label classes of a hierarchy. A role is a list of parts: (feature_set, node, with_root) for the labels under a node,
    (feature_set, None, False) for the leaves of a tree, the name of an earlier role, or =label for a label that needs no tree.
    Labels of minus' roles go. A node that its tree lacks is an error, but for the roles in optional.

    A tree holds a few hundred labels at most, so its closure is read once into the driver.
    """

    def __init__(self, edges: DataFrame, roles: Mapping[str, Sequence], minus: Mapping[str, Sequence[str]] | None = None, optional: Sequence[str] = ()):
        self.under: dict[tuple[str, str], set[str]] = {}
        for r in closure(edges).collect():
            self.under.setdefault((r.feature_set, r.ancestor), set()).add(r.node)
        self.sets: dict[str, frozenset[str]] = {}
        for name, parts in roles.items():
            found: set[str] = set()
            for part in parts:
                found |= self.part(part, name in optional)
            for other in (minus or {}).get(name, ()):
                found -= self.sets[other]
            self.sets[name] = frozenset(found)

    def part(self, part, optional: bool) -> set[str]:
        if isinstance(part, str):
            return {part[1:]} if part.startswith("=") else set(self.sets[part])
        feature_set, node, with_root = part
        if node is None:
            return {x for (fs, x), below in self.under.items() if fs == feature_set and below == {x}}
        if (feature_set, node) not in self.under:
            if optional:
                return set()
            raise KeyError(f"{feature_set} has no {node}")
        return {x for x in self.under[feature_set, node] if with_root or x != node}

    def __getitem__(self, name: str) -> frozenset[str]:
        return self.sets[name]

    def members(self, name: str, column) -> object:
        """A condition: column lies in the role."""
        return column.isin(sorted(self.sets[name])) if self.sets[name] else F.lit(False)


#: The roles of the genome labels that the presets and labels name.
GENOME_ROLES = {
    "ct": [("region", "ct", True)],
    "satellite": [("region", "centromeric", True)],
    "arm": [("region", "arm", True)],
    "acrocentric": [("chromosome", "acrocentric", False)],
    "canonical": [("subtelomeric", "canonical_telomere", True)],
    "noncanonical": [("subtelomeric", "noncanonical_telomere", True)],
    "its_tar1": [("subtelomeric", "ITS", True), ("subtelomeric", "TAR1", True)],
    "telomere": ["canonical", "noncanonical"],
    "chromosome": [("chromosome", None, False)],
    "interspersed": [("repeat", "Interspersed_Repeat", True)],
    "filler": ["telomere", "arm", "ct", "=telomere_like", "=nonsubtelomeric", "=nonrepeat", "=novel", "=categorized"],
    "structureless": ["filler"],
    "masked": ["interspersed", "=nonrepeat"],
}
GENOME_MINUS = {"satellite": ("ct",), "structureless": ("telomere",)}
GENOME_OPTIONAL = ("acrocentric", "interspersed")
