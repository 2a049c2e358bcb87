"""Placement of rows in a hierarchical weighted hash tree.

A tree holds regions, these hold racks, these hold shards with weights. A row
descends from the top: at each level every child draws ln(u) / weight, with u from
a hash of the row's key and the child's name, and the child with the largest draw
is taken. A child wins in proportion to its weight, and a child's draw depends on
nothing but itself, so a changed weight moves rows only into or out of the subtree
that holds it.

Growth must move rows only into what is new. If a rack simply became heavier, rows
drawn to it from elsewhere would spread over its old shards too. So what is added
later is a *branch* of its own: it stands under its region and rack by name, but
draws at the top for itself, with its own weight. The other draws stay as they are,
a row moves if the new branch's draw beats its old one, and then it is in there.

Everything is a column expression over literals of the tree; a row computes the
draws of the nodes on its own path, not of all shards.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import parts, stored
from tallywarden.operators.ordering import running


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    branch: int = 0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @staticmethod
    def even(regions: int, racks: int, per_rack: int) -> "Tree":
        """Shards of weight one, numbered from 0 through all racks."""
        return Tree(
            tuple(
                Shard(k // (racks * per_rack), k // per_rack % racks, k)
                for k in range(regions * racks * per_rack)
            )
        )

    def grown(self, added: Iterable[Shard]) -> "Tree":
        """The tree with more shards: rows move into these and nowhere else."""
        branch = 1 + max((s.branch for s in self.shards), default=-1)
        taken = {s.shard for s in self.shards}
        new = tuple(replace(s, branch=branch) for s in added)
        if any(s.shard in taken for s in new):
            raise ValueError("a shard of that number is there already")
        return Tree(self.shards + new)

    def reweighted(self, shard: int, weight: float) -> "Tree":
        """The tree with another weight of one shard: rows move only out of or into
        its region (or its branch, if it came later)."""
        return Tree(tuple(replace(s, weight=weight) if s.shard == shard else s for s in self.shards))


def _draw(key: Column, name: str) -> Column:
    """ln(u), u from 52 bits of a hash, never 0 or 1."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name)).cast("binary")), 1, 13), 16, 10)
    return F.log((digits.cast("double") + F.lit(0.5)) / F.lit(float(2**52)))


def _choose(key: Column, children: list[tuple[str, float]]) -> Column:
    """Place in the list of the child with the largest draw, ties to the first."""
    if len(children) == 1:
        return F.lit(0)
    draws = [
        F.struct((_draw(key, name) / F.lit(weight)).alias("draw"), F.lit(-k).alias("place"))
        for k, (name, weight) in enumerate(children)
    ]
    return -F.array_max(F.array(*draws))["place"]


def placed(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. The text form of ``key`` and the tree
    alone decide; a null key counts as empty text. Shards of weight 0 take nothing."""
    live = [s for s in tree.shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def descend(shards: list[Shard], level: int, name: str) -> Column:
        if level == 3:
            return F.lit(shards[0].shard)
        groups: dict[tuple, list[Shard]] = {}
        for s in shards:
            node = ((s.branch, s.region), (s.rack,), (s.shard,))[level]
            groups.setdefault(node, []).append(s)
        names = [name + "/" + ".".join(map(str, node)) for node in groups]
        below = [descend(group, level + 1, n) for n, group in zip(names, groups.values())]
        chosen = _choose(text, [(n, sum(s.weight for s in g)) for n, g in zip(names, groups.values())])
        if len(below) == 1:
            return below[0]
        # One-element array: the place is drawn once and named.
        def turn(place: Column) -> Column:
            case = F.when(place == 0, below[0])
            for k, b in enumerate(below[1:], 1):
                case = case.when(place == k, b)
            return case

        return F.get(F.transform(F.array(chosen), turn), F.lit(0))

    return df.withColumn(out, descend(live, 0, "").cast("int"))


def sharded(
    docs: DataFrame, tree: Tree, grown: Tree, id: str = "doc_id", text: str = "text", digits: int = 3
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``
    for every row: where it lies, its place there, and where it would lie in the
    ``grown`` tree.

    The id decides the shard: repeated ids lie together, a null id counts as empty
    text. A null text has no bytes (size 1, crc32 0). Repeated rows take a slot each.
    Slots count from 0 without gaps in the order of a hash of id and text, then id,
    size and crc32. Only ids and numbers are shuffled, equal rows are counted before
    that, and slots are numbered in blocks of the hash (16 to the power ``digits``
    per shard), so neither a common id nor null ids of many texts meet in one task.
    An empty table gives an empty one; other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    # Counted and stored first: the texts are read once.
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32").cast("string"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    counted = placed(counted, F.col("doc_id"), tree, "shard")
    counted = placed(counted, F.col("doc_id"), grown, "grown_shard")
    counted = stored(counted.withColumn("block", F.substring(F.md5(key.cast("binary")), 1, digits)), "shards", False)
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    numbered = running(counted, ["shard"], order, F.col("block"), F.col("copies"), "first", inclusive=False)
    # Copies get their slots in steps, so that no row holds a long array.
    step = 4096
    some = numbered.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    some = some.withColumn("k", F.explode(F.sequence("lo", F.least(F.col("lo") + step, F.col("copies")) - 1)))
    return some.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k")).alias("slot"), "grown_shard"
    )


def write_shards(
    docs: DataFrame, tree: Tree, path: str, id: str = "doc_id", files: int | None = None
) -> None:
    """Writes all columns of ``docs`` as Parquet, a folder per shard. Each shard is
    dealt over ``files`` tasks by a hash of the whole row's id and text, so a shard
    of any size is written by many."""
    spread = F.pmod(F.xxhash64(*docs.columns), F.lit(files or parts(docs.sparkSession)))
    out = placed(docs, F.col(id), tree, "shard").withColumn("__part", spread)
    n = max(parts(docs.sparkSession), len(tree.shards))
    out.repartition(n, "shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
