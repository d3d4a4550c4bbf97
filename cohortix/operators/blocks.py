"""Exchangeability blocks: family structure, restricted permutations, sign flips, variance groups.

Random order is the order of md5('seed:perm:id'): the same on every engine, for every partitioning, and without state."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortix.shared import placed


def shuffle_key(seed: int, perm: Column | str, item: Column | str) -> Column:
    perm, item = (F.col(c) if isinstance(c, str) else c for c in (perm, item))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), perm.cast("string"), item.cast("string")))


def permutations(n: int, spark) -> DataFrame:
    """(perm): 1 to n."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("perm"))


def permute_within(subjects: DataFrame, perms: DataFrame, block: str, seed: int = 0) -> DataFrame:
    """(perm, dst, src): subjects shuffled freely inside each block. subjects: (subject, block)."""
    at = subjects.select(F.col(block).alias("block"), F.col("subject").alias("dst"), F.row_number().over(Window.partitionBy(block).orderBy("subject")).alias("k"))
    rows = subjects.select(F.col(block).alias("block"), F.col("subject").alias("src")).crossJoin(F.broadcast(perms))
    order = Window.partitionBy("perm", "block").orderBy(shuffle_key(seed, "perm", "src"), "src")
    return rows.withColumn("k", F.row_number().over(order)).join(at, ["block", "k"]).select("perm", "dst", "src")


def permute_whole(subjects: DataFrame, perms: DataFrame, block: str, seed: int = 0) -> DataFrame:
    """(perm, dst, src): blocks of equal size swap as wholes, members in the order of subject."""
    member = subjects.select(F.col(block).alias("block"), "subject", F.row_number().over(Window.partitionBy(block).orderBy("subject")).alias("k"))
    sizes = member.groupBy("block").agg(F.count("*").alias("size"))
    at = sizes.select("size", F.col("block").alias("to"), F.row_number().over(Window.partitionBy("size").orderBy("block")).alias("r"))
    shuffled = sizes.crossJoin(F.broadcast(perms))
    shuffled = shuffled.select("perm", "size", F.col("block").alias("from"), F.row_number().over(Window.partitionBy("perm", "size").orderBy(shuffle_key(seed, "perm", "block"), "block")).alias("r"))
    moves = shuffled.join(at, ["size", "r"])
    dst, src = member.select(F.col("block").alias("to"), F.col("subject").alias("dst"), "k"), member.select(F.col("block").alias("from"), F.col("subject").alias("src"), "k")
    return moves.join(dst, "to").join(src, ["from", "k"]).select("perm", "dst", "src")


def apply_permutation(long: DataFrame, moves: DataFrame) -> DataFrame:
    """(perm, subject, feat, v): each subject takes the values of its source."""
    return moves.join(long.withColumnRenamed("subject", "src"), "src").select("perm", F.col("dst").alias("subject"), "feat", "v")


def sign_flips(subjects: DataFrame, perms: DataFrame, seed: int = 0) -> DataFrame:
    """(perm, subject, sign): +1 or -1 by the parity of the first hexadecimal digit of the key."""
    digit = F.conv(F.substring(shuffle_key(seed, "perm", "subject"), 1, 1), 16, 10).cast("int")
    return subjects.select("subject").crossJoin(F.broadcast(perms)).select("perm", "subject", F.when(digit % 2 == 0, 1).otherwise(-1).alias("sign"))


def variance_groups_within(subjects: DataFrame, block: str) -> DataFrame:
    """(subject, vg): members of a block may swap, so each block is a group."""
    codes = placed(subjects.select(block).distinct(), block).select(block, F.col("place").alias("vg"))
    return subjects.join(codes, block).select("subject", "vg")


def variance_groups_whole(subjects: DataFrame, block: str) -> DataFrame:
    """(subject, vg): the members at one place of all blocks of one size are a group."""
    member = subjects.select(F.col(block).alias("block"), "subject", F.row_number().over(Window.partitionBy(block).orderBy("subject")).alias("k"))
    sizes = member.groupBy("block").agg(F.count("*").alias("size"))
    places = member.join(sizes, "block")
    codes = placed(places.select("size", "k").distinct(), "size", "k").select("size", "k", F.col("place").alias("vg"))
    return places.join(codes, ["size", "k"]).select("subject", "vg")


def min_group_filter(subjects: DataFrame, group: str, least: int) -> DataFrame:
    """Subjects of groups with least members or more."""
    large = subjects.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    return subjects.join(large, group, "left_semi")


def family_blocks(rows: DataFrame, order: str, family: str, relation: str, zygosity: str, neg_ones: bool = False, sorted_signature: bool = False) -> DataFrame:
    """(subject, [neg_ones], family_type, family, relation): blocks of families of one make-up.

    Rows without family or relation go. Twins and triplets that aren't monozygotic, or of unknown zygosity, count as
    siblings. A family's signature is its members' relations in row order (or sorted); its type is the place of the
    signature's first row among all first rows. Families and relations are coded in sorted order."""
    rows = rows.dropna(subset=[family, relation])
    kin = F.when(F.col(relation).isin("twin", "triplet") & ~F.col(zygosity).eqNullSafe("monozygotic"), "sibling").otherwise(F.col(relation))
    rows = rows.select("subject", F.col(order).alias("_at"), F.col(family).alias("family"), kin.alias("relation"))
    members = F.array_sort(F.collect_list(F.struct("_at", "relation")))
    names = F.transform(members, lambda m: m.relation)
    families = rows.groupBy("family").agg(F.concat_ws("|", F.array_sort(names) if sorted_signature else names).alias("_signature"), F.min("_at").alias("_first"))
    kinds = families.groupBy("_signature").agg(F.min("_first").alias("_first"))
    kinds = placed(kinds, "_first").select("_signature", F.col("place").alias("family_type"))
    code = lambda c: placed(rows.select(c).distinct(), c).select(c, F.col("place").alias(f"_{c}"))
    out = rows.join(families.join(kinds, "_signature").select("family", "family_type"), "family").join(code("family"), "family").join(code("relation"), "relation")
    first = [F.lit(-1).alias("neg_ones")] if neg_ones else []
    return out.select("subject", *first, "family_type", F.col("_family").alias("family"), F.col("_relation").alias("relation"))


# Nested blocks: one permutation is a walk over a small tree of labels and needs all subjects of one replicate; replicates run in parallel.


def random_order(items: list, seed: int, perm: int) -> list:
    return sorted(items, key=lambda x: (hashlib.md5(f"{seed}:{perm}:{x}".encode()).hexdigest(), x))


def permute_nested(blocks: np.ndarray, seed: int, perm: int, within: bool = True) -> np.ndarray:
    """Sources of all subjects in one permutation of nested blocks, columns outermost first.

    The sign of a label governs its sub-blocks: those of a label of 0 or more swap as wholes among those of equal size and
    are then gone into; those of a negative label stay where they are and are gone into."""
    n = len(blocks)
    outer = np.full((n, 1), -1 if within else 1)
    levels = np.concatenate((outer, blocks.reshape(n, -1), np.arange(n).reshape(n, 1)), axis=1)
    last = levels.shape[1] - 1
    # members of a level are kept in the order of their labels, so that sub-blocks of equal size match place by place

    def arranged(members: list[int], level: int) -> list[int]:
        """The members' sources, in the members' order, from the level's label on."""
        if level == last:
            return members
        groups: dict[int, list[int]] = {}
        for m in members:
            groups.setdefault(int(levels[m, level + 1]), []).append(m)
        label = int(levels[members[0], level])
        inside = {g: arranged(ms, level + 1) for g, ms in groups.items()}
        if label < 0:
            return [x for g in groups for x in inside[g]]
        by_size: dict[int, list[int]] = {}
        for g, ms in groups.items():
            by_size.setdefault(len(ms), []).append(g)
        takes: dict[int, int] = {}
        for gs in by_size.values():
            takes |= dict(zip(gs, random_order(gs, seed, perm)))
        return [x for g in groups for x in inside[takes[g]]]

    order = sorted(range(n), key=lambda i: tuple(levels[i, 1:]))
    # grouping keeps the order of `order`, so positions and members line up at every level
    out = np.empty(n, dtype=np.int64)
    groups_in_order = arranged_positions(levels, order)
    out[groups_in_order] = arranged(groups_in_order, 0)
    return out


def arranged_positions(levels: np.ndarray, order: list[int]) -> list[int]:
    """Subjects in depth-first order of their label tree."""
    return sorted(order, key=lambda i: tuple(levels[i].tolist()))


def variance_groups_nested(blocks: np.ndarray, within: bool = True) -> np.ndarray:
    """Codes 0, 1, ... of the sets of subjects that permutations of nested blocks can exchange with one another."""
    n = len(blocks)
    levels = np.concatenate((np.full((n, 1), -1 if within else 1), blocks.reshape(n, -1), np.arange(n).reshape(n, 1)), axis=1)
    last = levels.shape[1] - 1
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def walk(members: list[int], level: int) -> None:
        if level == last:
            return
        groups: dict[int, list[int]] = {}
        for m in members:
            groups.setdefault(int(levels[m, level + 1]), []).append(m)
        if int(levels[members[0], level]) >= 0:
            first: dict[int, list[int]] = {}
            for ms in groups.values():
                for a, b in zip(first.setdefault(len(ms), ms), ms):
                    parent[find(a)] = find(b)
        for ms in groups.values():
            walk(ms, level + 1)

    walk(arranged_positions(levels, list(range(n))), 0)
    roots = [find(i) for i in range(n)]
    return np.unique(np.array(roots), return_inverse=True)[1]
