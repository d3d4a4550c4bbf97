"""Operator 10: near-duplicate documents by one-permutation MinHash.

Each shingle is hashed once: the top bits give its bin, and a bin keeps its least value (one permutation). An empty bin
takes the value of the first bin that isn't empty in a probing order of its own (optimal densification). Bands of bins
make buckets. Documents with equal shingle sets are one class, represented by the smallest id; in each bucket every
representative is paired with one of them only, the bucket's head (a star), so pairs grow with the rows and not with their
square. Heads are drawn anew in each bucket, so that a document is compared with many others of a large group. Pairs are
confirmed on full shingle sets, the likeliest of each document first, and then those that would still join two
components. Where a bucket still holds several components, all its members meet again in finer buckets, of two bands.
What then still shares a bucket but no component is compared pair by pair: documents connected by such buckets are a group,
cut into blocks, and a task counts the common shingles of all pairs of two blocks at once, on full sets. So no pair that
shares a bucket is left out, however large its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_classes, compact, discard, durable, mix, release_memory, shingles_of, slices, small_batches, spread_join, stored, text_bytes, words_of

SHINGLE = 5
#: Linked if 100 x intersection >= PERCENT x union.
PERCENT = 75
BINS, BANDS = 128, 32
#: Times that buckets of several components are cut finer, each time with another second band.
ROUNDS = 3
#: A block has an eighth of its group's documents, but within these bounds, and about so many shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = (256, 1024), 1 << 19
#: Shingles of more documents of two blocks than RARE are counted as products of matrices of so many columns.
RARE, COLUMNS = 8, 512

_probes: np.ndarray | None = None


def probes() -> np.ndarray:
    """For each bin the place of every bin in its probing order."""
    global _probes
    if _probes is None:
        rng = np.random.default_rng(10)
        _probes = np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)
    return _probes


def signature(distinct: np.ndarray) -> np.ndarray:
    """The BINS values of a set of hashes, sorted and not empty."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (distinct >> shift).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    out = np.empty(BINS, dtype=np.uint64)
    out[full] = distinct[first]
    if len(full) < BINS:
        empty = np.ones(BINS, dtype=bool)
        empty[full] = False
        e = np.flatnonzero(empty)
        out[e] = out[full[probes()[np.ix_(e, full)].argmin(axis=1)]]
    return out


def sets_of(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = text_bytes(texts)
    classes = byte_classes("nonspace")
    for i, j in slices(at):
        words, _, _, first = words_of(raw[at[i] : at[j]], at[i : j + 1] - at[i], classes)
        for k in range(j - i):
            yield np.unique(shingles_of(words[first[k] : first[k + 1]], size))


def sketched(text: Column | str, size: int = SHINGLE) -> Column:
    """Struct (n, k1, k2, bands): number of distinct shingles, 128-bit hash of their set, band hashes (null without words)."""

    @F.arrow_udf("struct<n:bigint,k1:bigint,k2:bigint,bands:array<bigint>>")
    def sketch(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = BINS // BANDS
        for texts in column:
            n, k1, k2, rows = [], [], [], []
            for s in sets_of(texts, size):
                n.append(len(s))
                k1.append(int(mix(s ^ np.uint64(0x1234567)).sum().astype(np.int64)))
                k2.append(int(mix(s ^ np.uint64(0x7654321)).sum().astype(np.int64)))
                if len(s):
                    rows.append(signature(s))
            sizes = np.concatenate(([0], np.cumsum(np.array(n, dtype=np.int64) > 0))) * BANDS
            values = np.stack(rows).reshape(-1, BANDS, width) if rows else np.zeros((0, BANDS, width), dtype=np.uint64)
            hashed = np.zeros(values.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(width):
                hashed = mix(hashed ^ values[:, :, i]) + np.uint64(i)
            empty = np.array(n, dtype=np.int64) == 0
            bands = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(hashed.reshape(-1).view(np.int64)), mask=pa.array(empty))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), bands], ["n", "k1", "k2", "bands"])
        release_memory()

    return sketch(text)


def alike(a: Column | str, b: Column | str, size: int = SHINGLE, percent: int = PERCENT) -> Column:
    """Whether two texts' full shingle sets are linked."""

    @F.arrow_udf("boolean")
    def compared(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            out = []
            for x, y in zip(sets_of(left, size), sets_of(right, size)):
                if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    out.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.array(out, pa.bool_())
        release_memory()

    return compared(a, b)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose texts are linked. texts: (id, text)."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.where(alike("text_a", "text_b", size, percent)).select("a", "b")


def stars(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, head): each member of a bucket of two or more with its head; the head is that whose id, XORed with a hash of the keys, is least."""
    salted = members.withColumn("_salt", F.xxhash64(*keys)).withColumn("_order", F.col("id").bitwiseXOR(F.col("_salt")))
    heads = salted.groupBy(*keys).agg(F.min("_order").alias("_least"), F.max("_order").alias("_last")).where("_least < _last").drop("_last")
    out = spread_join(salted, heads, keys).where("_order <> _least")
    return out.withColumn("head", F.col("_least").bitwiseXOR(F.col("_salt"))).drop("_salt", "_order", "_least")


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, root) of every id with links (a, b) to the smallest id it reaches, but for the roots themselves.

    Alternates two steps until only stars are left: every node hands its larger neighbours to its smallest one, then all
    its smaller ones. Smallest neighbours are aggregated, and no neighbourhood is gathered. Paths shrink by a factor each
    round, so that rounds are never used up in practice; if they were, that would be an error and not a wrong result."""
    edges = compact(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf + centre > 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = compact(small.where("a <> b").distinct())
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (a, b, ...) whose ends lie in different components so far."""
    root = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
    out = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return out.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def hashed_sets(text: Column | str, size: int = SHINGLE) -> Column:
    """The sorted distinct shingle hashes of each text, 8 bytes each."""

    @F.arrow_udf("binary")
    def hashed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            yield pa.array([s.astype("<u8").tobytes() for s in sets_of(texts, size)], pa.binary())
        release_memory()

    return hashed(text)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common hashes of each of the sets left with each of the sets right (places in sets)."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    often = np.diff(np.append(begin, len(flat)))
    place = np.full((2, len(sets)), -1, dtype=np.int64)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), dtype=np.int32)
    for k in np.unique(often[often <= RARE]).tolist():
        i, j = (c.ravel() for c in np.indices((k, k)))
        first = begin[often == k]
        for at in range(0, len(first), max(1, (1 << 20) // k**2)):
            rows = row[first[at : at + max(1, (1 << 20) // k**2), None] + np.arange(k)]
            a, b = place[0, rows[:, i]].ravel(), place[1, rows[:, j]].ravel()
            ok = (a >= 0) & (b >= 0)
            cell, n = np.unique(a[ok] * len(right) + b[ok], return_counts=True)
            out[cell] += n.astype(np.int32)
    out = out.reshape(len(left), len(right))
    first, n = begin[often > RARE], often[often > RARE]
    for at in range(0, len(first), COLUMNS):
        f, m = first[at : at + COLUMNS], n[at : at + COLUMNS]
        entry = np.arange(int(m.sum())) + np.repeat(f - (np.cumsum(m) - m), m)
        dense = np.zeros((len(sets), len(f)), dtype=np.float32)
        dense[row[entry], np.repeat(np.arange(len(f)), m)] = 1
        out += (dense[left] @ dense[right].T).astype(np.int32)
    return out


def linked_roots(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of roots whose documents are linked, as many as are needed to connect them; side: 0 left, 1 right, 2 both."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    n = np.array([len(s) for s in sets], dtype=np.int64)
    common = common_counts(sets, left, right).astype(np.int64)
    linked = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    linked &= (root[left][:, None] != root[right][None, :]) & (n[left] > 0)[:, None] & (n[right] > 0)[None, :]
    i, j = np.nonzero(linked)
    pairs = np.unique(np.sort(np.stack((root[left[i]], root[right[j]]), axis=1), axis=1), axis=0)
    out, up = [], {}
    for a, b in pairs.tolist():
        x, y = a, b
        while x in up:
            x = up[x]
        while y in up:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def cells(members: DataFrame, percent: int) -> DataFrame:
    """(id, root, cell, side): the blocks of each group that have to be compared meet in cells. members: (id, n, root, group).

    Pairs within the largest component of a group are left out, and those whose sizes alone rule out a link: sizes fall
    into classes, each larger by 100 / percent and a bit, and only neighbouring classes are compared."""
    most = members.groupBy("group", "root").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    base = 1.005 * 100 / max(1, percent)
    rows = compact(spread_join(members, most, ["group"]).select("id", "n", "root", "group", (F.col("root") != F.col("largest")).alias("asks"), F.floor(F.log("n") / F.log(F.lit(base))).alias("class")))
    unit = ["group", "asks", "class"]
    size = F.least(F.greatest(F.ceil(F.col("rows") / 8), F.lit(BLOCK_ROWS[0])), F.lit(BLOCK_ROWS[1]))
    units = rows.groupBy(*unit).agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    units = compact(units.select(*unit, F.greatest(F.ceil(F.col("rows") / size), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks")))
    left = units.where("asks").select("group", F.col("class").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    right = units.select("group", "asks", F.col("class").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    met = left.join(right, "group").where("abs(a - b) <= 1 and (not asks or a < b or a = b and i <= j)").withColumn("cell", F.xxhash64("group", "a", "i", "asks", "b", "j"))
    end = lambda asks, c, block, side: F.struct(asks.alias("asks"), F.col(c).alias("class"), F.col(block).alias("block"), F.lit(side).alias("side"))
    ends = F.when(F.expr("asks and a = b and i = j"), F.array(end(F.lit(True), "a", "i", 2))).otherwise(F.array(end(F.lit(True), "a", "i", 0), end(F.col("asks"), "b", "j", 1)))
    ends = met.select("group", "cell", F.explode(ends).alias("e")).select("group", "cell", "e.*")
    placed = spread_join(rows, units, unit).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return spread_join(placed, ends, [*unit, "block"]).select("id", "root", "cell", "side")


def all_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): roots that are linked by documents of one group, as many pairs as are needed to connect them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, out = None, [], []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "root", "set"))):
                if row[0] != cell:
                    out += compared(waiting)
                    cell, waiting = row[0], []
                waiting.append(row[1:])
        out += compared(waiting)
        for i in range(0, len(out), 100_000):
            a, b = zip(*out[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release_memory()

    def compared(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        if not rows:
            return []
        side, root, sets = zip(*rows)
        return linked_roots([np.frombuffer(s, dtype="<u8") for s in sets], np.array(side), np.array(root, dtype=np.int64), percent)

    spark = members.sparkSession
    sets, path = stored(texts.join(members.select("id").distinct(), "id", "left_semi").select("id", hashed_sets(F.col("text"), size).alias("set")))
    met = spread_join(cells(members, percent), sets, ["id"]).select("cell", "side", "root", "set")
    out = compact(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(found, "a bigint, b bigint"))
    discard(spark, path)
    return out


def near_dedup(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document.

    Documents without words have no shingles and are linked with nothing. Rows with equal ids are one document and stand
    or fall together; a row with null id belongs to no component (null) and is kept. An empty table gives an empty one."""
    small_batches(documents.sparkSession)
    named = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sketches = durable(named.select("id", sketched(F.col("text"), size).alias("s")).select("id", "s.*"))
    classes = durable(sketches.where("id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("head"), F.min_by("bands", "id").alias("bands")))
    members = classes.select(F.col("head").alias("id"), F.posexplode("bands").alias("band", "hash"))
    met = durable(stars(members, ["band", "hash"]).select("id", "head", "band", "hash"))
    pairs = compact(met.groupBy(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).agg(F.count("*").alias("shared")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts, path = stored(named.join(ends, "id", "left_semi"))
    first = compact(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")))
    roots = components(confirmed(first, texts, size, percent))

    def tried(roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(roots, tried pairs) after confirming those of more that may join two components."""
        more = compact(rooted(more, roots))
        if more.isEmpty():
            return roots, more
        links = compact(confirmed(more, texts, size, percent))
        if links.isEmpty():
            return roots, more
        return components(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))), more

    roots, _ = tried(roots, pairs.select("a", "b").join(first, ["a", "b"], "left_anti"))
    bands = classes.select(F.col("head").alias("id"), "bands")
    known = pairs.select("a", "b")
    for i in range(1, rounds + 2):
        mixed = compact(rooted(met.select(F.col("id").alias("a"), F.col("head").alias("b"), "band", "hash"), roots).select("band", "hash").distinct())
        if mixed.isEmpty():
            break
        if i > rounds:
            joint = spread_join(met, mixed, ["band", "hash"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
            groups = components(joint)
            groups = compact(groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "group"))
            sizes = classes.select(F.col("head").alias("id"), "n").distinct()
            members = groups.join(sizes, "id").join(roots, "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), "group")
            links = all_links(compact(members), texts, size, percent)
            if not links.isEmpty():
                roots = components(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
            break
        finer = spread_join(members, mixed, ["band", "hash"]).join(bands, "id")
        finer = finer.select("id", "hash", F.element_at("bands", F.pmod(F.col("band") + i, F.lit(BANDS)) + 1).alias("other"))
        again = stars(finer, ["hash", "other"]).select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct()
        roots, more = tried(roots, again.join(known, ["a", "b"], "left_anti"))
        known = known.unionByName(more)
    discard(documents.sparkSession, path)
    named_roots = classes.join(roots.select(F.col("id").alias("head"), "root"), "head", "left").select("k1", "k2", "n", F.coalesce("root", "head").alias("root"))
    out = spread_join(sketches.select("id", "n", "k1", "k2"), named_roots, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
