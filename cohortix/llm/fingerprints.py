"""Operator 8: document fingerprints as invertible Bloom lookup sketches. DataFrame functions only.

A text's units (sentences and lines) are digested to 64 bits. A sketch has buckets of 4 rows of cells; a digest goes to
one bucket, by its hash, and there to one cell of each row, where it is counted and XORed with the others, and so is its
check value. Sketches of one size subtract cell by cell; what both hold vanishes, and peeling recovers the rest: a cell
that holds one digest alone gives it away, and it is taken from its other cells. A bucket in which peeling stops short is
sketched anew with four and then eight times the cells; after that its digests themselves are compared.
The fingerprint is the sketch of one bucket: two of them give the same likeness where they can be peeled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of cells in a bucket, and the cells of a row in the sizes tried.
ROWS, WIDTHS = 4, (4, 16, 32)
#: Digests of both texts for a bucket, and rounds of peeling.
LOAD, ROUNDS = 4, 6
#: Where units end: at line ends and at every sentence end, whatever letter or script follows.
UNIT_ENDS = r"\n|(?<=[.!?]) "
#: Documents for a part of the order in which each finds its next, and how often the average the largest part may hold.
PART, UNEVEN = 1000, 4
HASH, CHECK, WIDE = "place", "check", "wide"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column, ends: str = UNIT_ENDS) -> Column:
    """Distinct 64-bit digests of a text's units that are not empty."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), ends), ""), lambda u: F.xxhash64(u)))


def item(k: Column, h: Column) -> list[Column]:
    """Fields of a digest: itself, its check value, its hash, and its cells in the smallest size."""
    r = F.xxhash64(k, F.lit(HASH))
    return [k.alias("k"), h.alias("h"), r.alias("r"), *[F.shiftright(r, 2 * s).bitwiseAND(F.lit(3).cast("long")).cast("int").alias(f"c{s}") for s in range(ROWS)]]


def placed(ds: Column) -> Column:
    return F.transform(ds, lambda d: F.struct(*item(d, F.xxhash64(d, F.lit(CHECK)))))


def cell_of(x: Column, row: int, width: int) -> Column:
    """The cell of an item in a row."""
    if width == WIDTHS[0]:
        return x[f"c{row}"]
    bits = width.bit_length() - 1
    r = x.r if width == WIDTHS[1] else F.xxhash64(x.k, F.lit(WIDE))
    return F.shiftright(r, 8 + bits * row).bitwiseAND(F.lit(width - 1).cast("long")).cast("int")


def buckets(items: Column, high: Column, low: Column) -> Column:
    """items (of placed()) dealt to high x low buckets in two steps, powers of two; each item is looked at high + low times."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), high - 1),
            lambda a: let(F.filter(items, lambda x: F.shiftright(x.r, 44).bitwiseAND(high - 1) == a), lambda part: F.transform(F.sequence(F.lit(0), low - 1), lambda b: F.filter(part, lambda x: F.shiftright(x.r, 24).bitwiseAND(low - 1) == b))),
        )
    )


def cells(items: Column, width: int) -> Column:
    """Cells (c, k, h) of one bucket, row after row: count, XOR of digests, XOR of check values."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    add = lambda a, x: F.struct((a.c + 1).alias("c"), a.k.bitwiseXOR(x.k).alias("k"), a.h.bitwiseXOR(x.h).alias("h"))
    row = lambda s: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.filter(items, lambda x: cell_of(x, s, width) == j), zero, add))
    return F.concat(*[row(s) for s in range(ROWS)])


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x.c - y.c).alias("c"), x.k.bitwiseXOR(y.k).alias("k"), x.h.bitwiseXOR(y.h).alias("h")))


def peel(difference: Column, width: int, rounds: int = ROUNDS) -> Column:
    """Struct (more, less): how many digests of either side come out of a bucket's cells; null if some stay in."""
    start = F.struct(difference.alias("cells"), F.lit(0).alias("more"), F.lit(0).alias("less"))

    def turn(state: Column, _: Column) -> Column:
        alone = F.filter(state.cells, lambda x: (F.abs(x.c) == 1) & (x.h == F.xxhash64(x.k, F.lit(CHECK))))
        pure = F.array_distinct(F.transform(alone, lambda x: F.struct(*item(x.k, x.h), x.c.alias("c"))))

        def taken(p: Column) -> Column:
            less = lambda a, x: F.struct((a.c - x.c).alias("c"), a.k.bitwiseXOR(x.k).alias("k"), a.h.bitwiseXOR(x.h).alias("h"))
            row = lambda s: F.transform(F.slice(state.cells, s * width + 1, width), lambda cell, j: F.aggregate(F.filter(p, lambda x: cell_of(x, s, width) == j), cell, less))
            more = F.size(F.filter(p, lambda x: x.c == 1))
            return F.struct(F.concat(*[row(s) for s in range(ROWS)]).alias("cells"), (state.more + more).alias("more"), (state.less + F.size(p) - more).alias("less"))

        return F.when(F.exists(state.cells, lambda x: x.c != 0), let(pure, taken)).otherwise(state)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)
    return let(done, lambda s: F.when(~F.exists(s.cells, lambda x: (x.c != 0) | (x.k != 0)), F.struct(s.more.alias("more"), s.less.alias("less"))))


def sketched(items: Column, log: Column) -> Column:
    """The buckets (items, cells), 2 to the power log, of a text's items (of placed())."""
    low = F.shiftright(log, 1)
    size = lambda n: F.pow(F.lit(2.0), n).cast("int")
    return F.transform(buckets(items, size(log - low), size(low)), lambda x: F.struct(x.alias("items"), cells(x, WIDTHS[0]).alias("cells")))


def likeness(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Jaccard similarity of two texts' units from the peeled difference of their sketches, of one size; 1 if both are empty."""
    keys = lambda x: F.transform(x, lambda i: i.k)

    def exact(x: Column, y: Column) -> Column:
        return F.struct(F.size(F.array_except(keys(x), keys(y))).alias("more"), F.size(F.array_except(keys(y), keys(x))).alias("less"))

    def compared(x: Column, y: Column) -> Column:
        larger = [peel(minus(cells(x["items"], w), cells(y["items"], w)), w) for w in WIDTHS[1:]]
        return F.coalesce(peel(minus(x.cells, y.cells), WIDTHS[0]), *larger, exact(x["items"], y["items"]))

    more = F.aggregate(F.zip_with(a, b, compared), F.lit(0), lambda n, x: n + x.more)
    return let(more, lambda m: F.when(n_b + m == 0, F.lit(1.0)).otherwise((n_a - m).cast("double") / F.greatest(n_b + m, F.lit(1))))


def fingerprint(items: Column) -> Column:
    """Hexadecimal cells of the sketch of one bucket, 28 digits each: 4 of the count, 16 of the digests, 8 of the checks."""
    number = lambda x, n: F.lpad(F.hex(x), n, "0")
    low = lambda x, bits: x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.array_join(F.transform(cells(items, WIDTHS[0]), lambda x: F.concat(number(low(x.c, 16), 4), number(x.k, 16), number(low(x.h, 32), 8))), "")


def with_next(documents: DataFrame, columns: list[str], doc_id: str = "doc_id", tie: str = "_tie", part: int = PART, uneven: float = UNEVEN) -> DataFrame:
    """documents with next, a struct of columns of the document that follows by (doc_id, tie), after the last of the first; null where doc_id is.

    The order is cut into parts of equal width in doc_id, or, where ids crowd together so that a part would be uneven
    times too large, into sampled ranges. Each part is sorted in one task; its last row's next is the first of the next
    part. Parts are ordered in runs of part of them, side by side, and one row for each run meets in one task. First rows,
    two numbers each, are broadcast up to 1,000,000 of them."""
    from .common import durable

    known = documents.where(F.col(doc_id).isNotNull())
    n, least, most = known.agg(F.count("*"), F.min(doc_id), F.max(doc_id)).first()
    if not n:
        return documents.withColumn("next", F.when(F.lit(False), F.struct(*columns)))
    width = max(1, -(-(most - least + 1) // max(1, -(-n // part))))
    number = F.floor((F.col(doc_id) - F.lit(least)) / F.lit(width)).cast("long")
    largest = known.groupBy(number.alias("p")).count().agg(F.max("count")).first()[0]
    if largest > uneven * max(part, 1):
        known = durable(known.repartitionByRange(max(1, min(-(-n // part), 100_000)), doc_id, tie).withColumn("_part", F.spark_partition_id().cast("long")))
    else:
        known = known.withColumn("_part", number)
    order = Window.partitionBy("_part").orderBy(doc_id, tie)
    # the first row of each part, which the last row of the part before needs
    heads = durable(known.groupBy("_part").agg(F.min(F.struct(doc_id, tie)).alias("head")))
    parts = heads.count()
    # the part before each part: within runs of part numbers side by side, and of the run before for the first of a run
    group = F.floor(F.col("_part") / F.lit(part)).cast("long")
    runs = heads.groupBy(group.alias("_run")).agg(F.max("_part").alias("_top"))
    runs = runs.withColumn("_top", F.lag("_top").over(Window.orderBy("_run")))
    last = heads.agg(F.max("_part")).first()[0]
    inside = heads.withColumn("_run", group).withColumn("_before", F.lag("_part").over(Window.partitionBy("_run").orderBy("_part")))
    after = inside.join(F.broadcast(runs), "_run")
    after = after.select(F.coalesce("_before", "_top", F.lit(last)).alias("_part"), F.col(f"head.{doc_id}").alias(doc_id), F.col(f"head.{tie}").alias(tie))
    after = F.broadcast(after) if parts <= 1_000_000 else after
    heads = known.drop("_part").join(after, [doc_id, tie]).groupBy("_part").agg(F.first(F.struct(*columns)).alias("_head"))
    out = known.withColumn("next", F.lead(F.struct(*columns)).over(order)).join(heads, "_part", "left")
    out = out.withColumn("next", F.coalesce("next", "_head")).drop("_head", "_part")
    return out.unionByName(documents.where(F.col(doc_id).isNull()).withColumn("next", F.lit(None).cast(out.schema["next"].dataType)))


def edited(text: Column, following: Column) -> Column:
    """text whose last floor(n/2) code points are replaced by the first as many (or all) of following."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = PART, uneven: float = UNEVEN) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each document.

    Null texts count as empty. Rows with equal ids follow one another by a hash of their text; rows with null id have no
    next document, and their edited text ends with nothing in place of its second half. Of one document alone the next is
    itself. An empty table gives an empty one."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_digests": digests(F.col("text"))})
    rows = with_next(rows, ["text", "_digests"], "doc_id", "_tie", part, uneven)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next.text")))
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        placed(F.col("_digests")).alias("_own"),
        placed(digests(F.col("_edited"))).alias("_new"),
        placed(F.coalesce(F.col("next._digests"), none)).alias("_next"),
    )
    most = F.size("_own") + F.greatest(F.size("_new"), F.size("_next"))
    log = F.round(F.log2(F.greatest(F.lit(1.0), most / F.lit(float(LOAD))))).cast("int")
    rows = rows.withColumn("_log", log).withColumns({f"_s{c}": sketched(F.col(c), F.col("_log")) for c in ("_own", "_new", "_next")})
    near = lambda c: likeness(F.col("_s_own"), F.col(f"_s{c}"), F.size("_own"), F.size(c))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"), near("_new").alias("near_edited"), near("_next").alias("near_next"))
