"""Names as columns: cleaning, sizes, mapping chains, affixes, side keys; and similarity and unique parts of names in Python."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Candidate tokens for the left and right side, in the order they are tried.
LEFT_KEYS = ["lh.", "hemi-L_", "left", "hemi-L", "lh_", "lh-", "lh", "L_", "L", "l"]
RIGHT_KEYS = ["rh.", "hemi-R_", "right", "hemi-R", "rh_", "rh-", "rh", "R_", "R", "r"]
# Units of human-readable sizes, each 1024 times the one before.
UNITS = ["B", "K", "M", "G", "T"]
#: Labels of one reference at most.
MOST_LABELS = 100_000


def clean_key(name: Column) -> Column:
    """Lower case; `.`, `-`, `_` become blanks, then double and triple blanks single ones, once each; tab and line feed blanks; `&` and."""
    out = F.lower(name)
    for old, new in ((".", " "), ("-", " "), ("_", " "), ("  ", " "), ("   ", " "), ("\t", " "), ("\n", " "), ("&", " and ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def size_to_bytes(size: Column) -> Column:
    """Bytes of `14G`, `10 KB`, `512`, `100B`: binary units, in any case, with or without a blank."""
    text = F.upper(F.trim(size.cast("string")))
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double") if hasattr(Column, "try_cast") else F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(text, r"^[0-9.]+\s*([BKMGT]?)", 1)
    factor = F.lit(1.0)
    for i, u in enumerate(UNITS):
        factor = F.when(unit == u, F.lit(float(1024**i))).otherwise(factor)
    return number * factor


def pieces(name: Column) -> Column:
    """Distinct tokens between blanks."""
    return F.array_distinct(F.array_remove(F.split(name, " "), ""))


def apply_mapping(name: Column, mapping: list[tuple[str, str]]) -> Column:
    """Cleaned keys replaced by cleaned values, one after the other in the mapping's order."""
    for old, new in mapping:
        name = F.replace(name, clean_key(F.lit(old)), clean_key(F.lit(new)))
    return name


def remove_affix(name: Column, key: str, kind: str | None) -> Column:
    """name without key at its start, at its end, or anywhere."""
    n = len(key)
    if kind == "start":
        return F.when(name.startswith(key), F.substring(name, F.lit(n + 1), F.char_length(name))).otherwise(name)
    if kind == "end":
        return F.when(name.endswith(key), F.substring(name, F.lit(1), F.char_length(name) - n)).otherwise(name)
    return F.replace(name, F.lit(key), F.lit(""))


def matches_key(name: Column, key: str, kind: str | None) -> Column:
    return name.startswith(key) if kind == "start" else name.endswith(key) if kind == "end" else name.contains(key)


def select_names(name: Column, include: list[tuple[str, str | None]], exclude: list[tuple[str, str | None]]) -> Column:
    """Whether a name has all keys to include and none to exclude."""
    out = F.lit(True)
    for key, kind in include:
        out &= matches_key(name, key, kind)
    for key, kind in exclude:
        out &= ~matches_key(name, key, kind)
    return out


def side_keys(names: DataFrame, column: str = "name", left: list[str] = LEFT_KEYS, right: list[str] = RIGHT_KEYS, tolerance: float = 0.15) -> DataFrame:
    """(rank, lh, rh, kind): the first pair of side tokens, at the start, at the end or anywhere, that each about half of the names have."""
    spark = names.sparkSession
    tries = [(i * 3 + j, a, b, k) for i, (a, b) in enumerate(zip(left, right)) for j, k in enumerate(("start", "end", "in"))]
    keys = F.broadcast(spark.createDataFrame(tries, "rank int, lh string, rh string, kind string"))
    name = F.col(column)
    has = lambda c: F.when(F.col("kind") == "start", name.startswith(F.col(c))).when(F.col("kind") == "end", name.endswith(F.col(c))).otherwise(name.contains(F.col(c)))
    counts = names.crossJoin(keys).groupBy("rank", "lh", "rh", "kind").agg(F.count("*").alias("n"), F.count_if(has("lh")).alias("l"), F.count_if(has("rh")).alias("r"))
    middle, slack = F.floor(F.col("n") / 2), F.col("n") * F.lit(tolerance)
    near = lambda c: (F.col(c) > middle - slack) & (F.col(c) < middle + slack)
    return counts.where(near("l") & near("r")).orderBy("rank").limit(1).select("rank", "lh", "rh", "kind")


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by matching blocks."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def longest_common_part(names: list[str]) -> str:
    """The longest substring of all names, the first in the alphabet of equals."""
    short = min(names, key=len)
    for n in range(len(short), 0, -1):
        hits = sorted({short[i : i + n] for i in range(len(short) - n + 1) if all(short[i : i + n] in x for x in names)})
        if hits:
            return hits[0]
    return ""


def unique_markers(names: list[str]) -> list[str]:
    """What is left of each name when common parts of two characters or more are taken out of all, longest first."""
    rest = list(names)
    while len(rest) > 1 and len(part := longest_common_part(rest)) > 1:
        rest = [x.replace(part, "") for x in rest]
    return rest


def best_reference(names: DataFrame, references: DataFrame) -> DataFrame:
    """(ref, n): the reference whose label names most distinct names contain, one of (ref, label) each; the first by name of equals."""
    hits = names.join(references, F.col("name").contains(F.col("label"))).groupBy("ref").agg(F.count_distinct("name").alias("n"))
    return hits.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("n"), "ref"))).where("_k = 1").select("ref", "n")


def resolve_names(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, label) for each name: the longest cleaned label it contains, else the one all of whose tokens it has; null if none.

    Labels are a reference's, few beside the names; ties go to the first label in the alphabet."""
    left = names.select("name", clean_key(F.col("name")).alias("_n"))
    right = labels.select("label", clean_key(F.col("label")).alias("_l"))
    part = F.col("_n").contains(F.col("_l"))
    tokens = F.size(F.array_except(pieces(F.col("_l")), pieces(F.col("_n")))) == 0
    both = left.join(right, part | tokens).select("name", "label", part.alias("_part"), F.char_length("_l").alias("_len"))
    order = Window.partitionBy("name").orderBy(F.desc("_part"), F.desc("_len"), "label")
    best = both.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("name", "label")
    return names.select("name").distinct().join(best, "name", "left")


def resolve_with_mapping(names: DataFrame, labels: DataFrame, mapping: list[tuple[str, str]], side: list[tuple[str, str | None]] = []) -> DataFrame:  # noqa: B006
    """(name, label): resolve_names() of the mapped name, else of the plain name, else of the name without its side tokens; the first that is found."""
    plain = names.select("name").distinct().withColumn("_m", apply_mapping(clean_key(F.col("name")), mapping))
    bare = F.col("name")
    for key, kind in side:
        bare = remove_affix(bare, key, kind)
    plain = plain.withColumn("_b", bare)
    out = plain
    for c in ("_m", "name", "_b"):
        found = resolve_names(plain.select(F.col(c).alias("name")).distinct(), labels)
        out = out.join(found.select(F.col("name").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    return out.select("name", F.coalesce("_m_label", "name_label", "_b_label").alias("label"))


def shortest_match(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, name): for each key the shortest name that contains it, the first in the alphabet of equals; null if none does."""
    hits = names.select("name").distinct().join(keys.select("key").distinct(), F.col("name").contains(F.col("key")))
    best = hits.groupBy("key").agg(F.min(F.struct(F.char_length("name").alias("n"), "name")).alias("b"))
    return keys.select("key").distinct().join(best.select("key", "b.name"), "key", "left")


def most_similar(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, label, ratio): the label of largest similarity() to each name, the first in the alphabet of equals. labels are a reference's, few."""
    both = names.select("name").distinct().crossJoin(F.broadcast(labels.select("label").distinct().limit(MOST_LABELS)))
    rated = both.withColumn("ratio", similarity(F.col("name"), F.col("label")))
    best = rated.groupBy("name").agg(F.max_by("label", F.struct("ratio", F.transform(F.split("label", ""), lambda c: -F.ascii(c)))).alias("label"), F.max("ratio").alias("ratio"))
    return best


def check_one_to_one(resolved: DataFrame) -> None:
    """Each label may be resolved from one name only."""
    twice = resolved.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"labels of several names: {sorted(r['label'] for r in twice)}")
