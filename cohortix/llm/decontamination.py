"""Operator 7: benchmark decontamination as a prefix-filtered set join. DataFrame functions only.

A benchmark item's windows are its runs of 13 words (or all its words, if it has fewer). A document holds a window only if
it holds the window's rarest word, so that one, the necessary prefix for full containment, is all that is joined; words are
ranked by their count in all documents. What a candidate's place leaves room for is then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, spread_join

WINDOW = 13
#: Windows, and bytes of them and their items, up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = ""


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else; null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): each distinct window once, with the ids of all items that hold it."""
    w = F.col("_words")
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice(w, i, size))
    each = F.when(n >= size, long).when(n > 0, F.array(w)).otherwise(F.array().cast("array<array<string>>"))
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words(F.col(text)).alias("_words"))
    return rows.select("item", F.explode(each).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def hits(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, n_words, start, length, items): a row for each occurrence of a window, and one with null start for each document.

    Up to broadcast_rows windows, of BROADCAST_BYTES at most, go to every task, and documents aren't shuffled. Beyond, only
    (document, place, word) meets the windows' rarest words, and the words of a document only its candidates."""
    windows = durable(item_windows(benchmark, size))
    n, held = windows.agg(F.count("*"), F.sum(16 * F.size("items") + F.octet_length(F.array_join("window", " ")))).first()
    small = n <= broadcast_rows and (held or 0) <= BROADCAST_BYTES
    few = F.broadcast if small else lambda df: df
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), words(F.col(text)).alias("words"))
    counts = docs.select(F.explode("words").alias("word")).join(few(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    places = windows.select("window", "items", F.posexplode("window").alias("at", "word"))
    places = places.join(F.broadcast(counts), "word", "left") if small else spread_join(places, counts, ["word"], "left")
    rarest = places.groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("least"))
    prefix = rarest.where("least.n > 0").select(F.col("least.word").alias("word"), F.col("least.at").alias("at"), "window", "items")
    start = F.col("place") - F.col("at")
    same = F.slice("words", F.col("start") + 1, F.size("window")) == F.col("window")
    out = ["doc_id", "key", F.size("words").cast("long").alias("n_words"), "start", F.size("window").alias("length"), "items"]
    if small:
        none = documents.sparkSession.range(1).select(F.lit(NO_WORD).alias("word"), F.lit(1).alias("at"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast(prefix.schema["items"].dataType).alias("items"))
        prefix = durable(prefix.unionByName(none))
        # a word that no document has stands first, so that each document keeps a row
        seen = docs.select("doc_id", "key", "words", F.posexplode(F.concat(F.array(F.lit(NO_WORD)), F.col("words"))).alias("place", "word"))
        begin = F.col("place") - 1 - F.col("at")
        fits = (begin >= 0) & (begin + F.size("window") <= F.size("words"))
        equal = F.slice("words", begin + 1, F.size("window")) == F.col("window")
        found = seen.join(F.broadcast(prefix), "word").where(F.col("window").isNull() | F.when(fits, equal).otherwise(False))
        return found.withColumn("start", F.when(F.col("window").isNotNull(), begin)).select(*out)
    seen = docs.select("doc_id", "key", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    candidates = spread_join(seen, durable(prefix), ["word"]).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n")))
    candidates = candidates.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "start", "window", "items")
    mine = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    found = docs.dropDuplicates(["doc_id", "key"]).join(candidates, mine).where(same).select(*out)
    alone = docs.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(prefix.schema["items"].dataType).alias("items"))
    return found.unionByName(alone)


def decontamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document.

    A word inside any occurrence of a window is hit. Null texts have no words, and items with null id or without words no
    windows; a word hit by several windows counts once, and an item named by several rows once. Repeated rows are counted
    together and put out as often as they occur. Either table may be empty."""
    found = hits(documents, benchmark, size, doc_id, text, broadcast_rows)
    spans = found.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("_rows"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.start + s.length - F.greatest(a.end, s.start))).alias("n"), F.greatest(a.end, s.start + s.length).alias("end"))
    out = spans.select(
        "doc_id",
        "n_words",
        F.aggregate("_spans", zero, step, lambda a: a.n).cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_row"),
    ).drop("_row")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of documents in whose text no window of benchmark occurs, with all their columns.

    A row is judged by its own text: of rows with equal ids only those that hold a window go, and rows with null id are
    judged like others. Null texts hold nothing and stay. Repeated rows get equal verdicts; either table may be empty."""
    found = hits(documents, benchmark, size, doc_id, text, broadcast_rows).where(F.col("start").isNotNull())
    hit_id, hit_key = free_name(documents, "hit_id"), free_name(documents, "hit_key")
    gone = found.select(F.col("doc_id").alias(hit_id), F.col("key").alias(hit_key)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.col(text)) == F.col(hit_key))
    return documents.join(gone, same, "left_anti")
