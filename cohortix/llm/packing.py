"""Operator 5: packing documents into sequences by bin completion, branch and bound.

Only the lengths matter for a packing, and there are no more of them than a sequence has tokens, so the corpus is reduced
to a histogram of lengths (bounded by the capacity, whatever the number of documents). The driver packs the histogram:
it takes the largest length left, enumerates the undominated fillings of the rest of its sequence, uses one as often as
the counts allow, and goes on; it goes back to other fillings while the waste bound allows fewer sequences than the best
packing so far, at first that of best fit decreasing. Executors then give every piece its place from its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release_memory, small_batches
from .token_counts import load

CAPACITY = 4096
END_ID = 1
ID = attrgetter("id")
#: Nodes of the search after which the best packing so far is taken.
NODES = 30_000
#: Fillings kept for a node.
WIDTH = 4
#: Encoded words that a worker remembers within a task and from task to task; beyond, it forgets those of more than SHORT
#: characters, which seldom come again, or all.
CACHE_WORDS, KEPT_WORDS, SHORT = 450_000, 100_000, 7
#: White space, or for one side only, other than blanks, tabs and line ends: texts with any are encoded whole, as are
#: those that may hold added tokens, which lower-casing could make.
RARE = r"[\x1c-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|<\|"


def byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


def is_latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def unstopped(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(words, first word of each text): all words of all texts, a comma or full stop right behind a letter a-z apart.

    Tokens never span a letter and what follows it there, so the ids stay the same and far fewer words are distinct."""
    flat = words.flatten()
    at = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    at -= at[0]
    _, offsets, data = flat.buffers()
    if not len(flat) or data is None:
        return flat, at
    edge = np.frombuffer(offsets, dtype=np.int32, count=len(flat) + flat.offset + 1)[flat.offset :]
    raw, end = np.frombuffer(data, dtype=np.uint8), edge[1:]
    long = np.flatnonzero(np.diff(edge) > 1)
    last, before = raw[end[long] - 1], raw[end[long] - 2]
    cut = long[((last == ord(",")) | (last == ord("."))) & (before >= ord("a")) & (before <= ord("z"))]
    edge = np.insert(edge, cut + 1, end[cut] - 1)
    return pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), data), at + np.searchsorted(cut, at)


class Words:
    """Ids of words, for tokenizers that lower-case and drop white space; words are encoded when first met.

    Such a tokenizer's tokens never span white space and its normalisers act on single words, so a text's ids are those of
    its words one after the other. A word of Latin-1 letters alone is one unit for the tokenizer, whatever its case, and
    goes to its model directly; so does one with a comma or full stop behind, which is a unit of its own. All other
    words go through the whole tokenizer. Word i of known has size[i] ids from first[i] on in ids."""

    def __init__(self, path: str) -> None:
        self.tok = load(path)
        self.tokenize, self.letters = self.tok.model.tokenize, byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def units(self, word: str) -> list[int]:
        """The ids of a word that isn't of ASCII letters alone."""
        if not word:
            return []
        if word.isalpha() and is_latin(word):
            return list(map(ID, self.tokenize(charmap_decode(word.lower().encode(), "strict", self.letters)[0])))
        if word[-1] in ".," and word[:-1].isalpha() and is_latin(word):
            return self.units(word[:-1]) + self.units(word[-1])
        return self.tok.encode(word, add_special_tokens=False).ids

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in known; new words are encoded and added."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(out < 0)
        ids: list[int] = []
        ends: list[int] = []
        tokenize, units = self.tokenize, self.units
        fresh = [words[i] for i in new.tolist()]
        for word in fresh:
            ids.extend(map(ID, tokenize(word.lower())) if word.isascii() and word.isalpha() else units(word))
            ends.append(len(ids))
        n, end = len(self.known), np.array(ends, dtype=np.int32)
        self.known.update(zip(fresh, range(n, n + len(fresh))))
        self.first = np.concatenate((self.first, len(self.ids) + np.append(0, end)[:-1].astype(np.int32))) if len(fresh) else self.first
        self.size = np.concatenate((self.size, np.diff(end, prepend=0).astype(np.int32)))
        self.ids = np.concatenate((self.ids, np.array(ids, dtype="<u4")))
        out[new] = np.arange(n, n + len(fresh))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Each distinct word of the batch is looked up once; the ids are then put together by place."""
        words, at = unstopped(pc.utf8_split_whitespace(pc.ascii_lower(texts)))
        coded = words.dictionary_encode()
        place = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = self.size[place][code]
        end = np.zeros(len(each) + 1, dtype=np.int32)
        np.cumsum(each, out=end[1:])
        flat = self.ids[np.repeat(self.first[place][code] - end[:-1], each) + np.arange(end[-1], dtype=np.int32)].tobytes()
        cut = (4 * end[at].astype(np.int64)).tolist()
        out = [flat[i:j] for i, j in zip(cut, cut[1:])]
        for i in np.flatnonzero(pc.match_substring_regex(texts, RARE).to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(texts[i].as_py())
        self.forget(CACHE_WORDS)
        return out

    def forget(self, most: int) -> None:
        """Makes room where more than most words are known: only short ones stay, or none."""
        if len(self.known) <= most:
            return
        short = [w for w in self.known if len(w) <= SHORT]
        if len(short) > most:
            self.clear()
            return
        old = np.fromiter(map(self.known.__getitem__, short), dtype=np.int64, count=len(short))
        first, size = self.first[old], self.size[old]
        end = np.cumsum(size, dtype=np.int32)
        self.ids = self.ids[np.repeat(first - (end - size), size) + np.arange(int(size.sum()), dtype=np.int32)]
        self.known, self.first, self.size = dict(zip(short, range(len(short)))), end - size, size


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """The worker's words of a vocabulary, kept from task to task."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def cut_ids(ids: bytes, capacity: int = CAPACITY, end_id: int = END_ID) -> list[tuple[int, int]]:
    """(length, crc32) of each piece of a document's ids with the end id."""
    ids += end_id.to_bytes(4, "little")
    size = 4 * capacity
    return [(len(p) // 4, zlib.crc32(p)) for i in range(0, len(ids), size) if (p := ids[i : i + size])]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text; null counts as empty, which is one piece."""
    kind = "array<struct<length:bigint,ids_crc32:bigint>>"

    @F.arrow_udf(kind)
    def cut(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = words(path)
        for texts in column:
            sizes, length, crc = [0], [], []
            for ids in known.encode(texts.fill_null("")):
                for n, c in cut_ids(ids, capacity):
                    length.append(n)
                    crc.append(c)
                sizes.append(len(length))
            values = pa.StructArray.from_arrays([pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["length", "ids_crc32"])
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
        known.forget(KEPT_WORDS)
        release_memory()

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).alias("doc_id"), cut(F.col(text)).alias("p")).select("doc_id", F.posexplode("p").alias("piece", "p"))
    return rows.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "p.length", "p.ids_crc32")


def previous(c: np.ndarray) -> np.ndarray:
    """For each size the largest length at hand that is no larger, 0 if none."""
    return np.maximum.accumulate(np.where(c > 0, np.arange(len(c)), 0))


def fillings(c: np.ndarray, room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of room from the lengths with counts c, least waste first, then the largest lengths first.

    One length that fits exactly dominates all else. Of single lengths only the largest is undominated, of pairs with the
    same larger length only that with the largest partner; pairs no longer than the largest single length are dominated.
    Every filling is maximal: nothing at hand fits in what it wastes."""
    prev = previous(c)
    one = int(prev[room])
    if not one:
        return [()]
    if one == room:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {(one,): room - one}

    def pairs(space: int, most: int, taken: int, head: tuple[int, ...]) -> None:
        """Adds (x, y) after head, x no larger than most; taken: a length of which head uses one."""
        x = np.flatnonzero(c[: min(space, most) + 1])
        if not len(x):
            return
        left = c[x] - (x == taken)
        x = x[left > 0]
        y = prev[np.minimum(space - x, x)]
        short = (y > 0) & (c[y] - (y == taken) - (y == x) <= 0)
        y[short] = prev[y[short] - 1]
        bad = (y > 0) & (c[y] - (y == taken) - (y == x) <= 0)
        waste = space - x - y
        keep = np.flatnonzero((y > 0) & ~bad & (x + y + sum(head) > one))
        for i in keep[np.lexsort((-x[keep], waste[keep]))[:width]]:
            found[(*head, int(x[i]), int(y[i]))] = int(waste[i])

    pairs(room, room, 0, ())
    if min(found.values()):
        for x in np.flatnonzero(c[: room + 1])[::-1][:8].tolist():
            if x < room:
                pairs(room - x, x, x, (x,))
    out = {}
    for items in found:
        left, used = room - sum(items), list(items)
        while left > 0 and (y := int(prev[left])):
            while y and c[y] <= used.count(y):
                y = int(prev[y - 1])
            if not y:
                break
            used.append(y)
            left -= y
        out[tuple(sorted(used, reverse=True))] = left
    return sorted(out, key=lambda k: (out[k], [-x for x in k]))[:width]


def best_fit(c: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) of best fit decreasing, as complete sequences: the largest that fits, again and again."""
    c, out = c.copy(), []
    while c.any():
        prev, items, left = previous(c), [], capacity
        while left > 0 and (x := int(prev[left])):
            n = min(left // x, int(c[x]))
            n -= items.count(x)
            if n <= 0:
                left_prev = x - 1
                while left_prev > 0 and (x := int(prev[left_prev])) and c[x] <= items.count(x):
                    left_prev = x - 1
                if left_prev <= 0 or not x:
                    break
                n = min(left // x, int(c[x]) - items.count(x))
            items += [x] * n
            left -= n * x
        times = min(int(c[x]) // items.count(x) for x in set(items))
        for x in items:
            c[x] -= times
        out.append((times, tuple(items)))
    return out


def complete(c: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) that pack counts c[length] into as few sequences as the search finds."""
    c = c.astype(np.int64)
    best = best_fit(c, capacity)
    fewest = sum(t for t, _ in best)
    sizes = np.arange(len(c))
    bound = -(-int((c * sizes).sum()) // capacity)
    left, bins, path, spent = c.copy(), 0, [], 0
    rest = int((c * sizes).sum())
    choices: list[list[tuple[int, ...]]] = []
    while fewest > bound and spent < nodes:
        spent += 1
        going = left.any() and bins + -(-rest // capacity) < fewest  # the waste bound
        if going:
            top = int(np.flatnonzero(left)[-1])
            left[top] -= 1
            choices.append([(top, *f) for f in fillings(left, capacity - top)])
            left[top] += 1
        elif not left.any() and bins < fewest:
            best, fewest = list(path), bins
        while choices and not choices[-1]:  # all fillings of this node are tried: undo the step that led to it
            choices.pop()
            if path:
                times, items = path.pop()
                for x in items:
                    left[x] += times
                rest += times * sum(items)
                bins -= times
        if not choices:
            break
        if len(choices) <= len(path):  # a leaf or a pruned node: undo its step and take the next filling of the node above
            times, items = path.pop()
            for x in items:
                left[x] += times
            rest += times * sum(items)
            bins -= times
            if not choices[-1]:
                continue
        items = choices[-1].pop(0)
        times = min(int(left[x]) // items.count(x) for x in set(items))
        for x in items:
            left[x] -= times
        rest -= times * sum(items)
        bins += times
        path.append((times, items))
    return best


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs of ranks: the pieces of a length with ranks from `rank` on go to sequences from `sequence` on, `each` to one,
    the first at `offset`. Sorted by (length, rank)."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for times, items in patterns:
        offset = 0
        for x in sorted(set(items), reverse=True):
            each = items.count(x)
            rows.append((x, rank.get(x, 0), base, each, offset))
            rank[x] = rank.get(x, 0) + times * each
            offset += x * each
        base += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns))


def pack(rows: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """rows (doc_id, piece, length of 1 to capacity, and more) with sequence_id and offset.

    rows are written once to the shared folder. To the driver go one count for each length (capacity at most) and, for
    ranks, one for each part of a length, 4 x shuffle partitions + capacity at most. Any number of pieces of one length is
    ranked in parts of about equal size. Repeated rows are packed each; an empty table gives an empty one."""
    spark = rows.sparkSession
    rows = durable(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    c = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        c[length] = n
    runs = places(complete(c, capacity, nodes))
    total, parts = max(1, int(c.sum())), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = spark.createDataFrame([(k, -(-parts * n // total)) for k, n in counts.items()], "length bigint, parts bigint")
    rows = rows.join(F.broadcast(share), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    before = rows.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(before.select("length", "part", "before")), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    wide = 1 << 44  # more than any rank

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        x, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(runs["length"] * wide + runs["rank"], x * wide + r, "right") - 1
        r = r - runs["rank"][i]
        sequence, offset = runs["sequence"][i] + r // runs["each"][i], runs["offset"][i] + r % runs["each"][i] * x
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return ranked.withColumn("_place", placed("length", "rank")).withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")}).drop("_place", "rank", "before", "part", "parts")


def packed_documents(documents: DataFrame, path: str, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    out = pack(pieces(documents, path, capacity), capacity, nodes)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
