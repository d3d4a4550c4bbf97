"""Operator 2: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point seeds; an n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds) those of its trigrams. A language's
prototype is the sum of its texts' unit vectors, less the mean prototype, and a text takes the language of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, release_memory, small_batches

DIMENSIONS = 1024
N = 3
#: Bound of the training sample: about so many texts of a language, chosen by a hash of doc_id.
TRAIN_PER_LANGUAGE = 4000
#: Parts in which the sample is encoded, and so the number of partial sums a language sends to the driver at most.
TRAIN_PARTS = 16
SEED = 20
#: Languages that a model may have; prototypes of all go to every task.
MOST_LANGUAGES = 10_000
#: Entries of a block of the (texts x n-grams) count matrix, and n-grams in one product.
CELLS, GRAMS = 1_000_000, 4096
#: Scale at which unit vectors are summed as integers, so that prototypes don't depend on the order of the texts.
SCALE = 1 << 24


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prototypes: np.ndarray  # languages x dimensions, unit rows
    dimensions: int
    mean: np.ndarray


_letters: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    if (code, dimensions) not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[code, dimensions] = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return _letters[code, dimensions]


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, letters): the unit vector of each text (zero without letters) and its number of letters.

    Texts are lower-cased; each run of other characters than letters counts as one blank, at both ends too."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    # a blank before each text and after the last
    flat = np.full(int(sizes.sum()) + len(texts) + 1, 32, dtype=np.uint32)
    where = np.cumsum(np.concatenate(([1], sizes + 1)))
    for c, p in zip(codes, where):
        flat[p : p + len(c)] = c
    used = np.flatnonzero(np.bincount(flat, minlength=33))
    alpha = np.array([c for c in used.tolist() if chr(c).isalpha()], dtype=np.int64)
    if not len(alpha):
        return out, np.zeros(len(texts), dtype=np.int64)
    small = np.zeros(int(used[-1]) + 1, dtype=np.int64)
    small[alpha] = np.arange(1, len(alpha) + 1)
    x = small[flat]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate((where[:-1] - 1, [len(flat)]))))
    letters = np.bincount(owner[x > 0], minlength=len(texts))
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
    keep[where[:-1] - 1] = True
    x, owner = x[keep], owner[keep]
    k = len(alpha) + 1
    gram = np.zeros(max(0, len(x) - N + 1), dtype=np.int64)
    for i in range(N):
        gram = gram * k + x[i : len(x) - N + 1 + i]
    # the blank that follows a text is the one before the next, so the last gram may use it and no more
    mine = owner[: len(gram)]
    ok = (owner[N - 2 : N - 2 + len(gram)] == mine) & ((owner[N - 1 : N - 1 + len(gram)] == mine) | (x[N - 1 : N - 1 + len(gram)] == 0))
    ok &= (x[1 : 1 + len(gram)] > 0)
    gram, mine = gram[ok], mine[ok]
    grams, index = np.unique(gram, return_inverse=True)
    vectors = np.stack([np.ones(dimensions, dtype=np.int8) if c < 0 else letter_vector(int(c), dimensions) for c in [-1, *alpha.tolist()]])
    turned = [np.roll(vectors, N - 1 - i, axis=1) for i in range(N)]
    for g in range(0, len(grams), GRAMS):
        part = grams[g : g + GRAMS]
        v = np.ones((len(part), dimensions), dtype=np.int8)
        for i in range(N):
            v *= turned[i][part // k ** (N - 1 - i) % k]
        inside = (index >= g) & (index < g + GRAMS) if len(grams) > GRAMS else slice(None)
        counts = np.bincount(mine[inside] * len(part) + index[inside] - g, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ v.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0), letters


def runs(texts: list[str], most_chars: int = 300_000, most_texts: int = CELLS // GRAMS) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        if run and (size + len(t) > most_chars or len(run) >= most_texts):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Prototypes from the labelled rows (null lang or text: not used), a bounded sample of each language.

    The sample of a language holds about per_language texts, or all if it has fewer; the driver gets a count and TRAIN_PARTS
    integer vectors for each language at most. More than MOST_LANGUAGES languages are an error."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = (F.xxhash64(F.col("id").cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    # rows are judged where they lie, by one number for each language; only the sample is shuffled
    part = F.create_map(*[F.lit(x) for name, n in counts for x in (name, per_language / n)]) if counts else F.create_map().cast("map<string,double>")
    sample = rows.where(share < F.element_at(part, F.col("lang").cast("string"))).select("id", "text", "lang")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            i = 0
            for run in runs(texts):
                vectors, _ = bundle(run, dimensions)
                whole = np.rint(vectors * SCALE).astype(np.int64)
                for j, name in enumerate(langs[i : i + len(run)]):
                    total[name] = total.get(name, 0) + whole[j]
                i += len(run)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "vector": pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))})
        release_memory()

    parts = sample.repartition(TRAIN_PARTS, "id").mapInArrow(summed, "lang string, vector array<bigint>").collect()
    whole: dict[str, np.ndarray] = {}
    for r in parts:
        whole[r["lang"]] = whole.get(r["lang"], 0) + np.array(r["vector"], dtype=np.int64)
    languages = sorted(k for k, v in whole.items() if v.any())
    if not languages:
        return Model([], np.zeros((0, dimensions), dtype=np.float32), dimensions, np.zeros(dimensions, dtype=np.float32))
    p = np.stack([whole[k] for k in languages]).astype(np.float64)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    mean = p.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
    p -= mean
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return Model(languages, p.astype(np.float32), dimensions, mean.astype(np.float32))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, cosine clipped to 0..1) of each text; `und` and 0 for null, without letters or without a model."""
    names, scores = [], []
    for run in runs([t or "" for t in texts]):
        vectors, letters = bundle(run, model.dimensions)
        if not model.languages:
            names += ["und"] * len(run)
            scores += [0.0] * len(run)
            continue
        off = vectors - (vectors @ model.mean)[:, None] * (model.mean / max(float(model.mean @ model.mean), 1e-12))
        size = np.linalg.norm(off, axis=1)
        cosine = (off @ model.prototypes.T) / np.maximum(size, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        for i, b in enumerate(best.tolist()):
            names.append(model.languages[b] if letters[i] else "und")
            scores.append(float(min(1.0, max(0.0, cosine[i, b]))) if letters[i] else 0.0)
    return names, scores


def predicted(text: Column | str, model: Model) -> Column:
    """Struct column (lang_pred, score). The model, languages x dimensions numbers, goes with the function."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            names, scores = classify(model, texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release_memory()

    return judged(text)


def language_id(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with lang_pred and score, which replace columns of these names.

    A null text or one without letters gets `und` and 0. Rows are independent: repeated rows get equal results, null ids
    pass, an empty table stays empty. Ties go to the first language in alphabetical order. One pass, no shuffle."""
    small_batches(documents.sparkSession)
    own = free_name(documents, "language")
    return documents.withColumn(own, predicted(F.col(text), model)).withColumns({"lang_pred": F.col(own)["lang_pred"], "score": F.col(own)["score"]}).drop(own)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
