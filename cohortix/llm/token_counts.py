"""Operator 1: exact token counts, huge texts by overlap resynchronisation.

A text longer than chunk_chars is encoded in overlapping chunks. Two neighbouring chunks are spliced at a position where
both encodings start a token, which every scan of the text must start one at (see boundaries()), and from which on both
agree for the rest of the overlap. Where the overlap has no such position it is doubled, up to the whole rest of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Characters before a chunk's end whose tokens may change when the text goes on: longer than every contraction, lookahead
#: and added token that the pattern of the tokenizer looks at.
MARGIN = 64


def load(path: str):
    """An encoder of one vocabulary file, run on one thread: the tasks of an executor are the threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def boundaries(text: str, starts: set[int]) -> list[int]:
    """Those starts of tokens at which every scan starts one, wherever it began.

    The patterns of these tokenizers never put a white space after another character, nor a character after a line feed,
    into one token, and added tokens hold no white space. So a break between text and a white space after it, and a break
    between a line feed and text, exist in each scan, and what follows depends on what follows only."""
    return sorted(p for p in starts if p and (text[p] in " \n\t" and not text[p - 1].isspace() or text[p - 1] == "\n" and not text[p].isspace()))


def spliced_ids(tok, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, seen: list | None = None) -> list[int]:
    """The ids of the whole text. seen, if given, gets (position, overlap) of each splice."""
    n = len(text)

    def encoded(a: int, b: int) -> tuple[list[int], list[int]]:
        e = tok.encode(text[a:b], add_special_tokens=False)
        return e.ids, [a + o[0] for o in e.offsets]

    out: list[int] = []
    begin, end = 0, min(n, chunk_chars)  # tokens from begin on, a proven boundary, are still to be put out
    ids, at = encoded(begin, end)
    while end < n:
        overlap = min(overlap_chars, end - begin)
        while True:
            s = end - overlap
            to = min(n, s + max(chunk_chars, 2 * overlap))
            more, where = encoded(s, to)
            if s == begin:  # the overlap is all that was left: the longer chunk starts at a proven boundary and replaces the shorter
                ids, at, end = more, where, to
                break
            stable = end - MARGIN
            both = {p for p in at if s < p < stable} & {p for p in where if p < stable}
            cut = None
            for p in boundaries(text, both):
                i, j = at.index(p), where.index(p)
                old = [(x, q) for x, q in zip(ids[i:], at[i:]) if q < stable]
                if old == list(zip(more[j : j + len(old)], where[j : j + len(old)])):
                    cut = (p, i, j)
                    break
            if cut:
                p, i, j = cut
                out += ids[:i]
                begin, end, ids, at = p, to, more[j:], where[j:]
                if seen is not None:
                    seen.append((p, overlap))
                break
            overlap = min(2 * overlap, end - begin)
    return out + ids


def count_tokens(tok, texts: list[str], chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    if not hasattr(tok, "encode_batch"):  # sentencepiece normalises across white space: whole texts only
        return [len(tok.encode(t)) for t in texts]
    short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
    out = [0] * len(texts)
    for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):  # the same ids, without offsets
        out[i] = len(e)
    for i, t in enumerate(texts):
        if len(t) > chunk_chars:
            out[i] = len(spliced_ids(tok, t, chunk_chars, overlap_chars))
    return out


def batches(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of about most characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def n_tokens(text: Column | str, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Column of token counts; the vocabulary is read once in each Python worker. Null counts as empty."""

    @F.arrow_udf("bigint")
    def counted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = load(path)
        for texts in column:
            out: list[int] = []
            for run in batches([t or "" for t in texts.to_pylist()]):
                out += count_tokens(tok, run, chunk_chars, overlap_chars)
            yield pa.array(out, pa.int64())
        release_memory()

    return counted(text)


def token_counts(documents: DataFrame, path: str, limit: int = 1024, text: str = "text", **chunking) -> DataFrame:
    """documents with n_bytes, n_tokens and over_limit (n_tokens > limit), which replace columns of these names.

    Null and empty texts have 0 bytes and 0 tokens; rows are independent, so repeated rows and null ids pass unchanged; an
    empty table gives an empty one. One pass, no shuffle."""
    small_batches(documents.sparkSession)
    return (
        documents.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
        .withColumn("n_tokens", n_tokens(F.col(text), path, **chunking))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
