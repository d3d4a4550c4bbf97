"""The ten operators against brute force on small tables, and the cases that must not crash: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortix.llm import decontamination, fingerprints, html_extraction, language_id, line_dedup, near_dedup, packing, substring_dedup, token_counts, url_filters
from cohortix.llm.queries import URL_RULES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" + rng.choice(["", "x", "é", "Ab"]) for _ in range(n)]


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in texts], DOCS)


def odd(spark):
    """Nulls in every column, an empty and a long text, repeated rows, equal ids, further columns with names that operators use."""
    rng = random.Random(1)
    long = "\n".join(" ".join(words(rng, 40)) + "." for _ in range(300))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, "one two three four five six", "fr", "s", 1), (None, "one two three four five six", "fr", "s", 1), (5, "!!! 123", None, "s", 1), (5, "other text here", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "n_tokens", "first", "h1", "id", "hash", "part", "next", "key", "kept", "_cut", "_id", "_key", "_language", "_list", "_mined", "_hit_id", "_row"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_spliced_counts_are_exact():
    tok = token_counts.load(BYTE)
    rng = random.Random(3)
    seen = []
    for n in (0, 1, 50, 3000):
        t = "".join(rng.choice(["the", "cat's", " ", "  ", "\n", "\n\n", "é", "日本", "<|endoftext|>", "!!", "1234", "'re", "\t"]) for _ in range(n))
        assert token_counts.spliced_ids(tok, t, 500, 80, seen) == tok.encode(t, add_special_tokens=False).ids
    assert len(seen) > 5
    solid = "x" * 3000 + " " + "日" * 2000
    seen = []
    assert token_counts.spliced_ids(tok, solid, 500, 80, seen) == tok.encode(solid, add_special_tokens=False).ids
    assert any(overlap > 80 for _, overlap in seen) or not seen


def test_spliced_counts_of_the_word_tokenizer():
    tok = token_counts.load(WORD)
    t = " ".join(words(random.Random(2), 900)).replace("w3", "\nw3")
    assert token_counts.spliced_ids(tok, t, 600, 100) == tok.encode(t, add_special_tokens=False).ids


def test_whole_texts_are_counted_without_offsets():
    tok = token_counts.load(BYTE)
    rng = random.Random(21)
    texts = ["", " ", "a\r\n\tb  é <|endoftext|> \u200b e\u0301", "x" * 3000, *(" ".join(words(rng, rng.randrange(1, 200))) for _ in range(50))]

    class Fast:
        encode_batch_fast = tok.encode_batch_fast

        def encode_batch(self, *a, **b):
            raise AssertionError("offsets are slow and not needed")

    assert token_counts.count_tokens(Fast(), texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark):
    tok = token_counts.load(BYTE)
    out = token_counts.token_counts(odd(spark), BYTE, limit=1000, chunk_chars=2000, overlap_chars=200).collect()
    assert len(out) == 8
    for r in out:
        t = r["text"] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1000)
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0


# 2


def test_language_id_learns_and_holds_out(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "ti", "mo", "ra"], "bb": ["sch", "ung", "ver", "eit"], "cc": ["ção", "lho", "nha", "ez"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(rng.choice(list(sounds)) for _ in range(150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out()))
    again = language_id.fit(df.where(~language_id.held_out()).repartition(7))
    assert model.languages == ["aa", "bb", "cc"] and np.array_equal(model.prototypes, again.prototypes)
    out = language_id.language_id(df, model).where(language_id.held_out()).collect()
    assert len(out) > 20 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in out)
    for r in df.select("doc_id", language_id.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_language_vectors_are_bound_and_bundled():
    v, n = language_id.bundle(["ab", "", "12", "ab ab", "éa"])
    assert n.tolist() == [2, 0, 0, 4, 2] and not v[1].any() and not v[2].any()
    blank = np.ones(language_id.DIMENSIONS)
    a, b = (language_id.letter_vector(ord(c), language_id.DIMENSIONS).astype(float) for c in "ab")
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert v[0] == pytest.approx(want / np.linalg.norm(want), abs=1e-6) and v[3] == pytest.approx(v[0], abs=1e-6)


def test_language_id_of_odd_rows(spark):
    model = language_id.fit(odd(spark))
    out = language_id.language_id(odd(spark), model).collect()
    assert len(out) == 8 and all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in out)
    none = language_id.fit(empty(spark))
    assert not none.languages and {r["lang_pred"] for r in language_id.language_id(odd(spark), none).collect()} == {"und"}


# 3


def test_chains_are_collinear_and_best():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(2, 25))
        a, b = np.sort(rng.integers(0, 60, n)), rng.integers(0, 60, n)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        best = defaultdict(float)

        def score(c):
            total = 5.0
            for i, j in zip(c, c[1:]):
                x, y = a[j] - a[i], b[j] - b[i]
                total += min(5, x, y) - 0.1 * max(0, x + y - 10)
            return total

        for i in range(n):
            best[i] = 5.0
        top = {i: 5.0 for i in range(n)}
        for j in range(n):
            for i in range(j):
                if a[i] < a[j] and b[i] < b[j]:
                    x, y = a[j] - a[i], b[j] - b[i]
                    top[j] = max(top[j], top[i] + min(5, x, y) - 0.1 * max(0, x + y - 10))
        found = substring_dedup.chains(a, b)
        assert sorted(i for c in found for i in c) == list(range(n))
        for c in found:
            assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all()
        assert score(found[0]) == pytest.approx(max(top.values()))


def test_passages_exact_and_fuzzy(spark):
    rng = random.Random(5)
    passage = words(rng, 80, 10**6)
    fuzzy = [w if rng.random() > 0.06 else "edited" + str(i) for i, w in enumerate(passage)]
    mixed = lambda p: " ".join(words(rng, 70, 10**6) + p + words(rng, 60, 10**6))
    texts = [(i, " ".join(words(rng, 200, 10**6))) for i in range(10)] + [(10, mixed(passage)), (11, mixed(passage)), (12, mixed(fuzzy)), (13, mixed(passage[:20]))]
    texts += [(14, texts[0][1]), (15, texts[0][1].replace("w", "W"))]
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    found = {(r["doc_id"], r["source_id"], r["kind"]) for r in out}
    assert {(11, 10, "passage"), (14, 0, "copy"), (15, 0, "copy")} <= found
    assert any(d == 12 for d, _, _ in found) and not {d for d, _, _ in found} & {*range(10), 13}
    r = next(r for r in out if r["doc_id"] == 11)
    assert (r["start_word"], r["n_words"], r["source_start"], r["n_equal"]) == (70, 80, 70, 80)


def test_passages_around_a_long_gap(spark):
    rng = random.Random(8)
    new = lambda n: words(rng, n, 10**9)
    texts, at = [], 0
    for size, gap in [(60, 60), (60, 100), (100, 150), (200, 300)]:
        p, q = new(size), new(size)
        texts += [(at, " ".join(new(70) + p + new(gap) + q + new(70))), (at + 1, " ".join(new(70) + p + new(gap) + q + new(70)))]
        at += 2
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    found = sorted((r["doc_id"], r["source_id"], r["start_word"], r["n_words"], r["n_equal"]) for r in out)
    assert found == sorted((2 * i + 1, 2 * i, s, n, n) for i, (n, g) in enumerate([(60, 60), (60, 100), (100, 150), (200, 300)]) for s in (70, 70 + n + g))


def test_passages_with_many_edits(spark):
    rng = random.Random(9)
    new = lambda n: words(rng, n, 10**9)
    texts = []
    for i in range(40):
        p = new(60)
        edits = {*range(i % 6, 60, 6)} if i < 20 else {*rng.sample(range(60), 9)}  # nine or ten words, at even and at random distances
        texts += [(2 * i, " ".join(new(70) + p + new(70))), (2 * i + 1, " ".join(new(50) + [w if k not in edits else "edited" + w for k, w in enumerate(p)] + new(50)))]
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in out} == {(2 * i + 1, 2 * i) for i in range(40)}


def test_passages_whose_parts_came_from_different_documents(spark):
    rng = random.Random(10)
    new = lambda n: words(rng, n, 10**9)
    texts, expected = [], set()
    for i in range(0, 200, 10):
        p = new(60)
        k = 5 + i // 10  # lengths of the parts: 5 to 24 words
        for j, part in enumerate([p[m : m + k] for m in range(0, 60, k)][:7]):
            texts.append((i + j, " ".join(new(50) + part + new(50))))
        q = [w if m not in (14, 44) else "edited" + w for m, w in enumerate(p)] if i >= 100 else p
        texts += [(i + 8, " ".join(new(40) + p + new(40))), (i + 9, " ".join(new(70) + q + new(20)))]
        expected.add((i + 9, i + 8, 70, 60))
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"], r["start_word"], r["n_words"]) for r in out} == expected


def near_copies(rng, groups=6):
    """Texts in groups with common passages and single edits, and a passage that most texts have."""
    common, texts = words(rng, 55, 10**9), []
    for g in range(groups):
        base = words(rng, 150, 10**9)
        for _ in range(6):
            t = [w if rng.random() > 0.03 else "edited" + w for w in base]
            k = rng.randrange(len(t))
            texts.append((7 * len(texts) % 101 + 3, " ".join(t[:k] + (common if rng.random() < 0.8 else []) + t[k:])))
    return texts


def test_hot_seeds_change_nothing(spark):
    df = frame(spark, near_copies(random.Random(20)))
    cold = sorted(map(tuple, substring_dedup.substring_dedup(df).collect()))
    assert len(cold) > 30 and sorted(map(tuple, substring_dedup.substring_dedup(df.repartition(3), hot=1).collect())) == cold


def test_equal_and_textual_ids(spark):
    rng = random.Random(21)
    texts = near_copies(rng, 3)
    plain = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    named = [(f"{i:05d}", t) for i, t in texts]
    out = substring_dedup.substring_dedup(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["source_id"], *r[2:]) for r in out) == sorted((f"{r['doc_id']:05d}", f"{r['source_id']:05d}", *r[2:]) for r in plain)
    one = words(rng, 60, 10**9)
    same = [(5, " ".join(one + words(rng, 30, 10**9))), (5, " ".join(words(rng, 40, 10**9) + one)), (8, " ".join(one))]
    out = substring_dedup.substring_dedup(frame(spark, [*same, same[0]])).collect()
    assert sorted((r["doc_id"], r["source_id"], r["n_equal"]) for r in out) == [(5, 5, 60), (8, 5, 60)]


def test_recall_against_brute_force(spark):
    """Of all pairs of texts with an equal run of 50 words, every later text is found with an earlier one, and its run is covered."""
    texts = near_copies(random.Random(22))
    cut = {i: t.lower().split() for i, t in texts}
    runs = defaultdict(list)
    for i, w in cut.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].append((i, k))
    covered = defaultdict(set)
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    for r in out:
        a, b = cut[r["doc_id"]], cut[r["source_id"]]
        assert r["source_id"] < r["doc_id"] and r["n_equal"] >= 0.75 * max(r["n_words"], r["source_words"]) and min(r["n_words"], r["source_words"]) >= 50
        assert len(set(a[r["start_word"] : r["start_word"] + r["n_words"]]) & set(b[r["source_start"] : r["source_start"] + r["source_words"]])) >= 0.7 * r["n_words"]
        covered[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    repeats = [(i, k) for places in runs.values() for i, k in places if i > min(places)[0]]
    assert len(repeats) > 100 and all(covered[i] >= set(range(k, k + 50)) for i, k in repeats)


def test_passages_whose_seeds_all_came_from_other_documents(spark):
    """Two texts repeat a passage with an edit every eighth word, and each of its equal runs first stood in another text; few or many texts have one of the runs."""
    rng = random.Random(23)
    new = lambda n: words(rng, n, 10**9)
    texts, expected, at = [], set(), 0
    for holders in (1, 1, 1, 40):
        p = new(80)
        for k in range(0, 80, 8):
            for _ in range(holders if k == 16 else 1):
                texts.append((at, " ".join(new(60) + p[k : k + 7] + new(60))))
                at += 1
        for _ in range(2):
            texts.append((at, " ".join(new(70) + [w if k % 8 < 7 else f"edited{at}{k}" for k, w in enumerate(p)] + new(70))))
            at += 1
        expected.add((at - 1, at - 2, 70, 79, 70, 79, 70))
    for hot in (substring_dedup.HOT, 1):
        out = substring_dedup.substring_dedup(frame(spark, texts), hot=hot).collect()
        assert {(r["doc_id"], r["source_id"], r["start_word"], r["n_words"], r["source_start"], r["source_words"], r["n_equal"]) for r in out} == expected and len(out) == 4


def test_texts_with_a_common_passage_are_connected(spark):
    """Brute force: of all pairs of texts with 50 words in place of which at least 41 are equal, both are connected by the pairs found."""
    rng = random.Random(24)
    texts = near_copies(rng, 4)
    parts = [words(rng, 60, 10**9) for _ in range(3)]
    texts = [(i, " ".join(rng.sample(t.split(), len(t.split()) // 3) + [w for p in rng.sample(parts, 2) for w in [v if rng.random() > 0.1 else "edited" + v for v in p]] + t.split()[20:90])) for i, t in texts]
    cut = {i: t.lower().split() for i, t in texts}
    lead = {i: i for i in cut}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for r in substring_dedup.substring_dedup(frame(spark, texts)).collect():
        lead[find(r["doc_id"])] = find(r["source_id"])
    n = 0
    for i in cut:
        for j in cut:
            if i < j:
                for d in range(-len(cut[i]) + 50, len(cut[j]) - 49):
                    a, b = (cut[i], cut[j][d:]) if d >= 0 else (cut[i][-d:], cut[j])
                    equal = np.cumsum([0, *(x == y for x, y in zip(a, b))])
                    if len(equal) > 50 and (equal[50:] - equal[:-50]).max() >= 41:
                        n += 1
                        assert find(i) == find(j)
                        break
    assert n > 50


def test_common_pairs_are_counted_like_multisets():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 1 + k % 9, rng.integers(0, 40)).astype("<u4") for k in range(90)]
    column = pa.array([r.view(np.uint8).reshape(-1, 4)[:, : substring_dedup.WORD_BYTES].tobytes() for r in rows], pa.binary())
    pairs = [Counter(zip(r[:-1].tolist(), r[1:].tolist())) for r in rows]
    left, right = np.arange(0, 60), np.arange(30, 90)
    out = substring_dedup.common_pairs(column, left, right)
    assert all(out[i, j] == sum((pairs[k] & pairs[m]).values()) for i, k in enumerate(left) for j, m in enumerate(right) if k != m)


def test_pairs_without_a_passage_are_not_aligned(spark, monkeypatch):
    """Of pairs with a common line of 30 words none gets slices of words, that with a passage does."""
    rng = random.Random(25)
    new = lambda n: words(rng, n, 10**9)
    texts = []
    for i in range(30):
        line = new(60 if i == 7 else 30)
        texts += [(2 * i + k, " ".join(new(70) + line + new(70))) for k in range(2)]
    rows, sliced = [], substring_dedup.sliced

    def counted(chains, *args):
        if "sizes" in chains.columns and args[-1] != "tags":
            rows.append(chains.count())
        return sliced(chains, *args)

    monkeypatch.setattr(substring_dedup, "sliced", counted)
    out = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    assert [(r["doc_id"], r["source_id"], r["n_words"]) for r in out] == [(15, 14, 60)] and sum(rows) == 2  # once for either text


def test_hopeless_chains_have_no_passage():
    """Against alignment itself: chains on one diagonal or several, at the ends of texts and of slices."""
    rng = np.random.default_rng(7)
    left_out = kept = 0
    for _ in range(600):
        a = rng.integers(0, 10**6, rng.integers(20, 250)).astype(np.uint32)
        b = np.where(rng.random(len(a)) < rng.choice([0.2, 0.5, 0.7, 0.9]), a, a + 10**6).astype(np.uint32)
        for k in rng.integers(0, len(b), rng.integers(0, 3)).tolist():
            b = np.insert(b, k, 5)
        at = {tuple(a[i : i + 5].tolist()): i for i in range(len(a) - 4)}
        seeds = [(at[w], j) for j in range(len(b) - 4) if (w := tuple(b[j : j + 5].tolist())) in at]
        seeds = seeds[rng.integers(len(seeds)) :][: rng.integers(1, 40)] if seeds else []
        if not seeds:
            continue
        p, q = np.array(seeds).T
        x, y = rng.integers(0, 2, 2) * 7  # a slice that doesn't begin where its text does, and one that doesn't end there
        ends = [np.array([len(a) + x + rng.integers(0, 2)]), np.array([len(b) + y + rng.integers(0, 2)])]
        slices = [(c, np.array([0, len(c)]), np.array([f]), e) for c, f, e in ((a, x, ends[0]), (b, y, ends[1]))]
        lost = substring_dedup.hopeless(*slices, p, q, np.array([len(p)]), np.array([0]), 5, 50, 0.75)
        i, j, before, after = substring_dedup.align(a, b, p, q)
        before &= not ((p[0] <= q[0] and x == 0) or (q[0] <= p[0] and y == 0))
        after &= not ((len(a) - p[-1] <= len(b) - q[-1] and x + len(a) == ends[0][0]) or (len(b) - q[-1] <= len(a) - p[-1] and y + len(b) == ends[1][0]))
        goes_on = before or after or substring_dedup.segments(i, j)
        assert not (lost[0] and goes_on)
        left_out, kept = left_out + int(lost[0]), kept + bool(goes_on)
    assert left_out > 50 and kept > 50


def test_segments_leave_no_passage_out():
    rng = np.random.default_rng(3)
    for _ in range(100):
        same = np.repeat(rng.random(40) < 0.7, rng.integers(1, 12, 40))
        x = np.flatnonzero(same)
        y = x + np.searchsorted(np.sort(rng.integers(0, len(same), 3)), x)
        out = substring_dedup.segments(x, y, 20, 0.75)
        taken = np.zeros(len(same), dtype=bool)
        for a, n, b, m, k in out:
            assert min(n, m) >= 20 and k >= 0.75 * max(n, m) and not taken[a : a + n].any()
            taken[a : a + n] = True
        free = [not taken[v] for v in x]
        for i in range(len(x)):
            for j in range(i, len(x)):
                n, m = x[j] - x[i] + 1, y[j] - y[i] + 1
                assert min(n, m) < 20 or j - i + 1 < 0.75 * max(n, m) or not all(free[i : j + 1])


def test_common_words_of_long_gaps_are_found():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50, 90), rng.integers(0, 50, 120)
    whole = len(substring_dedup.common(a, b))
    most, substring_dedup.TABLE = substring_dedup.TABLE, 100
    try:
        halved = substring_dedup.common(a, b)
    finally:
        substring_dedup.TABLE = most
    assert len(halved) == whole == substring_dedup.common_row(a, b)[-1] and all(a[i] == b[j] for i, j in halved)
    assert all(i < k and j < m for (i, j), (k, m) in zip(halved, halved[1:]))


def test_passages_of_odd_rows(spark):
    out = substring_dedup.substring_dedup(odd(spark))
    assert out.count() == 0 and substring_dedup.substring_dedup(empty(spark)).count() == 0


# 4


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        solid = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        cut = set()
        fresh = []
        for j in range(len(solid) - 2):
            w = tuple(x for _, x in solid[j : j + 3])
            if w in seen:
                cut |= set(range(solid[j][0], solid[j + 2][0] + 1))
            else:
                seen.add(w)
                fresh.append(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in cut)
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c ", "", " ", "d", "e"]) + rng.choice(["", "", "1"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert out == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    df = odd(spark)
    out = line_dedup.line_dedup(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    assert set(df.columns) <= set(line_dedup.line_dedup(df).columns) and line_dedup.line_dedup(empty(spark)).count() == 0


# 5


def test_words_are_the_tokenizers():
    w = packing.Words(WORD)
    rng = random.Random(7)
    pool = list("aàéÉßØİıŉﬁ'’.,!?-_#0١²½ \n\t\r\x0b\x0c\x1c\x85\xa0\u2009\u3000\u200b\ufeff\u0301ñÑΣσςжأ中😀") + ["<|endoftext|>", "the", "THE", "it's", "'S", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(6000)]
    for t, ids in zip(texts, w.encode(pa.array(texts, pa.string()))):
        assert ids == w.whole(t), repr(t)
    assert w.encode(pa.array([], pa.string())) == [] and w.encode(pa.array(["", "a"]).slice(1)) == [w.whole("a")]


def test_fillings_fit_and_are_maximal():
    rng = np.random.default_rng(8)
    for _ in range(200):
        c = np.zeros(61, dtype=np.int64)
        for x in rng.integers(1, 61, 12):
            c[x] += 1
        room = int(rng.integers(1, 60))
        for f in packing.fillings(c, room):
            assert sum(f) <= room and all(f.count(x) <= c[x] for x in f)
            rest = room - sum(f)
            assert not any(c[x] > f.count(x) for x in range(1, rest + 1))


def best_bins(items, capacity):
    """The fewest bins, by trying everything."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_packing_is_optimal_on_small_cases():
    rng = np.random.default_rng(9)
    for _ in range(40):
        items = rng.integers(1, 21, 10).tolist()
        c = np.bincount(items, minlength=21)
        patterns = packing.complete(c, 20)
        used = np.zeros(21, dtype=np.int64)
        for times, p in patterns:
            assert sum(p) <= 20
            for x in p:
                used[x] += times
        assert (used == c).all()
        assert sum(t for t, _ in patterns) == best_bins(items, 20)


def check_sequences(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= capacity
    return len(seqs)


def test_packed_documents(spark):
    tok = token_counts.load(WORD)
    df = odd(spark)
    out = packing.packed_documents(df, WORD).collect()
    check_sequences(out, 4096)
    want = []
    for r in df.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, 4096 * k, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, p in enumerate(ids[i : i + 4096] for i in range(0, len(ids), 4096))]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], key=key) == sorted(want, key=key)
    assert packing.packed_documents(empty(spark), WORD).count() == 0


def test_one_length_in_many_parts(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 20 + 1).cast("long").alias("length"))
    out = packing.pack(rows, 20).collect()
    assert len(out) == 500
    assert check_sequences(out, 20) <= -(-sum(r["length"] for r in out) // 20) + 70


# 6


def test_hosts_and_rules(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1?q#f", "https://example.NET/EN/1", "http://www.example.com/de/", "http://notexample.com/de/", "ftp://x.org/fr/?a", "x.org/fr/", None, "http://b.net", "http://c.net?/", "http://u://v.net/", "http://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("verdict", F.lit("clash"))
    out = {r["page_id"]: r for r in url_filters.url_filters(df, URL_RULES).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in range(len(urls))] == [
        ("a.net", "/x", "net/"), ("m.example.net", "/en/1", "example.net/en/"), ("example.net", "/EN/1", "net/"), ("www.example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/", None), ("x.org", "/fr/", "org/fr/"),
        ("", "", None), ("", "", None), ("b.net", "", None), ("c.net", "", None), ("u:", "//v.net/", None), ("net", "/", "net/"),
    ]
    assert all(r["verdict"] in ("allow", "block") for r in out.values())
    assert url_filters.url_filters(df.limit(0), URL_RULES).count() == 0


def test_no_rule_is_missing(spark):
    """All combinations of up to two tokens, counted one by one: each that would make a rule is one, or a smaller one is as sure."""
    rng = random.Random(11)
    rows = [(f"http://{h}.example.com/{p}/{rng.randrange(3)}", "block" if (h == "spam") != (p == "read") or rng.random() < 0.1 else "allow") for h, p in ((rng.choice(["spam", "good"]), rng.choice(["win", "read", "play"])) for _ in range(300))]
    rules, default, same = url_filters.mine_all(spark.createDataFrame(rows, "url string, label string"), min_support=0.02, min_confidence=0.7, most_tokens=2)
    cut = [(frozenset(url_filters.url_tokens(u)), lab) for u, lab in rows]
    tokens = sorted(set().union(*(t for t, _ in cut)))
    assert same and all([t for t, _ in cut if k in t] == [t for t, _ in cut if v in t] for k, v in same.items())
    share = {v: sum(lab == v for _, lab in cut) / len(cut) for v in ("block", "allow")}
    found = {r.tokens: r for r in rules}
    for i, a in enumerate(tokens):
        for b in tokens[i:]:
            key = tuple(sorted({a, b}))
            labels = [lab for t, lab in cut if t.issuperset(key)]
            for v in ("block", "allow"):
                if labels.count(v) < 0.02 * len(cut) or labels.count(v) / len(labels) < max(0.7, share[v] + 1e-9):
                    continue
                named = {tuple(sorted({same.get(t, t) for t in part})) for part in (key, *((t,) for t in key))}
                assert any(k in found and found[k].verdict == v and found[k].confidence >= labels.count(v) / len(labels) - 1e-9 for k in named), key
    verdicts = {tuple(r) for r in url_filters.url_filters(spark.createDataFrame(rows, "url string, label string"), [], labelled=spark.createDataFrame(rows, "url string, label string"), min_support=0.02, min_confidence=0.7).select("url", "verdict").collect()}
    plain, index = url_filters.mine(spark.createDataFrame(rows, "url string, label string"), min_support=0.02, min_confidence=0.7), None
    index = url_filters.inverted_index(plain[0])
    assert all(((best := url_filters.best_rule([same.get(t, t) for t in url_filters.url_tokens(u)], index)) and best.verdict or default) == v for u, v in verdicts)


def test_mined_rules_are_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(400):
        host = rng.choice(["spam", "good", "news"])
        path = rng.choice(["win", "read", "play"])
        rows.append((f"http://{host}.example.com/{path}/{rng.randrange(9)}", "block" if host == "spam" and path != "read" or rng.random() < 0.05 else "allow"))
    df = spark.createDataFrame(rows, "url string, label string")
    rules, default = url_filters.mine(df, min_support=0.02, min_confidence=0.7)
    assert default == "allow"
    for r in rules:
        both = [lab for u, lab in rows if set(r.tokens) <= set(url_filters.url_tokens(u))]
        assert r.confidence == pytest.approx(both.count(r.verdict) / len(both)) and r.support == pytest.approx(both.count(r.verdict) / len(rows))
    index = url_filters.inverted_index(rules)
    for u, _ in rows[:50]:
        t = url_filters.url_tokens(u)
        want = [r for r in rules if set(r.tokens) <= set(t)]
        got = url_filters.best_rule(t, index)
        assert (got is None) == (not want) and (got is None or got.confidence == max(r.confidence for r in want))
    best = url_filters.best_rule(url_filters.url_tokens("http://spam.example.com/win/3"), index)
    assert best.verdict == "block"


# 7


def brute_hits(docs, items, size=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, tuple(w[k : k + min(size, len(w))])) for i, t in items if i is not None and (w := cut(t)) for k in range(len(w) - min(size, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_is_brute_force(spark, most):
    rng = random.Random(11)
    vocabulary = ["The", "of", "É", "é", "x1", "and", "to", "zß", "q"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "-b"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(3, "of the"), (50, None), (51, "..."), (None, "of"), (52, "Only here 77")]
    docs = [(i, text(rng.randrange(0, 60)) + " " + (items[i % 12][1] if i % 3 else "")) for i in range(25)] + [(30, None), (31, ""), (32, "only HERE 77 é")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("word", F.lit("x"))
    out = decontamination.decontamination(frame(spark, docs), bench, broadcast_rows=most)
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_hits(docs, items))


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    out = decontamination.decontamination(odd(spark), bench).collect()
    assert len(out) == 8 and sum(r["n_hit"] == 3 for r in out) == 2
    assert decontamination.decontamination(odd(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontamination(empty(spark), bench).count() == 0


def test_rows_without_hits_stay(spark):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    out = decontamination.uncontaminated(odd(spark), bench)
    assert out.columns == odd(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in out.where("doc_id >= 4").collect()) == [(5, "!!! 123"), (5, "other text here")]
    assert out.count() == 6 and out.where("doc_id is null").count() == 0
    assert decontamination.uncontaminated(odd(spark), bench.limit(0)).count() == 8 and decontamination.uncontaminated(empty(spark), bench).count() == 0


# 8


def test_units_end_at_every_sentence_end(spark):
    lower = ["one line of lower case. ", "another sentence here! ", "does a third one follow? ", "the fourth is last. "]
    greek = ["\u03b1 \u03b2 \u03b3. ", "\u03b4 \u03b5. ", "\u03b6 \u03b7 \u03b8. ", "\u03b9 \u03ba \u03bb. "]
    df = spark.createDataFrame([(0, "".join(lower)), (1, "".join(greek)), (2, "And. Because. Do. Every.")], "doc_id long, text string")
    rows = df.select("doc_id", F.size(fingerprints.digests(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {0: 4, 1: 4, 2: 4}


def units(t):
    return {x for x in re.split(fingerprints.UNIT_ENDS, t or "") if x}


def alike(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), alike(t, e), alike(t, n))
    return out


@pytest.mark.parametrize("part,uneven", [(4, 4), (1000, 4), (5, 0)])
def test_fingerprints_are_brute_force(spark, part, uneven):
    rng = random.Random(12)
    line = lambda: " ".join(words(rng, rng.randrange(1, 9), 30)) + rng.choice([". ", ". Of ", "\n", "! Long "])
    rows = [(i * i % 97 + 100 * i, "".join(line() for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(7, None), (5000, rows_text := "same\ntext\nÜ 😀"), (5001, rows_text), (9000, "".join(line() for _ in range(900)))]
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, rows), part=part, uneven=uneven).collect()}
    for i, (n, sha, near, following) in expected(rows).items():
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near), pytest.approx(following))
    assert out[5000]["fingerprint"] == out[5001]["fingerprint"] and out[5000]["near_next"] == 1.0


def peeled(a, b):
    """The digests that only one of two fingerprints has, from their hexadecimal cells alone; None if they can't all be had."""
    cut = lambda t: [(int(t[i : i + 4], 16), int(t[i + 4 : i + 20], 16), int(t[i + 20 : i + 28], 16)) for i in range(0, len(t), 28)]
    cells = [[(x[0] - y[0] + 2**15) % 2**16 - 2**15, x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(cut(a), cut(b))]
    where = lambda k: [4 * s + (PLACE[k] >> 2 * s & 3) for s in range(4)]
    found = [set(), set()]
    while any(c[0] or c[1] for c in cells):
        pure = [c for c in cells if abs(c[0]) == 1 and c[1] in PLACE and CHECK[c[1]] == c[2]]
        if not pure:
            return None
        n, k, h = pure[0]
        found[n < 0].add(k)
        for j in where(k):
            cells[j] = [cells[j][0] - n, cells[j][1] ^ k, cells[j][2] ^ h]
    return found


PLACE, CHECK = {}, {}


def test_likeness_comes_from_the_two_columns(spark):
    """Where two fingerprints can be peeled, near_edited and near_next are what they give."""
    rng = random.Random(24)
    line = lambda: " ".join(words(rng, 5, 10**6)) + "."
    rows = []
    for i in range(40):
        text = [line() for _ in range(rng.randrange(1, 5 if i % 2 else 40))]
        rows += [(2 * i, "\n".join(text)), (2 * i + 1, "\n".join([*text[:-1], text[-1] if i % 3 else line()]))]
    df = frame(spark, rows)
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    every = spark.createDataFrame([(x,) for x in {u for i, t in rows for u in units(t) | units(expected_edit(rows, i))}], "u string").select(F.xxhash64("u").alias("k"))
    for r in every.select("k", F.xxhash64("k", F.lit("place")).alias("r"), F.xxhash64("k", F.lit("check")).alias("h")).collect():
        PLACE[r["k"] % 2**64], CHECK[r["k"] % 2**64] = r["r"] % 2**64, r["h"] % 2**32
    done = 0
    for i, t in rows:
        r = out[i]
        n, m = len(units(t)), len(units(expected_edit(rows, i)))
        if (found := peeled(r["fingerprint"], r["edited_fingerprint"])) is not None:
            done += 1
            assert (len(found[0]), len(found[1])) == (len(units(t) - units(expected_edit(rows, i))), len(units(expected_edit(rows, i)) - units(t)))
            assert r["near_edited"] == pytest.approx((n - len(found[0])) / (m + len(found[0])))
        following = out.get(i + 1)
        if following and (found := peeled(r["fingerprint"], following["fingerprint"])) is not None:
            assert r["near_next"] == pytest.approx((n - len(found[0])) / (len(units(dict(rows)[i + 1])) + len(found[0])))
    assert done > 20


def expected_edit(rows, i):
    ids = sorted(k for k, _ in rows)
    texts = dict(rows)
    t, n = texts[i], texts[ids[(ids.index(i) + 1) % len(ids)]]
    h = len(t) // 2
    return t[: len(t) - h] + n[:h]


def test_fingerprints_of_odd_rows(spark):
    out = fingerprints.fingerprints(odd(spark)).collect()
    assert len(out) == 8 and all(0 <= r["near_edited"] <= 1 for r in out)
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    alone = fingerprints.fingerprints(frame(spark, [(1, "only one")])).first()
    assert alone["near_next"] == 1.0


# 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><p>Site</p></header>
<nav><ul><li><a href="/">Home</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div><main><article><h1>Head&amp;line</h1><p>First <b>bold</b>
 text &lt;tag&gt;&nbsp;x<br>line<p>Second<form>Mail <input></form><aside>Side</aside><ul><li>One<li>Two</ul><div class="comments"><p>Nice!</p></div></article></main><footer>&copy; F</footer></body></html>"""


def test_main_text():
    assert html_extraction.main_text(PAGE) == "Head&line\nFirst bold text <tag> x line\nSecond\nOne\nTwo"
    assert html_extraction.main_text("<p>a<p>b &eacute;</p>c") == "a\nb é\nc"
    assert html_extraction.main_text("<nav>x") == "" and html_extraction.main_text("a < b") == "a < b"
    assert html_extraction.main_text('<p title="a>b">x</p>') == "x"
    assert html_extraction.main_text("<p>" + "x" * 300_000) == "x" * 300_000
    assert html_extraction.main_text('<p class="' + "a" * 100_000) is not None


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p style="overflow:hidden">Body text</p>', "Body text"),
        ('<p data-state="hidden-never">A</p><p data-id="nav">B</p><p title="the hidden side">C</p>', "A\nB\nC"),
        ('<svg class="i"/><p>Article</p>', "Article"),
        ("<select><p>b</p><title>c", "b\nc"),
        ("a<script>b<p>c</p>", "a"),
        ('<article><h2 id="related-work">R</h2><section id="search-methods">S</section><p id="comment-box">no</p></article>', "R\nS"),
        ('<div class="nav-primary">no</div><div id="ad-300x250">no</div><div class="lead ads">no</div><p hidden>no</p><p aria-hidden=true>no</p>yes', "yes"),
        ("<article>Teaser</article><div>" + "Real body. " * 20 + "</div>", "Teaser\n" + " ".join(["Real body."] * 20)),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert html_extraction.main_text(page) == text


def test_main_text_of_generated_pages():
    """Pages put together from known blocks and chrome, nested at random, give back the blocks."""
    rng = random.Random(23)
    plain = lambda: " ".join(words(rng, rng.randrange(1, 12))) + rng.choice([".", " & more", " < x", " \u00e9"])

    def shown(t):
        t = t.replace("&", "&amp;").replace("<", "&lt;")
        return rng.choice([t, f"<b>{t}</b>", f"<a href='/x?a=1&b=2' class=big>{t}</a>", t.replace(" ", "\n  ", 1), f"<!-- nav --><span id=s{rng.randrange(9)}>{t}</span>"])

    def chrome():
        t = shown(plain())
        return rng.choice([f"<nav><ul><li>{t}</ul></nav>", f"<aside><p>{t}</p></aside>", f"<div class='x ad'><div>{t}</div></div>", f"<form><input value='q'>{t}</form>", f"<div id=comments><p>{t}<p>{t}</div>", f"<script>if(a<b)'{'<p>'}'</script>", f"<div role=search>{t}</div>", f"<svg viewBox='0 0 1 1'><text>{t}</text></svg>"])

    for _ in range(300):
        blocks, body = [], []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.4:
                body.append(chrome())
            t = plain()
            blocks.append(" ".join(t.split()))
            kind = rng.choice(["p", "h2", "div", "blockquote", "pre", "section", "open"])
            body.append(f"<p>{shown(t)}" if kind == "open" else f"<{kind} data-ad='nav'>{shown(t)}</{kind}>")
            if kind == "open" and rng.random() < 0.5:
                body.append("</p>")
        page = "<html><head><title>T</title></head><body>" + chrome() + "<article>" + "".join(body) + "</article>" + chrome() + "<footer>F</footer></body></html>"
        assert html_extraction.main_text(page) == "\n".join(blocks), page


def test_html_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extraction.html_extraction(df).collect()
    assert sorted(r["text"] for r in out) == ["", "", "", "Head&line\nFirst bold text <tag> x line\nSecond\nOne\nTwo", "x"]
    assert all(r["n_chars"] == len(r["text"]) for r in out) and html_extraction.html_extraction(df.limit(0)).count() == 0


# 10


def shingle_set(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_is_brute_force(spark, seed):
    rng = random.Random(13 + seed)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randrange(8, 120), 10**6)
        for _ in range(rng.randrange(1, 12)):
            edited = [w if rng.random() > 0.02 else "new" for w in base]
            rows.append((len(rows), " ".join(edited)))
        rows.append((len(rows), " ".join(base).upper()))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "one", "One", "one two", None, "a b c d e", "a b c d e f", "\t\n"])]
    rng.shuffle(rows)
    out = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_components(rows)


def test_copies_linked_through_their_original_alone_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", (40, 64))
    rng = random.Random(19)
    base = words(rng, 228, 10**6)
    rows = [(250, " ".join(base))]
    for i in [*range(250), *range(251, 400)]:
        at = {1} | {rng.randrange(30) + k for k in (8, 44, 80, 116, 152, 188)}
        rows.append((i, " ".join(f"new{rng.random()}" if k in at else w for k, w in enumerate(base))))
    sets = [shingle_set(t) for _, t in rows]
    assert all(4 * len(s & sets[0]) >= 3 * len(s | sets[0]) for s in sets[1:])
    assert not any(4 * len(s & t) >= 3 * len(s | t) for s in sets[1:30] for t in sets[30:])
    assert {r["component_id"] for r in near_dedup.near_dedup(frame(spark, rows)).collect()} == {0}


def test_common_counts_and_linked_roots_are_brute_force():
    rng = np.random.default_rng(20)
    pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.sort(rng.choice(pool[: rng.integers(30, len(pool))], rng.integers(0, 30), replace=False)) for _ in range(60)]
    left, right = np.arange(0, 40), np.arange(20, 60)
    expected = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert near_dedup.common_counts(sets, left, right).tolist() == expected
    sets += [np.append(sets[0], pool[-1:]), sets[1]]
    pairs = near_dedup.linked_roots(sets, np.full(62, 2), np.arange(62), 75)
    root = list(range(62))
    for a, b in pairs:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    for i in range(62):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and len(sets[j]) and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                assert root[i] == root[j]
    assert root[61] == 1


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(14)
    for n in (3, 20, 400):
        same = []
        for _ in range(60):
            s = np.unique(rng.integers(0, 2**63, n * 5 // 4).astype(np.uint64) * np.uint64(2))
            a, b = s[: len(s) * 9 // 10], s[len(s) // 10 :]
            same.append((near_dedup.signature(a) == near_dedup.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(same)) < 0.06


def test_long_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 503)], "a long, b long")
    out = {r["id"]: r["root"] for r in near_dedup.components(links).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {501: 500, 503: 500}


def test_near_dedup_of_odd_rows(spark):
    out = near_dedup.near_dedup(odd(spark)).collect()
    assert len(out) == 8 and all(r["kept"] for r in out)
    assert near_dedup.near_dedup(empty(spark)).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    item = words(rng, 20, 10**6)
    texts = [(i, "\n".join(" ".join(words(rng, 30, 10**6)) for _ in range(4))) for i in range(20)]
    texts += [(20, texts[0][1].replace("\n", " ") + " more"), (21, " ".join(item + words(rng, 30, 10**6))), (22, "123 !!"), (23, None), (24, "\n".join(texts[1][1].split("\n")[:3] + ["own last line of this one"]))]
    long = words(rng, 1500, 10**6)
    texts += [(25, " ".join(long[:700] + item + long[700:]))]  # far under the share of words at which a document counts as contaminated
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_sequences(out, 4096)
    kept = {r["doc_id"] for r in out}
    lined = {i: t for i, t in brute_lines([(i, t) for i, t in texts if t and re.search(r"[^\W\d_]", t)]).items() if t.strip()}
    named = {i for i, (_, root, keep) in brute_components(list(lined.items())).items() if keep}
    dirty = {d for d, _, n_hit, *_ in brute_hits([(i, lined[i]) for i in named], [(1, " ".join(item))]) if n_hit}
    assert kept == named - dirty and {21, 22, 23, 20, 25}.isdisjoint(kept) and 24 in kept


def test_meetings_of_common_seeds_go_in_parts(spark, monkeypatch):
    """Blocks of a common line's holders meet in parts, one after the other, with the same rows."""
    rng = np.random.default_rng(46)
    words = [f"w{k}" for k in range(5000)]
    line = " ".join(rng.choice(words, 12))
    texts = [" ".join(rng.choice(words, 400)) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 55)) for _ in range(5)]
    rows = [(i, f"{t[:900]} {passages[i % 5] + ' ' if i % 2 else ''}{line} {t[900:]}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 5)
    run = lambda: sorted(tuple(r) for r in substring_dedup.substring_dedup(df).collect())
    parts, whole, plain = [], run(), substring_dedup.alike

    def alike(*args):
        out = plain(*args)
        parts.append(len(out[1]))
        return out

    monkeypatch.setattr(substring_dedup, "LEAST_SLICES", 1)
    monkeypatch.setattr(substring_dedup, "alike", alike)
    assert run() == whole and len(whole) > 20 and parts[0] > 1
