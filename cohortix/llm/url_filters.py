"""Operator 6: URL filters by association rules.

A URL's tokens are its scheme, the labels of its host with the suffixes they end, and the words of its path and query. Spark's FP-growth
mines the token combinations of labelled URLs, each labelled one with its label as a further item; a rule `tokens -> label` is kept if
its support, confidence and lift suffice and no rule with fewer tokens is as sure. An inverted index from each rule's rarest token finds
the rules that a URL matches. A list of (host, path) rules, where one fits, goes before the mined ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MOST_TOKENS = 0.005, 0.6, 3
LABEL = "label="


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there to `?`, `#` or the end. Else both empty."""
    m = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = url.contains("://")
    host = F.when(has, F.translate(F.regexp_extract(url, m, 1), UPPER, LOWER)).otherwise("")
    path = F.when(has, F.regexp_extract(url, m, 2)).otherwise("")
    return host, path


def list_rule(host: Column, path: Column, rules: list[ListRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL, sorted; a URL without `://` has only words."""
    if not url:
        return []
    out: set[str] = set()
    scheme, found, rest = url.lower().partition("://")
    if found:
        out.add("scheme=" + scheme)
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        rest = rest[len(host) :]
        labels = host.split(".")
        out |= {"label:" + x for x in labels if x}
        out |= {"host:" + ".".join(labels[i:]) for i in range(max(0, len(labels) - 3), len(labels))}
    else:
        rest = url.lower()
    out |= {"word:" + ("#" if w.isdigit() else w) for w in re.findall(r"\w+", rest)}
    return sorted(out)


def tokens_column(url: Column) -> Column:
    @F.arrow_udf("array<string>")
    def tokens(urls: pa.Array) -> pa.Array:
        return pa.array([url_tokens(u) for u in urls.to_pylist()], pa.list_(pa.string()))

    return tokens(url)


def representatives(rows: DataFrame, least: float) -> dict[str, str]:
    """Token -> the first, in the alphabet, of the tokens that are in exactly the same rows; for tokens in least rows or more.

    So many tokens occur in that share of the rows at most as a row has, over that share; they go to the driver. Tokens
    are in the same rows where their counts and 128 bits of their rows' hashes agree."""
    seen = rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token"))
    facts = seen.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(2))).alias("b")).where(F.col("n") >= least - 1e-9)
    first: dict[tuple, str] = {}
    out = {}
    for r in sorted(facts.collect(), key=lambda r: r["token"]):
        out[r["token"]] = first.setdefault((r["n"], r["a"], r["b"]), r["token"])
    return out


def mine(labelled: DataFrame, url: str = "url", label: str = "label", **mining) -> tuple[list[MinedRule], str]:
    """(rules, default verdict) of mine_all()."""
    return mine_all(labelled, url, label, **mining)[:2]


def mine_all(labelled: DataFrame, url: str = "url", label: str = "label", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_tokens: int = MOST_TOKENS) -> tuple[list[MinedRule], str, dict[str, str]]:
    """(rules, default verdict, token -> the token that stands for it in rules) from rows with a url and a non-null label; all rows count. The default is the commonest label.

    Tokens that are in the same rows are one item: those of equal counts that the rarer one's rows all have are found by
    pair and stand for one another, so that URLs with many tokens in common don't give all their combinations. Only itemsets
    of min_support or more, and of most_tokens tokens and a label, reach the driver, so their number doesn't grow with the
    rows; rules of more tokens aren't looked for. Without labelled rows there are no rules, and the default is allow."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).alias("label"))
    rows = durable(rows.select("label", tokens_column(F.col("url")).alias("tokens")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], "allow", {}
    n = sum(counts.values())
    default = min(counts, key=lambda k: (-counts[k], k))
    same = representatives(rows, min_support * n)
    kept = F.lit(sorted(set(same.values()))) if same else F.array().cast("array<string>")
    items = rows.select(F.concat(F.array_intersect("tokens", kept), F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    sets = model.freqItemsets.where(F.size("items") <= most_tokens + 1).collect()
    freq = {tuple(sorted(r["items"])): r["freq"] for r in sets}
    rules: dict[tuple[str, ...], MinedRule] = {}
    for itemset in sorted(freq, key=lambda k: (len(k), k)):
        label_items = [x for x in itemset if x.startswith(LABEL)]
        tokens = tuple(x for x in itemset if not x.startswith(LABEL))
        if len(label_items) != 1 or not tokens or len(tokens) > most_tokens:
            continue
        verdict = label_items[0][len(LABEL) :]
        confidence, lift = freq[itemset] / freq[tokens], freq[itemset] * n / (freq[tokens] * counts[verdict])
        if confidence < min_confidence or lift <= 1:
            continue
        smaller = [rules[s] for i in range(len(tokens)) if (s := tokens[:i] + tokens[i + 1 :]) in rules]
        if any(r.verdict == verdict and r.confidence >= confidence for r in smaller):
            continue
        old = rules.get(tokens)
        if old is None or confidence > old.confidence:
            rules[tokens] = MinedRule(tokens, verdict, confidence, freq[itemset] / n)
    return sorted(rules.values(), key=lambda r: r.tokens), default, {k: v for k, v in same.items() if k != v}


def inverted_index(rules: list[MinedRule]) -> dict[str, list[MinedRule]]:
    """Rules under their rarest token among the rules, so that few are looked at for a URL."""
    often: dict[str, int] = {}
    for r in rules:
        for t in r.tokens:
            often[t] = often.get(t, 0) + 1
    out: dict[str, list[MinedRule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append(r)
    return out


def best_rule(tokens: list[str], index: dict[str, list[MinedRule]]) -> MinedRule | None:
    """The surest rule that tokens match; ties go to larger support, then more tokens, then alphabetical order."""
    have, best = set(tokens), None
    for t in have:
        for r in index.get(t, ()):
            if have.issuperset(r.tokens) and (best is None or (-r.confidence, -r.support, -len(r.tokens), r.tokens) < (-best.confidence, -best.support, -len(best.tokens), best.tokens)):
                best = r
    return best


def mined_verdict(url: Column, rules: list[MinedRule], default: str, same: dict[str, str] = {}) -> Column:  # noqa: B006
    """Struct (mined_rule, verdict, confidence): that of the surest matching rule, else the default with null. same: of mine_all()."""

    @F.arrow_udf("struct<mined_rule:string,verdict:string,confidence:double>")
    def judged(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = inverted_index(rules)
        for urls in column:
            hits = [best_rule([same.get(t, t) for t in url_tokens(u)], index) for u in urls.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([" ".join(r.tokens) if r else None for r in hits], pa.string()), pa.array([r.verdict if r else default for r in hits], pa.string()), pa.array([r.confidence if r else None for r in hits], pa.float64())],
                ["mined_rule", "verdict", "confidence"],
            )

    return judged(url)


def url_filters(pages: DataFrame, rules: list[ListRule], labelled: DataFrame | None = None, url: str = "url", **mining) -> DataFrame:
    """pages with host, path, rule, mined_rule and verdict, which replace columns of these names.

    labelled: (url, label) rows to mine; without it, the pages that a list rule fits, labelled with its verdict. A null
    url has empty host and path, no rule, and the default verdict. Repeated rows get equal verdicts and count each in
    mining; an empty table gives an empty one."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    listed, guess = free_name(out, "list"), free_name(out, "mined")
    out = out.withColumn(listed, list_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = out.select(F.col(url).alias("url"), F.col(listed)["verdict"].alias("label"))
    mined, default, same = mine_all(labelled, "url", "label", **mining)
    out = out.withColumn(guess, mined_verdict(F.col(url), mined, default, same))
    return out.withColumns({"rule": F.col(listed)["rule"], "mined_rule": F.when(F.col(listed).isNull(), F.col(guess)["mined_rule"]), "verdict": F.coalesce(F.col(listed)["verdict"], F.col(guess)["verdict"])}).drop(listed, guess)
