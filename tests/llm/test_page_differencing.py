"""The figures that README gives for the exit from page differencing, measured anew on the page table."""

import difflib
import html
import os
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from cohortix.llm.html_extraction import INLINE, main_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


def lines(page):
    """All text lines of a page, chrome and all, cut at every tag that isn't inline."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", page or "")
    page = re.sub(r"</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>", lambda m: "" if m[1].lower() in INLINE and m[1].lower() != "br" else " " if m[1].lower() == "br" else "\n", page)
    return [x for x in (" ".join(html.unescape(line).split()) for line in page.split("\n")) if x]


def nearest(urls):
    """For each URL of a host the index of the other that shares the longest beginning of its path; the first of equals."""
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    return [max((j for j in range(len(urls)) if j != i), key=lambda j: (common(urls[i], urls[j]), -j)) for i in range(len(urls))]


@pytest.mark.skipif(not os.path.exists(PAGES), reason="needs the page table")
def test_differencing_leaves_chrome_in():
    hosts = defaultdict(list)
    for r in pq.read_table(PAGES).to_pylist():
        if r["url"] and "://" in r["url"]:
            host, _, path = r["url"].split("://", 1)[1].partition("/")
            hosts[host.lower()].append((path, lines(r["html"]), main_text(r["html"])))
    pages = shared = total = right = 0
    for rows in hosts.values():
        if len(rows) < 2:
            continue
        for (_, own, text), j in zip(rows, nearest([path for path, _, _ in rows])):
            same = set()
            for b in difflib.SequenceMatcher(None, own, rows[j][1], autojunk=False).get_matching_blocks():
                same |= set(range(b.a, b.a + b.size))
            pages, shared, total = pages + 1, shared + len(same), total + len(own)
            right += "\n".join(x for i, x in enumerate(own) if i not in same) == text
    print(f"{pages} pages with a neighbour share {shared} of {total} lines; deleting them leaves the article alone for {right}")
    assert pages > 200 and right < 0.05 * pages
