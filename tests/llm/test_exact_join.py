"""Components of a whole table against an exact join: rarest-first prefixes, which miss no pair, and sets of the shingles themselves.

EXACT_JOIN_DIR names another table, as ``EXACT_JOIN_DIR=/root/testdata/check_h python -m pytest tests/llm/test_exact_join.py``.
"""

import os
import re
from collections import Counter, defaultdict

from tidecount.llm.ngram_join import similarity_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())  # bytes.lower() lowers A-Z only
    return frozenset(b" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else [])


def exact_components(rows):
    """{doc_id: smallest doc_id reachable}; rows have distinct ids."""
    first, parent = {}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for i, text in sorted(rows):
        s = shingles(text)
        if s:
            join(first.setdefault(s, i), i)
    often = Counter(x for s in first for x in s)
    index = defaultdict(list)
    for s in sorted(first, key=len):
        me, n = first[s], len(s)
        rare = sorted(s, key=lambda x: (often[x], x))[: n - -(-3 * n // 4) + 1]
        for other in {o for x in rare for o in index[x]}:
            if find(first[other]) != find(me) and 4 * len(other) >= 3 * n:
                both = len(s & other)
                if 100 * both >= 75 * (n + len(other) - both):
                    join(me, first[other])
        for x in rare:
            index[x].append(s)
    return {i: find(i) for i in parent}


def test_whole_table(spark):
    folder = os.environ.get("EXACT_JOIN_DIR", "/root/testdata/sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = exact_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in similarity_components(docs).collect()}
    assert got == want
    sizes = Counter(want.values())
    print(f"{len(want)} documents, {sum(n for n in sizes.values() if n > 1)} in {sum(n > 1 for n in sizes.values())} components, the largest of {max(sizes.values())}")
