"""Repeat removal and the shingle join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidecount.llm import ngram_join, substring_dedup
from tidecount.llm.components import components

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_removal(rows):
    owner = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            if i is not None:
                owner[s] = min(owner.get(s, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 49) if i is not None and owner[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def removal(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup.remove_repeats(df).collect()), key=repr)


def test_removal_matches_brute_force(docs, prose):
    r = random.Random(8)
    shared = [prose(500 + k, n).split() for k, n in enumerate((49, 50, 51, 70, 120, 300))] + [["a"] * 120, ["a", "b"] * 80, ["a", "a", "b"] * 50]
    rows = [(1000 + i, t) for i, t in enumerate(ODD)]
    for i in range(70):
        w = prose(i, r.randrange(5, 200)).split()
        for _ in range(r.randrange(4)):
            part = list(r.choice(shared))
            a = r.randrange(len(part))
            part = part[a : a + r.randrange(1, 200)] if r.random() < 0.5 else part
            if r.random() < 0.3 and part:
                part[r.randrange(len(part))] = "EDIT"
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((r.randrange(60), r.choice((" ", "\n", "\t ")).join(w)))
    rows += [(200, rows[-1][1]), (201, rows[-1][1]), (201, rows[-1][1]), (None, rows[-1][1]), (202, "a " * 500), (203, "a " * 51)]
    r.shuffle(rows)
    assert removal(docs(rows, extra=True)) == sorted(brute_removal(rows), key=repr)


def test_removal_of_large_groups(docs, prose):
    base = prose(1, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        if i % 3:
            w[(i * 37) % 150] = f"edit{i}"
        rows.append((i, " ".join(w)))
    assert removal(docs(rows)) == sorted(brute_removal(rows), key=repr)
    assert removal(docs([])) == []


def test_anchors_depend_on_the_window_alone(prose):
    r = random.Random(3)
    for trial in range(40):
        core = r.choice((prose(trial, 50).split(), ["x"] * 50, ["x", "y"] * 25, (["p", "p", "q"] * 17)[:50]))
        names = set()
        for k in range(6):
            left = r.choice((prose(r.random(), r.randrange(20)).split(), [core[0]] * r.randrange(9)))
            right = r.choice((prose(r.random(), r.randrange(20)).split(), [core[-1]] * r.randrange(9)))
            text = substring_dedup.Recompressed([" ".join([*left, *core, *right]).encode()])
            b = text.blocks
            at = np.searchsorted(b.start, len(left), side="right") - 1
            names.add(int(b.anchor[at]))
        assert len(names) == 1


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Rows that share a doc_id are one document."""
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, one) in enumerate(sets):
        for b, two in sets[:k]:
            if one and two and find(a) != find(b):
                both = len(one & two)
                if 100 * both >= 75 * (len(one) + len(two) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near(r, base, rate):
    return [f"e{r.randrange(10**6)}" if r.random() < rate else x for x in base]


@pytest.fixture(scope="module")
def family(prose):
    r = random.Random(11)
    rows = [(5000 + i, t) for i, t in enumerate(ODD) if not t or len(t) < 1000]
    for g in range(12):
        base = prose(900 + g, r.choice((3, 6, 12, 40, 150, 400))).split()
        for _ in range(r.choice((1, 2, 5, 40))):
            w = near(r, base, r.choice((0, 0, 0.01, 0.03, 0.06)))
            text = " ".join(w)
            rows.append((len(rows), text.upper() if r.random() < 0.2 else text))
    rows += [(6000, "one two"), (6001, "ONE  two"), (6002, "two one"), (6003, "é É"), (6004, "É É")]
    return rows


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect()}
    assert got == brute_components(rows)


def test_components_match_brute_force(docs, family):
    check(docs(family, extra=True), family)


def test_small_tiles(docs, family, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 2000)
    monkeypatch.setattr(ngram_join, "MEMBER", 20)
    check(docs(family), family)


def test_leftover_tiles_alone_find_all_links(docs, family, monkeypatch):
    """Without the leaders' rounds everything goes through size-banded tiles."""
    empty = lambda pairs: pairs.selectExpr("id", "id AS grp", "0 AS side", "'' AS tile").limit(0)
    monkeypatch.setattr(ngram_join, "_stars", empty)
    monkeypatch.setattr(ngram_join, "ALONE", 1)
    monkeypatch.setattr(ngram_join, "TILE", 3000)
    base = [f"w{i}" for i in range(60)]
    rows = [*family, *((7000 + i, " ".join([*base[i : i + 40], *(f"z{i}_{k}" for k in range(5))])) for i in range(0, 20, 2)), *((8000 + i, " ".join([*base, "end", str(i)])) for i in range(5))]
    check(docs(rows), rows)


def test_one_doc_id_with_several_texts(docs, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, prose(3, 30)), (4, ""), (5, None), (5, prose(3, 30) + " z")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in ngram_join.similarity_components(docs(order)).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (5, 5)]
        assert sorted(r.doc_id for r in ngram_join.keep_one(docs(order)).collect()) == [1, 4, 5]
    assert {r.text for r in ngram_join.keep_one(docs(rows)).collect()} == {r.text for r in ngram_join.keep_one(docs(rows[::-1])).collect()}


def test_bitmaps_bound_the_overlap_from_above():
    r = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 3000):
        pool = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        sets = [np.unique(r.choice(pool, n, replace=False)) for _ in range(12)] + [np.unique(np.append(r.choice(pool, n, replace=False), pool[:1]))]
        base = np.unique(pool[:n])
        sets += [np.unique(np.append(base[k:], r.integers(0, 2**63, k, dtype=np.uint64))) for k in range(0, n // 2, max(1, n // 20))]
        size = np.array([len(s) for s in sets])
        got = ngram_join.partners([ngram_join._bitmap(s, ngram_join._bits(len(s))).tobytes() for s in sets], size, None, np.arange(len(sets)), 75)
        for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert got[i] and got[j]


def test_links_at_exactly_the_threshold():
    a = np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(a[:6]), np.sort(np.append(a[1:6], a[6])), np.sort(a[:7]), np.zeros(0, np.uint64)]  # 5/7, 6/7
    assert {tuple(sorted(p)) for p in ngram_join.linked(sets, None, 75)} == {(0, 2), (1, 2)}
    assert {tuple(sorted(p)) for p in ngram_join.linked([a[:3] * 1, a[:4] * 1], None, 75)} == {(0, 1)}
    assert not list(ngram_join.linked([a[:2] * 1, a[:3] * 1], None, 75))


def test_band_loss_is_small():
    assert (1 - 0.75**ngram_join.ROWS) ** ngram_join.BANDS < 4e-10


def test_keep_one(docs, prose):
    text = prose(1, 60)
    df = docs([(3, text), (1, text), (1, text), (2, text + " more"), (9, None), (8, ""), (None, "n")], extra=True)
    out = ngram_join.keep_one(df)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 8, 9, None]
    assert sorted(out.columns) == sorted(df.columns)
    assert ngram_join.similarity_components(docs([])).count() == 0 and ngram_join.keep_one(docs([])).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    path = list(range(300))
    r.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (1000, 1001)]
    got = {x.a: x.b for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
