"""The corpus pipeline against its stages' brute force on a small table."""

import random

import corpus_pipeline
from tidecount.llm import mixing, quality_rules, secret_scan

from .test_repeats import brute_components, near
from .test_text_operators import brute_base, brute_contamination


def test_pipeline_matches_brute_force(spark, docs, prose, tmp_path):
    r = random.Random(5)
    items = [(i, prose(700 + i, 30)) for i in range(4)]
    rows = [(1000, None, "a"), (1001, "", "b"), (1002, "too short.", None)]
    for i in range(120):
        w = prose(i % 80, r.randrange(10, 120)).split() if i % 3 else near(r, prose(i % 9, 80).split(), 0.02)
        if i % 10 == 0:
            w[5:5] = r.choice(items)[1].split()
        if i % 7 == 0:
            w[3:3] = ["password=abc123xyz"]
        rows.append((i, " ".join(w) if i % 11 else "!! ".join(w).upper(), r.choice(["a", "b", "c", None])))
    folder = str(tmp_path / "sf")
    df = docs(rows)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [x for x in rows if not brute_base(x[1])[5] and quality_rules.clean_lines(x[1])[2] * 2 <= brute_base(x[1])[0]]
    roots = brute_components([(i, t) for i, t, _ in left])
    left = [x for x in left if roots[x[0]][1] == x[0]]
    bad = [w[4] for w in brute_contamination([t for _, t, _ in left], items)]
    left = [x for x, b in zip(left, bad, strict=True) if not b]
    clean = {x.doc_id: x for x in secret_scan.redact(docs(left)).collect()}
    assert any("[secret]" in x.text for x in clean.values()) and 5 < len(left) < len(rows)
    taken = {x.doc_id: x.taken for x in mixing.mix(docs([(i, clean[i].text, s) for i, _, s in left])).collect() if x.taken}

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}
    assert {i: x.taken for i, x in got.items()} == taken
    assert all(x.text == clean[i].text and x.n_chars == len(x.text) for i, x in got.items())


def test_stages_keep_columns_and_empty_tables(spark, docs, prose, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in ([], [prose(3, 50), None]):
        df = docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, folder)
            assert out.columns == df.columns + (["taken"] if name == "mixture" else [])
            assert out.count() == min(1, len(rows))
            df = out
    assert len(corpus_pipeline.STAGES) == 5
