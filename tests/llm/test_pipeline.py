"""The pipeline against a plain version of its stages on a small table."""

import random

from cases import DOCS, prose
from test_decontaminate import distance
from test_mixing import plain_targets, size
from test_quality import plain as measures
from test_simhash import plain_report

import corpus_pipeline
from fieldflow.llm import sharding


def corpus(rng):
    item = prose(rng, 30)
    rows = [(i, prose(rng, rng.randrange(40, 120)), "en" if i % 3 else "de", "hot" if i % 3 else f"s{i % 4}") for i in range(200)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s9") for i in range(20)]
    rows += [(400 + i, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "en", "hot") for i in range(5)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "hot") for i in range(6)]
    rows += [(600, "too few words", "en", "hot"), (601, None, None, None), (602, "same same " * 40, "en", "s1")]
    return rows, [(1, item), (2, prose(rng, 40))]


def test_stages_one_by_one(spark, tmp_path):
    rows, items = corpus(random.Random(12))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, expected = docs.columns, rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(path := str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(path)
        got = sorted((tuple(r) for r in docs.select(*columns).collect()), key=str)
        if k == 0:
            failed = lambda t: (m := measures(t))[0] < 10 or 100 * m[5] > 20 * m[0]
            expected = [r for r in rows if not failed(r[1]) and "###" not in r[1]]
        elif k == 1:
            expected = [r for r, (d, _, c) in zip(sorted(expected, key=str), plain_report(expected)) if d == c]
        elif k == 2:
            leaked = lambda t: any(distance(i.split(), t.split()) <= 0.2 * len(i.split()) for _, i in items)
            expected = [r for r in expected if not leaked(r[1])]
        elif k == 3:
            sizes = {}
            for r in expected:
                sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
            targets = plain_targets(sizes)
            for source, target in targets.items():
                taken = [r for r in got if r[3] == source]
                own = [r for r in expected if r[3] == source]
                assert abs(len(taken) - target / sizes[source] * len(own)) <= 1.001
                assert all(taken.count(r) <= 3 for r in own)
            assert set(got) <= set(expected)
            expected = got
        assert got == sorted(expected, key=str), name
    table = sharding.lookup_table()
    plan = {r.doc_id: r.shard for r in sharding.shard_plan(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(r.shard == plan[r.doc_id] and r.shard in table for r in docs.collect())


def test_stage_names_and_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "benchmark decontamination", "mixing to weights", "sharding"]
