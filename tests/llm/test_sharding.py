from collections import Counter

import numpy as np
import pytest
from cases import empty_docs, messy_docs, messy_rows

from fieldflow.llm import sharding


def plain_table(shards, slots):
    """Preference lists written out in full; turns by the book."""
    import hashlib

    prefer = []
    for name in shards:
        d = hashlib.md5(name.encode()).digest()
        offset, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefer.append([(offset + j * step) % slots for j in range(slots)])
    table, at = {}, [0] * len(shards)
    while len(table) < slots:
        for s in range(len(shards)):
            while at[s] < slots and prefer[s][at[s]] in table:
                at[s] += 1
            if len(table) < slots:
                table[prefer[s][at[s]]] = s
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 7), (5, 101), (17, 1009)])
def test_table_against_full_lists(n, slots):
    shards = [f"n{i}" for i in range(n)]
    assert sharding.lookup_table(shards, slots).tolist() == plain_table(shards, slots)


def test_shares_are_even_and_few_slots_move():
    shards = list(sharding.SHARDS)
    table = sharding.lookup_table(shards)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1])
    moved = (table != fewer) & (table != len(shards) - 1)
    assert moved.mean() < 0.05


def test_tables_that_cannot_be():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcd"), 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_every_row_is_placed_with_all_its_columns(spark):
    docs = messy_docs(spark)
    out = sharding.assign_shards(docs)
    assert out.columns == [*docs.columns, "shard_"]
    assert out.count() == len(messy_rows())
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in messy_rows())
    plan = sharding.shard_plan(docs).collect()
    table = sharding.lookup_table()
    assert all(table[r.slot] == r.shard for r in plan)
    by_id = {}
    for r in plan:
        if r.doc_id is not None:
            assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.shard_plan(empty_docs(spark)).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = messy_docs(spark, extra=False)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=("a", "b", "c"), slots=101, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
