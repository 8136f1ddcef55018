import hashlib
import random
import re
import zlib

import pytest
from cases import rows_of

from fieldflow.llm import prefix_trie

CHATS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    chats = {}
    for c, turn, role, text in rows:
        if c is not None:
            chats.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: [t[2:] for t in sorted(ts)] for c, ts in chats.items()}
    made = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = (*chats.get(c - c % 20, [])[:h], *own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []

    def walk(path):
        """Leaves and saved tokens of a subtree."""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [walk(k) for k in kids.get(path, [])]
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * words
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if made[c] == path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[path]), len(path), parent, len(members[path]), len(kids.get(path, [])), leaves, saved, digest))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def chats(seed=1, n=300):
    rng = random.Random(seed)
    said = ["", "a b", "a  b\n c", "ü", "word " * 20, None, "a"]
    rows = []
    for c in [*range(0, n, 3), *range(1000, 1040), 5000]:
        if c % 60 and c % 20 == 0 and c < n:
            continue  # some have no conversation to share with
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(said)))
    for c in range(2000, 2400):  # one conversation, over and over
        rows += [(c, 0, "user", "hello there"), (c, 1, "assistant", "yes"), (c, 2, "user", "x"), (c, 3, "user", "bye bye")]
    rows += [(7000, t, "user", str(t % 3)) for t in range(500)] + [(7001, t, "user", str(t % 3)) for t in range(400)]
    rows += [(5000, 0, "user", "a"), (5000, 0, "user", "a"), (None, 0, "user", "nobody's"), (5001, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_keys,chunk_turns", [(8192, 1 << 18), (1, 1), (7, 60)])
def test_report_equals_plain_version(spark, monkeypatch, chunk_keys, chunk_turns):
    """However sorted strings are cut into trees."""
    monkeypatch.setattr(prefix_trie, "CHUNK_KEYS", chunk_keys)
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", chunk_turns)
    rows = chats()
    docs = spark.createDataFrame(rows, CHATS)
    names = "node parent seam depth key words digest turns".split()
    got = prefix_trie.trie_report(docs.select("*", *[docs.conv_id.alias(n) for n in names]))
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert rows_of(got) == plain_trie(rows)


def test_node_layouts_grow():
    rng = random.Random(5)
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        heads = rng.sample(range(256), n)
        keys = [bytes([b]) + bytes(15) for b in heads] + [bytes([b]) + bytes(15) + b"\1" * 16 for b in heads[::2]]
        root = prefix_trie.tree(keys)
        assert root.room == min(r for r in (4, 16, 48, 256) if r >= n)
        assert [b for b, _ in root.items()] == sorted(heads)
        for row, key in enumerate(keys):
            node, at = root, 0
            while True:
                assert key[at : at + len(node.path)] == node.path
                at += len(node.path)
                if at == len(key):
                    break
                node, at = node.child(key[at]), at + 1
            assert node.row == row
        assert root.child(next(b for b in range(257) if b not in heads)) is None if n < 256 else True


def test_paths_are_compressed():
    keys = sorted([b"a" * 160, b"a" * 80 + b"b" * 80, b"a" * 80])
    root = prefix_trie.tree(keys)
    assert len(root.path) == 80 and root.row == keys.index(b"a" * 80) and len(root.kids) == 2


def test_odd_tables(spark):
    assert prefix_trie.trie_report(spark.createDataFrame([], CHATS)).collect() == []
    nobody = [(None, 1, "user", "x")]
    assert prefix_trie.trie_report(spark.createDataFrame(nobody, CHATS)).collect() == []
    for rows in ([(5, 0, "user", "only turn")], [(20, 0, None, None), (20, 0, None, None), (21, None, "", "")], [(-7, 1, "a", "b c"), (0, 1, "a", "b c d")]):
        if rows[0][0] >= 0:
            assert rows_of(prefix_trie.trie_report(spark.createDataFrame(rows, CHATS))) == plain_trie(rows)
        else:
            assert prefix_trie.trie_report(spark.createDataFrame(rows, CHATS)).count() >= 2
