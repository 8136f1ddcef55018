import hashlib
from collections import defaultdict

from cases import empty_docs, messy_docs, messy_rows, rows_of

from fieldflow.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def plain(rows, min_docs):
    """(doc_id, n_lines, n_dropped, kept) by dictionaries."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    docs = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(doc_id)
    bad = {k for k, v in docs.items() if k and len(v) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lined_rows():
    rows = list(messy_rows())
    for i in range(200, 240):
        text = f"own line {i}\n  Subscribe NOW\t\nÉcole\n" + ("rare\n" if i < 209 else "") + ("École\n" if i % 4 else "école\n") + "\n"
        rows.append((i, text + f"tail {i}", "en", "hot"))
    rows += [(300, "subscribe now", "en", "s1"), (300, "subscribe now", "en", "s1"), (301, "RARE\n" * 50, "en", "s1")]
    rows += [(None, "subscribe now\nfor one", None, None)]
    return rows


def test_against_dictionaries(spark):
    rows = lined_rows()
    for least in (2, 10, 1000):
        got = line_dedup.line_report(messy_docs(spark, rows=rows), least)
        assert rows_of(got) == plain(rows, least)


def test_many_rows_without_an_identifier(spark):
    """Each row gets its own lines' hashes, not those of all rows without an identifier, or under one."""
    rows = [(None if i % 3 else 7, f"shared {i % 40}\nown {i}\ncommon", None, None) for i in range(600)]
    rows += [(1000 + i, f"shared {i % 20}\ncommon", None, None) for i in range(200)]
    docs = messy_docs(spark, rows=rows)
    assert rows_of(line_dedup.line_report(docs, 3)) == plain(rows, 3)
    assert line_dedup.repeated_lines(docs, 3).selectExpr("max(size(hashes))").first()[0] == 2


def test_a_line_counts_once_per_document(spark):
    rows = [(1, "a\na\na\nb", None, None), (2, "a", None, None), (2, "A", None, None)]
    assert rows_of(line_dedup.line_report(messy_docs(spark, rows=rows), 3)) == plain(rows, 3)
    assert [r.n_dropped for r in line_dedup.line_report(messy_docs(spark, rows=rows), 3).collect()] == [0, 0, 0]


def test_texts_are_replaced_in_place(spark):
    rows = lined_rows()
    docs = messy_docs(spark, rows=rows)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(d), t) for d, _, _, t in plain(rows, 10))


def test_no_documents(spark):
    assert line_dedup.line_report(empty_docs(spark)).collect() == []


def test_hash_pair_is_signed():
    a, b = line_dedup.line_hash(" X ")
    assert -(2**63) <= a < 2**63 and -(2**63) <= b < 2**63 and a != b
    assert line_dedup.line_hash("x") == (a, b) and line_dedup.line_hash("\t ") is None
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
