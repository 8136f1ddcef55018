import re

from cases import empty_docs, messy_docs, messy_rows, prose, rows_of

from fieldflow.llm import license_scan as scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def licensed_rows():
    import random

    rng = random.Random(8)
    mit, gpl = scan.NOTICES["mit"], scan.NOTICES["gpl"]
    changed = mit.split()
    changed[5] = "everybody"
    del changed[11]
    changed.insert(16, "and other")
    return messy_rows() + [
        (500, "Released under the MIT License.", None, None),
        (501, "CC BY, cc-by; CC BY CC BY-NC 4.0 cc by cc by", "en", "s1"),
        (502, "mit license mit license MIT  LICENSE", None, None),
        (503, "gnu general public license gnu general public", None, None),
        (504, "the GNU Lesser General Public License", None, None),
        (505, prose(rng, 50) + " " + mit + " " + prose(rng, 50), None, None),
        (506, prose(rng, 50) + " " + " ".join(changed) + " " + prose(rng, 30), None, None),
        (507, " ".join(mit.split()[:6]) + " " + prose(rng, 20), None, None),
        (508, prose(rng, 5) + gpl.upper() + " apache license", None, None),
        (509, "apache", None, None),
        (510, "license apache license", None, None),
        (511, ("mit license " + "of the software " * 3) * 300, None, None),
        (512, "É mit license été", None, None),
    ]


def test_base_against_loops(spark):
    rows = licensed_rows()
    got = scan.license_report(messy_docs(spark, rows=rows))
    names = "doc_id n_words n_base first_word last_word base_labels".split()
    assert rows_of(got.select(*names)) == sorted(((r[0], *plain_base(r[1])) for r in rows), key=str)


def test_notices_are_found_changed_but_not_cut(spark):
    got = {r.doc_id: r for r in scan.license_report(messy_docs(spark, rows=licensed_rows())).collect()}
    assert got[505].labels == "mit" and got[505].base_labels == "" and got[505].score == 1.0
    assert got[506].labels == "mit" and 0.6 <= got[506].score < 1
    assert got[507].labels == "" and got[507].score == 0
    assert got[508].labels == "apache,gpl" and got[504].labels == "lgpl"
    assert got[501].labels == "cc-by,cc-by-nc" and got[103].labels == ""
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values())


def test_spans_lie_where_the_notice_stands(spark):
    spans = scan.license_spans(messy_docs(spark, rows=licensed_rows())).where("label is not null").collect()
    (notice,) = [s for s in spans if s.doc_id == 505]
    assert (notice.start, notice.end) == (50, 50 + len(words_of(scan.NOTICES["mit"])) - 1)
    text = dict((r[0], words_of(r[1])) for r in licensed_rows())
    assert all(text[s.doc_id][s.start : s.end + 1] for s in spans)


def test_places_are_shared_out_by_row(spark):
    rows = [(1, "mit license", None, None), (1, "apache license", None, None), (1, "mit license", None, None), (None, "cc by", None, None)]
    got = rows_of(scan.license_report(messy_docs(spark, rows=rows)).select("doc_id", "n_base", "labels"))
    assert got == sorted([(1, 1, "mit"), (1, 1, "apache"), (1, 1, "mit"), (None, 1, "cc-by")], key=str)


def test_no_python_in_the_plan_and_no_documents(spark):
    made = scan.license_report(empty_docs(spark))
    assert made.collect() == []
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
