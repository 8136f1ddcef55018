"""Small tables with everything that may go wrong, and plain versions of what operators compute."""

import random

LONG = "word " * 30_000 + "\n" * 500
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "x", "yz"]) for _ in range(n))


def messy_rows(n=60, seed=5):
    """(doc_id, text, lang, source): nulls, blanks, repeated rows and ids, a hot source, long and odd texts."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 4}") for i in range(n)]
    rows += [
        (100, None, "en", "s1"),
        (101, "", None, None),
        (102, " \t\n\r\x0b\x0c ", "en", "s1"),
        (103, LONG, "en", "hot"),
        (104, "x" * 50_000, "de", None),
        (105, "Ünïcode ß ÄÖ\u00a0é\n\U0001f600 \u3000wide", None, "s2"),
        (106, "\n\n", "en", "s2"),
        (1, rows[1][1], rows[1][2], rows[1][3]),
        (1, "another text under the same identifier, with words", "en", "hot"),
        (None, "no identifier here but words enough to count as prose", "en", "s1"),
        (None, None, None, None),
    ]
    return rows


DOCS = "doc_id long, text string, lang string, source string"


def messy_docs(spark, extra=True, rows=None):
    """With columns named like those that operators make, dots and repeats included."""
    docs = spark.createDataFrame(messy_rows() if rows is None else rows, DOCS)
    if not extra:
        return docs
    names = "row key size digest target copies kept fp place words hashes out m n_words uid shard lang_pred a.b TEXT2".split()
    return docs.select("*", *[docs.doc_id.alias(n) for n in names])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
