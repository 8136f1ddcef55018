"""Removal of lines that many documents share.

Lines are exploded, normalised and hashed; a hash is counted once per document; hashes found in too many
documents are repeated lines, and every document is put together again from its other lines, in place.

The count runs over (hash, document) pairs first and over hashes second, both with partial sums, so a line
that a third of all documents hold is no hot key. What goes back to a document is the set of its own
repeated hashes, found by identifier and text digest, so that rows without an identifier, or many rows under one, each get
their own lines' hashes alone; a document without any needs no more than its own row, and texts move at most once.
Two independent 64-bit hashes make a key, so that two lines do not meet by accident.

Defined results: null or empty text is one empty line, which is kept; rows with the same doc_id count as
one document but are each put together from their own text; rows with null doc_id count as one document;
repeated rows give repeated results; no documents give no rows; further columns are handed through.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.llm import frames
from fieldflow.session import cut_lineage

MIN_DOCS = 10
SEEDS = (42, 1042)
SALTS = 32


def line_hash(line: str) -> tuple[int, int] | None:
    """Both signed hashes of a line's key; null if fewer than one code point is left of it."""
    key = line.strip(frames.WHITE).encode().lower()  # bytes.lower() changes A-Z alone
    if not key:
        return None
    a, b = (xxhash.xxh64_intdigest(key, seed) for seed in SEEDS)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _exploded(batches):
    """(doc_id, digest, h1, h2), each hash once per row."""
    for batch in batches:
        ids, digests, first, second = [], [], [], []
        for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = {line_hash(line) for line in set(text.split("\n"))} if text else set()
            hashes.discard(None)
            ids.extend([doc_id] * len(hashes))
            digests.extend([digest] * len(hashes))
            first.extend(h[0] for h in hashes)
            second.extend(h[1] for h in hashes)
        columns = [pa.array(x, pa.int64()) for x in (ids, digests, first, second)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "h1", "h2"])


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digest, hashes): the hashes of a text's lines that at least ``min_docs`` documents hold."""
    picked = frames.pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    pairs = picked.mapInArrow(_exploded, "doc_id long, digest long, h1 long, h2 long")
    pairs = cut_lineage(pairs, "line-pairs")
    often = (
        pairs.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    )
    # A line that most documents hold is met in SALTS tasks, not one.
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    salted = often.withColumn("salt", F.explode(every))
    hits = dealt.join(salted, ["h1", "h2", "salt"], "left_semi")
    return hits.groupBy("doc_id", "digest").agg(F.collect_set("h1").alias("hashes"))


_OUT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


@F.arrow_udf(_OUT)
def reassemble(text: pa.Array, hashes: pa.Array) -> pa.Array:
    """A text without the lines whose key is in its ``hashes``; the others in their order."""
    n_lines, n_dropped, kept = [], [], []
    for whole, drop in zip(text, hashes):
        lines = (whole.as_py() or "").split("\n")
        out = lines
        if drop.is_valid:
            drop = set(drop.values.to_pylist())
            out = [x for x in lines if (h := line_hash(x)) is None or h[0] not in drop]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(out))
        kept.append("\n".join(out))
    arrays = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
    return pa.StructArray.from_arrays(arrays, ["n_lines", "n_dropped", "kept"])


def _joined(rows: DataFrame, docs: DataFrame, min_docs: int) -> DataFrame:
    hits = repeated_lines(docs, min_docs).withColumnsRenamed({"doc_id": "hit_id", "digest": "hit_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_digest"))
    return rows.join(hits, same, "left").withColumn(
        "out", reassemble("text", "hashes")
    )


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of every document, with ``text`` put together from the lines that stay."""
    joined = _joined(frames.with_row(docs, doc_id="long", text="string"), docs, min_docs)
    at = docs.columns.index("text")
    columns = [F.col("out.kept") if i == at else F.col(f"row.c{i}") for i in range(len(docs.columns))]
    return joined.select(*columns).toDF(*docs.columns)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text that stays) of every document."""
    joined = _joined(frames.pick(docs, doc_id="long", text="string"), docs, min_docs)
    return joined.select("doc_id", "out.n_lines", "out.n_dropped", "out.kept")
