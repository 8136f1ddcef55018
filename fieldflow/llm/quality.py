"""Quality rules with thresholds that follow the data.

Every document is measured; quantile sketches of the measures are taken per (language, source) and merged
into sketches per language and of everything; upper fences come from the sketches and are joined back to
drop documents that lie far outside of what is usual for their language and source. Two rules stay fixed:
too few words, and too many words in repeated five-word windows.

Measures are shares of counts. Fences are drawn over smoothed shares, ``(k + 1) / (n + 1)``: where hardly any
document has a symbol or a repeated line, quartiles of plain shares are all 0 and tell nothing, while smoothed ones show how finely
documents of the group's lengths can tell a share at all. A fence is ``q75 + REACH * (q75 - q25)`` of its group, drawn
towards that of its language, and a language's towards the overall one, in the ratio of ``SHRINK`` documents to their own
number; nothing is fixed per measure. A document fails where its share, less one standard error of a
count, ``(k - sqrt(k)) / n``, lies above the fence: one repeated line in a short text is no evidence.

Sketches are partial aggregates, so a source with a third of all rows is no hot key, and the joined fence
table has one row per (language, source).

Defined results: null and empty texts measure 0 and fail; null languages and sources are groups of their
own; repeated rows are judged alike; no documents give no rows; further columns are handed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.llm import frames
from fieldflow.session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
REACH = 3.0
SHRINK = 50  # documents that weigh as much as the next higher group's fence
#: measure: (numerator, denominator)
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "shout_share": ("n_shouted", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words n_lines word_chars n_symbols n_shouted n_dup_lines n_repeat_words".split()
SLICE_BYTES = 1 << 20


def slices(text: pa.Array):
    """Runs of rows of about ``SLICE_BYTES``, so that memory follows the longest text, not the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(text):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield start, stop
        start = stop


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of non-white characters of all texts, and the row of each."""
    lists = pc.ascii_split_whitespace(text)
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def repeated_words(codes: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether a word lies in a window of ``window`` words that its row holds twice or more."""
    covered = np.zeros(len(codes), dtype=bool)
    n = len(codes) - window + 1
    if n <= 0:
        return covered
    whole = row[:n] == row[window - 1 :]
    start = np.flatnonzero(whole)
    mixed = row[start].astype(np.uint64)
    for k in range(window):  # a 64-bit mix of row and words; equal windows are equal, others meet with odds of 2^-64
        mixed = (mixed ^ codes[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    twice = np.zeros(len(start), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(window):
        covered[start[twice] + k] = True
    return covered


def _measure(text: pa.Array) -> list[np.ndarray]:
    n = len(text)
    count = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64)
    words, row = words_of(text)
    shouted = pc.and_(pc.equal(words, pc.utf8_upper(words)), pc.not_equal(words, pc.utf8_lower(words)))
    shouted = pc.and_(shouted, pc.greater(pc.utf8_length(words), 1)).to_numpy(zero_copy_only=False)
    codes = words.dictionary_encode().indices.to_numpy()
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
    signs = np.zeros(256, dtype=bool)
    signs[list(SYMBOLS)] = True
    data = text.buffers()[2]
    found = np.flatnonzero(signs[np.frombuffer(data, np.uint8)[: offsets[-1]]]) if data else np.zeros(0, int)
    n_symbols = np.searchsorted(found, offsets[1:]) - np.searchsorted(found, offsets[:-1])
    lists = pc.split_pattern(text, "\n")
    lines, line_row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(pc.ascii_trim(lines, characters=frames.WHITE)), 0)
    lines, line_row = lines.filter(full).dictionary_encode(), line_row[full.to_numpy(zero_copy_only=False)]
    once = np.unique(line_row.astype(np.int64) * max(1, len(lines.dictionary)) + lines.indices.to_numpy())
    n_lines = count(line_row)
    distinct = count(once // max(1, len(lines.dictionary)))
    chars = count(row, pc.utf8_length(words).to_numpy(zero_copy_only=False))
    return [
        count(row), n_lines, chars, n_symbols.astype(np.int64), count(row[shouted]), n_lines - distinct,
        count(row[repeated_words(codes, row)]),
    ]


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measure(text: pa.Array) -> pa.Array:
    """All measures of whole texts."""
    text = pc.fill_null(text.cast(pa.string()), "")
    parts = [_measure(pa.concat_arrays([text.slice(a, b - a)])) for a, b in slices(text)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in range(len(MEASURES))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def smoothed(name: str) -> Column:
    top, bottom = RATIOS[name]
    return (F.col(top) + 1) / (F.col(bottom) + 1)


def assured(name: str) -> Column:
    """A share less one standard error of its count."""
    top, bottom = RATIOS[name]
    return F.when(F.col(bottom) > 0, (F.col(top) - F.sqrt(top)) / F.col(bottom)).otherwise(F.lit(0.0))


def fences(measured: DataFrame, reach: float = REACH, shrink: float = SHRINK) -> DataFrame:
    """(lang, source, one upper fence per measure) for every group in ``measured``.

    Documents that fail the fixed rules do not shape the fences.
    """
    good = measured.where(~F.col("base_failed"))
    sketch = [F.kll_sketch_agg_double(smoothed(m)).alias(m) for m in RATIOS]
    groups = cut_lineage(good.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketch), "quality-sketches")
    merge = [F.kll_merge_agg_double(m).alias(m) for m in RATIOS]
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merge)

    def limit(m: str, at: str) -> Column:
        quantile = lambda q: F.kll_sketch_get_quantile_double(F.col(f"{at}.{m}"), F.lit(q))
        return quantile(0.75) + reach * (quantile(0.75) - quantile(0.25))

    whole = groups.agg(*merge).where(F.lit(groups.limit(1).count() > 0)).alias("o")
    overall = whole.select(*[limit(m, "o").alias(m) for m in RATIOS]).first()  # one row of as many numbers as measures
    joined = (
        measured.select("lang", "source").distinct().alias("k")
        .join(groups.alias("g"), F.col("k.lang").eqNullSafe(F.col("g.lang")) & F.col("k.source").eqNullSafe(F.col("g.source")), "left")
        .join(by_lang.alias("l"), F.col("k.lang").eqNullSafe(F.col("l.lang")), "left")
    )

    def drawn(m: str, at: str, above: Column) -> Column:
        n = F.col(f"{at}.n")
        return F.when(n.isNull(), above).otherwise((n * limit(m, at) + shrink * above) / (n + shrink))

    top = lambda m: F.lit(overall[m] if overall else None).cast("double")
    return joined.select("k.lang", "k.source", *[drawn(m, "g", drawn(m, "l", top(m))).alias(f"max_{m}") for m in RATIOS])


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    within = ~F.col("base_failed")
    for m in RATIOS:  # without any good document there is no fence
        within = within & F.coalesce(assured(m) <= F.col(f"max_{m}"), F.lit(True))
    return measured.join(limits, same, "left").withColumn("kept", within)


def _measured(rows: DataFrame) -> DataFrame:
    measured = rows.withColumn("m", measure("text")).select("*", "m.*").drop("m", "text")
    return measured.withColumn("base_failed", base_failed())


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lang, source, all measures, base_failed and kept of every document."""
    picked = frames.pick(docs, doc_id="long", lang="string", source="string", text="string")
    measured = cut_lineage(_measured(picked), "quality-measures")
    limits = cut_lineage(fences(measured, **options), "quality-fences")
    return _judged(measured, limits).select("doc_id", "lang", "source", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with all their columns; texts are measured again instead of being shuffled."""
    picked = frames.pick(docs, lang="string", source="string", text="string")
    measured = cut_lineage(_measured(picked), "quality-measures")
    limits = cut_lineage(fences(measured, **options), "quality-fences")
    rows = _measured(frames.with_row(docs, lang="string", source="string", text="string"))
    return frames.rows_of(_judged(rows, limits).where("kept"), docs.columns)
