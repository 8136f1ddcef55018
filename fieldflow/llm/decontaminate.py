"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Words are the symbols. A walk after Chakraborty, Goldenberg and Koucky embeds a stretch of words: at each
step the word under the pointer is written out, and a random bit of that word and step says whether the
pointer moves on. Stretches at a small edit distance give embeddings at a small Hamming distance, so a key
made of a few sampled steps is often equal. ``WALKS`` walks with ``KEYS`` samples each repeat the draw
until the target recall is met; every hit is then checked by its exact edit distance.

Windows are sized to the item: two thirds of its words, rounded down to one of ``STRIDES``' sizes, so that
some window inside a changed item is hardly touched. A document's windows start at every second or fourth
word, an item's at every word. Keys that sample fewer than ``DISTINCT`` words of an item would meet in any prose and
are not indexed.

Before any walk an exact test turns most of a document away. ``k`` edits leave ``n - k`` words of an item in at
most ``k + 1`` pieces, so each match holds ``ceil((n - k) / (k + 1))`` words in a row as the item has them. That is four
(``RUN``) or more for 8, 9, 12 to 14 and 16 words and over, three for 6, 7, 10, 11 and 15. Only windows within reach of such a
run of a benchmark item are walked. Items of fewer than ``SHORT`` words have too few windows for walks alone:
for them each run is a candidate itself, so none of their matches is missed. Items of fewer than eight words have runs
only; those of fewer than five are found word for word.

The benchmark is the query set: items go to the scan in blocks of about ``BLOCK_KEYS`` keys, an item's keys together, one
scan per block, so what is sent is bounded by that number and the longest item.

An item matches where the edit distance of its words to a stretch of the document is at most
``MAX_EDITS`` of its length, rounded down. Words are runs of letters and digits, A-Z lower-cased. Defined results: items
without any word, null ones included, match nothing; null and empty documents are clean; repeated items and rows give equal
results; an empty benchmark leaves all documents clean; rows with the same doc_id and text share a verdict; further
columns are handed through.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.llm import frames
from fieldflow.llm.quality import slices, words_of
from fieldflow.session import cut_lineage

MAX_EDITS = 0.2
WALKS, KEYS, SAMPLES = 4, 6, 5
DISTINCT = 4  # sampled words that a key needs to tell anything
STRIDES = {8: 2, 16: 4, 32: 4}  # window size: every how many words one starts in a document
BLOCK_KEYS = 4_000_000
RUN, SHORT = 4, 15  # items of fewer than SHORT words are also met by runs of equal words; none is longer than RUN
SEED = 20

_WORD_BYTES = np.full(256, 32, dtype=np.uint8)  # everything but letters, digits and non-ASCII is white
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD_BYTES[_b] = _b
for _b in range(65, 91):
    _WORD_BYTES[_b] = _b + 32


def word_text(text: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and everything but word characters white."""
    text = pa.concat_arrays([text])
    size = np.frombuffer(text.buffers()[1], np.int32)[len(text)] if len(text) else 0
    if not size:
        return text
    data = _WORD_BYTES[np.frombuffer(text.buffers()[2], np.uint8)[:size]]
    return pa.StringArray.from_buffers(len(text), text.buffers()[1], pa.py_buffer(data.tobytes()))


def word_hashes(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, their 64-bit hashes and the row of each."""
    words, row = words_of(word_text(text))
    coded = words.dictionary_encode()
    table = np.fromiter(
        (xxhash.xxh64_intdigest(w.encode(), SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    return words, table[coded.indices.to_numpy()] if len(words) else table, row


def _samples() -> dict[int, dict[int, list[tuple[int, np.uint64]]]]:
    """size -> step -> the keys that sample it, with a factor each; only steps a pointer makes inside the window."""
    rng = np.random.default_rng(SEED)
    out: dict = {size: {} for size in STRIDES}
    for size, at in out.items():
        for key in range(WALKS * KEYS):
            for step in rng.choice(size * 3 // 2, SAMPLES, replace=False).tolist():
                factor = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                at.setdefault((key // KEYS, step), []).append((key, factor))
    return out


STEPS = _samples()


def _moves(padded: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits of every word; a blank's are 0, so a pointer that reaches one stays."""
    with np.errstate(over="ignore"):
        mixed = (padded ^ np.uint64(0xD6E8FEB86659FD93 * (walk + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
    return np.where(padded == 0, np.uint64(0), mixed).view(np.int64)


def window_keys(
    hashes: np.ndarray, row: np.ndarray, starts: np.ndarray, sizes: list[int], told: np.ndarray | None = None
) -> list[np.ndarray]:
    """For each size (key, start): signed 64-bit keys of the windows of that many words at ``starts``.

    The sizes share their walks. A blank follows each row's words. ``told``, shaped like the keys of the
    only size, gets how many words each has sampled.
    """
    places = np.arange(len(hashes)) + row
    padded = np.zeros(len(hashes) + (row[-1] if len(row) else 0) + 2, dtype=np.uint64)
    padded[places] = hashes
    out = [np.zeros((WALKS * KEYS, len(starts)), dtype=np.uint64) for _ in sizes]
    last = None if told is None else np.full(told.shape, -1)
    for walk in range(WALKS):
        moves = _moves(padded, walk)
        at = places[starts]
        for step in range(max(sizes) * 3 // 2):
            word = None
            for size, keys in zip(sizes, out):
                for key, factor in STEPS[size].get((walk, step), ()):
                    word = padded[at] if word is None else word
                    keys[key] += word * factor
                    if told is not None:
                        told[key] += (at != last[key]) & (word != 0)
                        last[key] = at
            at += moves[at] >> (step % 64) & 1
    for size, keys in zip(sizes, out):
        keys ^= np.arange(WALKS * KEYS, dtype=np.uint64)[:, None] * np.uint64(1024) + np.uint64(size)
        keys *= np.uint64(0xC2B2AE3D27D4EB4F)  # keys of other sizes and samples are other keys
        keys ^= keys >> np.uint64(32)
    return [keys.view(np.int64) for keys in out]


def run_length(n_words: int, max_edits: float = MAX_EDITS) -> int:
    """How many words in a row, ``RUN`` at most, every match of an item has as the item has them."""
    k = int(n_words * max_edits)
    return min(RUN, -(-(n_words - k) // (k + 1)))


def run_keys(hashes: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit keys of all runs of ``length`` words in a row, and where they start."""
    n = max(0, len(hashes) - length + 1)
    starts = np.flatnonzero(row[:n] == row[len(row) - n :])
    keys = np.full(len(starts), length, dtype=np.uint64)
    for k in range(length):
        keys = (keys ^ hashes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64), starts


def size_of(n_words: int) -> int:
    """The window size for an item."""
    return max(s for s in STRIDES if s <= max(n_words * 2 // 3, min(STRIDES)))


_INDEX = "key long, item long, size int, at int, candidate boolean"
_ITEM = "item long, item_id long, words array<string>"
_HIT = "doc_id long, digest long, lo int, words array<string>, starts array<int>, keys array<long>"


def _item_words(batches):
    """(item, item_id, words) of every item that has words; ``item`` is its text's digest."""
    for batch in batches:
        words, _, row = word_hashes(pc.fill_null(batch.column(2), ""))
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)
        made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["item", "item_id", "words"])
        yield made.filter(pc.greater(pc.list_value_length(own), 0))


def _item_keys(max_edits: float):
    def keys(batches):
        """(key, item, size, at, candidate) of every window and run of every item, from (item, text)."""
        names = ["key", "item", "size", "at", "candidate"]
        for batch in batches:
            _, hashes, row = word_hashes(pc.fill_null(batch.column(1), ""))
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = np.searchsorted(row, [i, i + 1])
                if a == b:
                    continue
                alone, length = np.zeros(b - a, dtype=np.int64), run_length(b - a, max_edits)
                found, starts = run_keys(hashes[a:b], alone, length)
                columns = [found, np.full(len(found), item), np.full(len(found), length, np.int32), starts.astype(np.int32)]
                columns.append(np.full(len(found), b - a < SHORT))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                if b - a < min(STRIDES):
                    continue
                size = size_of(b - a)
                starts = np.arange(b - a - size + 1)
                told = np.zeros((WALKS * KEYS, len(starts)), dtype=np.int64)
                (found,) = window_keys(hashes[a:b], alone, starts, [size], told)
                columns = [found.ravel(), np.full(found.size, item), np.full(found.size, size, np.int32)]
                columns += [np.tile(starts, len(found)).astype(np.int32), np.full(found.size, True)]
                made = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                yield made.filter(pa.array(told.ravel() >= DISTINCT))

    return keys


class _Keys:
    """Sorted distinct keys, with a bit map of their tails that turns most others away before the exact look-up."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = (1 << 22) - 1
        self.tail = np.zeros(self.low + 1, dtype=bool)
        self.tail[self.keys & self.low] = True

    def find(self, tried: np.ndarray) -> np.ndarray:
        """Places in ``tried`` of keys that are here."""
        likely = np.flatnonzero(self.tail[tried & self.low])
        if not len(self.keys):
            return likely
        place = np.minimum(np.searchsorted(self.keys, tried[likely]), len(self.keys) - 1)
        return likely[self.keys[place] == tried[likely]]


def _scanner(index: dict[str, np.ndarray], reach: int):
    """Documents to the stretches around windows and runs whose key an item has, with those and their keys.

    A stretch reaches ``reach`` words to both sides; stretches that touch are one, so words leave once.
    """
    is_run = index["size"] < min(STRIDES)
    lengths = np.unique(index["size"][is_run]).tolist()
    sizes = np.unique(index["size"][~is_run]).tolist()
    parts = index["key"][~is_run], index["key"][is_run], index["key"][is_run & index["candidate"]]

    def scan(batches):
        windows, runs, short_runs = map(_Keys, parts)
        for batch in batches:
            text = pc.fill_null(batch.column(2).cast(pa.string()), "")
            for a, b in slices(text):
                words, hashes, row = word_hashes(text.slice(a, b - a))
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                window, key = [], []
                near = np.zeros(len(row) + 1, dtype=np.int64)  # +1 where a stretch that may match begins, -1 after it
                for length in lengths:
                    own, starts = run_keys(hashes, row, length)
                    met = runs.find(own)
                    np.add.at(near, np.maximum(starts[met] - reach, bounds[row[starts[met]]]), 1)
                    np.add.at(near, np.minimum(starts[met] + reach, bounds[row[starts[met]] + 1]), -1)
                    met = met[short_runs.find(own[met])]
                    window.append(starts[met])
                    key.append(own[met])
                place = np.flatnonzero(np.cumsum(near)[:-1])
                for stride in sorted({STRIDES[size] for size in sizes}):
                    starts = place[(place - bounds[row[place]]) % stride == 0]
                    for own in chain.from_iterable(window_keys(hashes, row, starts, [s for s in sizes if STRIDES[s] == stride])):
                        met = windows.find(own)
                        window.append(starts[met])
                        key.append(own[met])
                window = np.concatenate(window) if window else place
                key = np.concatenate(key) if key else place
                if not len(window):
                    continue
                order = np.argsort(window, kind="stable")
                at, key = window[order], key[order]
                lo = np.maximum(at - reach, bounds[row[at]])
                hi = np.minimum(at + reach, bounds[row[at] + 1])
                fresh = np.append(True, (row[at[1:]] != row[at[:-1]]) | (lo[1:] > hi[:-1]))
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(at)) - 1
                doc, cut = row[at[first]], pa.array(np.append(first, len(at)), pa.int32())
                base = bounds[row[at]]
                held = [words.slice(x, y - x).to_pylist() for x, y in zip(lo[first].tolist(), hi[last].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + a)),
                        batch.column(1).take(pa.array(doc + a)),
                        pa.array(lo[first] - bounds[doc], pa.int32()),
                        pa.array(held, pa.list_(pa.string())),
                        pa.ListArray.from_arrays(cut, pa.array(at - base, pa.int32())),
                        pa.ListArray.from_arrays(cut, pa.array(key, pa.int64())),
                    ],
                    ["doc_id", "digest", "lo", "words", "starts", "keys"],
                )

    return scan


def least_edits(item: list[str], near: list[str], most: float = float("inf")) -> int:
    """The least edit distance, in words, of ``item`` to any stretch of ``near``.

    Where more than ``most`` words of the item are not in ``near`` at all, their number, a lower bound.
    """
    if any(near[i : i + len(item)] == item for i, w in enumerate(near) if w == item[0]):
        return 0
    missing = sum((Counter(item) - Counter(near)).values())
    if missing > most:
        return missing
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([codes[w] for w in item])
    b = np.array([codes.get(w, -1) for w in near])
    row = np.zeros(len(b) + 1, dtype=np.int64)  # a stretch may start anywhere at no cost
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        kept = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], kept]) - steps) + steps
    return int(row.min())


@F.arrow_udf(T.LongType())
def edits(item: pa.Array, near: pa.Array, most: pa.Array) -> pa.Array:
    rows = zip(item.to_pylist(), near.to_pylist(), most.to_pylist())
    return pa.array([least_edits(a, b, m) for a, b, m in rows], pa.int64())


def _word_counts(batches):
    for batch in batches:
        _, _, row = word_hashes(pc.fill_null(batch.column(1), ""))
        counts = pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["item_id", "n_words"])


def unsearched(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words) of the items that match nothing, as they have no words."""
    picked = frames.pick(benchmark, item_id="long", text="string")
    return picked.mapInArrow(_word_counts, "item_id long, n_words long").where("n_words = 0")


def _digest() -> F.Column:
    return F.xxhash64(F.col("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """(doc_id, digest, item_id, n_edits): each item a document holds, with its least edit distance."""
    spark = docs.sparkSession
    texts = frames.pick(benchmark, item_id="long", text="string").withColumn("item", F.xxhash64("text"))
    items = cut_lineage(texts.select("item", "item_id", "text").mapInArrow(_item_words, _ITEM), "benchmark-items")
    once = texts.groupBy("item").agg(F.first("text").alias("text"))
    index = cut_lineage(once.mapInArrow(_item_keys(max_edits), _INDEX), "benchmark-keys")
    n_keys = index.count()
    longest = items.agg(F.max(F.size("words"))).first()[0]
    picked = frames.pick(docs, doc_id="long", text="string").select("doc_id", _digest().alias("digest"), "text")
    hits = spark.createDataFrame([], _HIT)
    blocks = -(-n_keys // BLOCK_KEYS)
    for block in range(blocks):
        mine = index.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        table = mine.select("key", "size", "candidate").toArrow()  # about BLOCK_KEYS keys
        if len(table):
            columns = {c: table.column(c).to_numpy() for c in table.column_names}
            hits = hits.union(picked.mapInArrow(_scanner(columns, int(longest * (1 + max_edits)) + 1), _HIT))
    hits = cut_lineage(hits, "benchmark-hits")
    windows = hits.select("doc_id", "digest", "lo", F.explode(F.arrays_zip("starts", "keys")).alias("w"))
    met = windows.select("doc_id", "digest", "lo", "w.starts", F.col("w.keys").alias("key")).join(index.where("candidate"), "key")
    tries = met.select("doc_id", "digest", "lo", "item", (F.col("starts") - F.col("at")).alias("begin")).distinct()
    tries = tries.withColumnsRenamed({"doc_id": "t_id", "digest": "t_digest", "lo": "t_lo"})
    own = (
        F.col("doc_id").eqNullSafe(F.col("t_id"))
        & (F.col("digest") == F.col("t_digest"))
        & (F.col("lo") == F.col("t_lo"))
    )
    joined = hits.select("doc_id", "digest", "lo", F.col("words").alias("near")).join(tries, own).join(items, "item")
    # Edits may shift where the item begins and ends by as many words as they are.
    slack = F.floor(F.size("words") * F.lit(max_edits)).cast("int")
    begin = F.greatest(F.col("begin") - F.col("lo") - slack, F.lit(0))
    stretch = F.slice("near", begin + 1, F.size("words") + 2 * slack)
    checked = joined.select("doc_id", "digest", "item_id", slack.alias("slack"), edits("words", stretch, slack).alias("n_edits"))
    right = checked.where(F.col("n_edits") <= F.col("slack"))
    return right.groupBy("doc_id", "digest", "item_id").agg(F.min("n_edits").alias("n_edits"))


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) and least_edits of every document."""
    leaks = cut_lineage(find_leaks(docs, benchmark, **options), "benchmark-leaks")
    per_doc = leaks.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("n_edits").alias("least_edits")
    )
    per_doc = per_doc.withColumnsRenamed({"doc_id": "l_id", "digest": "l_digest"})
    picked = frames.pick(docs, doc_id="long", text="string").select("doc_id", _digest().alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("digest").eqNullSafe(F.col("l_digest"))
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return picked.join(per_doc, same, "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        "least_edits",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any item, with all their columns."""
    leaks = cut_lineage(find_leaks(docs, benchmark, **options), "benchmark-leaks")
    bad = leaks.select(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest")).distinct()
    rows = frames.with_row(docs, doc_id="long", text="string").withColumn("digest", _digest()).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("digest").eqNullSafe(F.col("l_digest"))
    return frames.rows_of(rows.join(bad, same, "left_anti"), docs.columns)
