"""Language identification by unigram models summed over all segmentations.

The vocabulary is a fixed public list of byte pieces. A language's model is one probability per piece; a
word's probability is the sum, over every way to cut it into pieces, of the product of their
probabilities, which a forward pass computes. A text's score for a language is the sum of its words' log
probabilities, and the prediction the best language, with its posterior under equal priors as score.

Models are learned by expectation maximisation on word counts per language: a forward and a backward pass
give each piece's expected count over all segmentations. Counting and passes run as Spark jobs; what comes
to the driver is one number per piece and language. Learning reads at most about ``MAX_ROWS`` rows per
language, drawn by a digest of the identifier; prediction reads every row and whole texts. Inside a task
the distinct words of a slice are scored once, all words of a length together.

Words are runs of letters and non-ASCII characters, lower-cased; bytes of any text are pieces, so nothing
is unknown. Pieces of any length count. Words over ``BLOCK`` bytes are swept a block at a time: the sums of the last places
are carried on, divided by the newest one, whose logarithm is kept, so a word of any length is summed over all its
segmentations without a table of its length and without underflow.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if there
is nothing to learn from; ties go to the first language by name; rows with a null language are predicted
but not learned from; repeated rows are predicted alike; no documents give no rows; further columns are
handed through.
"""

from __future__ import annotations

import base64
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.llm import frames
from fieldflow.llm.quality import slices, words_of
from fieldflow.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_ROWS = 2_000
ROUNDS = 3
BLOCK = 32  # bytes
FLOOR = 1e-8  # of a piece's probability: 32 of them still fit a double
SHARED = 0.02  # weight of the mean over languages in each model
CHUNK = 8_192  # words of one length that are worked on together
LONG_CHUNK, LONG_BYTES = 1_024, 1 << 20  # words over a block, and the bytes of all of them
UNKNOWN = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)
for _b in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b


def _in_words(piece: bytes) -> bool:
    """Whether a word can hold the piece: letters and non-ASCII bytes, after a blank or not."""
    return all(_LETTERS[b] != 32 for b in piece[piece[:1] == b" " :])


class Pieces:
    """The vocabulary, and the pieces that start anywhere in words of one length."""

    def __init__(self, pieces: list[bytes]):
        singles = {bytes([b]) for b in range(256)}
        kept = sorted(singles | {p for p in pieces if p})
        self.size = len(kept)
        self.longest = max(len(p) for p in kept if len(p) == 1 or _in_words(p))
        # Sums of neighbouring places differ by up to FLOOR ** longest.
        self.real = np.float64 if self.longest <= 36 else np.longdouble
        self.by_length = []
        for k in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(kept) if len(p) == k], dtype=np.int64)
            own = np.frombuffer(b"".join(kept[i] for i in ids), np.uint8).reshape(len(ids), k)
            hashes = _rolled(own, k)[k - 1][:, 0] if len(ids) else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            self.by_length.append((hashes[order], ids[order]))

    def at(self, words: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: the piece words[:, i : i + k] at every i, or ``size`` if it is none."""
        n, length = words.shape
        out = []
        for k, hashes in enumerate(_rolled(words, min(length, self.longest)), 1):
            known, ids = self.by_length[k - 1]
            if not len(known):
                out.append(np.full(hashes.shape, self.size))
                continue
            spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            out.append(np.where(known[spot] == hashes, ids[spot], self.size))
        return out


def _rolled(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """64-bit hashes of all stretches of 1, 2, ... bytes."""
    byte = words.astype(np.uint64) + np.uint64(1)
    out = [byte * np.uint64(0x9E3779B97F4A7C15)]
    with np.errstate(over="ignore"):
        for k in range(2, longest + 1):
            mixed = (out[-1][:, :-1] ^ byte[:, k - 1 :]) * np.uint64(0xFF51AFD7ED558CCD)
            out.append(mixed ^ (mixed >> np.uint64(31)))
    return out


def read_pieces(path: str) -> Pieces:
    """A vocabulary file of lines "base64 rank"; read by the driver and sent to tasks, some megabytes."""
    with open(path, "rb") as lines:
        return Pieces([base64.b64decode(x.split()[0]) for x in lines if x.strip()])


def forward(at: list[np.ndarray], p: np.ndarray, length: int) -> np.ndarray:
    """alpha[n, i, language]: the summed probability of all segmentations of the first i bytes."""
    n = len(at[0])
    alpha = np.zeros((n, length + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    for j in range(1, length + 1):
        for k in range(1, min(j, len(at)) + 1):
            alpha[:, j] += alpha[:, j - k] * p[at[k - 1][:, j - k]]
    return alpha


def expected_counts(at: list[np.ndarray], p: np.ndarray, length: int, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations; ``p`` has one column, the last row is no piece."""
    n = len(at[0])
    alpha = forward(at, p, length)[:, :, 0]
    beta = np.zeros((n, length + 1))
    beta[:, length] = 1.0
    for j in range(length - 1, -1, -1):
        for k in range(1, min(length - j, len(at)) + 1):
            beta[:, j] += p[at[k - 1][:, j], 0] * beta[:, j + k]
    scale = weight / alpha[:, length]
    total = np.zeros(len(p))
    for k, ids in enumerate(at, 1):
        uses = alpha[:, : length + 1 - k] * p[ids, 0] * beta[:, k:] * scale[:, None]
        total += np.bincount(ids.ravel(), uses.ravel(), len(p))
    return total


def log_forward(pieces: Pieces, p: np.ndarray, words: np.ndarray, every: bool = False) -> np.ndarray:
    """Log of the summed probability of all segmentations of words [n, length], a column a language.

    With ``every`` the logs at all places, [n, length + 1, language].
    """
    (n, length), reach = words.shape, pieces.longest
    sums = np.zeros((n, reach + BLOCK, p.shape[1]), dtype=pieces.real)
    sums[:, reach - 1] = 1.0  # the place before the block; the ones before it stand to its left
    scale = np.zeros((n, p.shape[1]))
    logs = [scale[:, None]]
    for a in range(0, length, BLOCK):
        b, lo = min(a + BLOCK, length), max(0, a - reach + 1)
        ends = np.full((n, b - lo + 1, reach), pieces.size)  # by place, the piece of each length that ends there
        for k, ids in enumerate(pieces.at(words[:, lo:b]), 1):
            ends[:, k:, k - 1] = ids
        for j in range(1, b - a + 1):
            before = sums[:, j - 1 : reach - 1 + j][:, ::-1]
            sums[:, reach - 1 + j] = (before * p[ends[:, a - lo + j]]).sum(axis=1)
        if every:
            logs.append(np.log(sums[:, reach : reach + b - a]).astype(float) + scale[:, None])
        newest = sums[:, reach - 1 + b - a].copy()
        scale = scale + np.log(newest).astype(float)
        sums[:, :reach] = sums[:, b - a : b - a + reach] / newest[:, None]
    return np.concatenate(logs, axis=1) if every else scale


def log_backward(pieces: Pieces, p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations from each place on, [n, length + 1]; ``p`` is one language's."""
    (n, length), reach = words.shape, pieces.longest
    known = np.zeros((n, reach), dtype=pieces.real)
    known[:, 0] = 1.0  # from the block's end on
    scale = np.zeros(n)
    logs = np.zeros((n, length + 1))
    for b in range(length, 0, -BLOCK):
        a = max(0, b - BLOCK)
        starts = np.full((n, b - a, reach), pieces.size)
        for k, ids in enumerate(pieces.at(words[:, a : min(length, b + reach - 1)]), 1):
            own = ids[:, : b - a]
            starts[:, : own.shape[1], k - 1] = own
        sums = np.concatenate([np.zeros((n, b - a), dtype=pieces.real), known], axis=1)
        for j in range(b - a - 1, -1, -1):
            sums[:, j] = (sums[:, j + 1 : j + 1 + reach] * p[starts[:, j]]).sum(axis=1)
        logs[:, a:b] = np.log(sums[:, : b - a]).astype(float) + scale[:, None]
        scale = scale + np.log(sums[:, 0]).astype(float)
        known = sums[:, :reach] / sums[:, :1]
    return logs


def long_counts(pieces: Pieces, p: np.ndarray, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What ``expected_counts`` gives, for words over a block; ``p`` is one language's."""
    length = words.shape[1]
    ahead, behind = log_forward(pieces, p[:, None], words, every=True)[:, :, 0], log_backward(pieces, p, words)
    whole = ahead[:, -1:]
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    total = np.zeros(len(p))
    for a in range(0, length, 16 * BLOCK):
        b = min(a + 16 * BLOCK, length)
        for k, ids in enumerate(pieces.at(words[:, a : min(length, b + pieces.longest - 1)]), 1):
            own = ids[:, : b - a]
            m = own.shape[1]
            uses = np.exp(ahead[:, a : a + m] + behind[:, a + k : a + k + m] - whole + log_p[own]) * weight[:, None]
            total += np.bincount(own.ravel(), uses.ravel(), len(p))
    return total


def by_length(words: list[bytes]):
    """(index, matrix of bytes) for all words of each length, a bounded number at a time."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for same in np.split(order, cuts):
        size = int(length[same[0]]) if len(same) else 0
        step = CHUNK if size <= BLOCK else max(1, min(LONG_CHUNK, LONG_BYTES // size))
        for at in range(0, len(same) if size else 0, step):
            part = same[at : at + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), size)


def text_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and non-ASCII characters, and the row of each."""
    text = pa.concat_arrays([pc.utf8_lower(text)])
    size = np.frombuffer(text.buffers()[1], np.int32)[len(text)] if len(text) else 0
    if not size:
        return words_of(text)
    data = _LETTERS[np.frombuffer(text.buffers()[2], np.uint8)[:size]]
    return words_of(pa.StringArray.from_buffers(len(text), text.buffers()[1], pa.py_buffer(data.tobytes())))


def started(word: str) -> bytes:
    """A word with the blank that starts it."""
    return b" " + word.encode()


def _count_words(batches):
    """(lang, word, n), summed per slice."""
    for batch in batches:
        text = pc.fill_null(batch.column(1).cast(pa.string()), "")
        langs = batch.column(0).dictionary_encode()
        lang_of = langs.indices.to_numpy()
        for a, b in slices(text):
            words, row = text_words(text.slice(a, b - a))
            if not len(words):
                continue
            words = words.dictionary_encode()
            pair = lang_of[row + a].astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
            pair, n = np.unique(pair, return_counts=True)
            which = [pa.array(x) for x in np.divmod(pair, len(words.dictionary))]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(which[0]), words.dictionary.take(which[1]), pa.array(n, pa.int64())], ["lang", "word", "n"]
            )


def _expect(model, languages: list[str]):
    """Word counts to (language, piece, expected uses), one sum per task."""

    def run(batches):
        pieces, p = model.value
        total = np.zeros((len(languages), pieces.size + 1))
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            counts = batch.column(2).to_numpy()
            words = batch.column(1).to_pylist()
            for own in np.unique(lang):
                here = np.flatnonzero(lang == own)
                weight = counts[here].astype(np.float64)
                for index, matrix in by_length([started(words[i]) for i in here]):
                    if matrix.shape[1] > BLOCK:
                        total[own] += long_counts(pieces, p[:, own], matrix, weight[index])
                    else:
                        total[own] += expected_counts(pieces.at(matrix), p[:, own : own + 1], matrix.shape[1], weight[index])
        own, piece = np.nonzero(total[:, :-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[own, piece])], ["l", "piece", "n"]
        )

    return run


def learn(docs: DataFrame, pieces: Pieces, max_rows: int = MAX_ROWS, rounds: int = ROUNDS):
    """(languages, probabilities [piece, language]) from (doc_id, lang, text); the last row, no piece, is 0.

    Of a language with more rows than ``max_rows`` a part is drawn by digest, so about that many are read.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((pieces.size + 1, 0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    counted = known.where(draw).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    words = cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    p = np.full((pieces.size + 1, len(languages)), 1.0 / pieces.size)
    p[-1] = 0
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, p))  # pieces x languages numbers
        sums = words.mapInArrow(_expect(model, languages), "l int, piece int, n double").groupBy("l", "piece").agg(F.sum("n").alias("n"))
        got = sums.toArrow()  # at most pieces x languages rows
        counts = np.zeros_like(p)
        counts[got["piece"].to_numpy(), got["l"].to_numpy()] = got["n"].to_numpy()
        p = counts / np.maximum(counts.sum(axis=0), 1e-300)
        p = (1 - SHARED) * p + SHARED * p.mean(axis=1, keepdims=True)
        p[:-1] = np.maximum(p[:-1], FLOOR)
    return languages, p


def word_scores(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of every word under every language."""
    out = np.zeros((len(words), p.shape[1]))
    for index, matrix in by_length([started(w) for w in words]):
        long = matrix.shape[1] > BLOCK
        out[index] = log_forward(pieces, p, matrix) if long else np.log(forward(pieces.at(matrix), p, matrix.shape[1])[:, -1])
    return out


def _predict(pieces: Pieces, p: np.ndarray, text: pa.Array) -> np.ndarray:
    """Log probability of every text under every language."""
    words, row = text_words(text)
    total = np.zeros((len(text), p.shape[1]))
    if len(words):
        words = words.dictionary_encode()
        scores = word_scores(pieces, p, words.dictionary.to_pylist())[words.indices.to_numpy()]
        for k in range(p.shape[1]):
            total[:, k] = np.bincount(row, scores[:, k], len(text))
    return total


def predictor(spark: SparkSession, languages: list[str], p: np.ndarray, pieces: Pieces):
    """An Arrow function from text to struct(lang_pred, score)."""
    model = spark.sparkContext.broadcast((pieces, p))

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def apply(text: pa.Array) -> pa.Array:
        pieces, p = model.value
        text = pc.fill_null(text.cast(pa.string()), "")
        lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
        parts = [_predict(pieces, p, text.slice(a, b - a)) for a, b in slices(text)] if languages else []
        if not parts:
            lang, score = [UNKNOWN] * len(text), np.zeros(len(text))
        else:
            total = np.concatenate(parts)
            best = total.argmax(axis=1)
            # rounded, as sums over tasks come in any order
            score = (1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)).round(6)
            lang = [languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
            score = np.where(lettered, score, 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return apply


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: a quarter of all, by checksum of the identifier."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents not held out."""
    picked = frames.pick(docs, doc_id="long", lang="string", text="string").withColumn("held_out", held_out(F.col("doc_id")))
    pieces = read_pieces(vocabulary)
    languages, p = learn(picked.where(~F.col("held_out")), pieces, **options)
    apply = predictor(docs.sparkSession, languages, p, pieces)
    return picked.withColumn("out", apply("text")).select("doc_id", "held_out", "out.lang_pred", "out.score")


def identify(docs: DataFrame, languages: list[str], p: np.ndarray, pieces: Pieces) -> DataFrame:
    """All columns, and ``lang_pred`` and ``lang_score`` under given models (underscores are added while taken)."""
    apply = predictor(docs.sparkSession, languages, p, pieces)
    rows = frames.with_row(docs, text="string").withColumn("out", apply("text"))
    names = list(docs.columns)
    for name in ("lang_pred", "lang_score"):
        while name.lower() in {c.lower() for c in names}:
            name += "_"
        names.append(name)
    own = [F.col(f"row.c{i}") for i in range(len(docs.columns))]
    return rows.select(*own, "out.lang_pred", "out.score").toDF(*names)
