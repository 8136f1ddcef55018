"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Documents are
linked when their fingerprints differ in at most ``MAX_BITS`` bits; a component is what links reach.

Search over the distinct fingerprints: bits are put into partitions, correlated bits together, and each
partition i gets a threshold t_i with ``sum(t_i) = MAX_BITS - partitions + 1``, where -1 leaves it out. Two
fingerprints within ``MAX_BITS`` then agree within t_i in some partition. For each number of partitions a
dynamic programme picks the thresholds with the least estimated work: probe rows, plus candidate pairs
from how often values of the partition meet; the cheapest of all is taken, so more documents lead to fewer,
wider partitions. All statistics are sums over all distinct fingerprints. A threshold t is probed by masks
that leave out every choice of t of the partition's bits, so a probe is an equi-join on (mask, value).

Probes that meet in a small bucket are compared pair by pair. A bucket with more than ``PAIR_BUCKET``
fingerprints (a large group of near copies) never is: its members list every point within one bit of
themselves, and all that share a point are linked to the least of them. Two fingerprints are within two
bits exactly when they share such a point, so no link is lost, none is made up, and rows stay linear.
Those links reach the same components as all pairs would.

Defined results: fewer words than a shingle make one shingle of all words; null, empty and blank texts have
fingerprint zero and are linked like others; component_id is the smallest doc_id reached, null only if all
are null; repeated rows share everything; no documents give no rows; further columns are handed through.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.llm import frames
from fieldflow.llm.components import roots
from fieldflow.llm.quality import slices, words_of
from fieldflow.session import cut_lineage

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PAIR_BUCKET = 16
PARTITIONS = (2, 3, 4)
PROBE_COST, PAIR_COST = 1.0, 0.5  # of a probe row and a candidate pair


def _fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts."""
    n = len(text)
    out = np.zeros(n, dtype=np.uint64)
    words, row = words_of(pc.ascii_lower(text))
    count = np.bincount(row, minlength=n)
    if not len(words):
        return out.view(np.int64)
    # All words of all texts, one blank between two: a shingle is a stretch of these bytes.
    length = pc.binary_length(words).to_numpy().astype(np.int64)
    end = np.cumsum(length + 1) - 1
    start = end - length
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode()
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n_shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(n), n_shingles)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[owner]
    last = np.minimum(place + shingle - 1, first[owner] + count[owner] - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(start[place].tolist(), end[last].tolist())), np.uint64, len(owner)
    )
    full = np.flatnonzero(n_shingles)
    begin = (np.cumsum(n_shingles) - n_shingles)[full]
    step = 1 << 18
    ones = np.zeros((len(full), 64), dtype=np.int64)
    for at in range(0, len(hashes), step):  # bits of a bounded number of shingles at a time
        part = hashes[at : at + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = np.searchsorted(begin, at, "right") - 1
        until = np.searchsorted(begin, at + len(part), "left")
        cuts = np.maximum(begin[here:until] - at, 0)
        ones[here:until] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_ = 2 * ones > n_shingles[full][:, None]
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprint(shingle: int = SHINGLE):
    """An Arrow function from text to its signed 64-bit fingerprint."""

    @F.arrow_udf(T.LongType())
    def apply(text: pa.Array) -> pa.Array:
        text = pc.fill_null(text.cast(pa.string()), "")
        parts = [_fingerprints(pa.concat_arrays([text.slice(a, b - a)]), shingle) for a, b in slices(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return apply


def _bit_sums(batches):
    """Per task: how often bits i and j are set together (i = j: how often bit i is set)."""
    total = np.zeros((64, 64))
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float64)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"]
    )


def group_bits(together: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits in ``partitions`` groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(64)), []
    for g in range(partitions):
        size = (64 - sum(map(len, groups))) // (partitions - g)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost; ``cost[i][t + 1]`` is that of threshold t >= -1 at i."""
    best = {0: (0.0, [])}
    for row in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                new = (c + row[t + 1], [*chosen, t])
                if used + t not in now or new < now[used + t]:
                    now[used + t] = new
        best = now
    return best[total]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _long(value: int) -> F.Column:
    return F.lit(value).cast("long")


def probe_masks(fps: DataFrame, max_bits: int = MAX_BITS, partitions=PARTITIONS) -> list[int]:
    """The masks to probe: partitions from bit correlations, thresholds by dynamic programming."""
    sums = fps.mapInArrow(_bit_sums, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((64, 64))
    for r in sums:  # 64 x 64 sums, however many documents there are
        together[r.i, r.j] = r.n
    n = fps.count()
    if n < 2:
        return []
    p = np.diag(together) / n
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)  # odds that two fingerprints differ in a bit
    plans = {m: group_bits(together, n, m) for m in partitions}
    groups = [(m, g) for m, gs in plans.items() for g in gs]
    # Each partition's values over all fingerprints: pairs that agree in it.
    masks = F.array(*[F.struct(F.lit(k).alias("k"), _long(_mask(g)).alias("mask")) for k, (_, g) in enumerate(groups)])
    values = fps.select("fp", F.explode(masks).alias("m")).groupBy("m.k", F.col("fp").bitwiseAND(F.col("m.mask")).alias("v"))
    counted = values.agg(F.count("*").cast("double").alias("c")).groupBy("k")
    pairs = {r.k: r.s for r in counted.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s")).collect()}

    def costs(k: int, bits: list[int], top: int) -> list[float]:
        row, work, odds = [0.0], 0.0, differ[bits] / (1 - differ[bits])
        agree = max(pairs.get(k, 0.0), 1e-9)
        for t in range(top + 1):
            # a mask without t bits admits pairs that differ in any of them
            work = PROBE_COST * n * comb(len(bits), t) + PAIR_COST * comb(len(bits), t) * agree * (1 + odds.mean()) ** t
            row.append(work)
        return row

    plan = None
    for m in partitions:
        at = [k for k, (x, _) in enumerate(groups) if x == m]
        total = max_bits - m + 1
        found = allocate([costs(k, groups[k][1], max_bits) for k in at], total)
        if plan is None or found[0] < plan[0]:
            plan = (found[0], [(groups[k][1], t) for k, t in zip(at, found[1])])
    return [_mask(set(bits) - set(out)) for bits, t in plan[1] if t >= 0 for out in combinations(bits, t)]


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that reach what all links would reach."""
    if max_bits != 2:
        raise ValueError("large buckets are linked through points within one bit, which fits two differing bits")
    masks = probe_masks(fps, max_bits)
    if not masks:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    mask_table = F.array(*[_long(m) for m in masks])
    probes = fps.select("fp", F.explode(mask_table).alias("mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = probes.groupBy("mask", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(probes.join(sizes, ["mask", "v"]), "simhash-met")
    small = met.where(F.col("n") <= pair_bucket).groupBy("mask", "v").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    rest = lambda x, i: F.transform(F.slice(F.col("f"), i + 2, pair_bucket), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("f", rest))).alias("p")).select("p.a", "p.b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return pairs.union(_ball_links(met.where(F.col("n") > pair_bucket)))


def _ball_links(met: DataFrame) -> DataFrame:
    """Links of crowded buckets: members that share a point within one bit, to the least of them.

    At most 65 fingerprints lie within one bit of a point, so a group here has at most 65 rows.
    """
    flips = F.array(_long(0), *[_long(_mask([b])) for b in range(64)])
    free = F.filter(flips, lambda b: b.bitwiseAND(F.col("mask")) == 0)  # members of a bucket agree in its mask
    points = met.select("mask", "fp", F.explode(free).alias("bit"))
    points = points.select("mask", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    shared = points.groupBy("mask", "point").agg(F.collect_list("fp").alias("f")).where(F.size("f") > 1)
    return shared.select(F.explode("f").alias("a"), F.array_min("f").alias("b")).where("a <> b").distinct()


def near_components(printed: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in ``printed`` (doc_id, fp)."""
    fps = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = roots(near_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    picked = frames.pick(docs, doc_id="long", text="string")
    printed = cut_lineage(picked.select("doc_id", fingerprint(shingle)("text").alias("fp")), "simhash-prints")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return printed.join(near_components(printed), "fp").select("doc_id", digits, "component_id")


def _row_key() -> F.Column:
    """Equal for rows with the same identifier and text, never null."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.xxhash64("text").cast("string"), F.lit("-"))
    return F.concat_ws(":", *parts)


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, of its smallest doc_id, with all its columns.

    What goes back to the documents is the key (identifier and text digest) each component keeps; rows
    that repeat a key are told apart by number, in the same shuffle as the join.
    """
    picked = frames.pick(docs, doc_id="long", text="string")
    printed = picked.select("doc_id", _row_key().alias("key"), fingerprint(shingle)("text").alias("fp"))
    printed = cut_lineage(printed, "simhash-prints")
    candidate = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = printed.join(near_components(printed).select("fp", "root"), "fp").groupBy("root").agg(F.min(candidate).alias("c"))
    kept = cut_lineage(kept.select("c.key"), "simhash-kept")
    rows = frames.with_row(docs, doc_id="long", text="string").select("row", _row_key().alias("key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return frames.rows_of(rows.join(kept, "key").withColumn("place", place).where("place = 1"), docs.columns)
