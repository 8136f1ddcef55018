"""Documents whose word n-grams have a Jaccard similarity of ``MIN_PERCENT`` or more, by parity sketches.

A parity sketch is a bit vector; each shingle flips the bit that its hash names. Sketches of two sets differ at most
where the sets do, so their Hamming distance is a lower bound of the symmetric difference; and sets of a and b
shingles that are similar enough differ in at most ``(a + b) * (100 - p) / (100 + p)`` shingles.

Search. A set's wide sketch is cut into parts, as many for all sets of a size band (a power of two). Sets of d
differing shingles differ in at most d parts, so of any d + 1 parts with a bit set in the smaller set one is the
same in both: the pigeonhole join is an equi-join on (band, part, bits), where bits stand as the exclusive or of
their shingles' hashes. A set just above a band joins it too. A set looks itself up by those d + 1 of its parts
that fewest others share, so a passage that many documents hold is not what brings them together. The number of parts
per band is raised until every set of the band has more than d parts with a bit set; single shingles are the limit.

Verification. What small buckets bring together is compared by narrow sketches (their Hamming distance), then by exact sets. A
crowded bucket is never paired. Its most central member becomes a pivot, and each member is known from then on by
its difference to the pivot. Members linked to a pivot share its component. For the rest, the same pigeonhole holds on
differences: two sets whose differences to the pivot add up to no more than they may differ are both
linked to it; others share shingles of their differences. The one with the smaller difference lacks at most half of what
the two may differ in, so it finds the other by one more than that of its rarest; a linked member finds those not linked by
the rarest ``(|x| + (size(x) - size(pivot)) * q) / 2``, rounded up (q as above). Such buckets are paired if they are small and
get a pivot of their own if not. So rows stay linear in a large group of near copies, and no link between
components is lost. After ``ROUNDS`` rounds whatever is left is paired in full.

Texts are hashed anew where sets are needed instead of shuffling or storing them: once to describe sets, once for
parts, and once for the sets that some candidate names, told by a bit map of bounded size.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a
shingle make one of all words; component_id is the smallest doc_id reached, itself included, null only if all are; repeated rows are in one
component; no documents give no rows; further columns are ignored.
"""

from __future__ import annotations

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

SHINGLE = 5
MIN_PERCENT = 80
SEED = 13
#: parts of a band's sketch, as a multiple of its largest size; 0 stands for single shingles
PART_RATES = (0.3, 0.6, 0.0)
PAIRED = 3  # members of a bucket that is paired at once
PAIRED_LATER = 16  # look-ups of a bucket of differences that is paired
ROUNDS = 6
NARROW = 256  # bits of the narrowest sketch
MAP_BITS = 27  # the bit map of wanted sets has at most so many places (16 MB)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of each text's distinct shingles, both ascending."""
    words, row = words_of(pc.ascii_lower(text))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64)
    hashes = table[coded.indices.to_numpy()]
    count = np.bincount(row, minlength=len(text))
    first = np.cumsum(count) - count
    n_shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(text)), n_shingles)
    place = np.arange(len(owner)) - (np.cumsum(n_shingles) - n_shingles)[owner] + first[owner]
    size = np.minimum(count, shingle)[owner]
    mixed = _mix(size.astype(np.uint64), SEED)
    for k in range(shingle):
        inside = k < size
        word = hashes[np.minimum(place + k, len(hashes) - 1)]
        mixed = np.where(inside, _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + word, k + 1), mixed)
    ends = np.cumsum(n_shingles)
    for a, b in zip((ends - n_shingles).tolist(), ends.tolist()):
        mixed[a:b].sort()
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (mixed[1:] != mixed[:-1])) if len(owner) else np.zeros(0, bool)
    return owner[fresh], mixed[fresh]


def _starts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def set_digests(owner: np.ndarray, mixed: np.ndarray, n: int) -> np.ndarray:
    """A signed 64-bit digest of each set, from sums of two mixes of its members; 0 for empty sets."""
    bounds = _starts(owner, n)
    size = np.diff(bounds).astype(np.uint64)
    total = lambda salt: np.diff(np.append(np.uint64(0), np.cumsum(_mix(mixed, salt)))[bounds])
    digest = _mix(total(71) * np.uint64(0x9E3779B97F4A7C15) ^ total(72) ^ size, 73)
    return np.where(size > 0, digest, np.uint64(0)).view(np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """The band b of sizes from 2^b to 2^(b+1) - 1."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1


def most_apart(a, b, percent: int):
    """How many shingles sets of a and b shingles may differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


def largest_partner(size, percent: int):
    return size * 100 // percent


def parts_in_band(owner: np.ndarray, mixed: np.ndarray, band: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 64-bit key of every part with a bit set, for sketches of each owner's ``band``.

    ``rates`` has the parts of each band as a multiple of its largest size.
    """
    own_band = band[owner]
    n_parts = np.ceil(rates[own_band] * np.exp2(own_band + 1)).astype(np.uint64)
    # Hashes ascend in each set, and so do the parts that their upper halves name.
    part = np.where(n_parts == 0, mixed, (mixed >> np.uint64(32)) * n_parts >> np.uint64(32))
    bits = _mix(mixed, 9)
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))) if len(owner) else np.zeros(0, int)
    if not len(first):
        return owner, part
    flips = np.bitwise_xor.reduceat(bits, first)
    key = _mix(flips ^ _mix(part[first], 17) ^ (own_band[first].astype(np.uint64) << np.uint64(57)), 19)
    return owner[first], key


def _described(shingle: int, percent: int):
    def describe(batches):
        """(doc_id, class, size) and, for each rate, how many more parts the set has than may differ."""
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in slices(text):
                owner, mixed = shingle_sets(pa.concat_arrays([text.slice(a, b - a)]), shingle)
                n = b - a
                size = np.bincount(owner, minlength=n)
                need = most_apart(size, largest_partner(size, percent), percent) + 1
                band = band_of(size)
                spare = []
                for rate in PART_RATES[:-1]:
                    who, _ = parts_in_band(owner, mixed, band, np.full(64, rate))
                    spare.append(np.bincount(who, minlength=n) - need)
                spare.append(size - need)
                columns = [batch.column(0).slice(a, n), pa.array(set_digests(owner, mixed, n)), pa.array(size), pa.array(band, pa.int64())]
                spares = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(spare, 1).ravel()), len(PART_RATES)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, spares], ["doc_id", "class", "size", "band", "spare"])

    return describe


def _part_keys(shingle: int, percent: int, rates: np.ndarray):
    def keys(batches):
        """(key, class, own): the parts of each distinct set of a task, in its own band and the one it may reach down to."""
        seen: set[int] = set()
        for batch in batches:
            text = pc.fill_null(batch.column(0).cast(pa.string()), "")
            for a, b in slices(text):
                owner, mixed = shingle_sets(pa.concat_arrays([text.slice(a, b - a)]), shingle)
                digest = set_digests(owner, mixed, b - a)
                size = np.bincount(owner, minlength=b - a)
                # sets that may differ from no other are found by their class alone
                new = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], dtype=bool)
                new &= most_apart(size, largest_partner(size, percent), percent) > 0
                mine = new[owner]
                owner, mixed = owner[mine], mixed[mine]
                band = band_of(size)
                down = new & (size * percent <= 100 * (2**band - 1))
                low = down[owner]
                for own, who, what, at in ((True, owner, mixed, band), (False, owner[low], mixed[low], band - 1)):
                    who, key = parts_in_band(who, what, at, rates)
                    if len(who):
                        columns = [pa.array(key.view(np.int64)), pa.array(digest[who]), pa.array(np.full(len(who), own))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "class", "own"])

    return keys


def narrow_sketch(mixed: np.ndarray) -> np.ndarray:
    """A dense parity sketch with about a bit per shingle, at least ``NARROW``, as signed 64-bit words."""
    width = max(NARROW, 1 << int(len(mixed)).bit_length())
    bits = np.bincount((_mix(mixed, 23) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches; the wider one is folded, which keeps it a parity sketch."""
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _wanted_sets(shingle: int, wanted: np.ndarray, bits: int):
    def sets(batches):
        """(class, tokens, sketch) of every set on the map, once per task."""
        seen: set[int] = set()
        for batch in batches:
            text = pc.fill_null(batch.column(0).cast(pa.string()), "")
            for a, b in slices(text):
                owner, mixed = shingle_sets(pa.concat_arrays([text.slice(a, b - a)]), shingle)
                digest = set_digests(owner, mixed, b - a)
                place = (digest & ((1 << bits) - 1)).astype(np.int64)
                named = np.flatnonzero(wanted[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                bounds = _starts(owner, b - a)
                new = [i for i in named.tolist() if bounds[i] < bounds[i + 1]]
                new = [i for i in new if int(digest[i]) not in seen and not seen.add(int(digest[i]))]
                own = [mixed[bounds[i] : bounds[i + 1]] for i in new]
                if new:
                    columns = [pa.array(digest[new]), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))]
                    columns.append(pa.array([narrow_sketch(x) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["class", "tokens", "sketch"])

    return sets


@F.arrow_udf(T.LongType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([hamming(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(a, b)], pa.int64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """The tokens that only one of two sets has."""
    return pa.array([np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), True) for x, y in zip(a, b)], pa.list_(pa.int64()))


def _rates(described: DataFrame) -> np.ndarray:
    """For each band the first of ``PART_RATES`` at which no set lacks parts."""
    least = F.array(*[F.min(F.col("spare")[i]) for i in range(len(PART_RATES))])
    rates = np.zeros(64)
    for r in described.where("size > 0").groupBy("band").agg(least.alias("least")).collect():  # at most 64 bands
        rates[r.band] = next((rate for rate, spare in zip(PART_RATES, r.least) if spare >= 0), 0.0)
    return rates


def _bit_map(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """A map of the classes in ``wanted``: 64 places per class, 2^MAP_BITS at most.

    Beyond that bound it lets more sets through, and the join that follows drops them.
    """
    n = wanted.count()
    bits = int(min(MAP_BITS, max(15, (64 * max(1, n)).bit_length())))
    place = F.col("class").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = wanted.select(F.shiftright(place, 15).alias("at"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    pieces = pieces.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("map"))
    found = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for batch in pieces.toArrow().to_batches():
        for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[at * 4096 : (at + 1) * 4096] = np.frombuffer(part, np.uint8)
    return found, bits


def _allowed(a: str, b: str, percent: int) -> F.Column:
    return F.floor(((F.col(a) + F.col(b)) * (100 - percent) + 0.5) / (100 + percent)).cast("long")


def _buckets(members: DataFrame, by: list[str], pivot: F.Column) -> DataFrame:
    """Members with their bucket's numbers: all, those that look others up, and who would be its pivot."""
    counted = members.groupBy(*by).agg(
        F.count("*").alias("n_all"),
        F.sum(F.col("looks").cast("long")).alias("n_looks"),
        F.sum(F.col("found").cast("long")).alias("n_found"),
        F.sum((F.col("looks") & F.col("main")).cast("long")).alias("n_main_looks"),
        F.sum((F.col("found") & F.col("main")).cast("long")).alias("n_main_found"),
        (F.min("comp") < F.max("comp")).alias("several"),
        pivot.alias("next_pivot"),
    )
    # Look-ups and what they find make pairs if either one is a main member.
    n_pairs = F.col("n_main_looks") * F.col("n_found") + F.col("n_looks") * F.col("n_main_found")
    return members.join(counted.withColumn("n_pairs", n_pairs).where("several and n_pairs > 0"), by)


def _paired(small: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(kept key columns, a, b): every pair that a bucket brings together, once."""
    side = F.struct("class", "size", "main", "comp")
    left = small.where("looks").select(*by, side.alias("x"))
    right = small.where("found").select(*by, side.alias("y"))
    fit = F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent
    met = left.join(right, by).where(fit & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.main") | F.col("y.main")))
    group = [c for c in by if c == "gid"]
    first, second = F.struct("x.class", "x.size"), F.struct("y.class", "y.size")
    chosen = met.select(*group, F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).distinct()
    sides = [F.col(f"{c}.{f}").alias(n) for c, f, n in (("x", "class", "a"), ("x", "size", "a_size"), ("y", "class", "b"), ("y", "size", "b_size"))]
    return chosen.select(*group, *sides)


def _look_ups(met: DataFrame, by: str) -> DataFrame:
    """Which keys a set looks itself up by: as few of the rarest as it needs.

    ``met``: the key, class, size, own (a key it may look up), spare (how many own keys, shared or not, it can do without)
    and n_key (sets with that key, two at least).
    """
    per_class = Window.partitionBy("class")
    place = F.row_number().over(per_class.orderBy(F.col("own").desc(), "n_key", by))
    own = F.sum(F.col("own").cast("long")).over(per_class)
    # How much of a set is shared with how many others.
    central = F.sum(F.when(F.col("own"), F.log2("n_key")).otherwise(0.0)).over(per_class) / F.col("size")
    ranked = met.withColumn("place", place).withColumn("n_own", own).withColumn("central", central)
    looks = F.col("own") & (F.col("place") <= F.col("n_own") - F.col("spare"))
    return ranked.select(by, "class", "size", "central", looks.alias("looks"), F.lit(True).alias("found"), looks.alias("main"), F.col("class").alias("comp"))


def _checked_by_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are similar enough: first by sketches, then by sets."""
    for column, apart in (("sketch", _distance("x", "y")), ("tokens", F.size(_apart("x", "y")))):
        x = sets.select(F.col("class").alias("a"), F.col(column).alias("x"))
        y = sets.select(F.col("class").alias("b"), F.col(column).alias("y"))
        pairs = pairs.join(x, "a").join(y, "b").where(apart <= _allowed("a_size", "b_size", percent)).drop("x", "y")
        pairs = cut_lineage(pairs, f"jaccard-by-{column}")
    return pairs.select("a", "b")


def _round(state: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links among the members of each pivot's group, and the next state if crowded buckets are left.

    ``state``: gid, pivot, p_size, class, size, main, comp (its component so far), delta (the tokens that only one of member and pivot
    has) and linked (whether these are few enough).
    """
    links = state.where("linked").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    # A member that is no main one must be near a main one: their differences to the pivot are of about equal size.
    reach = state.groupBy("gid").agg(
        F.max(F.when(F.col("main"), F.size("delta"))).alias("reach"), (F.min("comp") < F.max("comp")).alias("several")
    ).where("several")  # what is one component already needs no more links
    most = F.floor(F.col("size") * (100 - percent) / percent).cast("long") + 1
    near = state.join(reach, "gid").where(F.col("main") | (F.size("delta") <= F.col("reach") + most))
    q = (100 - percent) / (100 + percent)
    v = F.ceil((F.size("delta") + (F.col("size") - F.col("p_size")) * q) / 2)
    half = F.floor(_allowed("size", "partner", percent) / 2).cast("long") + 1
    # A linked member may be the one with the larger difference of two, the other being smaller and not linked.
    found = ~F.col("linked") | (F.size("delta") >= F.floor((F.col("size") * percent / 100 + F.col("p_size")) * q))
    near = near.withColumn("partner", F.expr(f"size * 100 div {percent}")).withColumn("n_delta", F.size("delta"))
    tokens = near.select(
        "gid", "class", "size", "main", "comp", "linked", found.alias("found"), "n_delta",
        F.when(F.col("linked"), F.least(v, half)).otherwise(half).alias("prefix"), F.explode("delta").alias("token"),
    )
    tokens = cut_lineage(tokens, "jaccard-tokens")
    index = tokens.groupBy("gid", "token").agg(F.count("*").alias("n"), F.sum(F.col("found").cast("long")).alias("n_index"))
    index = index.where("n > 1 and n_index > 0")
    place = Window.partitionBy("gid", "class")
    useful = tokens.join(index, ["gid", "token"]).withColumn("others", F.col("n_index") - F.col("found").cast("long"))
    ranked = useful.withColumn("rank", F.row_number().over(place.orderBy(F.col("others") > 0, "others", "token")))
    ranked = ranked.withColumn("n_met", F.count("*").over(place))
    # Tokens by which no other member is found are the rarest of all, and nothing is found by them.
    look = F.col("rank") <= F.least("prefix", "n_delta") - (F.col("n_delta") - F.col("n_met"))
    ranked = ranked.withColumn("looks", look & (F.col("others") > 0))
    ranked = cut_lineage(ranked.where("looks or found").drop("rank", "n_met", "others", "prefix", "n", "n_index"), "jaccard-ranked")
    closest = F.min(F.when(~F.col("linked"), F.struct("n_delta", "class")))["class"]
    met = cut_lineage(_buckets(ranked, ["gid", "token"], closest), "jaccard-met")
    crowded = (F.col("n_pairs") > PAIRED_LATER * F.col("n_all")) & F.lit(not last)
    pairs = _paired(met.where(~crowded), ["gid", "token"], percent)
    deltas = state.select("gid", "class", "delta")
    x, y = deltas.toDF("gid", "a", "x"), deltas.toDF("gid", "b", "y")
    right = F.size(_apart("x", "y")) <= _allowed("a_size", "b_size", percent)
    links = links.union(pairs.join(x, ["gid", "a"]).join(y, ["gid", "b"]).where(right).select("a", "b"))
    links = cut_lineage(links, "jaccard-links")
    if last:
        return links, None
    # Each crowded bucket's members move on to its closest unlinked member.
    moved = met.where(crowded).groupBy("gid", F.col("next_pivot").alias("pivot"), "class", "size", "comp").agg(F.max("main").alias("main"))
    moved = moved.where("class <> pivot")
    pivots = state.select("gid", F.col("class").alias("pivot"), F.col("size").alias("p_size"), F.col("delta").alias("p_delta"))
    after = moved.join(deltas, ["gid", "class"]).join(pivots, ["gid", "pivot"]).select(
        F.xxhash64("gid", "pivot").alias("gid"), "pivot", "p_size", "class", "size", "main", "comp", _apart("delta", "p_delta").alias("delta")
    )
    after = cut_lineage(_with_linked(after, percent), "jaccard-state")
    return links, after if after.limit(1).count() else None


def _with_linked(state: DataFrame, percent: int) -> DataFrame:
    return state.withColumn("linked", F.size("delta") <= _allowed("size", "p_size", percent))


def near_links(docs: DataFrame, described: DataFrame, shingle: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """(a, b): links between different classes that reach what all links would reach.

    ``described`` has class, size, band and spare of every document in ``docs``.
    """
    texts = frames.pick(docs, text="string")
    rates = _rates(described)
    dealt = texts.mapInArrow(_part_keys(shingle, percent, rates), "key long, class long, own boolean").repartition("key")
    key = Window.partitionBy("key")
    shared = dealt.withColumn("lo", F.min("class").over(key)).withColumn("hi", F.max("class").over(key))
    shared = shared.withColumn("any_own", F.max("own").over(key)).where("lo <> hi and any_own").select("key", "class", "own")
    met = cut_lineage(shared.distinct().withColumn("n_key", F.count("*").over(key)), "jaccard-keys")
    at = F.array(*[F.lit(PART_RATES.index(rate)) for rate in rates.tolist()])
    info = described.where("size > 0").select("class", "size", F.col("spare")[at[F.col("band").cast("int")]].alias("spare"))
    info = info.groupBy("class").agg(F.max("size").alias("size"), F.max("spare").alias("spare"))
    central = F.max(F.when(F.col("looks"), F.struct("central", "class")))["class"]
    crowded = F.col("n_looks") > PAIRED

    ranked = cut_lineage(_look_ups(met.join(info, "class"), "key"), "jaccard-look-ups")
    buckets = cut_lineage(_buckets(ranked, ["key"], central), "jaccard-buckets")
    pairs = cut_lineage(_paired(buckets.where(~crowded), ["key"], percent), "jaccard-pairs")
    many = cut_lineage(buckets.where(crowded).select("class", "size").distinct(), "jaccard-crowd")

    wanted = cut_lineage(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(many.select("class")).distinct(), "jaccard-wanted")
    found, bits = _bit_map(wanted)
    sets = texts.mapInArrow(_wanted_sets(shingle, found, bits), "class long, tokens array<long>, sketch array<long>")
    sets = sets.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    sets = cut_lineage(sets, "jaccard-sets")

    # Sets in crowded buckets look each other up again, by their rarest single shingles. The smaller of two sets
    # lacks at most half of what they may differ in.
    token = Window.partitionBy("token")
    single = many.join(sets, "class").select("class", "size", F.explode("tokens").alias("token"))
    single = single.withColumn("n_key", F.count("*").over(token)).where("n_key > 1")
    single = single.withColumn("partner", F.expr(f"size * 100 div {percent}"))
    spare = F.col("size") - F.floor(_allowed("size", "partner", percent) / 2).cast("long") - 1
    ranked = cut_lineage(_look_ups(single.withColumn("own", F.lit(True)).withColumn("spare", spare), "token"), "jaccard-look-ups")
    buckets = cut_lineage(_buckets(ranked, ["token"], central), "jaccard-buckets")
    pairs = cut_lineage(pairs.union(_paired(buckets.where(~crowded), ["token"], percent)).distinct(), "jaccard-pairs")
    star = buckets.where(crowded).groupBy(F.col("next_pivot").alias("pivot"), "class", "size").agg(F.max("main").alias("main"))
    star = cut_lineage(star.where("class <> pivot"), "jaccard-star")

    links = _checked_by_sets(pairs, sets, percent)
    tokens = sets.select("class", "tokens")
    pivots = tokens.select(F.col("class").alias("pivot"), F.size("tokens").cast("long").alias("p_size"), F.col("tokens").alias("p_tokens"))
    state = star.join(tokens, "class").join(pivots, "pivot").select(
        F.col("pivot").alias("gid"), "pivot", "p_size", "class", "size", "main", _apart("tokens", "p_tokens").alias("delta")
    )
    state = cut_lineage(_with_linked(state, percent), "jaccard-state")
    if not state.limit(1).count():
        return links
    links = cut_lineage(links.union(state.where("linked").select("class", "pivot")), "jaccard-links")
    so_far = roots(links).select(F.col("node").alias("class"), F.col("root").alias("comp"))
    state = cut_lineage(state.join(so_far, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "jaccard-state")
    for k in range(ROUNDS):
        more, state = _round(state, percent, k == ROUNDS - 1)
        links = links.union(more)
        if state is None:
            break
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    picked = frames.pick(docs, doc_id="long", text="string")
    schema = "doc_id long, class long, size long, band long, spare array<long>"
    described = cut_lineage(picked.mapInArrow(_described(shingle, percent), schema), "jaccard-sets")
    links = near_links(docs, described, shingle, percent)
    classes = described.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots(links).withColumnRenamed("node", "class"), "class", "left")
    rooted = cut_lineage(rooted.withColumn("root", F.coalesce("root", "class")), "jaccard-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(named, "root").select("class", "component_id"), "jaccard-components")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return described.join(named, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
