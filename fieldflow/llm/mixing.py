"""Mixing sources to target weights by systematic sampling.

Sizes, weights and targets make one number per source: the expected copies of each of its documents.
Inside a source the expected copies are prefix-summed over documents ordered by size class, one offset
is added, and a document is emitted once for every whole number its stretch of the sum crosses. Nearly
equal documents stand together, so each class of sizes gets its share and the words taken come near the
target.

The sum is never taken in one task per source: documents are dealt into cells (source, size class, part
of a digest) whose number follows the measured counts, cells are summed up first and placed by a running
sum over the small cell table, and only positions inside a cell are numbered by a window.

Rows without an identifier are dealt by a digest of their text, and rows that share identifier and size are ordered by it, so
neither meets in one cell nor depends on the order of rows; only exact copies under one identifier stand together.

Defined results: null sources are one source, last in order; empty documents have size 0 and take part
like others; a source of size 0 has target 0 and no copies; repeated rows are documents of their own;
no documents give no rows; further columns are handed through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldflow.llm import frames
from fieldflow.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CELL_ROWS = 1024
BROADCAST_ROWS = 50_000  # of four numbers and a source name each
BITS = 24  # expected copies are whole numbers of 2^-24, so prefix sums are exact


def n_words(text) -> F.Column:
    """Runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source) -> F.Column:
    """Never null, and ordered as sources are: by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def _digest(text, seed: int) -> F.Column:
    """A number below 2^32 that any engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10).cast("long")


def text_key(text) -> F.Column:
    """60 bits of a text's MD5; a null text has the empty one's."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds what orders documents: source key, size class (sizes with the same five leading bits) and digest."""
    shift = F.greatest(F.length(F.bin("size")) - 5, F.lit(0))
    return docs.withColumns(
        {
            "key": _key(F.col("source")),
            "size_class": (shift * 64 + F.call_function("shiftright", F.col("size"), shift)).cast("int"),
            "digest": _digest(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("text_key"))), seed),
        }
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target) from rows of (key, size).

    Sources weigh ``weights``, repeating in their order, and share all sizes; a target stops at
    ``most_copies`` times its source's size and the excess is reshared by weight. That is one water level:
    ``target = min(most_copies * size, weight * level)``. Sources whose limit lies lowest for their weight
    fill first, and the level follows from the first source that does not fill. The windows see one row
    per source, never documents.
    """
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = sizes.withColumns({"weight": weight, "cap": F.lit(float(most_copies)) * F.col("source_size")})
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole).cast("double")
    full = F.coalesce(F.sum("cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", (total - full) / left)
    opens = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))
    found = levels.withColumn("found", F.min(opens).over(whole)["level"])
    # least() passes over a null level: when every source fills, targets are the limits themselves.
    return found.select("key", "source_size", F.least("cap", F.col("weight") * F.col("found")).alias("target"))


def _cells(narrow: DataFrame, weights, most_copies, seed, cell_rows) -> tuple[DataFrame, DataFrame]:
    """The plan of each (source, size class), and the running sum before each of its parts."""
    share = F.round(F.col("target") / F.col("source_size") * (1 << BITS))
    plan = (
        narrow.groupBy("key", "size_class")
        .agg(F.ceil(F.count("*") / cell_rows).cast("long").alias("parts"))
        .join(source_targets(narrow, weights, most_copies), "key")
        .withColumn("rate", F.when(F.col("source_size") > 0, share).otherwise(0).cast("long"))
    )
    plan = cut_lineage(plan, "mix-plan")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    earlier = Window.partitionBy("key").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("docs") * F.col("rate")).over(earlier), F.lit(0))
    counts = _parts(narrow, plan).groupBy("key", "size_class", "part", "rate").agg(F.count("*").alias("docs"))
    start = before + _digest(F.concat(F.lit("offset:"), "key"), seed) % ((1 << BITS) - 1)
    return plan, counts.select("key", "size_class", "part", start.alias("start"))


def _parts(placed: DataFrame, plan: DataFrame) -> DataFrame:
    part = F.floor(F.col("digest") * F.col("parts") / (1 << 32))
    return placed.join(plan, ["key", "size_class"]).withColumn("part", part)


def _drawn(
    docs: DataFrame, narrow: DataFrame, weights=WEIGHTS, most_copies=MOST_COPIES, seed=42, cell_rows=CELL_ROWS
) -> DataFrame:
    """``docs`` (doc_id, source, size, text_key and more) with source_size, target and copies; ``narrow`` is the same rows."""
    plan, starts = _cells(_placed(narrow, seed), weights, most_copies, seed, cell_rows)
    cell = ["key", "size_class", "part"]
    inside = Window.partitionBy(*cell).orderBy("digest", "doc_id", "size", "text_key")
    numbered = _parts(_placed(docs, seed), plan).withColumn("place", F.row_number().over(inside)).join(starts, cell)
    upto = F.col("start") + F.col("place") * F.col("rate")
    return numbered.withColumn("copies", F.shiftright(upto, BITS) - F.shiftright(upto - F.col("rate"), BITS))


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_key), written once: texts are read once for it."""
    picked = frames.pick(docs, doc_id="long", source="string", text="string")
    return cut_lineage(_sized(picked), "mix-sizes")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"size": n_words(F.col("text")), "text_key": text_key(F.col("text"))}).drop("text")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every column as given, each document as often as it was drawn."""
    rows = frames.with_row(docs, doc_id="long", source="string", text="string")
    drawn = _drawn(_sized(rows), _narrow(docs), **options).where(F.col("copies") > 0)
    repeated = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return frames.rows_of(repeated, docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; texts are not carried."""
    narrow = _narrow(docs)
    return _drawn(narrow, narrow, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
