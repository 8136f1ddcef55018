"""License scans by diagonal voting, in DataFrame functions alone.

Every pair of neighbouring words of every text is hashed and joined to the pairs of the license templates;
a hit votes for its diagonal, the word where the template would begin. A phrase stands wherever a diagonal
has the votes of all its pairs. A longer notice may be changed: its diagonals with at least ``MIN_VOTES``
votes are merged while they lie within ``MAX_SHIFT`` words of each other, and the merged span is verified by
the template's pairs it covers, each counted once, and by its length.

Templates are a fixed list, so the joined side is bounded by it and broadcast; text pairs never move. What
moves are hits and one row per document, once, by document.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. Defined results: null and
empty texts have no words, no places, empty labels and score 0; places may overlap and all count; labels are
distinct and sorted; repeated rows are scanned alike, each to its own row; no documents give no rows;
further columns are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldflow.llm import frames

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_VOTES = 2
MAX_SHIFT = 6
MIN_COVERED = 0.6
MAX_STRETCH = 1.5

# The phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases, and the opening of license notices as their owners publish them.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction""",
    "apache": """you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted""",
}


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_pairs(spark: SparkSession, base=None, phrases=None, notices=None) -> DataFrame:
    """(template, kind, label, t_words, t_at, w0, w1), one row per pair of neighbouring words of a template."""
    sets = (("base", BASE_PHRASES if base is None else base), ("phrase", PHRASES if phrases is None else phrases))
    found = [(kind, label, template_words(text)) for kind, texts in sets for text, label in texts.items()]
    found += [("notice", label, template_words(text)) for label, text in (NOTICES if notices is None else notices).items()]
    if any(len(words) < 2 for *_, words in found):
        raise ValueError("a template needs at least two words")
    rows = [
        (t, kind, label, len(words), at, words[at], words[at + 1])
        for t, (kind, label, words) in enumerate(found)
        for at in range(len(words) - 1)
    ]
    return spark.createDataFrame(rows, "template int, kind string, label string, t_words int, t_at int, w0 string, w1 string")


def _hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """A row for each pair that a template has, and each document's first row in any case."""
    words = F.array_remove(F.split(frames.lower_ascii(F.coalesce("text", F.lit(""))), NOT_WORD, -1), "")
    picked = frames.pick(docs, doc_id="long", text="string")
    worded = picked.select("doc_id", F.monotonically_increasing_id().alias("uid"), words.alias("a"))
    worded = worded.withColumn("b", F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))))
    pairs = worded.select(
        "doc_id", "uid", F.size("a").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip("a", "b")).alias("pos", "pair")
    ).select("doc_id", "uid", "n_words", "pos", "pair.a", "pair.b", F.xxhash64("pair.a", "pair.b").alias("gram"))
    same = (F.col("gram") == F.col("t_gram")) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1"))
    keyed = F.broadcast(templates.withColumn("t_gram", F.xxhash64("w0", "w1")))
    joined = pairs.join(keyed, same, "left").where("template is not null or pos is null or pos = 0")
    return joined.select(
        "doc_id", "uid", "n_words", "template", "kind", "label", "t_words", "t_at", "pos", (F.col("pos") - F.col("t_at")).alias("diagonal")
    )


def license_spans(docs: DataFrame, **templates) -> DataFrame:
    """doc_id, uid, n_words, kind, label, start, end and covered of each verified place.

    A document without any has one row with a null label. ``uid`` tells rows apart.
    """
    hits = _hits(docs, template_pairs(docs.sparkSession, **templates)).repartition("uid")
    row = ["doc_id", "uid", "n_words", "template", "kind", "label", "t_words"]
    voted = hits.groupBy(*row, "diagonal").agg(
        F.collect_set("t_at").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    notice, votes, pairs = F.col("kind") == "notice", F.size("at"), F.col("t_words") - 1
    strong = F.when(notice, votes >= MIN_VOTES).otherwise(votes == pairs)
    # Weak diagonals go; those of a document's first row stay, without a template, to keep the document.
    left = voted.withColumn("strong", F.coalesce(strong, F.lit(False))).where("strong or low is null or low = 0")
    left = left.withColumns({c: F.when(F.col("strong"), F.col(c)) for c in ("template", "kind", "label", "t_words", "diagonal")})
    by_template = Window.partitionBy("uid", "template").orderBy("diagonal")
    near = notice & (F.col("diagonal") - F.lag("diagonal").over(by_template) <= MAX_SHIFT)
    merged = (
        left.withColumn("fresh", F.when(near, 0).otherwise(1))
        .withColumn("place", F.sum("fresh").over(by_template))
        .groupBy(*row, "place")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_pairs"),
            F.min("diagonal").alias("start"),
            F.min("low").alias("low"),
            (F.max("high") + 1).alias("end"),
        )
    )
    covered = F.col("n_pairs") / pairs
    fits = (covered >= MIN_COVERED) & (F.col("end") - F.col("low") < MAX_STRETCH * F.col("t_words"))
    verified = F.col("template").isNotNull() & (~notice | fits)
    start = F.when(notice, F.col("low")).otherwise(F.col("start"))
    none = F.lit(None)
    return merged.select(
        "doc_id",
        "uid",
        "n_words",
        F.when(verified, F.col("kind")).otherwise(none).alias("kind"),
        F.when(verified, F.col("label")).otherwise(none).alias("label"),
        F.when(verified, start).otherwise(none).alias("start"),
        F.when(verified, F.col("end")).otherwise(none).alias("end"),
        F.when(verified, covered).otherwise(F.lit(0.0)).alias("covered"),
    )


def license_report(docs: DataFrame, **templates) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    base = F.col("kind") == "base"
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        license_spans(docs, **templates)
        .groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.max("covered").alias("score"),
        )
        .drop("uid")
    )
