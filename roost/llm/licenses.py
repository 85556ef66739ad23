"""Licence scan: exact set-similarity join of text blocks with licence templates, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost.llm.common import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Opening words of public licence notices. Short ones differ by a single word, hence the high default containment.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Words of a text in lower case. Beyond ASCII, lowering changes neither the cuts nor any ASCII word here."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrase_places(words: Column, phrases: list[tuple[str, str]]) -> Column:
    """Array of (start, label): every place where the words of a phrase stand consecutively."""
    return F.concat(*[_places(words, phrase.split(), label) for phrase, label in phrases])


def _places(words: Column, parts: list[str], label: str) -> Column:
    def here(i):
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), here)
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def template_blocks(
    docs: DataFrame, templates: list[tuple[str, str]], containment: float = 0.95, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text block (line) that holds ``containment`` of a template's distinct words or more.

    Tokens that no template has cannot add to an overlap and are left out of the sets; the others are ordered
    by how many blocks have them, rarest first. A block and a template share ``need = ceil(containment * |T|)`` words
    only if the block has that many (length filter), a word of the block's first ``|B| - need + 1`` is among the
    template's first ``|T| - need + 1`` (prefix filter), and enough words follow the first shared one on both
    sides (positional filter). Pairs that pass are verified on the whole sets. Templates are a parameter: a few thousand
    words at most, so their prefixes are a literal table. Null texts have no block.

    Rows: doc_id, text_hash, block, template, label, containment.
    """
    spark = docs.sparkSession
    sets = [(number, label, sorted(set(text.split()))) for number, (label, text) in enumerate(templates)]
    needs = {number: math.ceil(containment * len(tokens) - 1e-9) for number, _, tokens in sets}
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, _, tokens in sets for w in tokens})])
    text = F.col(text_col)
    blocks = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, r"[\r\n]+")).alias("block", "line")
    )
    known = blocks.select("doc_id", "text_hash", "block", F.array_intersect(words_of(F.col("line")), vocabulary).alias("tokens"))
    least = min(needs.values())
    held = stage(known.filter(F.size("tokens") >= least), "licence-blocks")

    counted = held.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    seen = {r["token"]: r["n"] for r in counted}  # at most the templates' words
    order = sorted({w for _, _, tokens in sets for w in tokens}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    table, prefixes = [], []
    for number, label, tokens in sets:
        ranks = sorted(rank[w] for w in tokens)
        table.append((number, label, ranks, len(ranks), needs[number]))
        prefixes += [(r, number, i, len(ranks), needs[number]) for i, r in enumerate(ranks[: len(ranks) - needs[number] + 1])]
    prefix_table = spark.createDataFrame(prefixes, "rank int, template int, i int, size int, need int")
    set_table = spark.createDataFrame(table, "template int, label string, ranks array<int>, size int, need int")

    position = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    ranked = held.withColumn("ranks", F.array_sort(F.transform("tokens", lambda w: F.element_at(position, w)))).drop("tokens")
    heads = ranked.withColumn("head", F.slice("ranks", 1, F.size("ranks") - least + 1)).select("*", F.posexplode("head").alias("j", "rank"))
    met = heads.join(F.broadcast(prefix_table), "rank")
    met = met.filter((F.size("ranks") >= F.col("need")) & (F.col("j") <= F.size("ranks") - F.col("need")))
    met = met.filter(1 + F.least(F.col("size") - F.col("i"), F.size("ranks") - F.col("j")) - 1 >= F.col("need"))
    pairs = met.groupBy("doc_id", "text_hash", "block", "template").agg(F.any_value("ranks").alias("block_ranks"))
    whole = pairs.join(F.broadcast(set_table), "template")
    shared = F.size(F.array_intersect("block_ranks", "ranks"))
    return whole.filter(shared >= F.col("need")).select(
        "doc_id", "text_hash", "block", "template", "label", (shared / F.col("size")).alias("containment")
    )


def scan_licenses(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    containment: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence phrases and templates of every whole text; one row per input row.

    n_words; n_base, first_word, last_word, base_labels: places of the phrases (words counted from 0; first and last null
    without a place); labels: those and the labels of matching templates; score: 1 with a phrase, else the best
    containment, 0 without a match. Label lists are distinct, sorted and comma-joined. Null text counts
    as empty; rows of equal id and text get equal results, whatever their number; a null id stays null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidate = F.contains(F.lower(text), F.lit(phrases[0][0].split()[-1])) if len({p.split()[-1] for p, _ in phrases}) == 1 else F.lit(True)

    def measured(words: Column) -> Column:
        places = F.when(candidate, phrase_places(words, phrases)).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))
        return F.struct(F.size(words).cast("long").alias("n_words"), places.alias("places"))

    # an array of one binds the words, so they are cut once
    bound = F.element_at(F.transform(F.array(words_of(F.col(text_col))), measured), 1)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), bound.alias("m"))
    found = template_blocks(docs, templates, containment, id_col, text_col)
    by_text = found.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("extra"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks")
    )
    b, t = base.alias("b"), by_text.alias("t")
    joined = b.join(t, F.col("b.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("b.text_hash") == F.col("t.text_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.col("m.places.label")))
    starts = F.col("m.places.start")
    return joined.select(
        "b.doc_id", "m.n_words", F.size("m.places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("extra", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("m.places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
