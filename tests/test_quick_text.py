"""Short ways through text functions give what the patterns give."""

import re

from pyspark.sql import functions as F

from roost import rules
from roost.functions.numbers import ROOMS, parse_rooms
from roost.functions.text import collapse_ws, fold_accents, says, strip_tags

TEXTS = [
    "exterior", "un exterior.", "piso exterior con", "a exterior", "piso  exteriores x", "exteriores", "el_exterior", "xexterior exterior", "todo exterior", "ático exterior", "exteriorá", "éxterior",
    "outside-facing room", "outside facingx", "luz natural", "natural lit", "well-lit", "wellness", "solead", "soleada", "luminosidad", "luminosas",
    "east facing", "facing", "orientación", "orientaci", "monta", "montaña", "naturaleza", "natur", "big windows", "windows", "panoramic", "", None,
]


def _column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_words_by_shared_parts_say_what_the_pattern_says(spark):
    rows = _column(spark, TEXTS)
    patterns = [rules.lower_pattern(p) for _, p in rules.TAG_PATTERNS] + [p for _, p in rules.TYPE_WORDS]
    out = rows.select("t", *[F.array(says(F.col("t"), p), F.col("t").rlike(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for row in out:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"][0] == row[f"p{i}"][1], (row.t, p)


def test_whole_words_between_blanks_need_no_pattern_and_shared_parts_come_first(spark):
    assert "' exterior '" in str(says(F.col("t"), rules.lower_pattern(rules.EXTERIOR)))
    assert "'facing'" in str(says(F.col("t"), rules.lower_pattern(rules.ORIENTATION)))


def test_blanks_tags_accents_and_rooms_as_before(spark):
    texts = [
        "a  b", "a\tb\n\nc ", " \r\n x", "a  b", "a   b\tc", "<b>a</b>  b", "a < b", "no tags & amp", "&lt;b&gt;  x", "x" * 3 + " " * 20 + "y",
        "é  è", "ﬁ ÅÑ", "é a", "3 habs. x", "12 Dormitorios", "4 ROOMS", "5 rom", "2 habitaciones y 3 rooms", "hab 3", "1234 hab", "", None,
    ]
    rows = _column(spark, texts)
    out = rows.select("t", collapse_ws(F.col("t")).alias("ws"), strip_tags(F.col("t")).alias("text"), fold_accents(F.col("t")).alias("fold"), parse_rooms(F.col("t")).alias("rooms"),
                      F.regexp_extract("t", ROOMS, 1).alias("found")).orderBy("i").collect()
    blank = "[ \t\n\x0b\f\r   -     　﻿]+"
    for row in out:
        assert row.ws == (None if row.t is None else re.sub(blank, " ", row.t).strip(" "))
        assert row.rooms == (float(row.found) if row.found else None)
    assert [r.text for r in out][5:9] == ["a b", "a", "no tags & amp", "<b> x"]
    assert [r.fold for r in out][10:13] == ["e  e", "ﬁ AN", "e a"]


def test_texts_without_room_words_are_not_searched_for_numbers(spark):
    plan = _column(spark, ["x"]).select(parse_rooms(F.col("t")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert "[hHdDrR][aAoO]" in plan
