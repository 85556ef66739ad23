"""Collocations against a plain count, with splits of texts into blocks, collisions and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from roost.llm import collocations

DOCS = "doc_id long, text string, lang string, n long, phrase string, place string, k int"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(A_TO_Z)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counts(rows, max_words=4):
    found = Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            found[lang or "und", 0, ""] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    found[lang or "und", k, " ".join(words[i : i + k])] += 1
    return found


def plain(rows, least, top, cover=80):
    f = {key: n for key, n in counts(rows).items() if n >= least or key[1] == 0}
    out = []
    for lang in {key[0] for key in f}:
        mine = {phrase: n for (other, k, phrase), n in f.items() if other == lang and k}
        scored = []
        for phrase, a in mine.items():
            words = phrase.split(" ")
            if len(words) < 2:
                continue
            inside = f" {phrase} "
            if any(len(x.split(" ")) > len(words) and inside in f" {x} " and 100 * b >= cover * a for x, b in mine.items()):
                continue
            cuts = []
            for c in range(1, len(words)):
                left, right = mine[" ".join(words[:c])], mine[" ".join(words[c:])]
                cuts.append((2000000 * a // (left + right), c, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, f[lang, 0, ""], -score))
    return sorted(out)


def prose(n, seed):
    draw = random.Random(seed)
    words = ["The", "the", "a", "été", "ÉTÉ", "x'y", "one two three four", "new york", " ", "z\x00z", " w"]
    return "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for _ in range(n))


ROWS = [(i, prose(60, i), [None, "und", "en", "fr"][i % 4]) for i in range(80)]
ROWS += [(0, prose(60, 0), "en"), (None, prose(60, 1), "fr"), (90, None, "en"), (91, "", None), (92, " \t\n", "de"), (93, prose(40_000, 5), "fr")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", "q", 2) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (30, 7)])
def test_equals_a_plain_count(spark, least, top):
    got = collocations.collocations(table(spark, ROWS).repartition(6), least=least, top=top)
    found = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == plain(ROWS, least, top) and len(found) > 10


def test_first_places_point_at_the_phrase(spark):
    text = {i: t for i, t, lang in ROWS if lang == "en" and i}
    for r in collocations.collocations(table(spark, ROWS[4:80]), least=5).filter("lang = 'en'").collect():
        words = [w for piece in pieces(text[r.doc_id]) for w in piece]
        assert " ".join(words[r.word : r.word + len(r.phrase.split(" "))]) == r.phrase


def test_empty_tables(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(1, "one word", "en")])).collect() == []


def batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "lang", "text"]
    )


@pytest.mark.parametrize("flat", [False, True])
def test_blocks_and_collisions_lose_and_double_nothing(monkeypatch, flat):
    monkeypatch.setattr(collocations, "BLOCK", 50)
    monkeypatch.setattr(collocations, "PIECE", 64)
    monkeypatch.setattr(collocations, "KNOWN", 20)
    if flat:
        monkeypatch.setattr(collocations._Block, "fingerprints", lambda self, k, at: np.full(len(at), 7, np.uint64))
    rows = [*ROWS[:12], (93, prose(3000, 5), "fr")]
    found = Counter()
    blocks = list(collocations._blocks(iter([batch(rows[:5]), batch(rows[5:])]), 3))
    assert len(blocks) > 20
    for block in blocks:
        for k in range(1, 5):
            at, n = collocations._groups(block, k, np.flatnonzero(block.starts(k)))
            for start, times in zip(at.tolist(), n.tolist(), strict=True):
                phrase = b" ".join(block.known.words[i] for i in block.ids[start : start + k]).decode()
                found[block.docs[block.owner[start]][1], k, phrase] += times
    assert found == Counter({key: n for key, n in counts(rows).items() if key[1]})
