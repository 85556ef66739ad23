"""Each operator against a plain version on small rows, and on nulls, empty tables, repeated rows and odd columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roost.llm import decontaminate, langid, licenses, neighbours, packing, paragraphs, quality, queries, simhash, suffixes, tokencounts
from roost.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, fp string, leaks string, node string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(900)]


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text: str, at: list[int]) -> str:
    words = text.split(" ")
    for i in at:
        words[i] = "changed"
    return " ".join(words)


BASE, PASSAGE = prose(200, 1), prose(60, 2)
TEXTS = [
    BASE, BASE, edited(BASE, [20, 90]), prose(150, 3), prose(40, 4) + "\n" + PASSAGE + "\n" + prose(30, 5),
    PASSAGE + "\n" + prose(30, 6), prose(80, 7) + "\n" + PASSAGE, None, "", " \n\t", "One.", prose(30_000, 8),
    "ÉTÉ été <|endoftext|> x's  end　\x00", prose(20, 9) + " " + PASSAGE + " " + prose(25, 10),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "no", "x", "y", "z") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en") for i, t in enumerate(TEXTS)]
    return table(spark, [*rows, (0, TEXTS[0], "en"), (None, BASE, None)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def roots_of(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200)]
    links += [(draw.randint(300, 700), draw.randint(300, 700)) for _ in range(300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in roots_of({n for pair in links for n in pair}, links).items() if n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[j : j + size]) for j in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [2, 9])
def test_simhash_equals_all_pairs(spark, docs, radius):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
    root = roots_of(range(len(rows)), near)
    smallest = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root[i]].append(doc_id)
    expected = sorted((str(d), fps[i], min(smallest[root[i]])) for i, (d, _) in enumerate(rows))
    got = simhash.simhash_groups(docs, radius).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == expected


def test_simhash_tiles_lose_no_pair():
    draw = np.random.default_rng(1)
    left = draw.integers(0, 1 << 63, 700, np.uint64)
    right = left[:300] ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64))
    a, b = simhash.close_pairs_as_stars(left[:, None], right[:, None], 2)
    assert sorted(zip(a, b, strict=True)) == [(700 + i, i) for i in range(300)]


def test_near_duplicate_documents_by_exact_jaccard(docs, empty):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_documents(docs).collect()}
    assert got[0] == got[1] == got[2] == 0
    assert got[7] == got[8] == got[9] == 7
    assert all(got.get(i, i) == i for i in (3, 4, 5, 6, 10, 11, 12, 13))
    assert simhash.near_duplicate_documents(empty).count() == 0 and simhash.simhash_groups(empty).count() == 0


def test_near_duplicates_that_repeat_a_line_more_often(spark):
    line = prose(12, 31)
    rows = [(2 * i + far, prose(200, 300 + i) + ("\n" + line) * (20 if far else 1), None) for i in range(12) for far in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_documents(table(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d in range(24)}


def test_packing_round_trip_and_ids(docs, empty):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), 256).toPandas()
    for doc_id, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        ids = np.array([*plain.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert own.start.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist() and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
        assert len(own) == 1 and len(ids) <= 256 or (own.length.iloc[1:] == 256).all()
    for _, row in got.groupby("sequence_id"):
        row = row.sort_values("offset")
        assert row.offset.tolist() == np.concatenate([[0], row.length.cumsum()[:-1]]).tolist() and row.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack_documents(docs).count() >= docs.count() and packing.pack_documents(empty).count() == 0


def test_best_fit_is_best_fit():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 101, 500)
    bins: list[int] = []
    for size in sorted(sizes.tolist(), reverse=True):
        fitting = [b for b in bins if b >= size]
        if fitting:
            bins.remove(min(fitting))
        left = (min(fitting) if fitting else 100) - size
        bins.append(left)
    where = packing.best_fit(sizes, 100)
    assert where.max() + 1 == len(bins) and np.bincount(where, weights=sizes).max() <= 100


def test_licenses_equal_plain_scan(spark, empty):
    texts = ["MIT License. the mit\nlicense", "Licensed under CC BY-NC 4.0.", None, "", "apache license general public license x", "ÉMIT license mit",
             "intro\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].n_words for i in range(6)] == [5, 7, 0, 0, 6, 3]
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels, got[0].score) == (2, 0, 3, "mit", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (0, None, "", "cc-by-nc")
    assert (got[4].base_labels, got[4].first_word, got[4].last_word) == ("apache,gpl", 0, 2)
    assert got[5].n_base == 0 and got[6].labels == "mit" and got[2].score == 0.0
    doubled = licenses.scan_licenses(table(spark, [(1, texts[1], None), (1, texts[1], None), (None, texts[1], None), (1, None, None)]))
    assert sorted((str(r.doc_id), r.labels) for r in doubled.collect()) == [("1", ""), ("1", "cc-by-nc"), ("1", "cc-by-nc"), ("None", "cc-by-nc")]
    assert licenses.scan_licenses(empty).count() == 0


def test_license_join_equals_brute_force(spark):
    draw = random.Random(9)
    words = ["permission", "license", "the", "of", "free", "copy", "any", "terms", "cc", "by"]
    templates = [("a", "permission license free copy any terms"), ("b", "cc by license terms"), ("c", "the of any copy")]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 12))) for _ in range(300)]
    rows = table(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.label, round(r.containment, 9)) for r in licenses.template_blocks(rows, templates, 0.7).collect()}
    want = set()
    for i, t in enumerate(texts):
        for label, template in templates:
            c = len(set(t.split()) & set(template.split())) / len(template.split())
            if c >= 0.7:
                want.add((i, label, round(c, 9)))
    assert got == want


ITEM = prose(40, 77) + ". " + prose(8, 78) + "."


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, ITEM), (2, prose(30, 79)), (3, None), (4, ""), (5, "tiny")], "item_id long, text string")
    parts = decontaminate.benchmark_items(items)
    leaked = prose(300, 80) + " " + ITEM.upper() + " " + prose(500, 81)
    broken = ITEM.split()
    half = prose(50, 82) + " " + " ".join(broken[:20]) + " " + prose(50, 83)
    shuffled = broken[:]
    random.Random(1).shuffle(shuffled)
    rows = table(spark, [(1, leaked, None), (2, half, None), (3, " ".join(shuffled), None), (4, edited(ITEM, [5]), None), (None, ITEM, None), (6, None, None), (7, "", None)])
    got = decontaminate.contaminated(rows, parts).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 1), ("4", 1), ("None", 1)]
    assert next((r.first_word, r.last_word) for r in got if r.doc_id == 1) == (300, 347)
    assert decontaminate.contaminated(empty, parts).count() == 0
    assert decontaminate.contaminated(docs, parts.limit(0)).count() == 0
    kept = decontaminate.with_leaks(rows, parts)
    assert kept.count() == 7 and kept.filter("size(leaks) = 0").count() == 4


def test_decontamination_in_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 400)
    items = [(i, prose(25, 500 + i)) for i in range(150)]
    parts = decontaminate.benchmark_items(spark.createDataFrame(items, "item_id long, text string"))
    rows = table(spark, [(i, prose(40, 900 + i) + " " + t + " " + prose(40, 990 + i), None) for i, t in items[::5]])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, parts).collect()}
    assert got == {(i, i) for i, _ in items[::5]}


def test_suffix_passages_equal_brute_force(docs, empty):
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(TEXTS)}
    seen = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            if min(seen[tuple(w[j : j + 50])]) < i:
                want[i].update(range(j, j + 50))
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert got == want and {5, 6, 13} <= set(got)
    assert suffixes.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("slots", [1, 4, 16, 64])
def test_suffix_passages_many_times_in_one_document(spark, slots):
    """Runs of one document in suffix order reach over partitions; nothing may depend on where they are cut."""
    lines = [prose(55, 1300 + k) for k in range(6)]
    draw = random.Random(slots)
    mixed = [" ".join(draw.choice(lines) for _ in range(draw.randint(1, 12))) + " " + prose(draw.randint(0, 30), 1400 + k) for k in range(12)]
    texts = [PASSAGE, " ".join([PASSAGE] * 40), *mixed]
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            if min(seen[tuple(w[j : j + 50])]) < i:
                want[i].update(range(j, j + 50))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    try:
        got = defaultdict(set)
        for r in suffixes.repeated_passages(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect():
            got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[1]) == 2400 and got == want


def test_suffix_passages_around_a_frequent_line(spark):
    lines = [prose(25, 600 + k) for k in range(10)]
    rows = [(0, "\n".join(prose(30, 650 + k) + "\n" + line for k, line in enumerate(lines)), None)]
    for pair in range(40):
        passage = prose(25, 700 + pair) + "\n" + lines[pair % 10] + "\n" + prose(25, 800 + pair)
        rows += [(d, prose(20, 900 + d) + "\n" + passage + "\n" + prose(20, 1100 + d), None) for d in (1 + pair, 101 + pair)]
    got = sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in suffixes.repeated_passages(table(spark, rows)).collect())
    assert got == [(101 + pair, 20, 75, 1 + pair) for pair in range(40)]


def test_minimisers_cover_every_window():
    keys = np.random.default_rng(0).integers(0, 1 << 60, 3000).astype(np.uint64)
    keys[1000:2000] = 7
    spots = suffixes.minimisers(keys, 35)
    assert np.diff(spots).max() <= 35 and spots[0] < 35 and len(spots) < 400


def test_language_id(spark, empty):
    docs = table(spark, [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze", "de")] * 10)])
    model = langid.fit(docs)
    asked = table(spark, [(1, "the house of the cat", "de"), (2, "die katze und der hund " * 50_000, None), (3, None, "en"), (4, "12 !!", "en"), (5, "", None)])
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(asked, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    unfitted = langid.predict(asked, langid.fit(empty))
    assert {r.lang_pred for r in unfitted.collect()} == {"und"} and langid.predict(empty, model).count() == 0
    assert model.score("the ")[1] == pytest.approx(plain_posterior(["the cat and the dog of the house", "der hund und die katze"], "the "), abs=1e-4)


def plain_posterior(texts, asked):
    def grams(text):
        text = f" {text.lower()} "
        return [b for n in langid.ORDERS for b in langid.ngram_buckets(text, n).tolist()]

    scores = []
    for text in texts:
        counts = np.bincount(grams(text) * 10, minlength=langid.BUCKETS) + 0.5
        scores.append(np.log(counts / counts.sum())[grams(asked)].sum())
    return float(np.exp(scores[0]) / np.exp(scores).sum())


def test_quality_grades(spark, empty):
    good = [(i, prose(60, 2000 + i), None) for i in range(200)]
    bad = [(1000 + i, prose(60, 4000 + i) + " awful " + prose(20, i), None) for i in range(120)]
    rows = table(spark, good + bad)
    rated = rows.select("text", F.when(F.col("doc_id") < 1000, 2).when(F.col("doc_id") < 1100, 1).otherwise(None).alias("grade"))
    model = quality.fit(rated)
    graded = quality.grade_documents(rows, model, least_grade=2).collect()
    assert np.mean([r.keep == (r.doc_id < 1000) for r in graded]) > 0.98 and all(1 <= r.expected_grade <= 2 for r in graded)
    odd = quality.grade_documents(table(spark, [(1, None, None), (2, "", None), (3, prose(50_000, 3), None)]), model, 2)
    assert odd.count() == 3 and odd.filter("tail_prob is null").count() == 0
    alone = quality.fit(rated.filter("grade = 2"))
    assert {r.keep for r in quality.grade_documents(rows, alone, 2).collect()} == {True}
    assert quality.fit(empty.select("text", F.lit(1).alias("grade"))).grades == [0] and quality.grade_documents(empty, model, 2).count() == 0


def test_ordinal_tails_fall_with_the_grade(spark):
    rows = [(prose(30, i) + " " + " ".join(["fine"] * g + ["poor"] * (3 - g)) + f" mark{g}", g) for i in range(60) for g in range(4)]
    model = quality.fit(spark.createDataFrame(rows, "text string, grade int"))
    tails = model.tails(rows[2][0])
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all() and (np.diff(tails) < 0).all()


def test_repeated_paragraphs(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert {d for d, _ in got} == {1, 2, 5, 6} and got[(5, 60)].first_doc_ids == [4] and got[(6, 60)].first_doc_ids == [4]
    shorter = {r.doc_id: r.text for r in paragraphs.without_stretches(docs.filter("doc_id > 0"), paragraphs.repeated_paragraphs(docs)).collect()}
    assert 1 not in shorter and 2 not in shorter and shorter[5] == prose(30, 6) and shorter[6] == prose(80, 7) and shorter[4] == TEXTS[4] and shorter[7] is None
    assert paragraphs.repeated_paragraphs(empty).count() == 0


def test_repeated_stretches_wherever_lines_break(spark, docs, empty):
    words = PASSAGE.split(" ")
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 60, 9))
    rows = docs.filter("doc_id is not null").unionByName(table(spark, [(20, prose(30, 21) + "\n" + wrapped + " " + prose(30, 22), None)]))
    stretches = paragraphs.repeated_stretches(rows)
    got = {(r.doc_id, r.n_words): r.first_doc_ids for r in stretches.collect()}
    assert {d for d, _ in got} == {1, 2, 5, 6, 13, 20} and all(got[(d, 60)] == [4] for d in (5, 6, 13, 20))
    shorter = {r.doc_id: r.text for r in paragraphs.without_stretches(rows, stretches).collect()}
    assert shorter[13].split() == (prose(20, 9) + " " + prose(25, 10)).split() and shorter[5] == prose(30, 6)
    assert shorter[20] == prose(30, 21) + "\n " + prose(30, 22) and 1 not in shorter and shorter[4] == TEXTS[4]
    assert paragraphs.repeated_stretches(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and rows >= 4


def test_embeddings_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 16))
    rows = np.concatenate([base, base[:40] + 0.1 * draw.normal(size=(40, 16)), np.repeat(base[:1], 700, 0) + 0.15 * draw.normal(size=(700, 16)), base[5:8]])
    data = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(rows)]
    n = len(data)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(data + [(n + k, v, None) for k, v in enumerate(odd)], "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.embedding_near_duplicates(df).collect()}
    exact = np.array([v for _, v, _ in data])
    unit = exact / np.linalg.norm(exact, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    root = roots_of(range(n), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert {i: got[i] for i in range(n)} == {i: (int(near[i].sum()) - 1, root[i], root[i] == i) for i in range(n)}
    assert all(got[n + k] == (0, n + k, True) for k in range(len(odd)))
    assert neighbours.embedding_near_duplicates(df.limit(0)).count() == 0


def test_token_rollup_is_idempotent(spark, docs, tmp_path):
    counted = tokencounts.count_tokens(docs, ["byte_bpe_50k"])
    rollup = tokencounts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.apply("a", tokencounts.inserts(counted)) and not rollup.apply("a", tokencounts.inserts(counted))
    total = sum(len(packing.token_ids(r.text)) for r in docs.collect())
    assert rollup.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (docs.count(), total)
    old = counted.filter("doc_id = 3")
    rollup.apply("b", tokencounts.revisions(old, old.withColumn("n_tokens", F.lit(7).cast("long")).withColumn("lang", F.lit("fr"))))
    assert [tuple(r) for r in rollup.totals().filter("lang = 'fr'").collect()] == [("s", "fr", "byte_bpe_50k", 1, 7)]
    rollup.apply("c", tokencounts.deletes(counted.filter("doc_id <> 3 or doc_id is null")))
    assert [tuple(r)[1:] for r in rollup.totals().collect()] == [("fr", "byte_bpe_50k", 1, 7)]
    # a batch that failed half-way has no marker: it is not counted and its retry overwrites it
    tokencounts.inserts(old).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(str(tmp_path / "rollup" / "batch=d"))
    assert rollup.totals().count() == 1 and rollup.apply("d", tokencounts.inserts(old.limit(0)))
    with pytest.raises(ValueError):
        rollup.apply("../x", counted)


def test_token_totals_with_null_and_repeated_ids(spark, tmp_path):
    mail, plain = "write to a.b@example.org today please", "seven plain words stand in this text"
    rows = [(None, mail, "en"), (1, plain, "en"), (2, mail, "en"), (2, plain, "en"), (3, plain, "en"), (3, mail, "en"), (4, None, None), (5, "", "en")]
    labels = spark.createDataFrame([(3, 1), (None, 1), (1, 0), (1, None)], "doc_id long, toxic int")
    got = queries._token_totals(table(spark, rows), labels, str(tmp_path / "totals"))
    left = [t.replace("a.b@example.org", "[email]") for _, t, lang in rows[:4] + rows[7:] if lang]
    want = (5, sum(len(packing.token_ids(t)) for t in left))
    assert got.filter("lang = 'en' and tokenizer_version = 'byte_bpe_50k'").select("n_docs", "n_tokens").first() == want
    assert got.filter("lang is null").select("n_docs", "n_tokens").distinct().collect() == [(1, 0)]


def test_decontamination_with_one_word_of_a_short_question_changed(spark):
    item = " ".join(prose(8, 1500).split()) + "? " + prose(40, 1501)
    words = item.split()
    words[4] = "changed"
    rows = table(spark, [(1, prose(60, 1502) + " " + " ".join(words) + " " + prose(60, 1503), None), (2, prose(200, 1504), None)])
    parts = decontaminate.benchmark_items(spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, parts).collect()] == [(1, 7)]
