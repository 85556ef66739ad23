"""Queries of the subpackage over the driver tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roost.llm import (
    collocations, decontaminate, langid, licenses, negatives, neighbours, packing, paragraphs, quality, simhash, suffixes, tokencounts, toxicity,
)
from roost.llm.common import read_table, stage
from roost.sources.staging import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark, sf_dir):
    """Totals after all documents came in, those labelled toxic went, and texts with
    e-mail addresses were counted anew without them; one batch comes twice.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/roost-llm/token-rollup-{uuid.uuid4().hex}"
    return _token_totals(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), folder)


def _token_totals(documents: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """The batches of ``op1_token_counts``. Rows with a null id are never toxic; a toxic id takes all its rows.

    What a revision takes back and what it puts in place come from the same rows, so ids may repeat.
    """
    docs = documents.select("doc_id", "source", "lang", "text")
    versions = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    redacted = F.regexp_replace("text", r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]")
    counted = stage(tokencounts.count_tokens(docs, versions, mark=redacted != F.col("text")), "token-counts")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    mailed = docs.filter(redacted != F.col("text")).withColumn("text", redacted).join(toxic, "doc_id", "left_anti")
    old = counted.filter("marked").join(toxic, "doc_id", "left_anti")
    rollup = tokencounts.Rollup(documents.sparkSession, folder)
    rollup.apply("b1-insert", tokencounts.inserts(counted))
    rollup.apply("b2-delete", tokencounts.deletes(counted.join(toxic, "doc_id", "left_semi")))
    rollup.apply("b3-revise", tokencounts.revisions(old, tokencounts.count_tokens(mailed, versions)))
    rollup.apply("b2-delete", tokencounts.deletes(counted.join(toxic, "doc_id", "left_semi")))
    return rollup.totals()


@query
def op2_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2,048 ids."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), capacity=2048, vocabulary="byte_bpe_50k")


@query
def op3_licenses(spark, sf_dir):
    """Licence phrases and template matches of every document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    words = "regexp_extract_all(lower({}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        places.append(f"SELECT r, i - 1 AS s, '{label}' AS label FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d) WHERE {test}")
    rows = ", ".join(f"({n}, '{label}', list_distinct(string_split('{text}', ' ')))" for n, (label, text) in enumerate(licenses.TEMPLATES))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
    base AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi FROM ({" UNION ALL ".join(places)}) GROUP BY r),
    base_label AS (SELECT DISTINCT r, label FROM ({" UNION ALL ".join(places)})),
    line AS (SELECT r, b, list_distinct({words.format("t")}) AS w
             FROM (SELECT r, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS t, generate_subscripts(regexp_split_to_array(text, '[\\r\\n]+'), 1) AS b FROM d)),
    hit AS (SELECT r, b, label, len(list_intersect(line.w, t.w)) / len(t.w) AS c
            FROM line JOIN (VALUES {rows}) t(n, label, w) ON len(list_intersect(line.w, t.w)) >= ceil(0.95 * len(t.w) - 1e-9)),
    best AS (SELECT r, max(c) AS c, count(DISTINCT b) AS n_blocks FROM hit GROUP BY r),
    bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM base_label GROUP BY r),
    al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT * FROM base_label UNION SELECT r, label FROM hit) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bl.l, '') AS base_labels,
           coalesce(al.l, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
    FROM d LEFT JOIN base USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN best USING (r)"""


ORACLES["op3_licenses"] = _license_sql()


@query
def op4_simhash(spark, sf_dir):
    """SimHash components of all documents: 3-word shingles, 2 bits."""
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), radius=2, shingle_words=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and the place."""
    items = decontaminate.benchmark_items(read_table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), items)


@query
def op6_suffix_dedup(spark, sf_dir):
    """Passages of 50 words or more of all documents that an earlier document has too."""
    return suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held_out))
    scored = langid.predict(docs.select("doc_id", "text"), model, lang_col="lang_pred", score_col="score")
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_substring_dedup(spark, sf_dir):
    """Stretches of repeated paragraphs and passages of all documents, with the documents that keep the text."""
    return paragraphs.repeated_stretches(read_table(spark, sf_dir, "documents"))


@query
def op9_embedding_dedup(spark, sf_dir):
    """Links of cosine 0.9 or more between all embeddings, and their components."""
    return neighbours.embedding_near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op10_quality(spark, sf_dir):
    """Expected grade of every document; kept when grade 2 (good and not toxic) is likelier than not."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.rated_documents(docs, read_table(spark, sf_dir, "labels")))
    return quality.grade_documents(docs, model, least_grade=2).select("doc_id", "expected_grade", "tail_prob", "keep")


@query
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding; the label of every seventh is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(read_table(spark, sf_dir, "embeddings").withColumn("label", label))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
    WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM r a JOIN r b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS i FROM s WHERE same) WHERE i <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.a, p.i ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query
def op12_collocations(spark, sf_dir):
    """The 2,000 firmest phrases of two to four words of every language."""
    best = collocations.collocations(read_table(spark, sf_dir, "documents"))
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLES["op12_collocations"] = """
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
    w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    g AS (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
    m AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    c AS (SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS cut FROM m),
    sc AS (SELECT c.lang, c.phrase, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
           FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
                  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
    lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM sc) WHERE i = 1),
    u AS (SELECT lang, k, a, w, unnest(generate_series(2, k - 1)) AS len FROM m WHERE k > 2),
    v AS (SELECT lang, a, w, len, unnest(generate_series(1, k - len + 1)) AS s FROM u),
    cover AS (SELECT lang, array_to_string(w[s:s + len - 1], ' ') AS phrase, max(a) AS b FROM v GROUP BY ALL),
    kept AS (SELECT m.lang, m.phrase, m.a, lo.l, lo.r, lo.score FROM m JOIN lo USING (lang, phrase) LEFT JOIN cover USING (lang, phrase)
             WHERE b IS NULL OR 100 * b < 80 * m.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query
def op13_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.is_held_out(F.col("doc_id")))
    scored = toxicity.score_documents(docs, toxicity.fit(toxicity.labelled_documents(docs, labels)))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
