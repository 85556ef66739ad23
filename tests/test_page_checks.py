"""Page checks and blanks: cheap looks first, the same results as the patterns alone."""

import random

from pyspark.sql import functions as F

from roost import rules
from roost.functions import text as T
from roost.operators import outcomes

BITS = [
    "pardon our interruption", "Forbidden", "forbıdden", "FORBİDDEN", "acceſs denied", "acceß denied", "DATADOME", "enable JavaScript",
    "sentimos la interrupciÓn", "sentimos la interrupcixn", "CAPTCHA-delivery.com", "var  dd = {", "var x {", "disable any ad blocKer", "otra casa", "",
]


def test_pages_are_classified_as_by_the_patterns(spark):
    draw = random.Random(4)
    rows = [(" ".join(draw.sample(BITS, draw.randint(0, 2))),) for _ in range(800)] + [(None,)]
    pages = spark.createDataFrame(rows, "html string")
    html = F.col("html")
    ok = F.lit(200)
    for name, pattern in (("idealista", outcomes.CHALLENGE["idealista"]), ("tucasa", rules.BOT_BLOCK)):
        met = F.coalesce(html.rlike(pattern), F.lit(False))
        got = outcomes.portal_page_class(name, ok, html) == "challenge"
        assert pages.filter(met).count() > 100 and pages.filter(met != got).isEmpty()
        # the pattern is only tried on pages that hold a word of it
        assert "contains(" in pages.select(got)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_blanks_collapse_as_by_the_whole_class(spark):
    draw = random.Random(5)
    signs = T.WS_CHARS + "  ab\x00\x1c\x85​᠎é"
    rows = [("".join(draw.choice(signs if i % 2 else " \t\n\x0b\f\r  ab") for _ in range(draw.randint(0, 12))),) for i in range(2000)]
    texts = spark.createDataFrame([*rows, (None,)], "t string")
    whole = F.trim(F.regexp_replace("t", f"{T.WS}+", " "))
    assert texts.filter(~whole.eqNullSafe(T.collapse_ws(F.col("t")))).isEmpty()
