"""STR-3/4: entities are replaced within the plan, as ``html.unescape`` does."""

from __future__ import annotations

import html
import random

from pyspark.sql import functions as F

from tapeworks.functions.html import article_body, strip_html, unescape_entities


def _texts() -> list[str | None]:
    rng = random.Random(5)
    texts = [None, "", "&", "&&", "a & b", "&" + "a" * 40 + ";", "&amp;amp;", "&notit;", "&#" + "9" * 40 + ";", "&#0000000065;x"]
    for name in html.entities.html5:
        texts += [f"&{name}", f"a &{name}x"]
    for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000]:
        texts += [f"&#{n};", f"&#x{n:x}z", f"&#X00{n:X};"]
    parts = ["&", "&#", "x", ";", "a", "amp", "lt", "not", "notin", " ", "\n", "41", "é", "😀", "\x01", "\x02", "AMP", "gt"]
    return texts + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]


def test_entities_as_the_library(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = {r.i: r.u for r in df.select("i", unescape_entities(F.col("t")).alias("u")).collect()}
    wrong = [(t, found[i]) for i, t in enumerate(texts) if found[i] != (None if t is None else html.unescape(t))]
    assert not wrong


def test_no_text_goes_through_python(spark):
    df = spark.createDataFrame([("<p>" + "Rates &amp; prices &mdash; " * 4 + "</p>",)], "h string").select(strip_html(F.col("h")).alias("s"), article_body(F.col("h")).alias("b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().s == ("Rates & prices — " * 4).strip() == df.first().b
