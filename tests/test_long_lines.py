"""No text may end a JVM or take the square of its length: functions over runs of megabytes."""

import pytest
from pyspark.sql import functions as F

from postweave.functions import mail, quotes, text
from postweave.operators import filters, search

SIZE = 3_000_000
UNITS = {"camel": "AbcdEf", "base64": "aB3/xY9+", "path": "/abc", "marks": "> ", "replies": "Re: ", "spaces": " ", "gap": " ", "letters": "a"}
FUNCTIONS = {
    "bare_subject": text.unre, "one_prefix": text.oneunre, "quote_depth": quotes.quote_depth, "quote_class": quotes.quote_class, "unquote": quotes.unquote, "line_kind": quotes.line_kind,
    "line_class": quotes.line_class, "links": text.link_urls, "urls": text.find_urls, "spamify": text.spamify, "escape": text.escape_html, "search_text": text.sanitize_for_search,
    "kept": search.kept_text, "msgid": mail.normalize_msgid, "ids": mail.bracketed_ids, "unfold": mail.unfold, "lines": mail.body_lines, "anchors": quotes.strip_anchor_tags,
    "rendered": lambda c: quotes.render_stateless(c, 2), "body_hit": lambda c: F.size(filters.body_match_indices(F.array(c), ["zz+y", "a{2}"])), "stripzone": text.stripzone}


@pytest.mark.parametrize("unit", UNITS)
def test_functions_over_a_long_run(spark, unit):
    run = F.repeat(F.lit(UNITS[unit]), SIZE // len(UNITS[unit]))
    own = spark.range(1).select((F.concat(F.lit("x"), run, F.lit("x")) if unit == "gap" else run).alias("x"))
    row = own.select("x", *[f(F.col("x")).alias(n) for n, f in FUNCTIONS.items()]).select(
        "quote_depth", "line_kind", *[F.hash(n).alias(n) for n in FUNCTIONS if n not in ("quote_depth", "line_kind")]).first()
    assert row.quote_depth == (SIZE // 2 if unit == "marks" else 0)
    assert row.line_kind == {"marks": "quote", "spaces": "blank"}.get(unit, "text")
