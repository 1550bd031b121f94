import random
import re
from collections import Counter, defaultdict

import pytest

from postweave.llm import divergence
from postweave.llm.divergence import audit

from .helpers import ODD, empty, odd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {g[1]: shares(counts[g]) for g in groups if g[0] == lang}
        q = shares(whole)
        for s in p:
            own = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", own, None), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, k))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(sources=14):
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260)] + ["Ünö", "漢字", "zero"]
    rows = []
    for s in range(sources):
        for _ in range(rng.randint(1, 6)):
            own = rng.sample(words, 30)
            rows.append((rng.choice(["en", "de", None]), f"s{s}" if s else None, " ".join(rng.choice(own).upper() for _ in range(rng.randint(0, 80)))))
    return [*rows, ("en", "bare", "1 2 3"), ("en", "none", None), ("xx", "alone", "one two one"), ("yy", "a", "x"), ("yy", "b", "y")]


@pytest.mark.parametrize("heavy, block, cells", [(3, 256, 1 << 18), (0, 4, 64), (100, 256, 1 << 18), (5, 3, 1 << 18)])
def test_the_split_gives_the_sums_of_brute_force(spark, monkeypatch, heavy, block, cells):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TILE_CELLS", cells)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(audit(spark, df, heavy=heavy, top=20)) == brute(rows, top=20)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 9 * 10**17, 9_000_000_000_000_000_001
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(12345)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + 12345)


def test_odd_rows_and_an_empty_table(spark):
    want = brute([(r[2], r[3], r[1]) for r in ODD])
    assert found(audit(spark, odd(spark))) == want
    assert audit(spark, empty(spark)).collect() == []
