"""Toxicity, language and mixing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweave.llm import language, mixing, toxicity
from postweave.llm.language import Chain, identify
from postweave.llm.mixing import Mix, mix, rake
from postweave.llm.toxicity import Machine, fit_toxicity, scored

from .helpers import ODD, empty, odd


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_machine_learns_an_interaction():
    """Neither term alone says anything; together they do."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    y = (a == b).astype(float)
    doc = np.repeat(np.arange(4000), 2)
    at = np.stack([a, 2 + b], 1).ravel()
    m = Machine(np.arange(4), 4).fit(doc, at, y, epochs=40)
    assert (((m.scores(doc, at, 4000) >= 0.5) == y).mean()) > 0.95


def test_raw_is_the_double_sum_over_pairs():
    """w0 + sum of weights + sum over pairs of dot products, term by term."""
    rng = np.random.default_rng(6)
    m = Machine(np.arange(12), 3)
    m.w0, m.w, m.v = 0.3, rng.normal(size=12), rng.normal(size=(12, 3))
    sets = [sorted(rng.choice(12, n, replace=False).tolist()) for n in (0, 1, 2, 5, 12)]
    doc, at = np.repeat(np.arange(5), [len(s) for s in sets]), np.array([x for s in sets for x in s], int)
    want = [0.3 + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for k, i in enumerate(s) for j in s[k + 1:]) for s in sets]
    assert np.allclose(m.raw(doc, at, 5)[0], want)


def test_gradient_is_that_of_the_log_loss():
    rng = np.random.default_rng(7)
    doc, at, y = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 2, 1, 0, 1, 3]), np.array([1.0, 0, 1])
    start = Machine(np.arange(4), 2)
    start.v = rng.normal(0, 0.5, (4, 2))

    def loss(m):
        p = m.scores(doc, at, 3)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    losses = []
    for epochs in (0, 1, 5, 30):
        m = Machine(np.arange(4), 2)
        m.v = start.v.copy()
        losses.append(loss(m.fit(doc, at, y, epochs=epochs, rate=0.05)))
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 2


def test_toxicity_learns_an_interaction_from_texts(spark):
    """Two words that are common in clean texts, each as common as in toxic ones, and toxic together."""
    rng, rows = random.Random(8), []
    for i in range(4000):
        words = [f"w{rng.randint(0, 60)}" for _ in range(12)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultword"] * a + ["groupword"] * b
        rng.shuffle(words)
        # alone each is as frequent among toxic rows as among clean ones
        rows.append((i, " ".join(words), int(a == b)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in scored(docs, fit_toxicity(spark, docs, labels)).select("doc.doc_id", "score").collect()}
    out = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if held(i, 5) == 0]
    assert sum(out) / len(out) > 0.95


def test_a_small_share_is_not_lost(spark):
    """Shares far below a millionth still name about as many rows as they should."""
    n = spark.range(2_000_000).filter(toxicity.below(F.xxhash64("id"), F.lit(5e-6))).count()
    assert 2 <= n <= 25 and spark.range(1000).filter(toxicity.below(F.xxhash64("id"), F.lit(1.0))).count() == 1000


def toxic_corpus(n):
    rng, rows = random.Random(1), []
    for i in range(n):
        bad = rng.random() < 0.15
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(rng.randint(5, 200))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(("grobian", "grobiane", "lout")) + rng.choice(("", ".", "!")))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in scored(docs, fit_toxicity(spark, docs, labels)).select("doc.doc_id", "score").collect()}
    out = [(got[i] >= 0.5, y) for i, _, y in rows if held(i, 5) == 0]
    assert sum(p == bool(y) for p, y in out) / len(out) > 0.97
    # labels of held-out rows have no part in the model
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in scored(docs, fit_toxicity(spark, docs, wrong)).select("doc.doc_id", "score").collect()}
    assert again == got


def test_toxicity_of_odd_rows(spark):
    machine = fit_toxicity(spark, odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    got = scored(odd(spark), machine).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got) and {r.doc.score for r in got} == {"clash"}
    assert scored(empty(spark), machine).collect() == []
    some = spark.createDataFrame([(1, None), (7, 1), (None, 1), (7, 0)], "doc_id long, toxic int")
    fit_toxicity(spark, odd(spark), some)


WORDS = {"aa": ["das", "nicht", "und", "schnell", "haus"], "bb": ["the", "quick", "and", "house", "not"], "cc": ["que", "casa", "rapido", "los", "nunca"]}


def test_language_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "en", "s")) for _ in range(rng.choice((3, 40, 400)))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(spark, docs, language.fit_language(spark, docs)).collect()}
    out = [got[i].lang_pred == lang for i, _, lang in rows if held(i, 4) == 2]
    assert sum(out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_every_language_is_a_label(spark):
    """Rare ones too; the sample and the model stay bounded."""
    rows = [(i, f"wort{i % 80} text", f"l{i % 80 if i % 3 else i % 2}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {lang for i, _, lang in rows if held(i, 4) != 2}
    labels, got = language.sample(spark, docs, 600, language.LANGUAGES)
    assert len(want) > language.LANGUAGES and set(labels) == want == {lang for lang, _ in got}
    assert len(language.sample(spark, docs, 8, 10)[1]) < 300
    assert Chain([str(k) for k in range(1000)]).weights.size < 2 * Chain([str(k) for k in range(64)]).weights.size


def test_many_labels_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    chain = Chain([f"l{k}" for k in range(300)])
    chain.weights[:] = rng.normal(0, 1, chain.weights.shape)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 10)) for _ in range(4096)] + [" ".join(f"w{x}" for x in rng.integers(0, 9000, 3000))]
    tracemalloc.start()
    found, _ = language.label_batch(chain, pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4097 and peak < 500e6


def test_sampled_words_are_of_whole_texts(spark):
    """Runs come from all parts of long texts, and about as many words as the bound names."""
    rows = [(i, " ".join(f"w{j}" for j in range(4000)), "aa") for i in range(60)]
    _, got = language.sample(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30, 64)
    at = np.array([int(w[1:]) for _, run in got for w in run.split()])
    assert 30 * 160 * 0.5 < len(at) < 30 * 160 * 2 and all(((lo <= at) & (at < lo + 1000)).mean() > 0.1 for lo in range(0, 4000, 1000))


def test_words_of_mixed_text():
    """Code switching: the labels of words follow the languages within one text."""
    rng, labels = random.Random(3), ["aa", "bb"]
    words, y = [], []
    for _ in range(200):
        k = rng.randrange(2)
        for _ in range(rng.randint(4, 20)):
            words.append(rng.choice(WORDS[labels[k]]).encode())
            y.append(k)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    data = np.frombuffer(b" ".join(words), np.uint8)
    chain = Chain(labels).fit(data, end - size, end, np.array(y), 40, epochs=6)
    assert chain.moves[0, 0] > chain.moves[0, 1] and chain.moves[1, 1] > chain.moves[1, 0]
    scores = chain.emissions(*language.features(data, end - size, end), len(words))
    assert (chain.marginals(scores, np.array([len(words)])).argmax(1) == np.array(y)).mean() > 0.98


@pytest.mark.parametrize("cells", [9, 27, 1 << 21])
@pytest.mark.parametrize("lengths", [[1], [128], [129], [5, 300, 1, 128, 1500, 400]])
def test_segments_give_exact_marginals(lengths, cells, monkeypatch):
    monkeypatch.setattr(language, "SLICE", 3)
    monkeypatch.setattr(language, "CELLS", cells)
    rng = np.random.default_rng(4)
    chain = Chain(["a", "b", "c"])
    chain.moves = rng.normal(0, 1, (3, 3))
    scores = rng.normal(0, 2, (sum(lengths), 3))
    got, at = chain.marginals(scores, np.array(lengths)), 0
    for n in lengths:
        e, t = np.exp(scores[at: at + n]), np.exp(chain.moves)
        alpha, beta = [np.full(3, 1 / 3) @ t * e[0]], [np.ones(3)]
        for k in range(1, n):
            alpha.append(alpha[-1] @ t * e[k])
            alpha[-1] /= alpha[-1].sum()
        for k in range(n - 1, 0, -1):
            beta.append(t @ (e[k] * beta[-1]))
            beta[-1] /= beta[-1].sum()
        p = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[at: at + n], p / p.sum(1, keepdims=True), atol=1e-6)
        at += n


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    got = identify(spark, docs, language.fit_language(spark, docs)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert identify(spark, empty(spark), language.fit_language(spark, empty(spark))).collect() == []
    none = identify(spark, docs, Chain([])).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_rake_meets_its_margins():
    rng = np.random.default_rng(5)
    mass, a, b = rng.random(60) + 0.1, rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    ta, tb = np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])
    w = rake(mass, [a, b], [ta, tb], 500, 1e-12)
    assert np.allclose(np.bincount(a, w), ta, atol=1e-6) and np.allclose(np.bincount(b, w), tb, atol=1e-6)


def sums(mixed, by):
    return {r[by]: r.t for r in mixed.groupBy(by).agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en" if i % 4 else "de", f"s{i // 4 % 3 if i % 5 else 0}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = Mix(keep=0.3, targets={"source": {"s0": 1, "s1": 1, "s2": 1}, "lang": {"de": 1, "en": 1}})
    got = mix(spark, docs, how)
    total = got.agg(F.sum("tokens")).first()[0]
    expected = got.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert abs(expected / total - 0.3) < 1e-6
    by = sums(got, "source")
    assert max(by.values()) / min(by.values()) < 1.02
    kept = {r.source: r.t for r in got.filter("sampled").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert max(kept.values()) / min(kept.values()) < 1.25
    assert got.filter("sampled").count() == mix(spark, docs.repartition(7), how).filter("sampled").count()


def test_mixing_meets_targets_with_cells_kept_whole(spark):
    """Some cells are wanted more than whole; the other cells of their margins make up for them."""
    rows = [(i, "w w w", "en" if i % 10 < 7 else "de", "s0" if i % 10 not in (0, 7) else "s1") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = Mix(keep=0.8, targets={"lang": {"en": 0.65, "de": 0.35}, "source": {"s0": 0.76, "s1": 0.24}})
    got = mix(spark, docs, how)
    report = {(r.margin, r.value): r for r in mixing.margins(got, how).collect()}
    assert got.agg(F.max("probability")).first()[0] == 1 and got.agg(F.max("factor")).first()[0] * how.keep > 1
    assert all(abs(r.expected - r.target) < 1e-6 for r in report.values())
    assert abs(got.agg(F.avg("probability")).first()[0] - 0.8) < 1e-6
    # out of reach: 0.2 of the tokens are at most 0.25 of the sample, and the report says so
    far = Mix(keep=0.8, targets={"source": {"s0": 0.6, "s1": 0.4}})
    report = {(r.margin, r.value): r for r in mixing.margins(mix(spark, docs, far), far).collect()}
    assert abs(report["source", "s1"].expected - 0.25) < 1e-6 and abs(report["source", "s1"].target - 0.4) < 1e-9


def naive_raking(rows, keep, power, rounds=400):
    """Row by row, without cells: weights scaled margin by margin, then again below a bound for each row."""
    n = len(rows)
    mass = [len((r["text"] or "").split()) for r in rows]
    total = sum(mass)
    margins = [[r[m] for r in rows] for m in ("source", "lang", "topic")]
    targets = []
    for values in margins:
        own = {}
        for v, m in zip(values, mass):
            own[v] = own.get(v, 0) + m / total
        own = {v: x ** power if x else 0.0 for v, x in own.items()}
        targets.append({v: x / sum(own.values()) for v, x in own.items()})
    weight = [m / total for m in mass]
    for _ in range(rounds):
        for values, target in zip(margins, targets):
            now = {v: 0.0 for v in target}
            for v, w in zip(values, weight):
                now[v] += w
            weight = [w * target[v] / now[v] if now[v] else 0.0 for v, w in zip(values, weight)]
    factor = [w * total / m if m else None for w, m in zip(weight, mass)]
    cap = [m / total / keep for m in mass]
    own, goals = list(weight), []
    for values, target in zip(margins, targets):
        most = {v: 0.0 for v in target}
        for v, c in zip(values, cap):
            most[v] += c
        goal, full = dict(target), set()
        while over := {v for v in goal if v not in full and goal[v] > most[v] + 1e-15}:
            full |= over
            rest, free = 1 - sum(most[v] for v in full), sum(target[v] for v in target if v not in full)
            goal = {v: most[v] if v in full else target[v] * rest / free for v in target}
        goals.append(goal)
    for _ in range(rounds):
        for values, goal in zip(margins, goals):
            now = {v: 0.0 for v in goal}
            for v, c, w in zip(values, cap, own):
                now[v] += min(c, w)
            own = [w * goal[v] / now[v] if now[v] else w for v, w in zip(values, own)]
    for _ in range(rounds):
        now = sum(min(c, w) for c, w in zip(cap, own))
        own = [w / now for w in own]
    return factor, [min(1.0, min(c, w) / c) if c else 1.0 for c, w in zip(cap, own)]


def mixed_rows():
    rng, rows = random.Random(11), []
    for i in range(500):
        text = " ".join(["w"] * rng.randint(0 if i else 1, 12)) or None
        rows.append({"doc_id": i, "text": text, "lang": rng.choice(("en", "en", "en", "de", "")), "source": rng.choice(("a", "a", "a", "a", "b", "c")), "topic": rng.choice(("x", "x", "x", "y"))})
    return rows


@pytest.mark.parametrize("keep,on_driver", [(0.1, True), (0.8, True), (0.8, False)])
def test_mixing_against_naive_raking(spark, monkeypatch, keep, on_driver):
    """Factors, probabilities and margins, topic included, on the driver's cells and over DataFrames."""
    if not on_driver:
        monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    rows = mixed_rows()
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, topic string")
    how = Mix(keep=keep, power=0.5, rounds=100 if on_driver else 10, tolerance=1e-9 if on_driver else 1e-7)
    got = {r.doc_id: r for r in mix(spark, docs, how, topic="topic").collect()}
    factor, rate = naive_raking(rows, keep, 0.5)
    near = 1e-6 if on_driver else 2e-3
    for r, f, p in zip(rows, factor, rate):
        if r["text"]:
            assert abs(got[r["doc_id"]].factor - f) < near * max(1, f) and abs(got[r["doc_id"]].probability - p) < near, (r, f, p, got[r["doc_id"]])
    assert any(p > 0.999 for r, p in zip(rows, rate) if r["text"]) == (keep == 0.8)


def test_mixing_of_odd_rows(spark, monkeypatch):
    clash = odd(spark)
    for name in ("doc", "topic", "factor", "probability", "sampled", "_source", "_topic", "mass"):
        clash = clash.withColumn(name, F.lit("clash"))
    got = mix(spark, clash).collect()
    assert len(got) == len(ODD) and {r.doc.sampled for r in got} == {"clash"} and got[0].doc.asDict().keys() == set(clash.columns)
    assert mix(spark, empty(spark)).collect() == []
    assert mix(spark, odd(spark).filter("coalesce(text, '') = ''")).filter("probability = 1").count() == 3
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    assert mix(spark, odd(spark), Mix(rounds=3)).count() == len(ODD)
    assert mix(spark, odd(spark).filter("coalesce(text, '') = ''")).filter("probability = 1").count() == 3
