import hashlib
import random

import numpy as np

from postweave.llm import fingerprints
from postweave.llm.fingerprints import bucket_counts, digest, fingerprint, likeness

from .helpers import ODD, empty, odd


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + after[:m]
        f, e, n = (digest(x.encode()) for x in (own, edited, after))
        out[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, n))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abcdefé🙂 \n", k=rng.choice((0, 1, 2, 30, 400))))) for i in rng.sample(range(-500, 5000), 150)] + [(9000, None)]
    got = fingerprint(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_near_texts_are_nearer():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "e", "ing", "ou", "tion")]
    base = " ".join(rng.choices(words, k=300))
    near = base.replace("ban", "gou", 3)
    far = " ".join(f"{rng.randint(0, 10**6)}" for _ in range(300))
    assert digest(base.encode()) == digest(base.encode()) and likeness(digest(base.encode()), digest(base.encode())) == 1.0
    assert likeness(digest(base.encode()), digest(near.encode())) > likeness(digest(base.encode()), digest(far.encode()))
    assert 0 <= likeness("00" + "00" * 32, "ff" + "ff" * 32) <= 1


def test_counts_in_pieces(monkeypatch):
    data = bytes(np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8))
    whole = bucket_counts(data)
    monkeypatch.setattr(fingerprints, "CHUNK", 700)
    assert (bucket_counts(data) == whole).all()


def test_odd_rows(spark):
    got = fingerprint(spark, odd(spark)).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, *_ in ODD)
    assert fingerprint(spark, empty(spark)).collect() == []
    one = fingerprint(spark, spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
