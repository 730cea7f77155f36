"""Personal data against the plain patterns and the plain rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import personal
from tests.llm import brute_words

ODD = [
    "a@b.c@d.e a@b.c_d@e.f x..y@-.- @a.b a@b a@b..c é@a.de b%+@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256.4 01.002.3.4 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111 1111 1 4111  1111 1111 1111", "+1 (743) 555-3824. +49 30 1234567890123456 ++12 345 678 90 +1",
    "0" * 14 + " " + "9" * 40, "+" + "1 " * 3000, "1." * 9000, "a." * 9000 + "@", "@" * 500 + "a@b.c", "1.1.1." + "0" * 5000 + "1",
    "tel:+1 212 555 0100,mail=x@y.example;card(4111111111111111)", "１２３４ +１２ ٣٤٥",
]


def test_base_spans_as_the_patterns_say(odd_texts):
    rng = random.Random(7)
    texts = ODD + [t[:5000] for t in odd_texts if t]
    texts += ["".join(rng.choice("0123459.@+- ()_%aé\n") for _ in range(rng.randrange(90))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert personal.base_spans(t) == brute_words.personal_base(t), t
    assert personal.base_spans("x" * 300_000 + "1" * 300_000 + "@") == []


def test_contexts_are_pairs_of_words():
    rng = random.Random(9)
    texts = ["".join(rng.choice(['a', 'B', ' ', ' ', '\n', ':', '(', 'é', '|', "'"]) for _ in range(60)) for _ in range(200)] + ["", "a", " : "]
    want = []
    for t in texts:
        words = brute_words.personal_words(t)
        one, two = (personal.string_hashes(pa.array(w, pa.string())) for w in (words[:-1], words[1:]))
        want += personal.pair_hashes(one, two).tolist()
    assert personal.pairs_of_words(personal.lower_texts(pa.array(texts))).tolist() == want


@pytest.fixture(scope="module")
def letters():
    """Addresses and numbers in telling places, unseen identifiers there, and the same kinds of
    strings in places that tell nothing."""
    rng = random.Random(13)

    def seed():
        digits = "".join(rng.choice("0123456789") for _ in range(7))
        return rng.choice([f"u{digits}@mail.example", f"+1 212 {digits[:3]} {digits[3:]}", f"10.{digits[0]}.{digits[1]}.{digits[2]}"])

    filler = "the of and to in is was for on with".split()
    texts = []
    for i in range(240):
        words = rng.choices(filler, k=30)
        words[10] = f"Reach me: {seed()} any time" if i % 2 else f"order {rng.randrange(10**8)} of"
        if i % 12 == 1:
            words[20] = f"reach me: 0170/55{i:04d}" if i % 24 == 1 else f"call (0170/55{i:04d}"
        if i % 12 == 4:
            words[20] = f"to 0170/66{i:04d} in"
        texts.append(" ".join(words))
    # found through identifiers that were found: the second place of those above
    texts += [f"so write back to 0170/55{i:04d} if you can" for i in range(240) if i % 24 == 1]
    texts += [f"or reach me: 0170/55{i:04d} now and then" for i in range(240) if i % 24 == 1]
    texts += [f"so write back to 0180-7{i:04d} if you can" for i in range(2)]
    return texts


def test_unseen_identifiers(spark, letters, odd_texts):
    texts = [*letters, *odd_texts, *ODD]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, letters[1], "y", 2)], "doc_id long, text string, spans string, row int")
    rows = {r.doc_id: r for r in personal.scan(df.repartition(3), ["doc_id", "row", "spans"]).collect()}
    assert len(rows) == len(texts) + 1 and rows[0].row == 1
    scores = brute_words.personal_scores([t or "" for t in texts] + [letters[1]])
    good = {e for e, s in scores.items() if s >= personal.ACCEPTED}
    assert sum(e.startswith("0170/55") for e in good) == 10 and not any(e.startswith("0170/66") for e in good)
    for i, t in enumerate(texts):
        spans = [tuple(s) for s in rows[i].spans]
        base = personal.base_spans(t or "")
        more = [(a, 4, b) for a, b in personal.identifiers(t or "", base) if t[a:b].lower() in good]
        assert spans == sorted(base + more), t
    assert personal.scan(df.limit(0), ["doc_id"]).count() == 0
    plain = personal.scan(df.where("doc_id < 3"), ["doc_id"]).collect()
    assert sum(len(r.spans) for r in plain) == 1


def test_filter_loses_nothing(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(int(h),) for h in hashes], "pattern long")
    bits = personal.bit_filter(df, "pattern", 3000)
    assert personal.passed(hashes, bits).tolist() == hashes.tolist()
    assert len(personal.passed(rng.integers(-(2**63), 2**63, 20_000), bits)) < 1000
    assert not len(personal.passed(hashes, personal.bit_filter(df.where(F.lit(False)), "pattern", 1)))
