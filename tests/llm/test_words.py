"""Spelling variants and phrases against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import phrases, spelling, word_ids
from cohortlens.llm.hat_trie import HatTrie, halves, merged, packed
from cohortlens.session import shared_folder
from tests.llm import brute_words


def misspelt(rng, word):
    i, letter = rng.randrange(len(word)), rng.choice("abé")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])


@pytest.fixture(scope="module")
def spelt():
    """Words with misspelt ones, runs of a letter, anagrams and a very long word."""
    rng = random.Random(11)
    base = ["anaab", "banaba", "straße", "éééééé", "aaaaaaa", "abababab", "ba" * 12, "zusammenhang", "ÀÖØÿÿ", "x" * 3000]
    base += ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    words = [w for w in base for _ in range(rng.randrange(1, 40))]
    words += [misspelt(rng, rng.choice(words)) for _ in range(900)]
    words += ["kettenaa"] * 4 + ["kettenab"] * 9 + ["kettencb"] * 22 + ["rettencb"] * 60
    rng.shuffle(words)
    return [(i if i % 9 else None, " ".join(words[i * 6 : i * 6 + 6]).replace("b ", "B1"), "x") for i in range(len(words) // 6)]


def test_variants(spark, spelt, odd_texts):
    rows = [*spelt, *[(i, t, "y") for i, t in enumerate(odd_texts)], spelt[4], spelt[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    want = brute_words.spelling_forms([r[:2] for r in rows])
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert spelling.group_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts,subparts", [(1, 3), (1, 4), (2, 2), (3, 1)])
def test_signatures_lose_no_near_vector(spark, parts, subparts):
    rng = random.Random(3)
    vectors = [sorted(rng.sample("abcdefghijklmnop", 8)) for _ in range(60)]
    vectors += [sorted(set(v) ^ set(rng.sample("abcdefghijklmnop", rng.choice([1, 2])))) for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), "i long, v array<string>")
    rows = df.select("v", F.array(*spelling.partenum(F.col("v"), 2, parts, subparts)).alias("s")).collect()
    for x in rows:
        for y in rows:
            if len(set(x.v) ^ set(y.v)) <= 2:
                assert any(a == b for a, b in zip(x.s, y.s, strict=True))
    with pytest.raises(ValueError):
        spelling.partenum(F.col("v"), 2, 1, 2)


@pytest.fixture(scope="module")
def spoken(odd_texts):
    """Texts of few words in some languages, a line that all share, and odd texts."""
    rng = random.Random(21)
    vocab = "the of and New York city san francisco bay É\x01 q\x7f a-b new york".split(" ")
    weights = [30, 20, 15, 6, 6, 4, 5, 5, 3, 2, 1, 2, 4, 4]
    rows = []
    for i in range(260):
        words = rng.choices(vocab, weights, k=rng.randrange(80))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + "the line that all of them share"))
    return rows + [(rng.choice(["en", None]), t) for t in odd_texts] + rows[:5]


@pytest.mark.parametrize("sizes", [{}, {"part_windows": 40, "burst": 16, "limit": 64}])
def test_phrases(spark, spoken, sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in spoken], "lang string, text string, n int, phrase string").repartition(3)
    got = phrases.collocations(df, least=6, best=40, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_words.phrases(spoken, least=6, best=40)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60
    assert phrases.collocations(df.limit(0)).count() == 0


def test_trie_counts_and_spills():
    rng = np.random.default_rng(5)
    trie, runs, seen = HatTrie(burst=32, limit=300), [], Counter()
    for _ in range(40):
        words = rng.zipf(1.4, (90, 4)).clip(1, 900)
        hi, lo = halves(words)
        seen.update(zip(hi.tolist(), lo.tolist(), strict=True))
        trie.add(hi, lo)
        assert trie.size == sum(x.size for x in trie.leaves) and trie.bounds == sorted(trie.bounds)
        if trie.full():
            for run in trie.spill(150):
                runs.append(packed(*run))
            assert trie.size <= 150
    runs += [packed(*run) for run in trie.spill()]
    assert len(trie.leaves) > 3 and len(runs) > 2
    hi, lo, n = merged(runs)
    assert dict(zip(zip(hi.tolist(), lo.tolist(), strict=True), n.tolist(), strict=True)) == seen
    assert sorted(zip(hi.tolist(), lo.tolist(), strict=True)) == list(zip(hi.tolist(), lo.tolist(), strict=True))


def test_words_of_equal_hashes_keep_apart(spark, monkeypatch):
    monkeypatch.setattr(word_ids, "word_hashes", lambda langs, words: np.full(len(words), 7, np.uint64))
    rows = pa.table({"bucket": [0] * 3, "lang": ["a", "b", "a"], "word": ["x", "x", "y"], "n": [5, 6, 7]})
    info = word_ids._write(shared_folder(spark) + "/clash")(rows)
    lookup = word_ids.Lookup(word_ids.WordIds(info.column("path").to_pylist(), [1]))
    ids, n = lookup.find(pa.array(["a", "a", "b", "b"]), pa.array(["y", "x", "x", "y"]))
    assert n.tolist() == [7, 5, 6, 0] and ids[3] == 0 and len(set(ids.tolist())) == 4
    assert lookup.rows(ids[:3])[1].to_pylist() == ["y", "x", "x"]
