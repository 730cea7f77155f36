"""Duplicate operators and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import components, decontaminate, exact_dedup, near_dedup, shingles
from tests.llm import brute


@pytest.fixture(scope="module")
def family():
    """Chains of texts that differ more and more, decoys just below the limit, and copies."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=120)
        for step in range(8):
            out.append(" ".join(base))
            for _ in range(1 + step % 3):
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        out += [out[-1], " ".join(base[:60] + rng.choices(vocabulary, k=60))]
    return out + ["", "two words", "Two  words", "a b c d", None]


@pytest.mark.parametrize("pivots, crowd, dealt", [(2048, 16, 512), (2, 3, 2)])
def test_near_components(spark, family, monkeypatch, pivots, crowd, dealt):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "DEALT", dealt)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rows = [(i, t, "x", 9) for i, t in enumerate(family)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id int").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    sizes, roots = brute.near_components(family)
    assert [got[i].n_shingles for i in range(len(family))] == sizes
    assert [got[i].component_id for i in range(len(family))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)
    assert 1 < len(set(roots)) < len(family)


def test_near_duplicates_of_odd_rows(spark, docs, odd_texts):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(odd_texts) + 2
    sizes, roots = brute.near_components(odd_texts)
    for r in rows:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id, r.kept) == (1, None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (100, 400, 900):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        one, two = shingles.fast_sketches([a, b], 512)
        assert abs(float((one == two).mean()) - shared / (2000 - shared)) < 0.09
    short = shingles.fast_sketches([pool[:1], pool[:1], pool[:0]], 64)
    assert (short[0] == short[1]).all() and len(set(short[0].tolist())) == 64
    assert (short[2] == np.iinfo(np.uint64).max).all()


def test_shingle_sets_match_brute_force(odd_texts):
    texts = [t or "" for t in odd_texts]
    assert [len(s) for s in shingles.shingle_sets(pa.array(texts))] == [len(brute.shingles(t)) for t in texts]


def test_private_shingles_are_never_overcounted(spark, family):
    texts = {shingles.set_key(x): t for t in family if t and (x := shingles.shingle_sets(pa.array([t]))[0]) is not None}
    df = spark.createDataFrame(list(texts.items()), "key binary, text string").repartition(3)
    sets = {k: brute.shingles(t) for k, t in texts.items()}
    expected = {k: len(s - set().union(*(o for j, o in sets.items() if j != k))) for k, s in sets.items()}
    got = {bytes(r.key): r.private for r in near_dedup.private_counts(df).collect()}
    assert all(got.get(k, 0) == n for k, n in expected.items())


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    edges += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    roots = brute.groups(400, edges)
    assert got == {i: roots[i] for e in edges for i in e if e[0] != e[1] or i in {x for y in edges if y[0] != y[1] for x in y}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_groups(spark, docs, odd_texts):
    index = exact_dedup.DigestIndex(spark, "digests_groups", 4)
    rows = index.absorb(docs, "one").collect()
    texts = [t or "" for t in odd_texts] + ["no id here", odd_texts[6]]
    assert len(rows) == len(texts)
    for r in rows:
        text = "no id here" if r.doc_id is None else texts[r.doc_id]
        same = [i for i, t in enumerate(odd_texts) if (t or "") == text]
        keep = max(same) if same else None
        assert bytes(r.digest) == hashlib.sha256(text.encode()).digest()
        assert (r.keep_id, r.group_size, r.kept) == (keep, texts.count(text), r.doc_id == keep)
    assert index.absorb(docs.limit(0), "none").count() == 0


def test_index_is_kept_between_batches(spark):
    def table(*rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    index = exact_dedup.DigestIndex(spark, "digests_batches", 3)
    index.absorb(table((1, "a"), (2, "b"), (3, "a")), "one").collect()
    index = exact_dedup.DigestIndex(spark, "digests_batches")
    second = index.absorb(table((10, "a"), (11, "c"), (12, "c")), "two")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in second.collect()}
    assert found == {10: (3, 3, False), 11: (12, 2, False), 12: (12, 2, True)}
    assert index.rows().count() == 3
    again = index.absorb(table((10, "a"), (11, "c"), (12, "c")), "two").where("kept").collect()
    assert [r.doc_id for r in again] == [12] and index.rows().count() == 3
    plan = index.rows().join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("Physical Plan")[1]


ITEMS = [
    (7, "Which of the nine planets is nearest to the sun, and why is it so?"), (8, "short item"),
    (9, "Which of the nine planets is nearest to the sun, and why not?"), (10, None), (11, "---"), (None, "nameless thing"),
]


def test_decontamination(spark):
    texts = [
        "Before. WHICH of the nine-planets is nearest to the SUN and then something else",
        "a short  item, and short-item again; short items", "nothing here", None, "", "which of the nine planets is nearest",
        "nameless THING", "É which of the nine planets is nearest to the sun and why is it so é" * 2,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (200_000, 3):  # one block, and several passes
        rows = decontaminate.scan(df.repartition(3), items, ["doc_id", "hits"], block_windows=limit).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, found = brute.contaminated(texts[r.doc_id], ITEMS)
            assert (r.n_words, {h.word for h in r.hits}) == (n, hit) and len(r.hits) == len(hit)
            assert r.item_ids == sorted(found - {None})
            words = brute.ITEM_WORD.findall((texts[r.doc_id] or "").translate(brute.LOWER))
            for h in r.hits:
                assert texts[r.doc_id][h.start : h.end].translate(brute.LOWER) == words[h.word]
    assert decontaminate.scan(df, items.limit(0), ["doc_id"]).where(F.size("hits") > 0).count() == 0
    assert decontaminate.scan(df.limit(0), items, ["doc_id"]).count() == 0


def test_queries_on_the_smallest_tables(spark):
    from cohortlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    sizes, roots = brute.near_components([r.text for r in rows])
    got = {r.doc_id: r for r in QUERIES["op4_minhash_near_dedup"](spark, folder).collect()}
    for i, r in enumerate(rows):
        assert (got[r.doc_id].n_shingles, got[r.doc_id].component_id) == (sizes[i], rows[roots[i]].doc_id)


def test_more_words_than_symbols(spark):
    """1.3 million different words: more than one automaton has characters for."""
    n = 130_000
    word = [F.concat(F.lit("w"), (F.col("id") * 10 + i).cast("string")) for i in range(10)]
    items = spark.range(0, n, 1, 8).select(F.col("id").alias("item_id"), F.concat_ws(" ", *word).alias("text"))
    blocks = list(decontaminate.window_blocks(items, "item_id", "text", decontaminate.BLOCK_WINDOWS))
    assert [len(b) for b in blocks] == [100_000, 30_000] and sum(len(b) for b in blocks) == n
    ends = (0, 99_999, 100_000, n - 1)
    texts = [" ".join(f"W{i * 10 + j}" for j in range(10)) for i in ends] + ["w1 w0"]
    scanners = [decontaminate.Scanner(b) for b in blocks]
    words = decontaminate.doc_words(pa.array(texts))
    found = sorted((first, size, *ids) for s in scanners for first, size, ids in s.found(words))
    assert found == [(10 * k, 10, i) for k, i in enumerate(ends)]
    # a block holds one window at least, also of more words than it may have
    again = list(decontaminate.window_blocks(items.limit(5).union(items.limit(5)), "item_id", "text", 9, 4))
    assert [len(b) for b in again] == [1] * 10
