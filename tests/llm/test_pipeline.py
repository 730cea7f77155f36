"""The pipeline on a small table against the stages' plain versions."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from cohortlens.llm import toxicity
from cohortlens.llm.units import load
from tests.llm import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=25))) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(vocabulary, k=60)
        bad = rng.random() < 0.3
        if bad:
            words[10:10] = ["you", "stupid", "moron", "you", "idiot"] * 2
        rows.append([i, " ".join(words)])
        labels.append((i, int(bad)))
    for i in range(0, 40, 2):
        rows.append([300 + i, rows[i][1]])
        rows.append([301 + i, rows[i + 1][1] + " tail"])
    for i in range(400, 410):
        rows.append([i, "start " + items[i % 5][1][10:120] + " end"])
    rows += [[410, None], [411, ""], [412, ""], [None, "no id"], [None, "no id"], rows[50]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, "de", f"s{k % 3}", k) for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, row string, score long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [tuple(r) for r in rows], items


def test_stages_and_result(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, labels, ["doc_id", "text"]).collect()}
    left = [r for r in rows if scores[r] < 0.5]
    assert 150 < len(left) < len(rows) - 50
    best = {}
    for i, t in left:
        text = t or ""
        known = best.get(text)
        best[text] = i if known is None else max(known, -1 if i is None else i)
    left = [(best[t], t) for t in best]
    order = sorted(left, key=lambda r: (r[0] is None, r[0]))
    _, roots = brute.near_components([t for _, t in order])
    left = [r for k, r in enumerate(order) if roots[k] == k]
    left = [(i, t) for i, t in left if not brute.contaminated(t, items)[1]]
    tokenizer, expected = load(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, t in left:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_stages_keep_columns_and_take_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]


def test_near_duplicates_from_four_fifths_on(spark):
    """Pairs from 0.80 to 0.85 are near duplicates in the stage, those just below 0.80 are not."""
    rng, texts = random.Random(6), []
    for k in range(80):
        words = [f"x{rng.randrange(10**9)}" for _ in range(100 if k % 2 else 88)]
        other = list(words)
        other[20], other[60] = "one", "two"  # ten shingles: 86 of 106 are shared, or 74 of 94
        texts += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, roots = brute.near_components(texts, 80)
    kept = {i for i, r in enumerate(roots) if r == i}
    assert len(kept) == 120 and len(set(brute.near_components(texts)[1])) == 160
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert {r.doc_id for r in got.collect()} == kept
