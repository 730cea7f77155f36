"""The named queries of these operators and their SQL twins."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from cohortlens.llm import (
    bpe_chunks, decontaminate, exact_dedup, kneser_ney, near_dedup, personal, phrases, secret_scan, spelling, token_counts,
    token_store, toxicity, warc,
)
from cohortlens.session import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def new_name(kind: str) -> str:
    """A name for a table or folder of one run."""
    return f"{kind}_{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by pattern and by novelty."""
    found = secret_scan.scan(documents(spark, sf_dir), ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("novel"),
    )


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts by digest; the largest doc_id of each stays."""
    index = exact_dedup.DigestIndex(spark, new_name("digests"))
    rows = index.absorb(documents(spark, sf_dir), "first")
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def id_digests(tokenizer, encoded: list) -> list[pa.Array]:
    """Number of ids, digest of the ids in decimal, digest of the text decoded from them."""
    decimal = [b"%d" % i for i in range(tokenizer.get_vocab_size())]
    ids = [x.tolist() for x in encoded]
    decoded = tokenizer.decode_batch(ids, skip_special_tokens=False)
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(b" ".join([decimal[i] for i in x])).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
    ]


ID_DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]


@query()
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_chunks.encode(documents(spark, sf_dir), path, ["doc_id"], finish=id_digests, fields=ID_DIGESTS)


@query()
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a shingle similarity of 0.85 or more."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text by a model of the texts outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = kneser_ney.fit(docs.where(~kneser_ney.held_out()))
    out = kneser_ney.score(docs, model, ["doc_id"])
    return out.select(
        "doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query(r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
        SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM items WHERE len(w) > 0)),
places AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN wins USING (size, win)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside passages of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(documents(spark, sf_dir), items, ["doc_id"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query("""
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER same
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER same
            THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    warc.register(spark)
    folder = f"{shared_folder(spark)}/{new_name('warc')}"
    records = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records.write.format("warc").mode("append").option("compression", "gzip").save(folder)
    return warc.read_pages(spark, folder)


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every text, learned outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(documents(spark, sf_dir), labels, ["doc_id"])
    return out.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.count_tokens(documents(spark, sf_dir), path, ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the written id array."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/{new_name('tokens')}"
    return token_store.read(token_store.write(documents(spark, sf_dir), path, folder, end_id=0))


@query(r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
counts AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k)
    GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts),
inside AS (
    SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS longer FROM (
        SELECT lang, w, f, size, unnest(range(1, k - size + 2)) AS i
        FROM found, (VALUES (2), (3)) AS sizes(size) WHERE k > size)
    GROUP BY ALL),
cuts AS (
    SELECT lang, phrase, f AS a, cut, array_to_string(w[:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM found WHERE k > 1)),
scored AS (
    SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
    FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = first JOIN counts r ON r.lang = c.lang AND r.phrase = rest),
worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
    FROM worst s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words."""
    return phrases.collocations(documents(spark, sf_dir))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the more common word one edit away, and the last word on that way."""
    return spelling.group_variants(documents(spark, sf_dir))


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text by pattern and by context."""
    found = personal.scan(documents(spark, sf_dir), ["doc_id"])
    names = F.array(*[F.lit(k) for k in personal.KINDS])

    def count(kind: str):
        number = personal.KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["kind"] < personal.KINDS.index("context"))
    return found.select(
        "doc_id", *[count(k) for k in personal.KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("context"),
    )
