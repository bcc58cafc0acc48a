"""The registered queries over the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.llm import ann, exact_dedup, genetic_packing, hard_negatives, hmm, mixing, near_dedup, packing, periodic, quality, secrets, substring_dedup, suffix_dedup
from judgespark.llm.common import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch(spark)).open()
    out = exact_dedup.ingest(index, documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    spans = F.col("spans")
    return out.select(
        "doc_id",
        *[secrets.count_of(spans, name).alias(f"n_{name}") for name in ("assign", "access", "hex")],
        F.sha2(secrets.listing(secrets.sure(spans)), 256).alias("base_sha256"),
        secrets.listing(spans).alias("spans"),
        secrets.link_listing(F.col("links")).alias("links"),
    )


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe())


@query(
    "op5_minhash_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words FROM documents
    ), sh AS (
        SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
    ), link AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
        GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
    ), reach(a, b) AS (
        SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
    ), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id,
           w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


@query(
    "op8_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
    ), again AS (
        SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again
    ), each AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s
        FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.s, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(documents(spark, sf_dir))
    shards = F.transform("copies", lambda c: c["shard"]).alias("shards")
    return out.select("doc_id", "size", "source_size", "target", "taken", shards)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def hash_of_id(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query("op4_hmm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.scores(documents(spark, sf_dir), hash_of_id(7) != 2)
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), *columns)


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(ann.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return ann.nearest(ann.build_index(vectors), vectors.where("id % 100 = 0"), k=10)


QUALITY_THRESHOLD = 0.3


def quality_space(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Space:
    """Learned from the labels whose document is not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(hash_of_id(5) != 0)
    return quality.learn(docs, labels.withColumnRenamed("quality", "label"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality.scores(docs, quality_space(spark, docs, sf_dir))
    return out.select(
        "doc_id",
        F.coalesce(hash_of_id(5) == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def with_periodic_part(docs: DataFrame) -> DataFrame:
    """Of every tenth document, by a hash of its id, the words from one on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    chosen = chosen.withColumn("n", F.size("words"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    chosen = chosen.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    both = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), left))
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(both, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse(with_periodic_part(documents(spark, sf_dir)))
    longer = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    run = "struct<start:bigint,length:bigint,period:bigint>"
    out = out.withColumn("best", F.aggregate("runs", F.lit(None).cast(run), longer))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_hard_negatives",
    """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike,
               list_inner_product(a.v, b.v)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    ), p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
        FROM s WHERE alike QUALIFY positive_rank <= 5
    )
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
           s.vec_id AS negative_id, positive_score, s.score AS negative_score, positive_rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
    QUALIFY rank <= 5
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.eligible(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def byte_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack(documents(spark, sf_dir), byte_bpe())
