"""One query per operator over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwright.llm import centroids, chat, decontaminate, edit_counts, language, packing, quality, runs, simhash_trie, sketch, substrings, token_shards, wrapper
from tillwright.llm.common import stage_compressed, table, whole_text
from tillwright.plans.staging import shared_path

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
CENTROIDS, ROUNDS = 40, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op2_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as wavelet-matrix shards and read every document's ids back from the files."""
    path = shared_path(spark, "shards")
    token_shards.write_shards(table(spark, folder, "documents"), path, public_tokenizers.path(WORD_VOCABULARY))
    shards = token_shards.read_shards(spark, path)
    docs = token_shards.read_tokens(shards)
    placed = token_shards.with_part_offsets(shards, docs, F.col("local_start"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


@query
def op9_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_trie.near_duplicates(table(spark, folder, "documents"))


@query
def op5_invertible_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return sketch.fingerprint_edits(table(spark, folder, "documents"))


@query
def op1_greedy_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain a benchmark item, in one piece or reordered."""
    return decontaminate.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return wrapper.extract_main_text(table(spark, folder, "pages"))


@query
def op8_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document."""
    docs = table(spark, folder, "documents")
    return quality.grade_documents(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op10_code_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    return language.predict_language(docs, language.train(docs))


@query
def op3_chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations and one that quotes control strings, read back from the formatted output."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id bigint, turn bigint, role string, text string")
    output = stage_compressed(chat.format_conversations(rows.unionByName(extra)), "chat")
    return chat.digest_of(output)


@query
def op7_edited_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents before and after three edits each: an insertion, a deletion, a replacement.

    The first 40 characters are inserted at a third, 25 are removed in the middle, and 10 near the end are replaced
    by the first 15.
    """
    vocabulary = public_tokenizers.path(BYTE_VOCABULARY)
    trees = stage_compressed(edit_counts.build_trees(table(spark, folder, "documents"), vocabulary), "count-trees")
    size = F.char_length("text")
    change = lambda at, remove, insert: F.struct(
        F.floor(at).cast("bigint").alias("at"), F.lit(remove).cast("bigint").alias("remove"), insert.alias("insert")
    )
    edits = F.array(
        change(size / 3, 0, F.left("text", F.lit(40))), change(size / 2, 25, F.lit("")),
        change(size * 0.9, 10, F.left("text", F.lit(15))),
    )
    return edit_counts.apply_edits(trees.withColumn("edits", edits), vocabulary)


@query
def op11_fm_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents that passages of 35 words standing elsewhere cover, and digests of the words that stay."""
    docs = table(spark, folder, "documents")
    dropped = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["end"] - span["start"])
    found = substrings.repeats_of_texts(docs).select(
        "key", "tag", "n_words", dropped.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
    return substrings.with_repeats(docs, found)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten is made periodic from some word on, by a rule on the id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    drawn = (
        docs.select("doc_id", whole_text().alias("text"), h.alias("h"))
        .withColumn("words", F.when(F.col("h") % 10 == 0, words))
        .withColumn("a", F.expr("h div 10 % size(words)"))
        .withColumn("p", F.expr("1 + (size(words) - a) div (3 + h div 10 % 8)"))
    )
    changed = F.transform("words", lambda word, i: F.when(i < F.col("a"), word).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return drawn.select("doc_id", F.when(F.size("words") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents, and digests of the runs and of the texts without their repeats."""
    found = runs.collapse_runs(with_planted_runs(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "runs", longest.alias("longest"), lines.alias("lines"), "text").select(
        "doc_id", "n_runs", (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query
def op13_ns_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distances and final centroid of every embedding."""
    points = stage_compressed(centroids.integer_vectors(table(spark, folder, "embeddings"), "embedding"), "points")
    drawn = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found = centroids.cluster_vectors(points, centroids.first_centroids(points, drawn, CENTROIDS), ROUNDS)
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    per_cluster = found.assigned.groupBy("cluster").agg(total.alias("own")).withColumn("all", F.sum("own").over(Window.partitionBy()))
    # One row per centroid on both small sides.
    facts = spark.createDataFrame(names, "cluster int, centroid_sha256 string").join(per_cluster, "cluster").select(
        "cluster", "centroid_sha256", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), F.expr("try_cast(`all` as bigint)").alias("inertia"))
    return found.assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql(k: int, rounds: int) -> str:
    """The same rounds as one common table after the other."""
    steps = [f"""
WITH points AS MATERIALIZED (
 SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
 SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM points QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
 SELECT vec_id, any_value(p.v) AS v,
  min(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT * {k} + c) AS best
 FROM points p CROSS JOIN c{r} c GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT best % {k} AS c, i, sum(x)::BIGINT AS s, count(*) AS n
 FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, cast(best % {k} AS INTEGER) AS cluster, best // {k} AS distance,
 cast(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, cast(sum(best // {k}) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best % {k}"""


ORACLE_SQL["op13_ns_clusters"] = _clusters_sql(CENTROIDS, ROUNDS)

ORACLE_SQL["op11_fm_repeats"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM texts),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM starts),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
removed AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM repeated),
sizes AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM numbered ANTI JOIN removed USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL["op3_chat_round_trip"] = """
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
guarded AS (
 SELECT *, regexp_replace(text, '([\\[<])(\\\\*)(/?(?:INST\\]|s>))', '\\1\\\\\\2\\3', 'g') AS safe,
  bool_or(regexp_matches(text, '\\[/?INST\\]|</?s>')) OVER (PARTITION BY conv_id) AS conflict FROM rows)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 cast(4 + sum(6 + length(role) + 1 + length(CASE WHEN conflict THEN safe ELSE text END) + 4) AS BIGINT) AS formatted_chars
FROM guarded GROUP BY conv_id"""
