"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafill.llm import chat, knn, langid, periods, sharding, simhash, toxicity
from stratafill.llm.aligned import align_documents
from stratafill.llm.archive import page_of, read_archives, write_archives
from stratafill.llm.common import small_batches, table
from stratafill.llm.decontaminate import contamination
from stratafill.llm.linededup import dedup_lines
from stratafill.llm.minhash import near_duplicates
from stratafill.llm.packing import pack_documents
from stratafill.sources.staging import new_path, remove_at_exit, stage

SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes, with its place there."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    records = stage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), sharding.text_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        sharding.place_hash(F.col("doc_id"), text).alias("hash")), "records")
    records = records.withColumn("slot", sharding.slot_of(F.col("hash")))
    path = new_path(spark, "slot_map")
    sharding.save_map(sharding.first_map(sharding.slot_sizes(records), SHARDS), path)
    remove_at_exit(spark, path)
    sharded = sharding.shard_of(records, sharding.load_map(spark, path))
    placed = sharding.places(sharded, "hash", ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in as few sequences of 2048 tokens as best fit finds."""
    import public_tokenizers

    small_batches(spark)
    packed = pack_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"))
    # of the ids that were written and placed
    return packed.select(F.col("_id").alias("doc_id"), "piece", "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier line, and all links of its lines."""
    small_batches(spark)
    cleaned = dedup_lines(table(spark, sf_dir, "documents"), all_links=True)
    return cleaned.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"), F.col("_links").alias("n_links"),
        F.col("_matches").alias("n_matches"), F.col("_classes").alias("class_ids"),
        F.col("_class_matches").alias("class_matches"), "text")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
        "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(stage(chat.format_turns(rows.unionByName(more)), "formatted"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every fiftieth vector among all vectors."""
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as the archives that were written of all pages give it back.

    Responses are read with their payload, of which length and digest are taken; revisits are
    read from their headers alone. Both filters are the source's.
    """
    small_batches(spark, 500)
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    remove_at_exit(spark, path)
    page = page_of("record_id").alias("page_id")
    responses = read_archives(spark, path, ["record_id", "record_type", "refers_to", "payload"])
    revisits = read_archives(
        spark, path, ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])
    return responses.where("record_type = 'response'").select(
        page, F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type",
        page_of("refers_to").alias("refers_to")
    ).unionByName(revisits.where("record_type = 'revisit'").select(
        page, "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        page_of("refers_to").alias("refers_to")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how much of it is inside windows of benchmark items, and of which."""
    small_batches(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; learned from labelled documents that are not held out."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.select("doc_id", "toxic").dropna().where(~langid.held_out())
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    model = toxicity.train(rows.select("text", "toxic"))
    found = toxicity.severity(docs, model)
    return found.select(F.col("_id").alias("doc_id"), "grade", "expected_severity",
                        "toxic_score", "toxic")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class of equal bags, its near-duplicate group, whether it is kept."""
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "group_id", "copies", "keep")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs, model, carry=["doc_id"])
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, after runs were planted in every tenth or so."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs().alias("text"))
    found = periods.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")),
        F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        F.col("_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_longest.before")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.finer")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.finer").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs() -> Column:
    """The text; of a tenth of the ids by hash, from word g % n on a part of its words repeats."""
    spaces = r"[\x20\x09-\x0D]+"
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", spaces), lambda w: w != "")
    n = F.size(words)
    g = F.floor(crc / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")

    def repeated(named: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), named.n - 1), lambda i: F.get(
            named.words, F.when(i < named.a, i).otherwise(named.a + (i - named.a) % named.p))), " ")

    # named once, so that the parts are not computed for every word
    named = F.transform(F.array(F.struct(words.alias("words"), n.alias("n"), a.alias("a"), p.alias("p"))),
                        repeated)
    chosen = (crc % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return F.when(chosen, F.get(named, F.lit(0))).otherwise(F.col("text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies align in every document, with corpus-wide counts."""
    import public_tokenizers

    small_batches(spark)
    found = align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
    groups = F.col("groups")
    return found.select(
        F.col("_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_a") > 0, F.sha2(groups.cast("binary"), 256)).otherwise("")
        .alias("groups_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the least id of its component of near fingerprints."""
    small_batches(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id")


LLM_QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_linededup": op3_linededup,
    "op4_chat": op4_chat,
    "op5_topk": op5_topk,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_langid": op10_langid,
    "op11_periods": op11_periods,
    "op12_alignment": op12_alignment,
    "op13_simhash": op13_simhash,
}
LLM_ORACLES: dict[str, str] = {
    "op5_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
      FROM scored)
WHERE place <= 5""",
    "op6_warc": """
WITH bodies AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT payload_digest, min(page_id) AS first_page FROM bodies
  WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, bodies.payload_digest,
  CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM bodies LEFT JOIN firsts ON bodies.payload_digest = firsts.payload_digest""",
}
