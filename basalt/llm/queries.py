"""The queries of the operators here, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basalt.llm import caps, chat_format, collocations, line_dedup, minhash, ngrams, packing, pieces, resampling, secret_scan, toxicity, url_filter
from basalt.llm.exact_dedup import exact_dedup
from basalt.plans.durable import written


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir)).drop("row_no")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(by))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chats = chats.unionByName(own).withColumn("parts", chat_format.text_parts(F.col("text")))
    out = written(chat_format.format_chats(chats).select("conv_id", "segments"), "chats")
    back = out.select("conv_id", "segments", chat_format.formatted(F.col("segments")).alias("all"))
    back = back.select("conv_id", chat_format.read_turns(F.col("all")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("all").cast("bigint").alias("formatted_chars"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_docs(spark, sf_dir), distance=2, least=20, short=10)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_docs(spark, sf_dir))
    return found.select(
        "doc_id",
        *(secret_scan.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        secret_scan.span_text(F.col("live")).alias("live_spans"),
        secret_scan.span_text(F.col("examples")).alias("example_spans"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(_docs(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = ngrams.train(docs, remainder("doc_id", 7) != 2)
    out = ngrams.score(docs, model)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(True)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), percent=85, size=5).drop("text_hash")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir), least=30, covered=80, top=2000)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least=20, longest=2, buckets=10_000, seed=7)


#: The rules of the query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.compile_rules(spark.createDataFrame(list(URL_RULES.items()), "rule string, verdict string"))
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_chat_format": OP3, "op11_collocations": OP11, "op12_importance_resampling": OP12, "op13_url_filter": OP13}


OP1 = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents
), d AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP3 = r"""
WITH own(conv_id, turn, role, text) AS (
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM own
), e AS (
  SELECT *, replace(replace(replace(text, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '>', chr(92) || 'g') AS esc FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || role || '>' || esc || '</turn>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM cut, range(1, 5) s(size) WHERE len(w) >= size
), f AS (SELECT lang, size, phrase, count(*) AS n FROM places GROUP BY ALL
), candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 30
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, range(1, 4) c(k) WHERE k < size
), scored AS (
  SELECT cuts.*, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part AND x.size = k JOIN f y ON y.lang = cuts.lang AND y.phrase = rest AND y.size = cuts.size - k
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part_size, array_to_string(w[i:i + part_size - 1], ' ') AS part, max(a) AS longer
  FROM candidates, range(2, 4) p(part_size), range(1, 4) b(i) WHERE part_size < size AND i + part_size - 1 <= size GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND part = phrase AND part_size = size WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# CRC-32 byte by byte: the table of 256 remainders first, then one step a byte
OP12 = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) r(i)
), docs AS (
  SELECT row_number() OVER () AS no, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark
), cut AS (
  SELECT no, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM docs
), runs AS (
  SELECT no, own, unnest(words) AS feature FROM cut
  UNION ALL SELECT no, own, unnest(list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1])) FROM cut
), distinct_features AS (
  SELECT DISTINCT feature, hex(encode(feature)) AS digits FROM runs
), hashed AS (
  SELECT feature, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM distinct_features, crc
), bucketed AS (SELECT no, own, bucket FROM runs JOIN hashed USING (feature)
), totals AS (SELECT count(*) FILTER (own)::DOUBLE AS s_all, count(*) FILTER (NOT own)::DOUBLE AS t_all FROM bucketed
), counted AS (SELECT bucket, count(*) FILTER (own)::DOUBLE AS s, count(*) FILTER (NOT own)::DOUBLE AS t FROM bucketed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counted, totals
), weights AS (
  SELECT no, count(*) AS n_features, sum(gain)::BIGINT AS total FROM bucketed JOIN gain USING (bucket) WHERE own GROUP BY no
), scored AS (
  SELECT no, doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0) AS n_features,
         coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM cut LEFT JOIN weights USING (no) WHERE own
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, 25 * count(*) OVER (PARTITION BY fit) // 100 AS drawn FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM placed
"""

OP13 = """
WITH rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), p AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT p.row_no, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY p.row_no
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (row_no)
"""
