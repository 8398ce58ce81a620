"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, editcounts, editprints, language, packing, pii, pseudolikelihood, secretscan, simhash, substrings, turns, urlrules
from .common import materialise, table


def op1_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_shape_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editprints.with_edits(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edit_fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints are alike in at least 0.8 of their slots, by banding and verification."""
    prints = editprints.fingerprinted(table(spark, sf_dir, "documents")).select("id", "fingerprint")
    found = editprints.near_classes(materialise(prints, "prints"))
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "n_links")


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).withColumnRenamed("id", "doc_id")


def op5_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pseudolikelihood.score(docs, pseudolikelihood.learn(docs)).withColumnRenamed("id", "doc_id")
    return found.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


#: (host, path prefix, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_sorted_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def sample_edits(text: str = "text") -> Column:
    """A replacement, an insertion and a deletion in each text, at places that depend on its length."""
    n = F.length(text)
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("text"))
    third, half, fifth = F.floor(n / 3), F.floor(n / 2), F.floor(n / 5)
    return F.array(edit(third, third + 7, F.lit("Edited in 2024")), edit(half, half, F.substring(text, 1, 40)), edit(fifth, fifth + 12, F.lit("")))


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = editcounts.count(table(spark, sf_dir, "documents"), ranks, pattern, sample_edits())
    return found.select(F.col("id").alias("doc_id"), "n_pretokens", "n_tokens", "n_tokens_edited", "n_encoded", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that op11 has to repair, by a hash of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("damage")).where("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def op11_cost_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = turns.repair(damaged(conversations))
    whole = found.conversations.withColumnRenamed("conv", "of")
    hashed = turns.digests(found.turns).withColumnRenamed("conv", "hashed")
    every = conversations.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(whole, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_structural_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in secretscan.BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op13_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(collocations.mine(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_relative_lempel_ziv": op1_relative_lempel_ziv,
    "op2_shape_field": op2_shape_field,
    "op3_edit_embedding": op3_edit_embedding,
    "edit_fingerprint_classes": edit_fingerprint_classes,
    "op4_simhash_pivots": op4_simhash_pivots,
    "op5_byte_convolution": op5_byte_convolution,
    "op6_masked_pseudo_likelihood": op6_masked_pseudo_likelihood,
    "op7_sorted_sweep": op7_sorted_sweep,
    "op8_concatenate_and_cut": op8_concatenate_and_cut,
    "op9_minhash_containment": op9_minhash_containment,
    "op10_edit_aware_counts": op10_edit_aware_counts,
    "op11_cost_to_go": op11_cost_to_go,
    "op12_structural_confirmation": op12_structural_confirmation,
    "op13_perfect_hash": op13_perfect_hash,
}

#: Distinct five-word shingles of a table's lower-cased texts; fewer words are one shingle.
SHINGLES = """
    SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
          FROM (SELECT {id} AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)"""

ORACLE_SQL: dict[str, str] = {
    "op7_sorted_sweep": """
    WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, v)),
    m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
          FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id)
    SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op11_cost_to_go": """
    WITH RECURSIVE named AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
    hit AS (
      SELECT *, xor(list_reduce(list_transform(range(octet_length(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT),
        lambda c, b: list_reduce(list_transform(range(8), lambda z: 0::BIGINT), lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS d
      FROM named),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) FROM hit WHERE d != 0)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
    judged AS (
      SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, left(role, 1) AS h,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
             coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd
      FROM placed),
    sums AS (
      SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM judged GROUP BY c),
    step AS (
      SELECT c, i, h, role, text, fault IN ('blank', 'duplicate') AND fault IS NOT NULL AS bad, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x FROM judged),
    back AS (
      SELECT c, n + 1 AS i, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM sums
      UNION ALL
      SELECT c, i, least(b0, b2 + 5, b3 + 10), least(b1, b2 + 5, b3 + 10), least(b2, b3 + 5), least(b3, b2 + 5)
      FROM (SELECT s.c, s.i,
              least(c0 + 2, CASE WHEN NOT bad THEN x + least(c2 + 1, CASE h WHEN 's' THEN c1 WHEN 'u' THEN c2 END) END) AS b0,
              least(c1 + 2, CASE WHEN NOT bad THEN x + least(c2 + 1, CASE WHEN h = 'u' THEN c2 END) END) AS b1,
              least(c2 + 2, CASE WHEN NOT bad THEN x + least(c3 + 1, CASE WHEN h = 'a' THEN c3 END) END) AS b2,
              least(c3 + 2, CASE WHEN NOT bad THEN x + least(c2 + 1, CASE WHEN h = 'u' THEN c2 END) END) AS b3
            FROM back b JOIN step s ON s.c = b.c AND s.i = b.i - 1)),
    togo AS (SELECT c, i, unnest([0, 1, 2, 3]) AS q, unnest([c0, c1, c2, c3]) AS v FROM back),
    options AS (  -- the next state by deletion stays, by insertion and rerole depends on the state, by keeping on the role
      SELECT t.c, t.i, t.q, e.edit, e.i2, e.q2, e.line FROM togo t LEFT JOIN step s ON s.c = t.c AND s.i = t.i,
        LATERAL (SELECT CASE t.q WHEN 2 THEN 3 ELSE 2 END AS nq, CASE t.q WHEN 2 THEN 'assistant' ELSE 'user' END AS nr) a,
        LATERAL (VALUES ('D', t.i + 1, t.q, NULL, CASE WHEN s.i IS NOT NULL THEN 2 END),
                        ('I', t.i, a.nq, a.nr || ':', 5),
                        ('K', t.i + 1, CASE WHEN t.q = 0 AND s.h = 's' THEN 1 ELSE a.nq END, s.role || ':' || s.text, CASE WHEN NOT s.bad AND (s.h = left(a.nr, 1) OR t.q = 0 AND s.h = 's') THEN s.x END),
                        ('R', t.i + 1, a.nq, a.nr || ':' || s.text, CASE WHEN NOT s.bad THEN s.x + 1 END)) e(edit, i2, q2, line, cost)
        JOIN togo u ON u.c = t.c AND u.i = e.i2 AND u.q = e.q2 WHERE e.cost + u.v = t.v),
    best AS (SELECT c, i, q, min(edit) AS edit, arg_min(i2, edit) AS i2, arg_min(q2, edit) AS q2, arg_min(struct_pack(l := line), edit).l AS line FROM options GROUP BY c, i, q),
    forth AS (
      SELECT c, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM sums
      UNION ALL
      SELECT f.c, b.i2, b.q2, f.audit || b.edit, CASE WHEN b.line IS NULL THEN f.lines ELSE list_append(f.lines, b.line) END
      FROM forth f JOIN best b ON b.c = f.c AND b.i = f.i AND b.q = f.q),
    done AS (SELECT f.c, f.audit, f.lines FROM forth f JOIN sums s ON s.c = f.c AND f.i = s.n + 1 AND f.q IN (0, 3))
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(t.v, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations) o
    LEFT JOIN sums USING (c) LEFT JOIN done USING (c) LEFT JOIN togo t ON t.c = o.c AND t.i = 1 AND t.q = 0""",
    "op13_perfect_hash": """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
    cut AS (SELECT c.lang, c.phrase, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c JOIN n USING (lang)
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
    best AS (SELECT lang, phrase, unnest(arg_min(struct_pack(l := l, r := r, n := n, score := score), score * 10 + j)) FROM cut GROUP BY lang, phrase),
    inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
               FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c)) GROUP BY ALL),
    kept AS (SELECT lang, c.phrase, a, l, r, n, score FROM c JOIN best USING (lang, phrase) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""",
    "op9_minhash_containment": f"""
    WITH d AS ({SHINGLES.format(id="doc_id", table="documents")}), b AS ({SHINGLES.format(id="item_id", table="benchmark")}),
    n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
    m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM m JOIN n ON n.id = m.item_id WHERE n_shared * 5 >= n_item * 4""",
}
