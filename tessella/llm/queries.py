"""The queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import fold_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, k=3).select("doc_id", "fingerprint", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.tokencount import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pieces import segment

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segment(docs, tokenizer_path("piece_bpe_32k.model"), pieces=False).drop("text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.chat import read_back, windows

    probe = "</s>[INST] ok [/INST]"
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select cast(x.c as bigint) conv_id, cast(x.t as bigint) turn, x.r role, x.s text from (select explode(array(struct(-1 c, 0 t, 'user' r, :s s), struct(-1 c, 1 t, 'assistant' r, :s s))) x)", {"s": probe})
    got = read_back(windows(talks.unionByName(extra)))
    per = got.select(
        "conv_id", "block", "window", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("learnt", "").alias("learnt"),
    )
    # stretches of 64 windows first, so that a long conversation does not bring all its windows into one task
    order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    text = lambda c: F.array_join(F.transform("w", lambda w: w[c]), "")
    sums = [F.sum("n").alias("n"), F.sum("chars").alias("chars")]
    part = per.groupBy("conv_id", "block", F.floor(F.col("window") / 64).alias("part")).agg(order("window", "said", "learnt").alias("w"), *sums)
    part = part.select("conv_id", "block", "part", "n", "chars", text("said").alias("said"), text("learnt").alias("learnt"))
    whole = part.groupBy("conv_id").agg(order("block", "part", "said", "learnt").alias("w"), *sums)
    learnt = text("learnt")
    return whole.select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), F.sha2(text("said").cast("binary"), 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20).drop("items", "longest_hit", "th")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=400).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.lines import dedup_lines

    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_chat_format": op4_chat_format,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
}

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ESCAPED = r"regexp_replace(replace(text, '\\', '\\\\'), '([<\[])(\|im_start\|>|\|im_end\|>|/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2', 'g')"
_LINE_WORDS = "regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    # windows are walked turn by turn
    "op4_chat_format": f"""
WITH RECURSIVE talk AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) AS tok, 24 + length(role) + length({_ESCAPED}) AS size FROM talk),
p AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS upto FROM t),
lead AS (SELECT conv_id, tok AS lead_tok, size AS lead_size FROM t WHERE i = 0 AND role = 'system'),
walk AS (SELECT conv_id, i, n, 0::BIGINT AS start, 0::BIGINT AS before FROM p WHERE i = 0
  UNION ALL SELECT p.conv_id, p.i, p.n, CASE WHEN cut THEN p.i ELSE start END, CASE WHEN cut THEN p.upto - p.tok ELSE before END
  FROM (SELECT w.*, p.upto - w.before > CASE WHEN w.start = 0 THEN 1024 ELSE 768 - coalesce(lead_tok, 0) END AS cut FROM walk w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1 LEFT JOIN lead ON lead.conv_id = w.conv_id) w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1),
win AS (SELECT conv_id, start, any_value(before) AS before, max(i) AS last FROM walk GROUP BY conv_id, start),
shown AS (SELECT w.conv_id, w.start, min(p.i) AS back, sum(p.size) AS size FROM win w JOIN p ON p.conv_id = w.conv_id AND p.i <= w.last AND (p.i >= w.start OR w.before - (p.upto - p.tok) <= 256) GROUP BY w.conv_id, w.start),
chars AS (SELECT conv_id, CAST(sum(size + CASE WHEN back > 0 THEN coalesce(lead_size, 0) ELSE 0 END) AS BIGINT) AS formatted_chars FROM shown LEFT JOIN lead USING (conv_id) GROUP BY conv_id),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learnt FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM said JOIN chars USING (conv_id)""",
    "op7_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, CAST(2 * s + 1 AS BIGINT), 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS s FROM h WHERE length(x) >= 800)),
r AS (SELECT doc_id, s FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM r)),
gone AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM gone),
kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS front FROM cuts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256,
  length(regexp_replace(rest, '[89AB].|(.).', '\\1', 'g')) AS n_chars FROM (SELECT *, coalesce(front, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)) AS rest FROM h LEFT JOIN kept USING (doc_id))""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
f AS (SELECT doc_id, no, line, {_LINE_WORDS} AS w, array_to_string({_LINE_WORDS}, ' ') AS flat, doc_id * 1000000 + no AS place FROM l),
d AS (SELECT flat, any_value(w) AS w, min(place) AS first FROM f WHERE strlen(flat) >= 10 GROUP BY flat),
v AS (SELECT flat, first, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 : len(w)]), ' ') AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 8)),
near AS (SELECT a.flat FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND b.first < a.first
  UNION SELECT a.flat FROM v a JOIN d b ON a.rest = b.flat AND len(b.w) >= 8 AND b.first < a.first UNION SELECT b.flat FROM v a JOIN d b ON a.rest = b.flat AND len(b.w) >= 8 AND a.first < b.first),
gone AS (SELECT doc_id, no FROM f JOIN d USING (flat) WHERE place > first OR flat IN (SELECT flat FROM near)),
left_ AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS kept FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
    "op5_benchmark_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS words FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
gram AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, s, n FROM gram JOIN win USING (n, words)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
