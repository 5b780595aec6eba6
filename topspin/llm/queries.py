"""The registered queries of this subpackage and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topspin.llm import bpe, cosine_dedup, decontamination, html_text, knn, periodic_runs, preferences, quality, simhash, substrings, token_counts, turn_repair, warc
from topspin.llm.shared import materialise, table

CONTEXT_TOKENS = 4096


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen over itself with the last answer of its neighbour (ids 2k and 2k + 1)."""
    chosen = table(spark, sf_dir, "conversations")
    rejected = preferences.with_swapped_answer(chosen, F.col("conv_id").bitwiseXOR(F.lit(1)))
    pairs = preferences.preference_pairs(chosen, rejected, pair_column="conv_id")

    def mask(name: str) -> Column:
        parts = F.zip_with(f"{name}_segments", f"{name}_loss", lambda s, loss: F.concat(F.when(loss, "+").otherwise("-"), F.length(s).cast("string")))
        return F.array_join(parts, " ").alias(f"{name}_mask")

    text = [F.array_join(f"{n}_segments", "").alias(n) for n in ("chosen", "rejected")]
    return pairs.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", *text, mask("chosen"), mask("rejected"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write(pages, warc.archive_folder(spark))
    kind = pages.schema["page_id"].dataType
    found = warc.read(index, payloads=False)
    return found.select(F.col("page_id").try_cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults, by the remainder of a checksum of id and turn number; a null id, turn, role or text counts as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns)
    scripts = materialise(turn_repair.repair_scripts(rows))
    digests = turn_repair.digests(turn_repair.repaired_turns(rows, scripts)).select(F.col("conv_id").alias("digest_id"), "sha256")
    found = scripts.withColumnRenamed("conv_id", "script_id").join(digests, F.col("digest_id").eqNullSafe(F.col("script_id")), "left")
    # a row that is missing after the damage, or a script that leaves no turn
    found = turns.select("conv_id").distinct().join(found, F.col("script_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of ``documents``, by a checksum of the id, with words repeating from some word on; words joined by one space there. Null ids stay as they are."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    root, rest = F.slice("words", F.col("a") + 1, F.col("p")), F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("p")).cast("int"))), 1, rest)
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # fractions are compared by their cross products
    best = F.reduce("runs", F.col("runs")[0], lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = (
    op1_bpe_encode_decode,
    op2_token_counts,
    op3_quality_classifier,
    op4_substring_dedup,
    op5_html_extraction,
    op6_preference_formatting,
    op7_simhash_near_dedup,
    op8_warc_bundles,
    op9_benchmark_decontamination,
    op10_voronoi_top_k,
    op11_turn_repair,
    op12_embedding_near_dedup,
    op13_periodic_runs,
)

ORACLES = {
    "op6_preference_formatting": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        l AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM c WHERE role = 'assistant' GROUP BY conv_id),
        s AS (SELECT a.conv_id, a.turn, b.text FROM l AS a LEFT JOIN l AS b ON b.conv_id = xor(a.conv_id, 1)),
        j AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN s.conv_id IS NULL THEN c.text ELSE s.text END AS text
              FROM c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn),
        m AS (SELECT c.conv_id, c.turn, c.role, c.text, j.text AS other FROM c JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn),
        k AS (SELECT conv_id, min(CASE WHEN other IS NULL OR other <> text THEN turn END) AS cut FROM m GROUP BY conv_id),
        t AS (SELECT m.conv_id, m.turn, coalesce(m.turn < k.cut, true) AS common, '<|im_start|>' || role || chr(10) AS head,
                     text || '<|im_end|>' || chr(10) AS body, other || '<|im_end|>' || chr(10) AS other,
                     CASE WHEN role = 'assistant' THEN '+' ELSE '-' END AS sign FROM m JOIN k ON k.conv_id = m.conv_id)
        SELECT conv_id, CAST(sum(CASE WHEN common THEN 1 ELSE 0 END) AS BIGINT) AS prompt_turns,
               coalesce(string_agg(CASE WHEN common THEN head || body END, '' ORDER BY turn), '') AS prompt,
               coalesce(string_agg(CASE WHEN NOT common THEN head || body END, '' ORDER BY turn), '') AS chosen,
               coalesce(string_agg(CASE WHEN NOT common THEN head || other END, '' ORDER BY turn), '') AS rejected,
               coalesce(string_agg(CASE WHEN NOT common THEN '-' || length(head) || ' ' || sign || length(body) END, ' ' ORDER BY turn), '') AS chosen_mask,
               coalesce(string_agg(CASE WHEN NOT common THEN '-' || length(head) || ' ' || sign || length(other) END, ' ' ORDER BY turn), '') AS rejected_mask
        FROM t GROUP BY conv_id""",
    "op8_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op10_voronoi_top_k": """
        WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
        s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
              FROM v AS q JOIN v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, v.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_turn_repair": """
        WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
        k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
               lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind FROM s),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
                     regexp_extract(text, '([^ \\t-\\r])[ \\t-\\r]*$', 1) AS last FROM o),
        f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS two FROM r),
        -- what one edit makes of a state of the pattern: 0 nothing yet, 1 system, 2 user, 3 assistant
        step(before, after, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
        kept(before, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        runs AS (SELECT st AS before, st AS after, '' AS code, '' AS said, 0 AS cost FROM range(4) AS t(st)
                 UNION ALL SELECT before, after, 'I', chr(10) || name || ':', 5 FROM step
                 UNION ALL SELECT a.before, b.after, 'II', chr(10) || a.name || ':' || chr(10) || b.name || ':', 10 FROM step AS a JOIN step AS b ON b.before = a.after),
        e AS (SELECT f.conv_id, f.n, runs.before, runs.after, runs.code || 'D' AS code, runs.said, runs.cost + 2 AS cost FROM f, runs
              UNION ALL SELECT f.conv_id, f.n, runs.before, kept.after, runs.code || 'K', runs.said || chr(10) || f.role || ':' || f.text, runs.cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END
              FROM f JOIN kept ON kept.initial = f.role[1] JOIN runs ON runs.after = kept.before WHERE fault NOT IN ('blank', 'duplicate')
              UNION ALL SELECT f.conv_id, f.n, runs.before, step.after, runs.code || 'R', runs.said || chr(10) || step.name || ':' || f.text, runs.cost + 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END
              FROM f, runs JOIN step ON step.before = runs.after WHERE fault NOT IN ('blank', 'duplicate')),
        p AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, {'cost': 0, 'audit': '', 'said': ''} AS way FROM conversations
              UNION ALL
              SELECT p.conv_id, e.n, e.after, min({'cost': CAST(p.way.cost + e.cost AS INTEGER), 'audit': p.way.audit || e.code, 'said': p.way.said || e.said})
              FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.before = p.state GROUP BY p.conv_id, e.n, e.after),
        c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        w AS (SELECT p.conv_id, min({'cost': p.way.cost + runs.cost, 'audit': p.way.audit || runs.code, 'said': p.way.said || runs.said}) AS way
              FROM p LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id JOIN runs ON runs.before = p.state AND runs.after IN (0, 3) WHERE p.n = coalesce(c.n, 0) GROUP BY p.conv_id)
        SELECT w.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(way.cost AS BIGINT) AS cost, way.audit AS audit, sha256(substr(way.said, 2)) AS repaired_sha256
        FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id""",
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT * FROM v WHERE len(v) > 0 AND NOT list_contains(list_transform(v, lambda x: coalesce(isfinite(x), false)), false) AND list_max(list_transform(v, lambda x: abs(x))) > 0),
        l AS (SELECT a.r AS a, b.r AS b FROM u AS a JOIN u AS b ON a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        c AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
