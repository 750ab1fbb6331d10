"""Registered queries of the training-data operators: whole tables, full results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import (bpe, centroids, covertree, decontaminate, langid, merkle, mixing, pii, quality, simhash, suffix,
                         toxicity, warc)
from netlens.llm.common import crc_mod, table


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    scored = toxicity.train_and_score(docs, labels.where(~held_out), fold=lambda key: crc_mod(key, 5) == 4)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.cluster(table(spark, sf_dir, "embeddings")).select(
        "*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).try_cast("long").alias  # noqa: E731  a null key reads back as null
    return warc.read_archives(spark, archives, with_payload=False).select(
        number("record_id")("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")("refers_to"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.taken(mixing.mix(docs, keep=["doc_id"]))
    return rows.select("row.doc_id", "size", "source_size", "target", "taken", "shard_words")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return (langid.predict(docs, model)
                  .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.detect(table(spark, sf_dir, "documents")))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(*more))
    rows = merkle.manifest(docs, columns=columns, carry={"tampered": tampered})
    rows = merkle.verify(rows.withColumn("given", F.coalesce("tampered", "leaf")), leaf="given")
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", "verified")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_suffix": op10_suffix,
    "op11_merkle": op11_merkle,
    "op12_decontaminate": op12_decontaminate,
    "op13_centroids": op13_centroids,
}


def _centroid_sql(rounds: int) -> str:
    """Lloyd's rounds as one chain of common table expressions."""
    sql = """
        WITH v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS r, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS c, e FROM v
            ORDER BY c LIMIT 16),"""
    near = """
        a{k} AS MATERIALIZED (
            SELECT r, c, d FROM (
                SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
                    SELECT r, c, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.e, c{k}.e)])::BIGINT AS d
                    FROM v CROSS JOIN c{k})) WHERE place = 1)"""
    move = """,
        s{k} AS MATERIALIZED (
            SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
            FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{k} JOIN v USING (r)) GROUP BY c, i),
        c{next} AS MATERIALIZED (
            SELECT c, coalesce(m, e) AS e FROM c{k} LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY c) USING (c)),"""
    for k in range(rounds):
        sql += near.format(k=k) + move.format(k=k, next=k + 1)
    return sql + near.format(k=rounds) + f"""
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


ORACLE: dict[str, str] = {
    "op3_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
                  UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id,
               c.vec_id = component_id AS kept
        FROM c""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT *, strlen(h) AS b, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, b AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN b >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM q""",
    "op5_quality": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents),
        one AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        windows AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS n
            FROM (SELECT r, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4
                  FROM one WINDOW p AS (PARTITION BY r ORDER BY i)) WHERE w4 IS NOT NULL),
        again AS (
            SELECT r, count(DISTINCT pos) AS n_repeat_words
            FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM windows WHERE n > 1) GROUP BY r),
        base AS (
            SELECT d.doc_id, r, host, len(ws) AS n_words,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN again USING (r)),
        lines AS (
            SELECT r, host, t, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
                   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
            FROM (SELECT r, host, t, unnest(ls) AS line FROM d)),
        hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
        frequent AS (
            SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM lines GROUP BY ALL) JOIN hosts USING (host)
            WHERE n > 10 AND n > 0.05::DOUBLE * docs),
        gone AS (SELECT r, sum(w) AS w FROM lines SEMI JOIN frequent USING (host, line) GROUP BY r)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
                   AND n_words - coalesce(gone.w, 0) >= 10
                   AND n_words - coalesce(gone.w, 0) >= 0.3::DOUBLE * n_words AS kept
        FROM base LEFT JOIN gone USING (r)""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('17|' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                     row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
        w AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER ()
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / (sum(weight) OVER ()
                         - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      AS level FROM w),
        t AS (
            SELECT source, place, source_size, least(cap::DOUBLE, coalesce(weight * max(CASE WHEN weight * level <= cap THEN level END) OVER (),
                                                                    cap::DOUBLE)) AS target FROM l),
        q AS (SELECT *, round(target)::BIGINT AS quota,
                     greatest(1, ceil(sum(round(target)) OVER () / 65536))::BIGINT AS block FROM t),
        b0 AS (SELECT place, 0 AS node, unnest(range(ceil(quota / block)::BIGINT)) AS i FROM q),""" + "".join(f"""
        n{k} AS (SELECT place, node, i, count(*) OVER (PARTITION BY node) AS total,
                        md5('17|' || node || '|' || row_number() OVER (PARTITION BY node ORDER BY place, i)) AS key FROM b{k}),
        b{k + 1} AS (SELECT place, i, 2 * node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY key) <= round(total / 2.0)
                                                 THEN 1 ELSE 2 END AS node FROM n{k}),""" for k in range(4)) + r"""
        leaf AS (SELECT place, node - 15 AS shard, count(*) AS n FROM b4 GROUP BY ALL),
        run AS (SELECT place, shard, n, sum(n) OVER (PARTITION BY place ORDER BY shard) AS upto FROM leaf),
        o AS (
            SELECT row_number() OVER () AS r, doc_id, size, source_size, target, quota, block, place,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        x AS (
            SELECT r, shard, sum(greatest(0, least(quota, block * upto, e * source_size + before + size)
                                             - greatest(least(quota, block * (upto - n)), e * source_size + before)))::BIGINT AS n
            FROM o JOIN run USING (place), range(3) AS g(e) GROUP BY r, shard),
        y AS (SELECT r, sum(n) AS taken, string_agg(shard || ':' || n, ',' ORDER BY shard) AS shard_words FROM x WHERE n > 0 GROUP BY r)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shard_words, '') AS shard_words
        FROM o LEFT JOIN y USING (r)""",
    "op11_merkle": """
        WITH RECURSIVE
        p AS (SELECT row_number() OVER () AS r, lang, doc_id AS id, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
                     [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS w FROM documents),
        h AS (SELECT r, lang, id, sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN v], '')) AS leaf,
                     sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN w], '')) AS bad FROM p),
        crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(id::VARCHAR, '')]),
                    lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT FOR i IN range(8)]),
                        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
                FROM h WHERE id IS NOT NULL),
        leaves AS (SELECT r, coalesce('=' || lang, '-') AS g, leaf, CASE WHEN crc % 7 = 0 THEN bad ELSE leaf END AS given, id,
                          row_number() OVER (PARTITION BY lang ORDER BY id NULLS FIRST, leaf, r) - 1 AS pos,
                          count(*) OVER (PARTITION BY lang) AS n
                   FROM h LEFT JOIN crc USING (r)),
        up AS (SELECT g, 0 AS lvl, pos, leaf AS d, n FROM leaves
               UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
                         FROM up WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
        subroots AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        over_ AS (SELECT 0 AS lvl, pos, d, n FROM subroots
                  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
                            FROM over_ WHERE n > 1 GROUP BY lvl, pos // 2, n),
        steps AS (
            SELECT r, up.lvl, (leaves.pos >> up.lvl) % 2 AS slot, coalesce(s.d, '') AS sib
            FROM leaves JOIN up ON up.g = leaves.g AND up.n > 1 AND up.pos = leaves.pos >> up.lvl
                 LEFT JOIN up s ON s.g = up.g AND s.lvl = up.lvl AND s.pos = xor(up.pos, 1)
            UNION ALL
            SELECT r, 1000 + o.lvl, (subroots.pos >> o.lvl) % 2, coalesce(s.d, '')
            FROM leaves JOIN subroots USING (g) JOIN over_ o ON o.n > 1 AND o.pos = subroots.pos >> o.lvl
                 LEFT JOIN over_ s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1)),
        path AS (SELECT r, string_agg(sib, '' ORDER BY lvl) AS proof, list(slot || sib ORDER BY lvl) AS sibs FROM steps GROUP BY r)
        SELECT id AS doc_id, leaf, subroots.d AS subroot, top.d AS root, sha256(coalesce(proof, '')) AS proof_sha256,
               list_reduce(list_prepend(given, coalesce(sibs, [])),
                   lambda a, s: sha256(CASE WHEN s[1] = '1' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root,
               folded_root = top.d AS verified
        FROM leaves JOIN subroots USING (g) JOIN (SELECT d FROM over_ WHERE n = 1) top ON true LEFT JOIN path USING (r)""",
    "op12_decontaminate": r"""
        WITH
        dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        iw AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS t
                FROM (SELECT *, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM iw WHERE len(ws) > 0)),
        one AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM dw),
        run AS (SELECT r, p, list(w) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM one),
        grams AS (SELECT r, p, n, array_to_string(l[1:n], ' ') AS t FROM run JOIN (SELECT DISTINCT n FROM win) ON len(l) >= n),
        hit AS (SELECT DISTINCT r, p, n, t FROM grams SEMI JOIN win USING (n, t)),
        words_hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY encode(i)) AS l
                  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit JOIN win USING (n, t) WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)""",
    "op13_centroids": _centroid_sql(3),
}
