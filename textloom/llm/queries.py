"""Thin queries of the numbered operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_search, bpe, exact_dedup, merkle, near_dedup, packing, quality, sharding, storage, token_lengths, tokens, trie, url_rules, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four parts, each appended on its own; the store is then compacted and read back: every row with the size and digest of its text, and how many shards are still due for a merge."""
    docs = _table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, storage.new_path(spark, "shards"))
    for part in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), F.lit(store.due()).alias("shards_due"))


def op2_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokens.tokenizer_path(tokens.WORD_BPE), end_id=0, capacity=2048)
    return packing.pack(pieces, capacity=2048, report=True)


def op3_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_lengths.context_table(token_lengths.length_histogram(docs, tokens.tokenizer_path(tokens.WORD_BPE)))


def op4_weighted_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_block_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(_table(spark, sf_dir, "labels")), n_grades=3)
    return quality.score(docs, model).withColumn("selected", F.col("tail") >= 0.5)


def op7_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write_shards(_table(spark, sf_dir, "documents"), tokens.tokenizer_path(tokens.WORD_BPE), end_id=1)
    return wavelet.read_documents(spark, path)


def op10_warc_chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(spark, warc.write_archives(_table(spark, sf_dir, "pages")))


def op11_radix_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations"))


#: The rules that the query's contract lists.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op12_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose document is labelled toxic or of low quality teach which URLs to block."""
    bad = F.greatest(F.col("toxic") == 1, F.col("quality") == 0)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), bad.alias("bad"))
    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), labels, HOST_RULES).drop("url")


def op13_merkle_traversal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, verified against texts of which half have lost their line ends."""
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), F.when(half, F.translate("text", "\n", "")).otherwise(F.col("text")))


QUERIES = {f.__name__: f for f in (op1_size_tiered_shards, op2_bin_completion_packing, op3_token_length_histogram, op4_weighted_minhash_dedup, op5_block_matrix_search, op6_ordinal_quality, op7_perfect_hash_dedup, op8_rank_queue_bpe, op9_wavelet_token_shards, op10_warc_chunk_records, op11_radix_conversation_trie, op12_association_url_filter, op13_merkle_traversal_manifest)}

#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
_LEAF = "sha256(" + " || ".join("CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END".format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || CASE WHEN {text} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END)"


def _levels(name: str, leaves: str) -> str:
    """All levels of the ternary trees over leaves (tree, pos, h), and each tree's height and root."""
    return f"""
        {name} AS (
            SELECT tree, 0 AS lvl, pos, h FROM {leaves}
            UNION ALL
            SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS width FROM {name}) WHERE width > 1 GROUP BY tree, lvl, pos // 3),
        {name}_top AS (SELECT tree, max(lvl) AS height, arg_max(h, lvl) AS root FROM {name} GROUP BY tree),
        {name}_path AS (
            SELECT f.tree, f.pos, up.lvl, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < f.pos // CAST(pow(3, up.lvl) AS BIGINT)), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > f.pos // CAST(pow(3, up.lvl) AS BIGINT)), '') AS after
            FROM {leaves} f JOIN {name}_top USING (tree) JOIN (SELECT unnest(range(0, 40)) AS lvl) up ON up.lvl < height
            JOIN {name} n ON n.tree = f.tree AND n.lvl = up.lvl AND n.pos // 3 = f.pos // CAST(pow(3, up.lvl + 1) AS BIGINT) GROUP BY f.tree, f.pos, up.lvl)"""


ORACLES = {
    "op11_radix_conversation_trie": f"""
        WITH t AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS u, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, list(u ORDER BY turn NULLS FIRST, u) AS us, list(w ORDER BY turn NULLS FIRST, u) AS ws FROM t GROUP BY conv_id),
        k AS (SELECT *, {_CRC.format(s='conv_id::VARCHAR')} % 4 AS h FROM s),
        b AS (SELECT k.conv_id, list_concat(coalesce(o.us, [])[1:h], k.us[h + 1:]) AS us, list_concat(coalesce(o.ws, [])[1:h], k.ws[h + 1:]) AS ws FROM k LEFT JOIN s o ON o.conv_id = k.conv_id - k.conv_id % 20),
        m AS (SELECT conv_id, d, len(us) AS n, array_to_string(us[1:d], '') AS p, array_to_string(us[1:d - 1], '') AS up, coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(range(0, len(us) + 1)) AS d FROM b)),
        n AS (SELECT p, any_value(up) AS up, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY p, d),
        c AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
        z AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.p)
        SELECT a.conv_id, a.depth, any_value(q.conv_id) AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.own) AS BIGINT) AS saved_tokens, a.ends_sha256
        FROM z a JOIN z b ON starts_with(b.p, a.p) LEFT JOIN n q ON a.depth > 0 AND q.p = a.up GROUP BY a.p, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends_sha256""",
    "op13_merkle_traversal_manifest": f"""
        WITH RECURSIVE d AS (SELECT *, {_LEAF.format(text='text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC.format(s='doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other, coalesce('s' || source, '-') AS tree FROM documents),
        f AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, doc_id, {_LEAF.format(text='other')} AS tampered FROM d),
        {_levels('a', 'f')},
        g AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, root AS h, tree AS source FROM a_top),
        {_levels('b', 'g')},
        p AS (SELECT tree, pos, lvl AS step, before, after FROM a_path UNION ALL SELECT f.tree, f.pos, 100 + lvl, before, after FROM f JOIN g ON g.source = f.tree JOIN b_path ON b_path.pos = g.pos),
        k AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS i FROM p),
        r AS (SELECT tree, pos, 0 AS i, tampered AS h FROM f UNION ALL SELECT r.tree, r.pos, k.i, sha256(k.before || r.h || k.after) FROM r JOIN k ON k.tree = r.tree AND k.pos = r.pos AND k.i = r.i + 1),
        e AS (SELECT tree, pos, arg_max(h, i) AS folded FROM r GROUP BY tree, pos),
        s AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY step) AS proof FROM p GROUP BY tree, pos)
        SELECT f.doc_id, f.h AS leaf, a_top.root AS subroot, b_top.root AS root, sha256(coalesce(s.proof, '')) AS proof_sha256, e.folded AS folded_root, e.folded = b_top.root AS verified
        FROM f JOIN a_top USING (tree) JOIN b_top ON b_top.tree = '' JOIN e ON e.tree = f.tree AND e.pos = f.pos LEFT JOIN s ON s.tree = f.tree AND s.pos = f.pos""",
    "op1_size_tiered_shards": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, md5(text) AS text_md5, 0::BIGINT AS shards_due FROM documents",
    "op5_block_matrix_search": """
        WITH c AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id)
        SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, list_inner_product(q.v, c.v) AS score
        FROM c q JOIN c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) QUALIFY rank <= 20""",
    "op10_warc_chunk_records": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
            FROM pages),
        w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
        FROM p LEFT JOIN w USING (payload_digest)""",
    "op7_perfect_hash_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        ends AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS middle FROM documents),
        g AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size,
                   bool_or(doc_id < (SELECT middle FROM ends)) AS known
            FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256, g.known
        FROM t JOIN g USING (text_sha256)""",
}
