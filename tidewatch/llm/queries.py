"""Registered queries of these operators: name -> (Spark callable, SQL twin or None)."""
from tidewatch.llm import (alignment, decontaminate, exact, fingerprints, packing, quality, secrets,
                           setsketch, tokens, toxicity, trie, urls, warc)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_warc_packages(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark, sf_dir):
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_near_dedup(spark, sf_dir):
    return setsketch.near_groups(_table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.report(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"), urls.fit(urls.seed_urls(spark)))


def op11_token_alignment(spark, sf_dir):
    return alignment.alignment_report(_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark, sf_dir):
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return trie.family_trie(_table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(name, table, key, pattern):
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return (f"{name}_w AS (SELECT DISTINCT {key} AS id, regexp_extract_all({text}, '{pattern}') AS w FROM {table}),\n"
            f"{name} AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM ("
            f"SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT id, w, ")


OP3_SQL = f"""
WITH {_words("item", "benchmark", "item_id", "[a-z0-9" + chr(0x80) + "-" + chr(0x10FFFF) + "]+")}
  least(len(w), 5) AS k FROM item_w WHERE len(w) > 0))),
{_words("doc", "documents", "doc_id", "[a-z0-9" + chr(0x80) + "-" + chr(0x10FFFF) + "]+")}
  unnest((SELECT list(DISTINCT k) FROM item)) AS k FROM doc_w))),
size AS (SELECT id, count(*) AS n FROM item GROUP BY id),
hit AS (SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS n_shared
        FROM item JOIN doc ON item.s = doc.s AND item.k = doc.k GROUP BY doc.id, item.id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_item,
       CAST(n_shared AS DOUBLE) / n AS containment
FROM hit JOIN size ON size.id = item_id WHERE n_shared >= 0.75 * n AND doc_id IS NOT NULL
"""

OP7_SQL = f"""
WITH RECURSIVE {_words("doc", "documents", "doc_id", "[^ " + chr(92) + "t-" + chr(92) + "r]+")}
  least(len(w), 5) AS k FROM doc_w WHERE len(w) > 0))),
size AS (SELECT id, count(*) AS n FROM doc GROUP BY id),
keyed AS (SELECT id, md5(string_agg(s, chr(10) ORDER BY s)) AS set_key FROM doc GROUP BY id),
class AS (SELECT set_key, min(id) AS rep FROM keyed GROUP BY set_key),
sh AS (SELECT doc.id, s, n FROM doc JOIN class ON class.rep = doc.id JOIN size ON size.id = doc.id),
pair AS (SELECT a.id AS x, b.id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id
           AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
         GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edge AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
reach AS (SELECT rep AS x, rep AS y FROM class UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id,
       coalesce(low.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size ON size.id = d.doc_id LEFT JOIN keyed ON keyed.id = d.doc_id
LEFT JOIN class ON class.set_key = keyed.set_key LEFT JOIN low ON low.x = class.rep
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""

_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT ids.conv_id AS c, pos, r, x FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 100 AND pos <= h
      UNION ALL SELECT ids.conv_id, pos, r, x FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos > h),
p AS (SELECT conv_id AS c, 0 AS d, '' AS node, 0 AS n FROM ids UNION ALL
      SELECT c, row_number() OVER w, sha256(string_agg(sha256(length(r) || ':' || r || x), '') OVER w), length(x)
      FROM s WINDOW w AS (PARTITION BY c ORDER BY pos)),
q AS (SELECT c, d, node, n, lag(node) OVER v AS up, lead(node) OVER v IS NULL AS is_end FROM p WINDOW v AS (PARTITION BY c ORDER BY d)),
nodes AS (SELECT node, d, max(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n FROM q GROUP BY node, d),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
own AS (SELECT nodes.conv_id, d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * n AS saved
        FROM nodes LEFT JOIN kids ON kids.up = node),
below AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
          FROM own JOIN p ON p.c = own.conv_id AND p.d <= own.d GROUP BY node),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM q WHERE is_end GROUP BY node)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id,
       CAST(nodes.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below ON below.node = nodes.node LEFT JOIN kids ON kids.up = nodes.node
LEFT JOIN nodes parent ON parent.node = nodes.up LEFT JOIN ends ON ends.node = nodes.node
"""

QUERIES = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_warc_packages": (op2_warc_packages, OP2_SQL),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_token_counts": (op4_token_counts, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_quality": (op6_quality, None),
    "op7_near_dedup": (op7_near_dedup, OP7_SQL),
    "op8_secrets": (op8_secrets, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_url_filter": (op10_url_filter, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_fingerprints": (op12_fingerprints, None),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
