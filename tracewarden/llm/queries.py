"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_trie import op7_bpe_trie
from .collocations import op13_phrase_collocations
from .conversations import op12_conversation_repair
from .licences import op2_suffix_automaton_licences
from .maglev import op9_permutation_sharding
from .minhash import op6_circulant_minhash
from .packing import op10_pack_nnls
from .permutations import op4_permutation_index
from .secrets import op8_char_cnn_secrets
from .tiff import op5_tiff
from .toxicity import op1_crf_toxicity
from .warc import op3_merkle_warc
from .winnowing import op11_winnowing_decontamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_crf_toxicity,
        op2_suffix_automaton_licences,
        op3_merkle_warc,
        op4_permutation_index,
        op5_tiff,
        op6_circulant_minhash,
        op7_bpe_trie,
        op8_char_cnn_secrets,
        op9_permutation_sharding,
        op10_pack_nnls,
        op11_winnowing_decontamination,
        op12_conversation_repair,
        op13_phrase_collocations,
    )
}

#: Ids of pages are far from filling a part of a file here, so that every file is one part.
_OP3 = """
WITH replicas AS (
  SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, url, html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM replicas
), primary_ AS (
  SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file, strlen(r) AS length, sha256(r) AS primary_sha256, r, html FROM hashed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS idx, CAST(sum(length) OVER w AS BIGINT) - length AS "offset"
  FROM primary_ WINDOW w AS (PARTITION BY file ORDER BY page_id, primary_sha256)
)
SELECT file, CAST(0 AS BIGINT) AS part, idx, page_id, "offset", length, 'changed' AS status, primary_sha256,
  sha256(substr(r, 1, length(r) - length(html) - 4) || '#' || substr(html, 2) || chr(13) || chr(10) || chr(13) || chr(10)) AS replica_sha256
FROM placed WHERE page_id % 97 = 13 AND strlen(html) > 0
"""

_OP11 = """
WITH texts AS (
  SELECT doc_id, NULL AS item, text FROM documents UNION ALL SELECT NULL, CAST(item_id AS VARCHAR), text FROM benchmark
), split AS (
  SELECT doc_id, item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts
), windows AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM split WHERE item IS NOT NULL AND len(w) > 0))
), hits AS (
  SELECT doc_id, i, size, item
  FROM (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM split, (SELECT DISTINCT size FROM windows) WHERE doc_id IS NOT NULL AND len(w) >= size))
  JOIN windows USING (size, words)
), places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) WHERE doc_id IS NOT NULL
"""

_OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(list_zip(p, range(len(p)))) AS u
  FROM (SELECT lang, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)
), split AS (
  SELECT lang, list_filter(string_split_regex(u[1], '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), counts AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, CAST(count(*) AS BIGINT) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)
  GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = lp AND l.size = k JOIN counts r ON r.lang = c.lang AND r.phrase = rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS inside
  FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM found WHERE size > 2))
  GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE inside IS NULL OR CAST(100 AS HUGEINT) * inside < CAST(80 AS HUGEINT) * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_merkle_warc": _OP3, "op11_winnowing_decontamination": _OP11, "op13_phrase_collocations": _OP13}
