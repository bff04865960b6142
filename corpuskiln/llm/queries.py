"""The registered query of each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from .audio import op1_audio_features
from .bpe import op8_bpe
from .idfiles import op13_id_files
from .imatch import op10_imatch
from .neardup import op7_minhash_near_dedup
from .packing import op4_best_fit_packing
from .phrases import op11_collocations
from .secrets import op2_secret_scan
from .substring import op9_substring_dedup
from .toxicity import op3_toxicity
from .urltree import op5_url_filter
from .vectorcodes import op12_vector_codes
from .warc import op6_warc_revisits

QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filter": op5_url_filter,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_imatch": op10_imatch,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_id_files": op13_id_files,
}

#: Revisit resolution is plain SQL: the digest's largest id is the original of its payloads of 1000 bytes and more.
_OP6 = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
best AS (SELECT payload_digest, max(page_id) AS original FROM heads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT h.page_id, CAST(h.payload_bytes AS BIGINT) AS payload_bytes, h.payload_digest,
  CASE WHEN h.payload_bytes >= 1000 AND h.page_id <> b.original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN h.payload_bytes >= 1000 AND h.page_id <> b.original THEN b.original END AS refers_to
FROM heads h LEFT JOIN best b USING (payload_digest)
"""

#: All phrases of 1 to 3 words are counted, without levels.
_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, unnest(flatten([
    list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i], ' ')),
    list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')),
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))])) AS phrase FROM lists),
f AS (SELECT lang, phrase, CAST(count(*) AS HUGEINT) AS f FROM phrases GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 10 AND phrase LIKE '% %'),
inner_phrases AS (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE len(w) = 3),
covering AS (SELECT lang, phrase, max(a) AS within FROM inner_phrases GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covering v USING (lang, phrase) WHERE within IS NULL OR 100 * within < 50 * a),
cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM kept),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k+1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _op12() -> str:
    """Every part against every entry, in as many rounds as the query has; parts of four components."""
    assign = """
a{i} AS (SELECT c.vec_id, c.part, c.x, min((({d})) * 64 + e.entry) AS found FROM cut c JOIN b{i} e USING (part) GROUP BY ALL)"""
    move = """,
m{i} AS (SELECT part, found % 64 AS entry, [{means}] AS c FROM a{i} GROUP BY ALL),
b{j} AS (SELECT part, entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry)),"""
    d = " + ".join(f"(c.x[{k}] - e.c[{k}]) * (c.x[{k}] - e.c[{k}])" for k in range(1, 5))
    means = ", ".join(f"(sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
    rounds = "".join(assign.format(i=i, d=d) + (move.format(i=i, j=i + 1, means=means) if i < 2 else "") for i in range(3))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM kept, range(16) AS t(part)),
least AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT part, entry, x AS c FROM cut JOIN least USING (vec_id)),{rounds},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', found % 64), '' ORDER BY part) AS code, CAST(sum(found // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept k JOIN coded USING (vec_id), digest
"""


ORACLE_SQL: dict[str, str] = {"op6_warc_revisits": _OP6, "op11_collocations": _OP11, "op12_vector_codes": _op12()}
