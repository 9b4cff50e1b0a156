"""Check queries of this subpackage in DuckDB's SQL, where SQL can express an operator and is quick enough."""

from __future__ import annotations

#: Unsigned CRC-32 of an id as text.
CRC32 = """
xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(
    list_prepend(xor(a, b), range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
), 4294967295::BIGINT)
"""

#: Two equal words of a text are q apart; places in a row, q apart, are a run less its last period.
OP11 = f"""
WITH split AS (
  SELECT doc_id, {CRC32} AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), chosen AS (
  SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted, h // 10 AS g,
    CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a
  FROM split
), placed AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM chosen
), listed AS (
  SELECT doc_id, n, CASE WHEN planted
      THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
      ELSE words END AS words
  FROM placed
), placed_words AS (
  SELECT doc_id, n, unnest(words) AS w, unnest(range(n)) AS i FROM listed
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i
  FROM placed_words x JOIN placed_words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), grouped AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, min(i) AS s, count(*) + q AS length, q FROM grouped GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, s, length, min(q) AS q FROM stretches GROUP BY ALL
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min(struct_pack(s := s, length := length, q := q), struct_pack(a := -length, b := s, c := q)) AS r
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM placed_words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.length AS length, r.q AS period,
  (1000 * r.length) // r.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256, n AS n_words
FROM listed LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
    ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces
), runs AS (
  SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM listed, range(1, 6) AS sizes(k)
), counts AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 100
), inner_phrases AS (
  SELECT lang, f AS longer, k, w, unnest(range(2, k)) AS size FROM candidates
), starts AS (
  SELECT lang, longer, w, size, unnest(range(1, k - size + 2)) AS i FROM inner_phrases
), held AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(longer) AS longer FROM starts GROUP BY ALL
), kept AS (
  SELECT candidates.* FROM candidates LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f
), cuts AS (
  SELECT lang, phrase, f AS a, w, k, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT lang, cuts.phrase, a, x.f AS l, y.f AS r, n, cut,
    ((1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts JOIN totals USING (lang)
  JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 : cuts.k], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""

CHECKS: dict[str, str] = {"op11_periodic_runs": OP11, "op12_embedding_links": OP12, "op13_collocations": OP13}
