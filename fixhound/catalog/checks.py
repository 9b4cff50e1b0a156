"""The check queries: the same results in SQL for another engine (DuckDB).

They are written from the rules, not from the Spark plans: no hashing, salting or caps
before joins, and every text is read whole.
"""

from __future__ import annotations

from fixhound.catalog.queries import EARLIER_SHARE, FIRST_SEEDS, MIN_SHARE, MIN_STARS

# Named parts, put before a query in the order given.
PARTS = {
    "seeds": r"""seeds AS (
        SELECT item_id + 2 AS row_index, 'CVE-' || item_id AS cve_id, text AS code,
               '' AS found, regexp_extract_all(lower(text), '\S+') AS w
        FROM benchmark)""",
    "files": r"""files AS (
        SELECT doc_id AS file_id, source AS repo_name, text AS content,
               lang || '/' || doc_id AS file_path,
               regexp_extract_all(lower(text), '\S+') AS w
        FROM documents)""",
    "pairs": """pairs AS MATERIALIZED (
        SELECT DISTINCT file_id, repo_name, w[i] || ' ' || w[i + 1] AS pattern
        FROM (SELECT file_id, repo_name, w, unnest(range(1, len(w))) AS i FROM files))""",
    "patterns": """own AS (
        SELECT row_index, pattern, min(i) AS place FROM (
          SELECT row_index, i, w[i] || ' ' || w[i + 1] AS pattern
          FROM (SELECT row_index, w, unnest(range(1, len(w))) AS i FROM seeds))
        GROUP BY ALL),
      rare AS MATERIALIZED (
        SELECT * FROM (
          SELECT row_index,
            row_number() OVER (PARTITION BY row_index ORDER BY n_files, place) AS pattern_no,
            pattern, n_files
          FROM own JOIN (SELECT pattern, count(*) AS n_files FROM pairs
                         WHERE pattern IN (SELECT pattern FROM own) GROUP BY pattern)
          USING (pattern))
        WHERE pattern_no <= 5),
      patterns AS MATERIALIZED (
        SELECT row_index, pattern_no, pattern FROM rare
        UNION ALL SELECT row_index, 1, w[1] FROM seeds WHERE len(w) = 1)""",
    "hits": """hits AS (
        SELECT pattern, file_id, repo_name,
               row_number() OVER (PARTITION BY pattern ORDER BY file_id) AS hit_no
        FROM pairs WHERE pattern IN (SELECT pattern FROM patterns))""",
    "capped": """capped AS (
        SELECT row_index, pattern_no, pattern, hit_no, file_id, repo_name
        FROM patterns JOIN hits USING (pattern) WHERE hit_no <= 10)""",
    "repos": """repos AS (
        SELECT source AS repo_name, CAST(sum(n_chars) AS BIGINT) AS stars,
               5 * sum(toxic) > count(toxic) AS flagged
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""",
    "readmes": """readmes AS (
        SELECT source AS repo_name, nullif(lang, 'en') AS description, text AS readme
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
              FROM documents)
        WHERE n = 1)""",
    "entries": """entries AS (
        SELECT row_index, repo_name, pattern_no, hit_no, file_id, n_hits, stars, flagged
        FROM (SELECT *,
                     row_number() OVER (PARTITION BY row_index, repo_name
                                        ORDER BY pattern_no, hit_no) AS n,
                     count(*) OVER (PARTITION BY row_index, repo_name) AS n_hits
              FROM capped)
        JOIN repos USING (repo_name)
        WHERE n = 1)""",
    "known_entries": f"""known_entries AS (
        SELECT row_index, repo_name, pattern_no, hit_no, file_id, n_hits,
               CASE WHEN stars >= {MIN_STARS} THEN stars ELSE 0 END AS stars
        FROM entries WHERE NOT (stars >= {MIN_STARS} AND flagged IS TRUE))""",
    "listed": """listed AS (
        SELECT * EXCLUDE (flagged) FROM (
          SELECT *, row_number() OVER (PARTITION BY row_index
                                       ORDER BY stars DESC, pattern_no, hit_no) AS rank
          FROM entries WHERE flagged IS NOT TRUE)
        WHERE rank <= 10)""",
    "accepted": "accepted AS (SELECT * EXCLUDE (share) FROM by_share)",
    "shingles": """seed_shingles AS (
        SELECT DISTINCT row_index, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle
        FROM (SELECT row_index, w, unnest(range(1, len(w) - 1)) AS i FROM seeds)),
      file_shingles AS (
        SELECT DISTINCT file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle
        FROM (SELECT file_id, w, unnest(range(1, len(w) - 1)) AS i FROM files)),
      seed_sizes AS (
        SELECT row_index, count(*) AS seed_shingles FROM seed_shingles GROUP BY row_index),
      file_sizes AS (
        SELECT file_id, count(*) AS file_shingles FROM file_shingles GROUP BY file_id),
      shares AS (
        SELECT row_index, file_id, count(*) AS shared
        FROM seed_shingles JOIN file_shingles USING (shingle) GROUP BY ALL)""",
    "by_share": f"""by_share AS (
        SELECT listed.*, shared / seed_shingles AS share
        FROM listed JOIN shares USING (row_index, file_id) JOIN seed_sizes USING (row_index)
        WHERE shared >= {MIN_SHARE} * seed_shingles)""",
    "matches": """matches AS (
        SELECT * EXCLUDE (rank, place), place AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY rank) AS place
          FROM accepted)
        WHERE place <= 5)""",
    "cells": """cells AS (
        SELECT row_index, coalesce(string_agg(
                 repo_name || ' (' || stars || ' stars) | https://github.com/' || repo_name,
                 chr(10) ORDER BY rank), 'None found') AS found
        FROM seeds LEFT JOIN matches USING (row_index) GROUP BY row_index)""",
}

PARTS["given_patterns"] = PARTS["patterns"].replace("patterns AS MATERIALIZED (", "plain AS (") + """,
      patterns AS (
        SELECT * FROM plain WHERE row_index % 2 = 1
          OR row_index IN (SELECT row_index FROM seeds WHERE len(w) < 4)
        UNION ALL SELECT row_index, i, w[2 * i - 1] || ' ' || w[2 * i]
        FROM seeds, (SELECT unnest([1, 2]) AS i) WHERE row_index % 2 = 0 AND len(w) >= 4)"""
PARTS["answered"] = """answered AS (
        SELECT * EXCLUDE (flagged) FROM (
          SELECT *, row_number() OVER (PARTITION BY row_index
                                       ORDER BY stars DESC, pattern_no, hit_no) AS rank
          FROM entries WHERE repo_name NOT IN
            (SELECT repo_name FROM readmes WHERE length(readme) > 2000))
        WHERE rank <= 10),
      accepted AS (
        SELECT answered.* FROM answered LEFT JOIN labels ON doc_id = file_id
        WHERE coalesce(quality = 1, true))"""
PARTS["faulty"] = """numbered AS (
        SELECT item_id, 'CVE-' || item_id AS cve_id, item_id % 9 = 4 AS damaged, item_id % 6 = 0 AS done,
          CASE WHEN item_id % 7 = 3 THEN NULL WHEN item_id % 5 = 1 THEN item_id + 1
            ELSE item_id + 2 END AS row_index
        FROM benchmark),
      counted AS (
        SELECT *, count(*) OVER (PARTITION BY row_index) AS n FROM numbered),
      messages AS (
        SELECT *, CASE WHEN row_index IS NULL THEN 'no row number'
            WHEN row_index < 2 THEN 'row number below the first row'
            WHEN n > 1 THEN 'row number occurs ' || n || ' times'
            WHEN damaged THEN 'code is not text' END AS message
        FROM counted),
      statuses AS (
        SELECT row_index, cve_id, message, CASE WHEN message IS NOT NULL THEN 'error'
            WHEN done THEN 'skipped'
            WHEN item_id + 2 IN (SELECT row_index FROM matches) THEN 'updated'
            ELSE 'none_found' END AS status
        FROM messages)"""

PARTS["learned"] = """counts AS MATERIALIZED (
        SELECT file_id, word, count(*) AS n FROM (SELECT file_id, unnest(w) AS word FROM files) GROUP BY ALL),
      taught AS (
        SELECT file_id, toxic = 1 AS scanner FROM files JOIN labels ON doc_id = file_id WHERE file_id % 2 = 0),
      per_word AS (
        SELECT word, coalesce(sum(n) FILTER (scanner), 0) AS yes, coalesce(sum(n) FILTER (NOT scanner), 0) AS no
        FROM counts JOIN taught USING (file_id) GROUP BY word),
      sizes AS (
        SELECT count(*) AS v, sum(yes) AS in_yes, sum(no) AS in_no FROM per_word),
      model AS (
        SELECT word, ln((yes + 1) / (no + 1)) AS ratio FROM per_word),
      learned AS (
        SELECT file_id AS repo_name,
          sum(n * (coalesce(ratio, 0) + (SELECT ln((in_no + v + 1) / (in_yes + v + 1)) FROM sizes)))
            + (SELECT ln(count_if(scanner) / count_if(NOT scanner)) FROM taught) AS score
        FROM counts LEFT JOIN model USING (word) GROUP BY file_id)"""

_PATTERNS = ("seeds", "files", "pairs", "patterns")
_FOUND = (*_PATTERNS, "hits", "capped")
_ENTRIES = (*_FOUND, "repos", "entries")
_LISTED = (*_ENTRIES, "listed")
_ACCEPTED = (*_LISTED, "shingles", "by_share", "accepted")
_MATCHES = (*_ACCEPTED, "matches")


def _with(parts: tuple[str, ...], query: str) -> str:
    return "WITH " + ",\n      ".join(PARTS[p] for p in parts) + "\n" + query


_REPORT = """SELECT DISTINCT concat(fx.o_orderpriority, '/commit/', fx.o_orderkey) AS commit_url,
       fx.o_custkey AS cve_id, fx.o_orderkey AS hash, fx.o_orderpriority AS repo_url
  FROM lineitem f
  JOIN orders c ON f.l_orderkey = c.o_orderkey
  JOIN orders fx ON c.o_orderkey = fx.o_orderkey
  JOIN customer cv ON fx.o_custkey = cv.c_custkey
  JOIN customer cc ON cv.c_custkey = cc.c_custkey
  WHERE fx.o_totalprice / 5000 >= 55 AND f.l_returnflag = 'R' AND cc.c_mktsegment = 'BUILDING'"""

_REPLIES = r"""replies AS (
    SELECT event_id AS row_index,
      CASE event_type
        WHEN 'click' THEN ' ' || chr(10) || pair || chr(9)
        WHEN 'view' THEN '```json' || chr(10) || pair || chr(10) || '```'
        WHEN 'purchase' THEN '[' || user_id || ', 2.5, true, null, "null", "f", "g"]'
        WHEN 'error' THEN '```json ' || pair || '```'
        WHEN 'signup' THEN props END AS reply
    FROM (SELECT *, '["user ' || user_id || '", "' || event_type || '"]' AS pair FROM events)),
  stripped AS (
    SELECT row_index, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS s,
           string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), chr(10)) AS lines
    FROM replies),
  opened AS (
    SELECT row_index, starts_with(s, '```') AND len(lines) > 2 AS fenced, s,
           array_to_string(lines[2:len(lines) - 1], chr(10)) AS inside,
           regexp_replace(lines[1], '^```', '') AS label
    FROM stripped),
  bodies AS (
    SELECT row_index, CASE WHEN NOT fenced THEN s
      WHEN starts_with(inside, 'json') THEN regexp_replace(substr(inside, 5), '^\s+|\s+$', '', 'g')
      ELSE inside END AS body
    FROM opened),
  lists AS (
    SELECT row_index, CASE WHEN json_valid(body) AND json_type(body) = 'ARRAY'
      THEN json_extract(body, '$[*]')[1:5] ELSE [] END AS list
    FROM bodies),
  items AS (
    SELECT row_index, i AS pattern_no, CASE json_type(e)
      WHEN 'NULL' THEN 'None'
      WHEN 'BOOLEAN' THEN CASE CAST(e AS VARCHAR) WHEN 'true' THEN 'True' ELSE 'False' END
      WHEN 'VARCHAR' THEN e->>'$'
      ELSE CAST(e AS VARCHAR) END AS pattern
    FROM (SELECT row_index, unnest(list) AS e, unnest(range(1, len(list) + 1)) AS i FROM lists))"""

_PHRASES = _with(
    ("seeds", "files"),
    """, given AS (
        SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS pattern
        FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM seeds, (SELECT unnest([4, 6]) AS n))),
      runs AS (
        SELECT file_id, repo_name, array_to_string(w[i:i + n - 1], ' ') AS pattern
        FROM (SELECT file_id, repo_name, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM files, (SELECT unnest([4, 6]) AS n)))
      SELECT DISTINCT pattern, file_id, repo_name
      FROM runs WHERE pattern IN (SELECT pattern FROM given)""",
)

_FINGERPRINTS = r"""WITH texts AS (
      SELECT 'file' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT 'seed', item_id + 2, coalesce(text, '') FROM benchmark),
    kept AS (
      SELECT word FROM (
        SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*')) AS word
        FROM texts WHERE kind = 'file')
      GROUP BY word ORDER BY count(*) DESC, word LIMIT 500),
    tokens AS (
      SELECT kind, id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS place
      FROM (SELECT kind, id, regexp_extract_all(
              text, '[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\p{L}\p{N}_\x09-\x0D\x20]') AS w
            FROM texts)),
    folded AS (
      SELECT kind, id, list(CASE WHEN word IS NOT NULL THEN token
          WHEN regexp_matches(token, '^\p{N}') THEN '0'
          WHEN regexp_matches(token, '^[\p{L}_]') THEN 'v' ELSE token END ORDER BY place) AS w
      FROM tokens LEFT JOIN kept ON token = word GROUP BY kind, id),
    runs AS (
      SELECT kind, id, len(w) AS n_tokens, list_transform(
        range(1, greatest(1, len(w) - 7) + 1),
        lambda i: CAST('0x' || md5(array_to_string(w[i:i + 7], ' '))[1:15] AS BIGINT)) AS h
      FROM folded),
    prints AS MATERIALIZED (
      SELECT kind, id, coalesce(n_tokens, 0) AS n_tokens, coalesce(list_sort(list_distinct(list_transform(
        range(1, greatest(1, len(h) - 5) + 1), lambda i: list_min(h[i:i + 5])))), []) AS prints
      FROM texts LEFT JOIN runs USING (kind, id))
    """

CHECKS: dict[str, str] = {
    "fix_report_sql": f"{_REPORT} ORDER BY cve_id",
    "fix_report_semi": f"{_REPORT} ORDER BY cve_id",
    "fix_report_summary": f"SELECT count(*) AS n_rows FROM ({_REPORT})",
    "fix_report_preview": f"{_REPORT} ORDER BY cve_id, hash, repo_url, commit_url LIMIT 5",
    "scalar_concat_nulls": """SELECT o_orderkey,
        concat(nullif(o_orderpriority, '1-URGENT'), '/commit/', o_orderkey) AS commit_url
      FROM orders""",
    "pattern_qualified": _with(
        _PATTERNS,
        """SELECT row_index, pattern_no, CASE pattern_no
            WHEN 2 THEN pattern || ' Language:Python'
            ELSE pattern || ' language:python' END AS query
          FROM patterns""",
    ),
    "text_truncated": """SELECT doc_id AS file_id, substring(text, 1, 5000) AS code_snippet
      FROM documents""",
    "detail_cell_truncated": """SELECT doc_id AS file_id, CASE WHEN length(text) > 30000
        THEN substring(text, 1, 30000) || chr(10) || '... (truncated)' ELSE text END AS cell
      FROM documents""",
    "utf8_or_empty": """SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE text END AS content
      FROM documents""",
    "pattern_list_parse": f"""WITH {_REPLIES}
      SELECT row_index, CAST(len(list) AS BIGINT) AS n_patterns,
        coalesce((SELECT string_agg(pattern, '|' ORDER BY pattern_no) FROM items
                  WHERE items.row_index = lists.row_index), '') AS patterns
      FROM lists""",
    "pattern_rows": f"WITH {_REPLIES} SELECT row_index, pattern_no, pattern FROM items",
    "verdict_parse": """SELECT event_id, event_type IN ('click', 'view') AS scanner,
        event_type IN ('click', 'view', 'error') AS similar
      FROM events""",
    "seed_rows_clean": """SELECT * FROM (
        SELECT doc_id + 2 AS row_index,
          CASE WHEN quality = 1 THEN '1' ELSE '' END AS quality,
          CASE WHEN toxic = 1 THEN 'True' ELSE '' END AS toxic,
          CASE WHEN quality = 1 THEN lang ELSE '' END AS lang,
          CASE WHEN toxic = 1 THEN text ELSE '' END AS code
        FROM documents LEFT JOIN labels USING (doc_id))
      WHERE quality <> '' OR toxic <> '' OR lang <> '' OR code <> ''""",
    "seeds_first_n": _with(
        ("seeds",),
        f"""SELECT row_index, cve_id, code, found FROM seeds
          ORDER BY row_index LIMIT {FIRST_SEEDS}""",
    ),
    "pending_seeds": _with(
        (*_MATCHES, "cells"),
        """SELECT row_index, cve_id, cells.found FROM seeds JOIN cells USING (row_index)
          WHERE length(cells.found) <= 10""",
    ),
    "seed_patterns": _with(
        _PATTERNS, "SELECT row_index, pattern_no, pattern FROM patterns"
    ),
    "seed_patterns_rare": _with(
        _PATTERNS, "SELECT row_index, pattern_no, pattern, n_files FROM rare"
    ),
    "pattern_hits": _with(_FOUND[:-1], "SELECT pattern, file_id, repo_name FROM hits"),
    "phrase_hits": _PHRASES,
    "pattern_hits_capped": _with(_FOUND, "SELECT * FROM capped"),
    "hits_union_all": _with(
        _FOUND,
        r""", talks AS (
            SELECT conv_id * 1000 + turn AS file_id, role AS repo_name,
                   regexp_extract_all(lower(text), '\S+') AS w
            FROM conversations),
          talk_hits AS (
            SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY file_id) AS hit_no
            FROM (SELECT DISTINCT file_id, repo_name, w[i] || ' ' || w[i + 1] AS pattern
                  FROM (SELECT file_id, repo_name, w, unnest(range(1, len(w))) AS i FROM talks)))
          SELECT row_index, pattern_no, pattern, hit_no, file_id, repo_name FROM capped
          UNION ALL
          SELECT row_index, pattern_no, pattern, hit_no, file_id, repo_name
          FROM patterns JOIN talk_hits USING (pattern) WHERE hit_no <= 10""",
    ),
    "indexed_places": _with(_FOUND[:-1], "SELECT pattern, file_id, repo_name FROM hits"),
    "indexed_phrases": _PHRASES,
    "indexed_patterns": _with(
        _PATTERNS, "SELECT row_index, pattern_no, pattern, n_files FROM rare"
    ),
    "indexed_hits": _with(_FOUND, "SELECT * FROM capped"),
    "incremental_hits": _with(_FOUND, "SELECT * FROM capped"),
    "repo_candidates": _with(_ENTRIES, "SELECT * EXCLUDE (flagged) FROM entries"),
    "repo_samples": _with(
        _FOUND,
        """SELECT row_index, capped.repo_name, count(*) AS n_samples,
            string_agg(substring(content, 1, 5000), chr(10) ORDER BY pattern_no, hit_no)
              AS code_samples,
            string_agg('https://github.com/' || capped.repo_name || '/blob/HEAD/' || file_id,
                       chr(10) ORDER BY pattern_no, hit_no) AS file_urls
          FROM capped JOIN files USING (file_id)
          GROUP BY row_index, capped.repo_name""",
    ),
    "repo_attributes": _with(("repos",), "SELECT * FROM repos"),
    "repo_readme": _with(
        ("readmes",),
        """SELECT repo_name, coalesce(description, '') AS description,
            substring(readme, 1, 2000) AS readme FROM readmes""",
    ),
    "repos_min_stars": _with(("repos",), f"SELECT * FROM repos WHERE stars >= {MIN_STARS}"),
    "repos_fork_archive": _with(
        ("repos",),
        """SELECT *, CASE WHEN stars % 3 = 0 THEN length(repo_name) % 2 = 0 END AS fork,
            CASE WHEN stars % 2 = 0 THEN stars % 5 = 0 END AS archived
          FROM repos
          WHERE NOT coalesce(stars % 3 = 0 AND length(repo_name) % 2 = 0, false)
            AND NOT coalesce(stars % 2 = 0 AND stars % 5 = 0, false)""",
    ),
    "repos_unknown_kept": _with((*_ENTRIES, "known_entries"), "SELECT * FROM known_entries"),
    "repos_top_stars": _with(
        ("repos",), "SELECT * FROM repos ORDER BY stars DESC, repo_name LIMIT 5"
    ),
    "repos_not_flagged": _with(
        _ENTRIES, "SELECT * EXCLUDE (flagged) FROM entries WHERE flagged IS NOT TRUE"
    ),
    "repos_not_flagged_answers": _with(
        (*_ENTRIES, "readmes"),
        """SELECT * EXCLUDE (flagged) FROM entries WHERE repo_name NOT IN
            (SELECT repo_name FROM readmes WHERE length(readme) > 2000)""",
    ),
    "scanners_learned": _with(
        ("files", "learned"),
        """SELECT file_id AS repo_name, round(score, 4) AS score, coalesce(score > 0, false) AS flagged
          FROM files LEFT JOIN learned ON learned.repo_name = file_id""",
    ),
    "scanners_agreement": _with(
        ("files", "learned"),
        """SELECT toxic = 1 AS scanner, count(*) AS answers,
            count_if(coalesce(score > 0, false) = (toxic = 1)) AS agreed
          FROM labels LEFT JOIN learned ON repo_name = doc_id WHERE doc_id % 2 = 1 GROUP BY toxic""",
    ),
    "candidates_top10": _with(_LISTED, "SELECT * FROM listed"),
    "validated_candidates": _with(_ACCEPTED, "SELECT * FROM accepted"),
    "validated_by_share": _with((*_LISTED, "shingles", "by_share"), "SELECT * FROM by_share"),
    "validated_by_answers": _with(
        _LISTED,
        """SELECT listed.* FROM listed LEFT JOIN labels ON doc_id = file_id
          WHERE coalesce(quality = 1, true)""",
    ),
    "latest_commit": """SELECT user_id || '/' || event_type AS file_id,
        CAST(event_id AS VARCHAR) AS sha,
        'https://github.com/' || user_id || '/commit/' || event_id AS commit_url
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                         ORDER BY ts DESC, event_id DESC) AS n FROM events)
      WHERE n = 1""",
    "commit_or_head": """SELECT file_id, repo_name, sha AS commit_sha,
        'https://github.com/' || repo_name || '/commit/' || sha AS commit_url
      FROM (
        SELECT doc_id AS file_id, source AS repo_name, CASE WHEN toxic = 1
            THEN 'head-' || source ELSE CAST(event_id AS VARCHAR) END AS sha
        FROM documents LEFT JOIN labels USING (doc_id)
        LEFT JOIN (SELECT user_id, event_id, row_number() OVER (
                     PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e
          ON e.user_id = doc_id AND n = 1)""",
    "similar_pairs": _with(
        ("seeds", "files", "shingles"),
        f"""SELECT min(row_index) AS row_index, count(DISTINCT row_index) AS n_seeds,
            min(file_id) AS file_id, count(DISTINCT file_id) AS n_files,
            shared, seed_shingles, file_shingles, shared / seed_shingles AS share,
            shared / (seed_shingles + file_shingles - shared) AS jaccard
          FROM shares JOIN seed_sizes USING (row_index) JOIN file_sizes USING (file_id)
          JOIN (SELECT row_index, list(shingle ORDER BY shingle) AS seed_text
                FROM seed_shingles GROUP BY row_index) USING (row_index)
          JOIN (SELECT file_id, content FROM files) USING (file_id)
          WHERE shared >= {MIN_SHARE} * seed_shingles
          GROUP BY seed_text, content, shared, seed_shingles, file_shingles""",
    ),
    "similar_classes": """WITH RECURSIVE texts AS (
        SELECT min(doc_id) AS doc, count(*) AS n_files, regexp_extract_all(lower(text), '\\S+') AS w
        FROM documents GROUP BY text),
      shingles AS (
        SELECT DISTINCT doc, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle
        FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
      sizes AS (SELECT doc, count(*) AS n FROM shingles GROUP BY doc),
      links AS MATERIALIZED (
        SELECT a, b FROM (
          SELECT x.doc AS a, y.doc AS b, count(*) AS shared
          FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc <> y.doc GROUP BY ALL)
        JOIN sizes p ON p.doc = a JOIN sizes q ON q.doc = b
        WHERE shared / (p.n + q.n - shared) >= 0.8),
      reached AS (
        SELECT doc AS a, doc AS b FROM texts
        UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
      labels AS (SELECT a AS doc, min(b) AS label FROM reached GROUP BY a)
      SELECT label AS class_id, count(*) AS n_texts, CAST(sum(n_files) AS BIGINT) AS n_files
      FROM texts JOIN labels USING (doc) GROUP BY label""",
    "file_fingerprints": _FINGERPRINTS
    + """SELECT id AS file_id, n_tokens, len(prints) AS n_prints,
          md5(array_to_string(prints, ' ')) AS prints_md5
        FROM prints WHERE kind = 'file'""",
    "renamed_copies": _FINGERPRINTS
    + """, sets AS (
          SELECT kind, min(id) AS id, count(*) AS n, prints FROM prints WHERE len(prints) > 0
          GROUP BY kind, prints)
        SELECT row_index, n_seeds, file_id, n_files, shared, seed_prints, file_prints,
          shared / seed_prints AS share
        FROM (SELECT s.id AS row_index, s.n AS n_seeds, f.id AS file_id, f.n AS n_files,
                len(list_intersect(s.prints, f.prints)) AS shared,
                len(s.prints) AS seed_prints, len(f.prints) AS file_prints
              FROM sets s JOIN sets f ON s.kind = 'seed' AND f.kind = 'file')
        WHERE shared >= 0.5 * seed_prints""",
    "matches_top5": _with(_MATCHES, "SELECT * FROM matches"),
    "matches_in_rounds": _with(
        _MATCHES,
        """, stopped AS (
            SELECT row_index, max(rank) AS last FROM (
              SELECT row_index, rank, row_number() OVER (PARTITION BY row_index ORDER BY rank) AS place
              FROM accepted)
            WHERE place <= 5 GROUP BY row_index HAVING count(*) = 5)
          SELECT row_index, count(*) AS n_compared, max(rank) AS last_rank,
            count_if((row_index, rank) IN (SELECT row_index, rank FROM accepted)) AS n_matches
          FROM listed LEFT JOIN stopped USING (row_index)
          WHERE last IS NULL OR rank <= last
          GROUP BY row_index""",
    ),
    "found_in_projects": _with((*_MATCHES, "cells"), "SELECT * FROM cells"),
    "found_column_update": _with(
        (*_MATCHES, "cells"),
        """SELECT row_index, cve_id, code, cells.found
          FROM seeds JOIN cells USING (row_index)""",
    ),
    "found_column_touched_files": _with(
        (*_MATCHES, "cells"),
        """SELECT row_index, cve_id, code, cells.found
          FROM seeds JOIN cells USING (row_index)""",
    ),
    "detail_rows": _with(
        _MATCHES,
        """SELECT cve_id AS "CVE ID", 'Unknown' AS "Vulnerability Type",
            m.repo_name AS "Repository Name", stars AS "Stars",
            'https://github.com/' || m.repo_name AS "Repository URL",
            'https://github.com/' || m.repo_name || '/commit/' || event_id AS "Commit URL",
            file_path AS "File Path", substring(content, 1, 5000) AS "Code Snippet"
          FROM matches m JOIN seeds USING (row_index) JOIN files USING (file_id)
          LEFT JOIN (SELECT user_id, event_id, row_number() OVER (
                       PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e
            ON e.user_id = file_id AND n = 1""",
    ),
    "detail_rows_with_heads": _with(
        _MATCHES,
        """SELECT cve_id AS "CVE ID", 'Unknown' AS "Vulnerability Type",
            m.repo_name AS "Repository Name", stars AS "Stars",
            'https://github.com/' || m.repo_name AS "Repository URL",
            'https://github.com/' || m.repo_name || '/commit/' || CASE WHEN toxic = 1
              THEN 'head-' || m.repo_name ELSE CAST(event_id AS VARCHAR) END AS "Commit URL",
            file_path AS "File Path", substring(content, 1, 5000) AS "Code Snippet"
          FROM matches m JOIN seeds USING (row_index) JOIN files USING (file_id)
          LEFT JOIN labels ON labels.doc_id = file_id
          LEFT JOIN (SELECT user_id, event_id, row_number() OVER (
                       PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e
            ON e.user_id = file_id AND n = 1""",
    ),
    "matches_by_answers": _with(
        ("seeds", "files", "pairs", "given_patterns", "hits", "capped", "repos", "readmes", "entries",
         "answered", "matches"),
        "SELECT * FROM matches",
    ),
    "row_status": _with((*_MATCHES, "faulty"), "SELECT * FROM statuses"),
    "run_summary_with_errors": _with(
        (*_MATCHES, "faulty"),
        """SELECT count(*) AS total, count_if(status <> 'error') AS processed,
            count_if(status = 'skipped') AS skipped, count_if(status = 'updated') AS updated,
            count_if(status = 'none_found') AS none_found, count_if(status = 'error') AS errors
          FROM statuses""",
    ),
    "run_summary": _with(
        _MATCHES,
        f"""SELECT count(*) AS total, count(*) AS processed,
            count_if(done) AS skipped, count_if(NOT done AND hit) AS updated,
            count_if(NOT done AND NOT hit) AS none_found
          FROM (SELECT row_index IN (SELECT row_index FROM by_share
                                     WHERE share >= {EARLIER_SHARE}) AS done,
                       row_index IN (SELECT row_index FROM matches) AS hit FROM seeds)""",
    ),
    "seed_funnel": _with(
        _ACCEPTED,
        """SELECT row_index,
            (SELECT count(*) FROM entries e WHERE e.row_index = s.row_index) AS found,
            (SELECT count(*) FROM entries e
             WHERE e.row_index = s.row_index AND flagged IS NOT TRUE) AS kept,
            (SELECT count(*) FROM listed l WHERE l.row_index = s.row_index) AS compared,
            (SELECT count(*) FROM accepted v WHERE v.row_index = s.row_index) AS validated
          FROM seeds s""",
    ),
    "incremental_run": _with(
        (*_MATCHES, "cells"),
        f""", earlier AS (
            SELECT row_index, string_agg(
              repo_name || ' (' || stars || ' stars) | https://github.com/' || repo_name,
              chr(10) ORDER BY rank) AS found
            FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY rank) AS place
                  FROM by_share WHERE share >= {EARLIER_SHARE})
            WHERE place <= 5 GROUP BY row_index)
          SELECT row_index, cve_id, coalesce(earlier.found, cells.found) AS found
          FROM seeds JOIN cells USING (row_index) LEFT JOIN earlier USING (row_index)""",
    ),
}
