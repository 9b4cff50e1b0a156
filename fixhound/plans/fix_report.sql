-- Fixes of one weakness class that touch one language, one row each.
-- The joined tables are reduced to their distinct keys first, so a commit that changed a
-- million files counts once and the joins cannot multiply rows. A CVE or a commit with very
-- many fixes is spread over eight tasks; this text cannot look for such keys first, so it
-- repeats all distinct keys eight times.
WITH touched AS (
  SELECT f.hash
  FROM (SELECT DISTINCT hash FROM file_change WHERE programming_language = :language) f
  LEFT SEMI JOIN (SELECT DISTINCT hash FROM commits) c ON c.hash = f.hash
),
classed AS (
  SELECT w.cve_id
  FROM (SELECT DISTINCT cve_id FROM cwe_classification WHERE cwe_id = :cwe_id) w
  LEFT SEMI JOIN (SELECT DISTINCT cve_id FROM cve) v ON v.cve_id = w.cve_id
),
picked AS (
  SELECT DISTINCT
    cve_id,
    hash,
    repo_url,
    CAST(pmod(xxhash64(hash, repo_url), 8) AS INT) AS cve_part,
    CAST(pmod(xxhash64(cve_id, repo_url), 8) AS INT) AS hash_part
  FROM fixes
  WHERE score >= :min_score
)
SELECT
  concat_ws('', p.repo_url, '/commit/', p.hash) AS commit_url,
  p.cve_id,
  p.hash,
  p.repo_url
FROM picked p
JOIN (SELECT cve_id, explode(sequence(0, 7)) AS part FROM classed) c
  ON c.cve_id = p.cve_id AND c.part = p.cve_part
JOIN (SELECT hash, explode(sequence(0, 7)) AS part FROM touched) t
  ON t.hash = p.hash AND t.part = p.hash_part
ORDER BY p.cve_id NULLS LAST, p.hash, p.repo_url
