"""DuckDB SQL for the registered queries that SQL can express."""

from zonecast.llm import licenses


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    """The canonical form of a licence text, line ends kept."""
    lower = f"translate(coalesce({column}, ''), {_quoted(licenses.UPPER)}, {_quoted(licenses.LOWER)})"
    start, named = "^[^a-z0-9]*", r"copyright[ \t:]+[^a-z0-9 \t\n\x0b\f\r,.;)]*"
    dated = licenses.DATED_C.replace("{no_digit}", "([^0-9]|$)")
    holder = f"""(regexp_matches(l, {_quoted(f"{start}({licenses.STATED})")})
      OR CASE WHEN contains({lower}, '(b)') THEN regexp_matches(l, {_quoted(start + dated)}) ELSE regexp_matches(l, {_quoted(start + licenses.MARK_C)}) END
      OR (regexp_matches(l, {_quoted(f"{start}{named}[a-z0-9]")}) AND NOT regexp_matches(l, {_quoted(f"{start}{named}{licenses.NO_HOLDER}([^a-z]|$)")})))"""
    out = f"array_to_string(list_transform(string_split({lower}, chr(10)), lambda l: CASE WHEN {holder} THEN '' ELSE l END), chr(10))"
    out = f"regexp_replace({out}, {_quoted(licenses.MARKS)}, ' ', 'g')"
    for a, b in licenses.EQUIVALENT:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return out


def _one_line(form: str) -> str:
    return f"trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'))"


def _centroids(dim: int, scale: int, k: int, rounds: int, seed: int) -> str:
    """Rounds of nearest centroids and exact floored means, whole comparisons throughout."""
    ctes = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) * {scale} >= 134217728)) = 0
)""", f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)"""]
    for i in range(rounds + 1):
        # |x|^2 + |c|^2 - 2 x.c of integers, exact in double precision
        ctes.append(f"""a{i} AS (
  SELECT r, vec_id, kept.v, c{i}.c, c{i}.v AS cv,
    CAST(list_inner_product(kept.v::DOUBLE[], kept.v::DOUBLE[]) + list_inner_product(c{i}.v::DOUBLE[], c{i}.v::DOUBLE[]) - 2 * list_inner_product(kept.v::DOUBLE[], c{i}.v::DOUBLE[]) AS BIGINT) AS d
  FROM kept CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c{i}.c) = 1
)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (
  SELECT c, i, sum(v[i]) AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {dim + 1}) AS g(i) GROUP BY c, i
), c{i + 1} AS (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c) m ON m.c = c{i}.c
)""")
    return "WITH " + ", ".join(ctes) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{rounds}
"""


_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.known_texts() + licenses.whole_texts())

ORACLES = {
    "op1_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(role || chr(1) || text,
      '(<)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|\|endoftext\|>|\|startoftext\|>)', '\1\\\2\3', 'g'),
      '(\[)(\\*)(INST\]|/INST\])', '\1\\\2\3', 'g') AS said
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(said) - 1 + length('<|im_start|><|im_sep|><|im_end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op5_quality": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_latin,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes
  FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id
), f AS (
  SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
    + 8 * (word_chars > 20 * n_words)::INT + 16 * (100 * n_symbols > 10 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
    + 64 * (100 * n_upper > 60 * n_latin)::INT + 128 * (100 * n_echoes > 30 * n_words)::INT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits
FROM f
""",
    "op4_licenses": f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license
  FROM (SELECT license, {_one_line(_canonical("text"))} AS form FROM (VALUES {_KNOWN}) AS v(license, text))
  WHERE form <> '' GROUP BY 1
), rows AS (
  SELECT row_number() OVER () AS r, doc_id, {_canonical("text")} AS form FROM documents
), lines AS (
  SELECT DISTINCT r, trim(regexp_replace(line, ' +', ' ', 'g')) AS line FROM (SELECT r, unnest(string_split(form, chr(10))) AS line FROM rows)
), whole AS (
  SELECT r, doc_id, sha256({_one_line("form")}) AS digest FROM rows
), both_ AS (
  SELECT whole.*, known.license AS text_license FROM whole LEFT JOIN known ON known.digest = whole.digest
), every AS (
  SELECT r, license FROM lines JOIN known ON digest = sha256(line) WHERE line <> ''
  UNION SELECT r, text_license FROM both_ WHERE text_license IS NOT NULL
)
SELECT doc_id, digest, text_license, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses
FROM both_ LEFT JOIN (SELECT r, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM every GROUP BY r) named ON named.r = both_.r
""",
    "op11_neardup": """
WITH valid AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.r, b.r AS other, a.vec_id, b.vec_id AS other_id FROM valid a JOIN valid b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.v = b.v OR list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.95
), reach AS (
  WITH RECURSIVE walk AS (
    SELECT DISTINCT vec_id, other_id FROM pairs
    UNION SELECT walk.vec_id, pairs.other_id FROM walk JOIN pairs ON pairs.vec_id = walk.other_id
  ) SELECT vec_id, min(other_id) AS least FROM walk GROUP BY vec_id
)
SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE pairs.vec_id = e.vec_id) AS n_links,
  least(e.vec_id, coalesce(reach.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(reach.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN reach ON reach.vec_id = e.vec_id
""",
    "op13_centroids": _centroids(64, 64, 16, 3, 1),
}
