"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from . import mixing, quality, sharding

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str, nodes: str) -> str:
    """Body of CTEs from ``links`` (a, b, both ways) and ``nodes`` (id) to ``comp`` (id, c)."""
    return f"""reach(id, c) AS (
      SELECT id, id FROM ({nodes})
      UNION
      SELECT l.b, r.c FROM reach r JOIN ({links}) l ON l.a = r.id WHERE r.c < l.b
    ), comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"""


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("text"))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
{_components("SELECT a, b FROM links", "SELECT doc_id AS id FROM documents")}
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w JOIN comp ON comp.id = w.doc_id LEFT JOIN size ON size.doc_id = w.doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
{_components("SELECT a, b FROM links", "SELECT vec_id AS id FROM embeddings")}
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) m ON m.a = v.vec_id
"""

OP10 = rf"""
WITH base AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sizes),
caps AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, cap, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, cap, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
final AS (SELECT *, first_value(CASE WHEN cap >= level * weight THEN level END IGNORE NULLS) OVER
  (ORDER BY cap / weight, cap, weight ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM levels),
target AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * weight) END AS target FROM final),
plan AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole FROM target),
placed AS (SELECT b.*, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS part,
  sum(b.size) OVER (PARTITION BY b.source ORDER BY ('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 15))::BIGINT, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - upto + size)) AS BIGINT) AS taken FROM placed
"""


def op4() -> str:
    """The measures, the votes, and the rounds of the estimation as one recursive query."""
    n_rules = len(quality.RULES)
    priors, rates = quality.start_model(n_rules)
    votes = ", ".join(sql for _, sql in quality.RULES)
    lit = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
    ks = range(n_rules)
    # Log score of class c for the votes of a pattern, from the current model m.
    score = lambda c: f"ln(m.p[{c + 1}]) + " + " + ".join(
        f"CASE WHEN t.v[{k + 1}] < 0 THEN ln(m.r[{c * n_rules + k + 1}]) WHEN t.v[{k + 1}] > 0 THEN ln(1 - m.r[{c * n_rules + k + 1}]) ELSE 0 END" for k in ks)
    good = f"1 / (1 + exp(least(({score(1)}) - ({score(0)}), 700)))"
    share = ("(e.q * e.n)", "((1 - e.q) * e.n)")
    belief = f"{quality.BELIEF!r} * greatest(1, sum(e.n))"
    mass = [f"({belief} * {priors[c]!r} + sum({share[c]}))" for c in range(2)]
    new = ", ".join(
        f"({belief} * {priors[c]!r} * {rates[c][k]!r} + sum(CASE WHEN e.v[{k + 1}] < 0 THEN {share[c]} ELSE 0 END)) / ({belief} * {priors[c]!r} + sum(CASE WHEN e.v[{k + 1}] <> 0 THEN {share[c]} ELSE 0 END))"
        for c in range(2) for k in ks)
    # DuckDB's patterns can't look around, so plain words and ends are found word by word.
    plain = r"^[(\"]?\p{L}+(?:[''-]\p{L}+)?[.,;:!?)\"]{0,2}$"
    return rf"""
WITH RECURSIVE raw AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM raw WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
base AS (SELECT raw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters, len(regexp_extract_all(text, '!')) AS n_exclaims,
  len(list_filter(w, lambda x: length(x) <= 3)) AS n_short, len(list_filter(w, lambda x: regexp_matches(x, '{plain}'))) AS n_plain, len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) AS n_ends
  FROM raw LEFT JOIN covered c ON c.doc_id = raw.doc_id),
voted AS (SELECT *, [{votes}] AS v FROM base),
tally AS (SELECT v, count(*) AS n FROM voted GROUP BY v),
model(round, p, r) AS (
  SELECT 0, {lit(priors)}, {lit([r for row in rates for r in row])}
  UNION ALL
  SELECT e.round + 1, [{mass[0]} / ({mass[0]} + {mass[1]}), {mass[1]} / ({mass[0]} + {mass[1]})], [{new}] FROM (
    SELECT m.round, t.v, t.n, {good} AS q FROM model m, tally t WHERE m.round < {quality.ROUNDS}) e GROUP BY e.round
),
fitted AS (SELECT t.v, {good} AS good FROM model m, tally t WHERE m.round = {quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND good >= {quality.KEEP} AS kept FROM voted JOIN fitted USING (v)
"""


def op2() -> str:
    """Slots by MD5, and the filled table as a string of three digits for each slot."""
    owners = "".join(f"{k:03d}" for k in sharding.fill([f"shard-{k:03d}" for k in range(256)]))
    return f"""
SELECT doc_id, source, slot, 'shard-' || substr('{owners}', 3 * slot + 1, 3) AS shard FROM (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
"""


ORACLE_SQL = {"op1_minhash_dedup": OP1, "op2_sharding": op2(), "op3_embedding_dedup": OP3, "op4_quality": op4(), "op10_mixing": OP10}
