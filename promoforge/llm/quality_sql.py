"""The quality rules as one SQL statement, for comparison: the same steps unrolled."""

from __future__ import annotations

from promoforge.llm.quality_outliers import CHI2_MEDIAN, CHI2_REWEIGHT, CUTOFF, FLOORS, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR_LENGTH, PRIOR_LINES, PRIOR_WORDS, STATS

SIZE = range(len(STATS))


def _distance() -> str:
    solved: list[str] = []
    for i in SIZE:
        rest = f"{STATS[i]} - m{i}" + "".join(f" - l{i}{j} * ({y})" for j, y in enumerate(solved))
        solved.append(f"({rest}) / l{i}{i}")
    return " + ".join(f"({y}) * ({y})" for y in solved)


def _factored(source: str) -> str:
    """Cholesky factor of the covariances of ``source`` plus the squared floors."""
    columns = []
    for i in SIZE:
        for j in range(i + 1):
            rest = f"s{i}{j}" + (f" + {FLOORS[i] ** 2!r}" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            columns.append(f"sqrt(greatest({rest}, {FLOORS[i] ** 2!r})) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return f"SELECT level, {', '.join(f'm{i}' for i in SIZE)}, {', '.join(columns)} FROM {source}"


def _moments(source: str) -> str:
    return (f"SELECT level, {', '.join(f'avg({STATS[i]}) AS m{i}' for i in SIZE)}, "
            f"{', '.join(f'covar_pop({STATS[i]}, {STATS[j]}) AS s{i}{j}' for i in SIZE for j in range(i + 1))} FROM {source} GROUP BY level")


def statement(min_group: int = 50, steps: int = 3) -> str:
    parts = [r"""d AS (
  SELECT doc_id, coalesce('=' || lang, '?') AS g1, coalesce('=' || source, '?') AS g2, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, said FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM windows JOIN twice USING (doc_id, said)) GROUP BY doc_id
), lined AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), counted AS (
  SELECT d.doc_id, g1, g2, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lined USING (doc_id) LEFT JOIN covered c USING (doc_id)
)""", f"""judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         ln((word_chars + {PRIOR_WORDS * PRIOR_LENGTH}) / (n_words + {PRIOR_WORDS})) AS {STATS[0]}, sqrt(n_symbols / (n_words + {PRIOR_WORDS})) AS {STATS[1]},
         sqrt(n_dup_lines / (n_lines + {PRIOR_LINES})) AS {STATS[2]}, sqrt(n_repeat_words / (n_words + {PRIOR_WORDS})) AS {STATS[3]}, [g1 || ' ' || g2, g1, ''] AS levels
  FROM counted
)""", f"vectors AS (SELECT unnest(levels) AS level, {', '.join(STATS)} FROM judged WHERE NOT base_failed)",
             f"centre AS (SELECT level, {', '.join(f'median(round({s}, 3)) AS m{i}' for i, s in enumerate(STATS))} FROM vectors GROUP BY level HAVING count(*) >= {min_group})",
             f"""start AS (SELECT level, {', '.join(f'any_value(m{i}) AS m{i}' for i in SIZE)}, {', '.join(
                 f'pow(median(round(abs({STATS[i]} - m{i}), 3)) * 1.4826, 2) AS s{i}{j}' if i == j else f'0.0 AS s{i}{j}' for i in SIZE for j in range(i + 1))}
  FROM vectors JOIN centre USING (level) GROUP BY level)""", f"e0 AS ({_factored('start')})"]
    for k in range(steps + 1):
        parts.append(f"n{k} AS (SELECT v.*, {_distance()} AS d2 FROM vectors v JOIN e{k} USING (level))")
        parts.append(f"h{k} AS (SELECT level, median(round(ln(1 + d2), 3)) AS half FROM n{k} GROUP BY level)")
        kept = "round(ln(1 + d2), 3) <= half" if k < steps else f"d2 <= {CHI2_REWEIGHT} * greatest(1.0, (exp(half) - 1) / {CHI2_MEDIAN})"
        parts.append(f"k{k} AS (SELECT n.* FROM n{k} n JOIN h{k} USING (level) WHERE {kept})")
        parts.append(f"o{k} AS ({_moments(f'k{k}')})")
        parts.append(f"e{k + 1} AS ({_factored(f'o{k}')})")
    last = f"e{steps + 1}"
    pick = f"coalesce((SELECT level FROM {last} WHERE level = levels[1]), (SELECT level FROM {last} WHERE level = levels[2]), (SELECT level FROM {last} WHERE level = levels[3]))"
    parts.append(f"placed AS (SELECT *, {pick} AS level FROM judged)")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({_distance()}, 0) <= {CUTOFF} AS kept FROM placed LEFT JOIN {last} USING (level)"""
