"""DuckDB SQL for the detection queries, as common table expressions that build on each other."""

from __future__ import annotations

from claimworks.functions import lexicon as L
from claimworks.functions.text import TOKEN
from claimworks.operators.detect import ASPECTS, BY_LENGTH, DAY, ORDINAL_YEAR, YEAR
from claimworks.sources.tables import CLAIMS_SQL, quoted, sql_list

WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def tokenize(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({text}), '[’‘]', '''', 'g'), {quoted(TOKEN)})"


def terms(values) -> str:
    return f"list_filter({sql_list(values)}, lambda t: contains(j, ' ' || t || ' '))"


def any_of(values) -> str:
    return "(" + " OR ".join(f"contains(j, {quoted(f' {v} ')})" for v in values) + ")"


def _bodies() -> str:
    s = "' ' || array_to_string(tokens, '  ') || ' '"
    for b in BY_LENGTH:
        w = b.split()
        s = f"replace({s}, {quoted(' ' + '  '.join(w) + ' ')}, {quoted(' ' + '  '.join(['{' + '_'.join(w) + '}', *['~'] * (len(w) - 1)]) + ' ')})"
    return f"CASE WHEN who THEN replace({s}, ' who ', ' {{WHO}} ') ELSE {s} END"


_WEIGHTS = ", ".join(f"{{'term': {quoted(t)}, 'weight': {w}}}" for t, w in L.SENSATIONAL.items())
_HITS = ", ".join(f"{{'topic': {quoted(t)}, 'ord': {i}, 'hits': len({terms(words)})" + (" + (CASE WHEN who AND list_contains(tokens, 'who') THEN 1 ELSE 0 END)" if t == "health" else "") + "}" for i, (t, words) in enumerate(L.TOPICS.items()))

BASE = rf"""WITH {CLAIMS_SQL},
d0 AS (SELECT claim_id, text, regexp_replace(text, '^{WHITE}+|{WHITE}+$', '', 'g') AS raw FROM claims),
d1 AS (SELECT *, {tokenize('raw')} AS tokens, regexp_matches(raw, '\bWHO\b') AS who FROM d0),
d2 AS (SELECT *, ' ' || array_to_string(tokens, ' ') || ' ' AS j FROM d1)"""

SIGNALS = rf"""{BASE},
d3 AS (SELECT *, length(regexp_replace(raw, '[^A-Za-z]', '', 'g')) AS plain, length(regexp_replace(raw, '\P{{L}}', '', 'g')) AS letters,
  {any_of(L.DEBUNK)} OR ({any_of(['rumour', 'rumours', 'rumor'])} AND {any_of(['false'])}) AS debunk,
  {terms(L.HEDGING)} AS hedging, {terms(L.EMOTION)} AS emotion, {terms(L.URGENCY)} AS urgency, {terms(L.FORWARD)} AS forward, {terms(L.CLICKBAIT)} AS clickbait,
  list_transform(regexp_extract_all(raw, '(?i)\b\d[\d,.]*\s?(?:%|percent|crore|lakh|million|billion|kg|km)?'), lambda x: regexp_replace(x, '\s+$', '')) AS numbers,
  len(regexp_extract_all(raw, '[!?]+')) AS bangs, len(tokens) AS word_count, string_split(trim({_bodies()}), '  ') AS marked, [{_HITS}] AS hits FROM d2),
d4 AS (SELECT *, CASE WHEN letters = 0 THEN 'non-english' WHEN plain::DOUBLE / letters >= 0.8 THEN 'english' ELSE 'non-english' END AS language,
  CASE WHEN plain = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(raw, '[^A-Z]', '', 'g'))::DOUBLE / plain END AS caps,
  list_filter([{_WEIGHTS}], lambda t: contains(j, ' ' || t.term || ' ') AND NOT (debunk AND list_contains({sql_list(L.SUPPRESSED)}, t.term))) AS sensational,
  list_filter(list_transform(marked, lambda t, i: {{'i': i, 'name': replace(regexp_replace(t, '[{{}}]', '', 'g'), '_', ' '), 'hit': starts_with(t, '{{')}}), lambda x: x.hit) AS bodies FROM d3),
d5 AS (SELECT *, coalesce(list_sum(list_transform(sensational, lambda t: t.weight)), 0)::INTEGER AS weight FROM d4),
d6 AS (SELECT *, greatest(0.0::DOUBLE, caps - 0.12::DOUBLE) AS over FROM d5),
d7 AS (SELECT *, CAST(greatest(5, least(100, 100 - weight * 3)) AS INTEGER) AS s_sensational, CAST(greatest(8, 96 - len(emotion) * 22) AS INTEGER) AS s_emotion,
  CAST(greatest(10, 95 - len(urgency) * 25) AS INTEGER) AS s_urgency, CAST(greatest(10, 94 - len(clickbait) * 30) AS INTEGER) AS s_clickbait,
  CAST(floor(greatest(8.0::DOUBLE, least(100.0::DOUBLE, 98 - over * 260 - bangs * 12)) + 0.5) AS INTEGER) AS s_style FROM d6)"""

#: Dates need positions: one row per token, with what stands beside it.
DATES = rf"""{BASE},
tk AS (SELECT claim_id, i - 1 AS i, tokens[i] AS t, tokens[i - 1] AS a0, tokens[i + 1] AS b, tokens[i + 2] AS c FROM (SELECT claim_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM d2)),
mo AS (SELECT *, CASE WHEN i > 0 THEN a0 END AS a FROM tk WHERE list_contains({sql_list(L.MONTHS)}, t)),
mm AS (SELECT *, coalesce(regexp_matches(a, '{DAY}'), false) AS da, coalesce(regexp_matches(b, '{DAY}'), false) AS db, coalesce(regexp_matches(b, '{ORDINAL_YEAR}'), false) AS yb, coalesce(regexp_matches(c, '{YEAR}'), false) AS yc FROM mo),
us AS (SELECT claim_id, i - 1 AS i FROM mm WHERE da UNION SELECT claim_id, i + 1 FROM mm WHERE db OR yb UNION SELECT claim_id, i + 2 FROM mm WHERE db AND yc),
dt AS (SELECT claim_id, 0 AS pass, i, concat_ws(' ', CASE WHEN da THEN a END, t, CASE WHEN db OR yb THEN b END, CASE WHEN db AND yc THEN c END) AS x FROM mm WHERE da OR db OR yb
  UNION ALL SELECT claim_id, 1, i, t FROM tk WHERE regexp_matches(t, '{YEAR}') AND NOT EXISTS (SELECT 1 FROM us WHERE us.claim_id = tk.claim_id AND us.i = tk.i)),
da AS (SELECT claim_id, list(x ORDER BY pass, i) AS dates FROM dt GROUP BY claim_id)"""

_DATES_ONLY = DATES[len(BASE) :]
SCORES = rf"""{SIGNALS}{_DATES_ONLY},
d8 AS (SELECT d7.*, coalesce(da.dates, []) AS dates, CAST(greatest(0, least(96, 26 + len(numbers) * 11 + len(coalesce(da.dates, [])) * 14)) AS INTEGER) AS s_specificity,
  CAST(floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, weight * 2 + len(emotion) * 12 + len(urgency) * 18 + len(forward) * 10 + len(clickbait) * 20 + over * 120 + bangs * 6)) + 0.5) AS INTEGER) AS risk_score
  FROM d7 LEFT JOIN da ON da.claim_id = d7.claim_id),
d9 AS (SELECT *, CASE WHEN language = 'non-english' THEN 'unknown' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS language_risk FROM d8),
r AS (SELECT *, CASE WHEN language_risk = 'high' AND len(urgency) + len(forward) > 0 THEN 'likely-misleading' ELSE 'unverified' END AS verdict FROM d9)"""

ASPECTS_SQL = SCORES + ",\nx AS (" + " UNION ALL ".join(f"SELECT claim_id, {i} AS pos, {quoted(a)} AS aspect, {quoted(label)} AS label, {c or 'NULL'}::INTEGER AS score FROM r" for i, (a, label, c) in enumerate(ASPECTS)) + "),\nasp AS (SELECT *, CASE WHEN score IS NULL THEN 'unchecked' WHEN score >= 70 THEN 'pass' WHEN score >= 45 THEN 'warn' ELSE 'fail' END AS verdict FROM x)"

ATTRIBUTION = rf"""{SIGNALS},
ab AS (SELECT claim_id, k, b.name AS name, tokens[b.i + len(string_split(b.name, ' ')):b.i + len(string_split(b.name, ' ')) + 2] AS after,
  array_to_string(tokens[greatest(b.i - 5, 1):b.i - 1], ' ') AS before FROM (SELECT claim_id, tokens, bodies[k] AS b, k FROM (SELECT claim_id, tokens, bodies, unnest(range(1, len(bodies) + 1)) AS k FROM d4))),
av AS (SELECT *, list_filter(after, lambda t: list_contains({sql_list(L.VERBS)}, t))[1] AS verb FROM ab),
atr AS (SELECT claim_id, k, 0 AS z, name || ' ' || verb AS x FROM av WHERE verb IS NOT NULL
  UNION ALL SELECT claim_id, k, 1, (CASE WHEN regexp_matches(before, '\baccording to\b') THEN 'according to ' ELSE 'as per ' END) || name FROM av WHERE regexp_matches(before, '\baccording to\b|\bas per\b')),
an AS (SELECT claim_id, x, min(k * 2 + z) AS o FROM atr GROUP BY claim_id, x),
att AS (SELECT claim_id, array_to_string(list(x ORDER BY o), '|') AS attribution FROM an GROUP BY claim_id)"""
