"""DuckDB twins of the text operators: stems by joining words with a table of rules, ranks by trying every stretch of positions."""

from __future__ import annotations

from tidemark.functions import stemming
from tidemark.operators import fulltext, search


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(replace(replace(replace(translate(lower({x}), '{search.ACCENTED}', '{search.PLAIN}'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '’', '''')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^a-z0-9]+'), lambda w: w <> '')"


def _rule_rows(language: str) -> str:
    rows, n = [], 0
    for k, step in enumerate(stemming.STEPS[language]):
        for r in step.rules:
            n += 1
            rows.append(f"({k}, {n}, {_text(r.suffix)}, {_text(r.put)}, {_text(r.region)}, {_text(r.before)}, {_text(r.unless)}, {r.span or len(r.suffix)}, {str(step.inside).lower()})")
    return ", ".join(rows)


def _step(name: str, source: str, rules: str, k: int, when: str = "true") -> str:
    """A table (word, w, was) after step k; was is the word before it."""
    start = "CASE region WHEN 'r1' THEN r1 WHEN 'r2' THEN r2 WHEN 'rv' THEN rv ELSE 0 END"
    return f"""{name}_all AS (SELECT s.*, r.*, (CASE WHEN region = 'none' THEN r1 >= length(w) ELSE length(w) - span >= {start} END) AS placed, left(w, length(w) - length(suffix)) AS base
        FROM {source} s JOIN {rules} r ON r.step = {k} AND suffix = right(w, length(suffix)) AND length(suffix) <= length(w) WHERE ({when}) AND (NOT inside OR length(w) - length(suffix) >= rv)),
      {name}_most AS (SELECT word, max(length(suffix)) AS most FROM {name}_all GROUP BY word),
      {name}_one AS (SELECT a.word, arg_min(base || put, n) AS made FROM {name}_all a JOIN {name}_most m ON a.word = m.word AND length(suffix) = most
        WHERE placed AND regexp_matches(base, before) AND (unless = '' OR NOT regexp_matches(base, unless)) GROUP BY a.word),
      {name} AS (SELECT s.word, coalesce(made, w) AS w, w AS was, r1, r2, rv FROM {source} s LEFT JOIN {name}_one o ON s.word = o.word)"""


def stems(source: str) -> str:
    """Tables english_stems and french_stems (word, stem) of source (word), as common table expressions."""
    v, fv = stemming.VOWELS, stemming.FRENCH_VOWELS

    def behind(x: str, vowels: str) -> str:
        found = f"regexp_extract({x}, '^.*?[{vowels}][^{vowels}]')"
        return f"CASE WHEN {found} <> '' THEN length({found}) ELSE length({x}) END"

    def scan(x: str, letter: str, capital: str) -> str:
        return f"list_reduce(list_prepend('', string_split({x}, '')), lambda acc, c, i: acc || CASE WHEN c = '{letter}' AND regexp_matches(right(acc, 1), '[{fv}]') AND regexp_matches(substr({x}, i, 1), '[{fv}]') THEN '{capital}' ELSE c END)"

    parts = [f"english_rules(step, n, suffix, put, region, before, unless, span, inside) AS (VALUES {_rule_rows('english')})"]
    parts.append(f"english_marked AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([{v}])y', '\\1Y', 'g') AS w FROM {source})")
    parts.append(f"english_first AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) ELSE {behind('w', v)} END AS r1 FROM english_marked)")
    parts.append(f"e_0 AS (SELECT word, w, w AS was, r1, r1 + {behind('substr(w, r1 + 1)', v)} AS r2, 0 AS rv FROM english_first)")
    parts += [_step("e_1", "e_0", "english_rules", 0), _step("e_2", "e_1", "english_rules", 1), _step("e_3", "e_2", "english_rules", 2, "w <> was AND NOT regexp_matches(was, 'eed(ly)?$')")]
    parts += [_step(f"e_{k + 1}", f"e_{k}", "english_rules", k) for k in range(3, len(stemming.ENGLISH))]
    own = " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in stemming.ENGLISH_WORDS.items())
    whole = ", ".join(map(_text, stemming.ENGLISH_WHOLE))
    parts.append(f"english_stems AS (SELECT z.word, CASE WHEN length(z.word) <= 2 THEN z.word ELSE coalesce(CASE z.word {own} END, CASE WHEN lower(a.w) IN ({whole}) THEN lower(a.w) END, lower(z.w)) END AS stem FROM e_{len(stemming.ENGLISH)} z JOIN e_1 a ON a.word = z.word)")
    parts.append(f"french_rules(step, n, suffix, put, region, before, unless, span, inside) AS (VALUES {_rule_rows('french')})")
    parts.append("french_q AS (SELECT word, replace(word, 'qu', 'qU') AS w FROM " + source + ")")
    parts.append(f"french_u AS (SELECT word, {scan('w', 'u', 'U')} AS w FROM french_q)")
    parts.append(f"french_i AS (SELECT word, {scan('w', 'i', 'I')} AS w FROM french_u)")
    parts.append(f"french_y AS (SELECT word, regexp_replace(regexp_replace(w, 'y([{fv}])', 'Y\\1', 'g'), '([{fv}])y', '\\1Y', 'g') AS w FROM french_i)")
    rv = f"CASE WHEN regexp_matches(w, '^([{fv}][{fv}]|par|col|tap)') THEN least(3, length(w)) WHEN regexp_matches(w, '^.[^{fv}]*[{fv}]') THEN length(regexp_extract(w, '^.[^{fv}]*[{fv}]')) ELSE length(w) END"
    parts.append(f"french_r AS (SELECT *, {rv} AS rv, {behind('w', fv)} AS r1 FROM french_y)")
    parts.append(f"f_0 AS (SELECT word, w, w AS was, r1, r1 + {behind('substr(w, r1 + 1)', fv)} AS r2, rv FROM french_r)")
    parts.append(_step("f_1", "f_0", "french_rules", 0))
    parts.append(_step("f_go", "f_1", "french_rules", 1, "w = was"))
    parts.append("f_2_in AS (SELECT g.* REPLACE (a.was = a.w AS was) FROM (SELECT word, w, CAST(w <> was AS VARCHAR) AS was, r1, r2, rv FROM f_go) g JOIN f_1 a USING (word))")
    parts.append(_step("f_2", "f_2_in", "french_rules", 2, "was"))
    parts.append("f_3_in AS (SELECT b.word, b.w, i.was AND b.w = i.w AS was, b.r1, b.r2, b.rv FROM f_2 b JOIN f_2_in i USING (word))")
    parts.append(_step("f_3", "f_3_in", "french_rules", 3, "was"))
    parts.append("f_4_in AS (SELECT c.word, c.w, NOT (i.was AND c.w = i.w) AS was, c.r1, c.r2, c.rv FROM f_3 c JOIN f_3_in i USING (word))")
    parts.append(_step("f_4", "f_4_in", "french_rules", 4, "was"))
    parts.append(_step("f_5", "f_4_in", "french_rules", 5, "NOT was"))
    parts.append("f_6_in AS (SELECT i.word, CASE WHEN i.was THEN a.w ELSE b.w END AS w, i.was, i.r1, i.r2, i.rv FROM f_4_in i JOIN f_4 a USING (word) JOIN f_5 b USING (word))")
    parts.append(_step("f_6", "f_6_in", "french_rules", 6, "NOT was"))
    parts.append(_step("f_7", "f_6", "french_rules", 7))
    parts.append(f"french_stems AS (SELECT word, lower(regexp_replace(w, '[éè]([^{fv}]+)$', 'e\\1')) AS stem FROM f_7)")
    return ", ".join(parts)


def tokens(docs: str, key: str, fields: list[fulltext.Field]) -> str:
    """Tables `read` (key, token, pos, weight) of docs, a table of key and the fields' columns."""
    parts, number = [], 0
    selects = []
    for field in fields:
        for language in field.languages:
            stop = ", ".join(map(_text, fulltext.STOP_WORDS[language])) or "''"
            selects.append(f"SELECT {key}, {number} AS section, '{language}' AS language, '{field.weight}' AS weight, list_filter(list_transform({words(f"coalesce({field.column}, '')")}, lambda w, i: {{'word': w, 'pos': i}}), lambda x: x.word NOT IN ({stop})) AS items FROM {docs}")
            number += 1
    parts.append("parts AS (" + " UNION ALL ".join(selects) + ")")
    parts.append(f"placed AS (SELECT *, coalesce(sum(coalesce(items[-1].pos, 0)) OVER (PARTITION BY {key} ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM parts)")
    parts.append(f"flat AS (SELECT {key}, language, weight, shift, unnest(items) AS item FROM placed)")
    parts.append("vocabulary AS (SELECT DISTINCT item.word AS word FROM flat)")
    parts.append(stems("vocabulary"))
    parts.append(f"read AS (SELECT f.{key}, CASE language WHEN 'english' THEN e.stem WHEN 'french' THEN g.stem ELSE item.word END AS token, CAST(item.pos + shift AS BIGINT) AS pos, weight FROM flat f JOIN english_stems e ON e.word = item.word JOIN french_stems g ON g.word = item.word)")
    return ", ".join(parts)


def vectors(docs: str, key: str, fields: list[fulltext.Field]) -> str:
    """CTEs that end in `vectors` (key, n_tokens, n_places, vector)."""
    return f"""{tokens(docs, key, fields)}, entries AS (SELECT {key}, token || ':' || string_agg(pos || weight, ',' ORDER BY pos, weight) AS entry, count(*) AS n FROM read GROUP BY {key}, token),
      vectors AS (SELECT {key}, count(*) AS n_tokens, CAST(sum(n) AS BIGINT) AS n_places, string_agg(entry, ' ' ORDER BY entry) AS vector FROM entries GROUP BY {key})"""


def ranks(docs: str, key: str, fields: list[fulltext.Field], alternatives: list[list[str]], absent: list[str] = ()) -> str:
    """CTEs that end in `ranks` (key, rank). alternatives: the tokens of each reading, as the caller states them; documents with an absent token have no rank."""
    weight = "CASE weight " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fulltext.WEIGHTS.items()) + " END"
    every = ", ".join(_text(t) for t in sorted({t for a in alternatives for t in a}))
    holds = " OR ".join("(" + " AND ".join(f"list_contains(ts, {_text(t)})" for t in a) + ")" for a in alternatives)
    gone = ", ".join(map(_text, absent)) or "''"
    return f"""{tokens(docs, key, fields)}, lengths AS (SELECT {key}, count(*) AS length, bool_or(token IN ({gone})) AS gone FROM read GROUP BY {key}),
      spots AS (SELECT {key}, pos, list(token) AS ts, max({weight}) AS weight FROM read WHERE token IN ({every}) GROUP BY {key}, pos),
      stretches AS (SELECT a.{key}, a.pos AS low, b.pos AS high, flatten(list(c.ts)) AS ts, count(*) AS n, sum(1 / c.weight) AS inverse
        FROM spots a JOIN spots b ON a.{key} = b.{key} AND a.pos <= b.pos JOIN spots c ON c.{key} = a.{key} AND c.pos BETWEEN a.pos AND b.pos GROUP BY a.{key}, a.pos, b.pos),
      full_ones AS (SELECT * FROM stretches WHERE {holds}),
      covers AS (SELECT * FROM full_ones f WHERE NOT EXISTS (SELECT 1 FROM full_ones g WHERE g.{key} = f.{key} AND g.low >= f.low AND g.high <= f.high AND g.high - g.low < f.high - f.low)),
      ranks AS (SELECT {key}, sum(n / inverse / (1 + (high - low) - (n - 1))) / ln(max(length) + 1::DOUBLE) AS rank FROM covers JOIN lengths USING ({key}) WHERE NOT gone GROUP BY {key})"""
