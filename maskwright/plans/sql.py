"""The analysis as SQL for DuckDB, whose regular expressions are RE2: an independent account of what the queries return."""

from __future__ import annotations

import re

from maskwright.functions.checksums import ES_LETTERS, FI_LETTERS, IT_ODD_DIGITS, IT_ODD_LETTERS, SG_LETTERS, SG_M_LETTERS
from maskwright.functions.regex import to_duckdb
from maskwright.operators.catalog import Recognizer
from maskwright.plans import vectors

_OPEN, _CLOSE, _WORD = "chr(64976)", "chr(64977)", r"[\p{L}\p{Nd}\p{M}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_vectors() -> str:
    """Documents and the texts with test values."""
    return "SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in vectors.rows()) + ") v(doc_id, text)"


def _dot(weights, first: int = 1) -> str:
    return "(" + " + ".join(f"d[{i}] * {w}" for i, w in enumerate(weights, first)) + ")"


def _mod11(total: str) -> str:
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)"


def _pair(a, b, at: int) -> str:
    return f"{_mod11(_dot(a))} = d[{at}] AND {_mod11(_dot(b))} = d[{at + 1}]"


def _doubled(odd: int) -> str:
    """Sum of digits with every other one doubled and its digits added. Places from the right; odd: 1 if the second from the right is the first doubled."""
    return f"list_sum([CASE WHEN (len(d) - i) % 2 = {odd} THEN CASE WHEN d[i] > 4 THEN d[i] * 2 - 9 ELSE d[i] * 2 END ELSE d[i] END FOR i IN range(1, len(d) + 1)])"


def _letter(table: str, at: str) -> str:
    return f"substr('{table}', CAST({at} AS INT) + 1, 1)"


_MIXED = "len(list_distinct(d)) > 1"
_UNSPACED = "replace(text, ' ', '')"
_IBAN = f"list_reduce(list_prepend(0, [CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INT) FOR c IN string_split(substr({_UNSPACED}, 5) || left({_UNSPACED}, 4), '')]), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END)"
#: The dihedral group of order ten: the product of a and b, and the digit c at place i.
_PRODUCT = "CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b) % 5 WHEN b < 5 THEN 5 + (a - b) % 5 ELSE (a - b + 5) % 5 END"
_ODD = "[" + ", ".join(str(int(x) + int(y)) for x, y in zip(IT_ODD_DIGITS[::2], IT_ODD_DIGITS[1::2], strict=True)) + "]"
_C = "substr(text, i, 1)"
_FISCAL = f"(list_sum([CASE WHEN i % 2 = 1 AND {_C} <= '9' THEN {_ODD}[ascii({_C}) - 47] WHEN i % 2 = 1 THEN strpos('{IT_ODD_LETTERS}', {_C}) - 1 WHEN {_C} <= '9' THEN ascii({_C}) - 48 ELSE ascii({_C}) - 65 END FOR i IN range(1, 16)]) % 26)"


def _verhoeff() -> str:
    """Digits from the right, each permuted i times, multiplied up; the permutation by composing its fixed table."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    table = [list(range(10))]
    for _ in range(7):
        table.append([base[x] for x in table[-1]])
    flat = "[" + ", ".join(str(x) for row in table for x in row) + "]"
    return f"list_reduce(list_prepend(0, [{flat}[((len(d) - i) % 8) * 10 + d[i] + 1] FOR i IN range(len(d), 0, -1)]), lambda a, b: ({_PRODUCT}) % 10) = 0"


def validators() -> dict[str, str]:
    """A condition over text (the span) and d (its digits) for each check."""
    t1 = "(" + " + ".join(f"d[{i}] * {16 - i}" for i in range(1, 12)) + ")"
    cns = f"CASE WHEN d[1] IN (1, 2) THEN CASE WHEN {t1} % 11 = 1 THEN d[12] = 0 AND d[13] = 0 AND d[14] = 1 AND d[15] = 11 - ({t1} + 2) % 11 WHEN {t1} % 11 = 0 THEN d[12] + d[13] + d[14] + d[15] = 0 ELSE d[12] + d[13] + d[14] = 0 AND d[15] = 11 - {t1} % 11 END WHEN d[1] IN (7, 8, 9) THEN {_dot(range(15, 0, -1))} % 11 = 0 ELSE false END"
    a, b = _dot(range(9, 0, -1)) + " % 11", _dot(range(1, 10)) + " % 11"
    low = f"(CASE WHEN {a} >= 10 THEN 2 ELSE 0 END)"
    cnh = f"d[10] = (CASE WHEN {a} >= 10 THEN 0 ELSE {a} END) AND d[11] = (CASE WHEN {b} >= 10 THEN 0 WHEN {b} - {low} < 0 THEN {b} - {low} + 11 ELSE {b} - {low} END)"
    u = _dot(range(2, 10)) + " % 11"
    u = f"(CASE WHEN {u} = 10 THEN 0 ELSE {u} END)"
    v = f"((7 * d[9] + 8 * d[10] + 9 * {u}) % 11)"
    sized = lambda n, rule: f"len(d) = {n} AND {rule}"
    fin = _dot([2, 7, 6, 5, 4, 3, 2])
    return {
        "luhn": f"len(d) > 0 AND {_doubled(1)} % 10 = 0",
        "iban": f"regexp_full_match({_UNSPACED}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {_IBAN} = 1",
        "ssn": sized(9, f"d[1] < 9 AND d[1] * 100 + d[2] * 10 + d[3] NOT IN (0, 666) AND d[4] + d[5] > 0 AND d[6] + d[7] + d[8] + d[9] > 0 AND array_to_string(d, '') NOT IN ('012345678', '123456789') AND {_MIXED}"),
        "itin": sized(9, "d[1] = 9 AND (d[2] * 10 + d[3] BETWEEN 50 AND 65 OR d[2] * 10 + d[3] BETWEEN 70 AND 88 OR d[2] * 10 + d[3] BETWEEN 90 AND 92 OR d[2] * 10 + d[3] BETWEEN 94 AND 99) AND d[4] + d[5] > 0 AND d[6] + d[7] + d[8] + d[9] > 0"),
        "aba": sized(9, f"{_dot([3, 7, 1] * 3)} % 10 = 0"),
        "nhs": sized(10, f"(11 - {_dot(range(10, 1, -1))} % 11) % 11 = d[10]"),
        "nino": "NOT regexp_matches(text, '^(BG|GB|NK|KN|TN|NT|ZZ)')",
        "tfn": sized(9, f"{_dot([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0"),
        "abn": sized(11, f"((CASE WHEN d[1] > 0 THEN d[1] - 1 ELSE 0 END) * 10 + {_dot([1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 2)}) % 89 = 0"),
        "acn": sized(9, f"(10 - {_dot(range(8, 0, -1))} % 10) % 10 = d[9]"),
        "medicare": sized(10, f"d[1] BETWEEN 2 AND 6 AND {_dot([1, 3, 7, 9] * 2)} % 10 = d[9]"),
        "aadhaar": sized(12, _verhoeff()),
        "it_fiscal": f"{_FISCAL} = ascii(substr(text, 16, 1)) - 65",
        "it_vat": sized(11, "(10 - list_sum([CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN d[i] * 2 - 9 ELSE d[i] * 2 END FOR i IN range(1, 11)]) % 10) % 10 = d[11]"),
        "es_nif": f"right(text, 1) = {_letter(ES_LETTERS, 'TRY_CAST(left(text, 8) AS BIGINT) % 23')}",
        "es_nie": f"right(text, 1) = {_letter(ES_LETTERS, 'TRY_CAST(translate(left(text, 1), $$XYZ$$, $$012$$) || substr(text, 2, 7) AS BIGINT) % 23')}",
        "sg_fin": f"right(text, 1) = CASE WHEN left(text, 1) = 'M' THEN {_letter(SG_M_LETTERS, f'({fin} + 3) % 11')} ELSE {_letter(SG_LETTERS, f'{fin} % 11')} END",
        "cpf": sized(11, f"{_MIXED} AND {_pair(range(10, 1, -1), range(11, 1, -1), 10)}"),
        "cnpj": sized(14, f"{_MIXED} AND {_pair([5, 4, 3, 2, *range(9, 1, -1)], [6, 5, 4, 3, 2, *range(9, 1, -1)], 13)}"),
        "cnh": sized(11, f"{_MIXED} AND {cnh}"),
        "pis": sized(11, f"{_MIXED} AND {_mod11(_dot([3, 2, *range(9, 1, -1)]))} = d[11]"),
        "cns": sized(15, cns),
        "titulo": sized(12, f"d[9] * 10 + d[10] BETWEEN 1 AND 28 AND d[11] = {u} AND d[12] = (CASE WHEN {v} = 10 THEN 0 ELSE {v} END)"),
        "renavam": sized(11, f"{_MIXED} AND {_mod11(_dot([3, 2, *range(9, 1, -1)]))} = d[11]"),
        "pesel": sized(11, f"(10 - {_dot([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = d[11]"),
        "kr_rrn": sized(13, f"(11 - {_dot([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = d[13]"),
        "fi_code": f"right(text, 1) = {_letter(FI_LETTERS, 'TRY_CAST(left(text, 6) || substr(text, 8, 3) AS BIGINT) % 31')}",
        "th_tnin": sized(13, f"(11 - {_dot(range(13, 1, -1))} % 11) % 10 = d[13]"),
    }


def _in_three(pattern: str) -> str:
    """A pattern with one capturing group as three: before it, the group, after it."""
    at = re.search(r"\((?!\?)", pattern).start()
    depth = 0
    for k in range(at, len(pattern)):
        depth += (pattern[k] == "(") - (pattern[k] == ")") if pattern[k - 1] != "\\" else 0
        if not depth:
            return f"({pattern[:at]}){pattern[at : k + 1]}({pattern[k + 1 :]})"
    raise ValueError(pattern)


def spans(source: str, keys: list[str], recognizers: list[tuple[int, Recognizer]], context: bool = True) -> str:
    """A query for (keys, entity_type, start, end, score, text, recognizer) over a source of (keys, text). recognizers: with their numbers."""
    checks, key = validators(), ", ".join(keys)
    scans = {s: k for k, s in enumerate(dict.fromkeys((rx, g) for _, r in recognizers for _, rx, g in r.patterns))}
    ctes = [f"src AS (SELECT row_number() OVER () AS rid, * FROM ({source}) WHERE text IS NOT NULL)"]
    cut, rules = [], []
    for (rx, g), k in scans.items():
        pattern = to_duckdb(rx)
        marked = f"regexp_replace(text, '{_in_three(pattern)}', '\\1' || {_OPEN} || '\\2' || {_CLOSE} || '\\3', 'g')" if g else f"regexp_replace(text, '({pattern})', {_OPEN} || '\\1' || {_CLOSE}, 'g')"
        cut.append(f"SELECT rid, {k} AS scan, string_split({marked}, {_OPEN}) AS parts FROM src WHERE regexp_matches(text, '{pattern}')")
    for i, r in recognizers:
        ways = "|".join(" ".join(f"{w}(?:s|es)?" for w in p.lower().split()) for p in r.context) if context and r.context and not r.validator else ""
        for p, (score, rx, g) in enumerate(r.patterns):
            tests = [f"coalesce({checks[r.validator]}, false)"] if r.validator else []
            if r.labels:
                tests.append(f"regexp_matches(label, '(?: {' | '.join(r.labels)} )')")
            worth = "1.0" if r.validator else f"CASE WHEN regexp_matches(near, ' (?:{ways}) ') THEN least(1.0, greatest({score} + 0.35, 0.4)) ELSE {score} END" if ways else str(score)
            rules.append(f"SELECT rid, '{r.entity}' AS entity_type, start, stop, CAST({worth} AS DOUBLE) AS score, text, '{r.name}' AS recognizer, {i * 10 + p} AS ord FROM hits WHERE scan = {scans[rx, g]}" + "".join(f" AND ({x})" for x in tests))
    ctes.append("cut AS MATERIALIZED (" + " UNION ALL ".join(cut) + ")")
    ctes.append("one AS (SELECT rid, scan, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut)")
    ctes.append("summed AS (SELECT rid, scan, part, i, sum(strlen(part) - 3) OVER w AS bytes, sum(length(part) - 1) OVER w AS chars FROM one WINDOW w AS (PARTITION BY rid, scan ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    # of earlier marks, each was counted with its three bytes
    ctes.append(f"placed AS (SELECT s.rid, scan, CAST(bytes + 3 AS INT) AS start, split_part(part, {_CLOSE}, 1) AS hit, left(src.text, CAST(chars + 1 AS INT)) AS prior FROM summed s JOIN src ON s.rid = src.rid WHERE i > 1)")
    cutoff = f"CASE WHEN regexp_matches(hit, '^{_WORD}') THEN regexp_replace(prior, '{_WORD}+$', '') ELSE prior END"
    label = "regexp_replace(lower(right(prior, list_max([k FOR k IN range(0, 25) IF strlen(right(prior, k)) <= 24]))), '[^\\p{L}\\p{Nd}]+', ' ', 'g')"
    ctes.append(
        f"hits AS MATERIALIZED (SELECT rid, scan, start, CAST(start + strlen(hit) AS INT) AS stop, hit AS text, [CAST(c AS INT) FOR c IN string_split(regexp_replace(hit, '[^0-9]', '', 'g'), '') IF c <> ''] AS d, "
        f"' ' || array_to_string(regexp_extract_all(lower({cutoff}), '{_WORD}+')[-5:], ' ') || ' ' AS near, ' ' || {label} || ' ' AS label FROM placed WHERE hit <> '')"
    )
    ctes.append("found AS MATERIALIZED (" + " UNION ALL ".join(rules) + ")")
    inside = "y.rid = x.rid AND y.entity_type = x.entity_type AND y.start <= x.start AND y.stop >= x.stop AND (y.start < x.start OR y.stop > x.stop OR y.ord < x.ord)"
    return f"WITH {', '.join(ctes)} SELECT {key}, x.entity_type, x.start, x.stop AS \"end\", x.score, x.text, x.recognizer FROM found x JOIN (SELECT rid, {key} FROM src) k ON k.rid = x.rid WHERE NOT EXISTS (SELECT 1 FROM found y WHERE {inside})"
