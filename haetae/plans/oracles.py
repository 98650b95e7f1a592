"""DuckDB statements of the queries, for comparison on the same tables."""

from __future__ import annotations

from haetae import rules as catalog
from haetae.plans.formats import BUILDERS
from haetae.plans.queries import MODES, OVERLAY, OWN

UPPER_LEFT = "[0-9A-Za-z*]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: What the other engine has no syntax for.
REWRITTEN = {"[a-z&&[^aeiou]]": "[b-df-hj-np-tv-z]", r"\d++": r"\d+"}


def pattern(text: str) -> str:
    """The same classes in the other engine's notation."""
    for a, b in REWRITTEN.items():
        text = text.replace(a, b)
    return q(text.replace(r"\d", r"\p{Nd}").replace(r"\s", r"\t\n\x{0B}\f\r\x{85}\p{Z}"))


def digit(t: str, i: int) -> str:
    return f"(ascii(substr({t}, {i + 1}, 1)) - 48)"


def weighted(t: str, weights: str) -> str:
    return " + ".join(f"{digit(t, i)} * {w}" for i, w in enumerate(weights))


def rrn_ok(t: str) -> str:
    return f"((11 - ({weighted(t, '234567892345')}) % 11) % 10 = {digit(t, 12)})"


def corp_ok(t: str) -> str:
    return f"((10 - ({weighted(t, '121212121212')}) % 10) % 10 = {digit(t, 12)})"


def biz_ok(t: str) -> str:
    return f"((10 - ({weighted(t, '137137135')} + {digit(t, 8)} * 5 // 10) % 10) % 10 = {digit(t, 9)})"


def luhn_ok(t: str) -> str:
    each = f"list_transform(range(1, len({t}) + 1), lambda i: (ascii(substr({t}, len({t}) - i + 1, 1)) - 48) * (2 - i % 2))"
    return f"(len({t}) BETWEEN 13 AND 19 AND list_sum(list_transform({each}, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0)"


def date_ok(t: str) -> str:
    century = f"CASE WHEN {digit(t, 6)} IN (1, 2, 5, 6) THEN '19' WHEN {digit(t, 6)} IN (3, 4, 7, 8) THEN '20' END"
    return f"(TRY_CAST(({century}) || substr({t}, 1, 2) || '-' || substr({t}, 3, 2) || '-' || substr({t}, 5, 2) AS DATE) IS NOT NULL)"


def verdict(validator: str, raw: str = "raw") -> str:
    t = f"regexp_replace({raw}, '[^0-9*]', '', 'g')"
    star = f"contains({raw}, '*')"
    plain = f"CASE WHEN {star} THEN 'already_masked' ELSE 'confirmed' END"
    graded = lambda ok: f"CASE WHEN {ok} THEN 'confirmed' ELSE 'suspicious' END"
    separated = f"regexp_matches({raw}, '[- –]')"
    if validator in ("rrn", "frn"):
        low, high = (1, 4) if validator == "rrn" else (5, 8)
        mine = f"{digit(t, 6)} BETWEEN {low} AND {high}"
        return f"CASE WHEN len({t}) <> 13 THEN 'skip' WHEN {star} THEN CASE WHEN {mine} OR substr({t}, 7, 1) = '*' THEN 'already_masked' ELSE 'skip' END WHEN {mine} AND {date_ok(t)} THEN {graded(rrn_ok(t))} ELSE 'skip' END"
    if validator == "corp":
        return f"CASE WHEN len({t}) <> 13 THEN 'skip' WHEN {star} THEN 'already_masked' ELSE {graded(corp_ok(t))} END"
    if validator == "luhn":
        return f"CASE WHEN len({t}) NOT BETWEEN 13 AND 19 THEN 'skip' WHEN {star} THEN 'already_masked' WHEN {digit(t, 0)} BETWEEN 3 AND 6 THEN {graded(luhn_ok(t))} ELSE 'skip' END"
    if validator == "phone":
        return f"CASE WHEN {digit(t, 0)} <> 0 OR NOT starts_with({raw}, '01') OR NOT ({star} OR len(regexp_replace({raw}, '[^0-9]', '', 'g')) IN (10, 11)) THEN 'skip' ELSE {plain} END"
    if validator == "email":
        return f"CASE WHEN contains({raw}, '@') AND contains({raw}, '.') THEN {plain} ELSE 'skip' END"
    if validator == "passport":
        return f"CASE WHEN {star} AND regexp_full_match({raw}, '[A-Za-z]{{1,2}}[0-9*]{{6,8}}') THEN 'already_masked' WHEN regexp_full_match({raw}, '[A-Za-z]{{1,2}}[0-9]{{7,8}}') THEN 'confirmed' ELSE 'skip' END"
    if validator == "biz":
        return f"CASE WHEN len({t}) <> 10 THEN 'skip' WHEN {star} THEN 'already_masked' WHEN {biz_ok(t)} THEN 'confirmed' WHEN {separated} THEN 'suspicious' ELSE 'skip' END"
    if validator == "health":
        return f"CASE WHEN len({t}) <> 11 THEN 'skip' WHEN {star} THEN 'already_masked' WHEN {separated} THEN 'confirmed' ELSE 'skip' END"
    if validator == "bank":
        return f"CASE WHEN len({t}) BETWEEN 10 AND 14 THEN {plain} ELSE 'skip' END"
    if validator == "ip":
        parts = f"string_split({raw}, '.')"
        small = f"len(list_filter({parts}, lambda p: TRY_CAST(p AS INTEGER) BETWEEN 0 AND 255 AND regexp_full_match(p, '[0-9]+')))"
        return f"CASE WHEN contains({raw}, '.') THEN CASE WHEN len({parts}) = 4 AND {small} = 4 THEN 'confirmed' WHEN len({parts}) = 4 AND {small} = 3 AND {parts}[4] = '*' THEN 'already_masked' ELSE 'skip' END WHEN contains({raw}, ':') THEN {plain} ELSE 'skip' END"
    return plain


def stars(raw: str, which: str = "[0-9A-Za-z]") -> str:
    return f"regexp_replace({raw}, {q(which)}, '*', 'g')"


def partial(kind: str, raw: str = "raw") -> str:
    full = stars(raw)
    first = {"rrn": 7, "corp": 7, "biz": 3, "health": 6}
    if kind in first:
        head = f"regexp_extract({raw}, '^(?:[^0-9]*[0-9]){{0,{first[kind]}}}[^0-9]*')"
        return f"{stars(head, '[A-Za-z]')} || {stars(f'substr({raw}, len({head}) + 1)')}"
    if kind == "account":
        tail = f"regexp_extract({raw}, '(?:[0-9][^0-9]*){{0,4}}$')"
        return f"{stars(f'substr({raw}, 1, len({raw}) - len({tail}))')} || {stars(tail, '[A-Za-z]')}"
    if kind in ("card", "phone"):
        head = f"regexp_extract({raw}, '^(?:[^0-9]*[0-9]){{0,{4 if kind == 'card' else 3}}}')"
        rest = f"substr({raw}, len({head}) + 1)"
        tail = f"regexp_extract({rest}, '(?:[0-9][^0-9]*){{0,4}}$')"
        return f"{head} || {stars(f'substr({rest}, 1, len({rest}) - len({tail}))', '[0-9]')} || {tail}"
    if kind == "email":
        local = f"split_part({raw}, '@', 1)"
        return f"substr({local}, 1, 1) || {stars(f'substr({local}, 2)', '[^._-]')} || substr({raw}, len({local}) + 1)"
    if kind == "driver":
        head = f"regexp_extract({raw}, '^[^0-9]*')"
        return f"{head} || {stars(f'substr({raw}, len({head}) + 1)', '[0-9' + chr(92) + 'p{L}]')}"
    if kind == "passport":
        return stars(raw, "[0-9]")
    if kind == "ip":
        return f"CASE WHEN contains({raw}, '.') THEN regexp_replace({raw}, '\\.[^.]*$', '.*') WHEN contains({raw}, ':') THEN regexp_replace({raw}, ':[^:]*$', ':*') ELSE {full} END"
    return full


def by_rule(rules: catalog.RuleSet, of, column: str = "r") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN {of(rule)}" for i, rule in enumerate(rules)) + " END"


def replaced(rules: catalog.RuleSet, mode: str) -> str:
    if mode == "full":
        return stars("raw")
    if mode == "delete":
        return "''"
    return by_rule(rules, (lambda r: partial(r.partial)) if mode == "partial" else (lambda r: q(r.replace_token)))


def lines(source: str) -> str:
    """CTE body ``k, pi, text`` of the lines of ``source`` (k, text)."""
    return f"SELECT k, unnest(range(len(l))) AS pi, rtrim(unnest(l), chr(13)) AS text FROM (SELECT k, string_split(coalesce(text, ''), chr(10)) AS l FROM ({source}))"


def found(name: str = "lines", rules: catalog.RuleSet | None = None, prefix: str = "") -> str:
    """CTEs over ``name`` (k, pi, text) up to ``{prefix}found`` (k, pi, text, r, raw, s, e, confidence)."""
    rules = rules or catalog.builtin()
    each = " UNION ALL ".join(
        f"SELECT k, pi, text, {i} AS r, {j} AS o, regexp_extract_all(text, {pattern(p)}) AS ms, string_split_regex(text, {pattern(p)}) AS sg FROM {name} WHERE regexp_matches(text, {pattern(p)})"
        for i, rule in enumerate(rules)
        for j, p in enumerate(rule.patterns)
    )
    return f"""
{prefix}matches AS ({each}),
{prefix}spans AS (SELECT k, pi, text, r, o, ms[i] AS raw, CAST(list_sum(list_transform(sg[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0) AS INTEGER) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {prefix}matches)),
{prefix}judged AS (SELECT k, pi, text, r, o, raw, s, CAST(s + len(raw) AS INTEGER) AS e, {by_rule(rules, lambda x: verdict(x.validator))} AS confidence FROM {prefix}spans
  WHERE len(raw) > 0 AND NOT (s > 0 AND regexp_matches(substr(text, s, 1), '{UPPER_LEFT}')) AND NOT regexp_matches(substr(text, s + len(raw) + 1, 1), '{UPPER_LEFT}')),
{prefix}claimed AS (SELECT k, pi, text, list_reduce(list([{{'r': r, 's': s, 'e': e, 'raw': raw, 'c': confidence}}] ORDER BY r, s, o), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS f
  FROM {prefix}judged WHERE confidence <> 'skip' GROUP BY k, pi, text),
{prefix}found AS (SELECT k, pi, text, x.r AS r, x.raw AS raw, x.s AS s, x.e AS e, x.c AS confidence FROM (SELECT k, pi, text, unnest(f) AS x FROM {prefix}claimed))"""


def masked(mode: str, name: str = "lines", rules: catalog.RuleSet | None = None, prefix: str = "") -> str:
    """CTEs after ``found``: ``{prefix}masked`` (k, pi, before, after)."""
    rules = rules or catalog.builtin()
    return f"""
{prefix}pieces AS (SELECT k, pi, s, e, text, substr(text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || ({replaced(rules, mode)}) AS piece FROM {prefix}found WHERE confidence <> 'already_masked' WINDOW w AS (PARTITION BY k, pi ORDER BY s)),
{prefix}joined AS (SELECT k, pi, string_agg(piece, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS after FROM {prefix}pieces GROUP BY k, pi),
{prefix}masked AS (SELECT l.k, l.pi, l.text AS before, coalesce(j.after, l.text) AS after FROM {name} l LEFT JOIN {prefix}joined j ON l.k = j.k AND l.pi = j.pi)"""


def over(source: str, select: str, *more: str, rules: catalog.RuleSet | None = None) -> str:
    ctes = [f"lines AS ({lines(source)})", found(rules=rules), *more]
    return "WITH " + ",\n".join(ctes) + f"\n{select}"


RULES = catalog.builtin()
ID, LABEL, PREVIEW = by_rule(RULES, lambda r: q(r.id)), by_rule(RULES, lambda r: q(r.label)), f"CASE WHEN confidence = 'already_masked' THEN raw ELSE {by_rule(RULES, lambda r: partial(r.partial))} END"
DOCS, PAGES = "SELECT doc_id AS k, text FROM documents", "SELECT page_id AS k, html AS text FROM pages"
DETAIL = f"""CAST(pi AS INTEGER) AS paragraph_index, {ID} AS rule_id, {LABEL} AS label, raw, {PREVIEW} AS masked_preview, confidence,
  CAST(strlen(substr(text, 1, s)) AS INTEGER) AS byte_start, CAST(strlen(substr(text, 1, s)) + strlen(raw) AS INTEGER) AS byte_end, s AS char_start, e AS char_end,
  substr(text, greatest(s - 20, 0) + 1, s - greatest(s - 20, 0)) AS context_before, substr(text, e + 1, 20) AS context_after"""
LINE = f"(substr(text, greatest(s - 20, 0) + 1, s - greatest(s - 20, 0)) || CASE WHEN confidence = 'already_masked' THEN raw ELSE {stars('raw')} END || substr(text, e + 1, 20))"
COUNTS = "count(*) FILTER (confidence = 'confirmed') AS confirmed, count(*) FILTER (confidence = 'suspicious') AS suspicious, count(*) FILTER (confidence = 'already_masked') AS already_masked"
BY_RULE = f"SELECT {ID} AS rule_id, confidence, count(*) AS n FROM found GROUP BY 1, 2"


def pad(value: str, n: int) -> str:
    return f"lpad(CAST(({value}) % {10**n} AS VARCHAR), {n}, '0')"


K = "c_custkey"
IDENTIFIERS = "SELECT c_custkey AS k, " + " || chr(10) || ".join((
    f"'주민 ' || {pad(K, 2)} || {pad('c_custkey % 14', 2)} || {pad('c_custkey % 33', 2)} || '-' || {pad('c_custkey % 10', 1)} || {pad('c_custkey * 7919', 6)}",
    f"'법인 ' || {pad('c_custkey * 104729', 6)} || '-' || {pad('c_custkey * 7919 + 9000000', 7)}",
    f"'카드 4111-1111-' || {pad('c_custkey * 7', 4)} || '-' || {pad('c_custkey * 11', 4)}",
    f"'사업자 ' || {pad('c_custkey * 13', 3)} || '-' || {pad(K, 2)} || '-' || {pad('c_custkey * 37', 5)}",
    f"'전화 010-' || {pad('c_custkey * 31', 4)} || '-' || {pad('c_custkey * 17', 4)} || '/010-****-' || {pad(K, 4)}",
    "'메일 u' || c_custkey || '@example.com, u***@example.com'",
    f"'면허 서울-' || {pad(K, 2)} || '-' || {pad('c_custkey * 101', 6)} || '-' || {pad('c_custkey * 3', 2)}",
    f"'여권 M' || {pad('c_custkey * 12347', 8)}",
    f"'계좌 110-' || {pad('c_custkey * 3', 3)} || '-' || {pad('c_custkey * 1009', 6)}",
    f"'보험 ' || {pad('c_custkey * 997', 6)} || '-' || {pad('c_custkey * 41', 5)}",
    f"'주소 10.' || c_custkey % 300 || '.0.' || c_custkey % 7 || ' 시각 10:15:' || {pad('c_custkey % 60', 2)}",
    f"'번호 ' || {pad('c_custkey * 99991', 13)} || ' ' || {pad('c_custkey * 13', 10)}",
)) + " AS text FROM customer"


def whole(mode: str) -> str:
    """Masked documents as digests; carriage returns stay."""
    raw_lines = "raw_lines AS (SELECT k, unnest(range(len(l))) AS pi, unnest(l) AS line FROM (SELECT doc_id AS k, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
    body = "docs AS (SELECT m.k, string_agg(m.after || substr(w.line, len(m.before) + 1), chr(10) ORDER BY m.pi) AS masked FROM masked m JOIN raw_lines w ON m.k = w.k AND m.pi = w.pi GROUP BY m.k)"
    return over(DOCS, "SELECT doc_id, md5(masked) AS masked_md5, CAST(len(masked) AS BIGINT) AS n_chars FROM documents LEFT JOIN docs ON doc_id = k", masked(mode), raw_lines, body)


def residual(source: str, mode: str) -> str:
    again = f"again AS (SELECT k, pi, after AS text FROM masked), {found('again', prefix='r_')}"
    return over(source, f"SELECT {ID} AS rule_id, confidence, count(*) AS n FROM r_found GROUP BY 1, 2", masked(mode), again)


FILE_COUNTS = "counts AS (SELECT k, " + COUNTS + " FROM found GROUP BY k)"
LEFT = f"again AS (SELECT k, pi, after AS text FROM masked), {found('again', prefix='r_')}, left_over AS (SELECT k, CAST(count(*) FILTER (confidence = 'confirmed') AS INTEGER) AS rc, CAST(count(*) FILTER (confidence = 'suspicious') AS INTEGER) AS rs FROM r_found GROUP BY k)"
ESC = {
    "xml": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")],
    "unxml": [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")],
    "html": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")],
}


def chain(column: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        column = f"replace({column}, {q(a)}, {q(b)})"
    return column


JSON = "replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
OWN_RULES = catalog.load(OWN)
OVER_RULES = catalog.overlay(RULES, OVERLAY)

#: The written file's lines, where they are not the masked lines themselves, and lines of its own.
WRITTEN = {
    "json": ("'\"' || after || '\"' || CASE WHEN pi < 11 THEN ',' ELSE '' END", "UNION ALL SELECT c_custkey, '[' FROM customer UNION ALL SELECT c_custkey, ']' FROM customer"),
    "csv": ("CASE WHEN pi % 2 = 0 THEN '\"' || after || chr(10) || lead(after) OVER (PARTITION BY k ORDER BY pi) || '\",x' END", ""),
}


def round_trip(kind: str) -> str:
    """Counts and lines of a customer's text, whatever the format: all formats hold the same lines."""
    line, more = WRITTEN.get(kind, ("after", ""))
    form, extension = BUILDERS[kind][:2]
    text = f"texts AS (SELECT k, md5(string_agg(line, chr(10) ORDER BY line)) AS lines_md5 FROM (SELECT k, {line} AS line FROM masked {more}) WHERE line IS NOT NULL AND line <> '' GROUP BY k)"
    select = f"SELECT c_custkey, '{form}' AS format, CAST(coalesce(confirmed, 0) AS INTEGER) AS confirmed, CAST(coalesce(suspicious, 0) AS INTEGER) AS suspicious, CAST(coalesce(already_masked, 0) AS INTEGER) AS already_masked, coalesce(rc, 0) AS residual_confirmed, coalesce(rs, 0) AS residual_suspicious, c_custkey || '.{'txt' if kind == 'pdf' else extension}' AS output_name, lines_md5 FROM customer LEFT JOIN counts ON c_custkey = counts.k LEFT JOIN left_over ON c_custkey = left_over.k JOIN texts ON c_custkey = texts.k"
    return over(IDENTIFIERS, select, masked("full"), LEFT, FILE_COUNTS, text)


#: Lines and the masked text of each document.
WHOLE = "whole AS (SELECT m.k, count(*) AS n, count(*) FILTER (before <> after) AS changed, string_agg(m.after || substr(w.line, len(m.before) + 1), chr(10) ORDER BY m.pi) AS out FROM masked m JOIN (SELECT k, unnest(range(len(l))) AS pi, unnest(l) AS line FROM (SELECT doc_id AS k, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) w ON m.k = w.k AND m.pi = w.pi GROUP BY m.k)"

ORACLES: dict[str, str] = {
    "findings_by_rule_confidence": over(DOCS, BY_RULE),
    "findings_detail_documents": over(DOCS, f"SELECT k AS doc_id, {DETAIL} FROM found"),
    "findings_detail_pages": over(PAGES, f"SELECT k AS page_id, {DETAIL} FROM found"),
    "findings_conversations": over("SELECT conv_id * 1000 + turn AS k, text FROM conversations", BY_RULE),
    "findings_identifiers": over(IDENTIFIERS, f"SELECT k AS c_custkey, CAST(pi AS INTEGER) AS paragraph_index, {ID} AS rule_id, raw, {PREVIEW} AS masked_preview, confidence, s AS char_start, e AS char_end FROM found"),
    "candidates_per_pattern": over(DOCS, f"SELECT {ID} AS rule_id, o AS pattern, count(*) AS n, CAST(sum(len(raw)) AS BIGINT) AS chars FROM spans GROUP BY 1, 2"),
    **{f"mask_{mode}": whole(mode) for mode in MODES},
    **{f"mask_identifiers_{mode}": over(IDENTIFIERS, "SELECT k AS c_custkey, CAST(pi AS INTEGER) AS paragraph_index, before, after FROM masked", masked(mode)) for mode in MODES},
    **{f"residual_identifiers_{mode}": residual(IDENTIFIERS, mode) for mode in MODES},
    "residual_documents": residual(DOCS, "full"),
    "doc_totals": over(DOCS, "SELECT doc_id, coalesce(confirmed, 0) AS confirmed, coalesce(suspicious, 0) AS suspicious, coalesce(already_masked, 0) AS already_masked FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN counts ON doc_id = k", FILE_COUNTS),
    "doc_summaries": over(DOCS, f"SELECT k AS doc_id, {ID} AS rule_id, {LABEL} AS label, n AS count, confirmed, suspicious, already_masked, preview, CAST(row_number() OVER (PARTITION BY k ORDER BY place) AS INTEGER) AS first_seen FROM (SELECT k, r, count(*) AS n, {COUNTS}, arg_min({LINE}, pi * 1000000 + s) AS preview, min(pi * 1000000 + s) AS place FROM found GROUP BY k, r)"),
    "changed_paragraphs": over(DOCS, "SELECT k AS doc_id, CAST(pi AS INTEGER) AS paragraph_index, before, after FROM masked WHERE before <> after", masked("partial")),
    "paragraph_split": f"WITH lines AS ({lines(DOCS)}) SELECT k AS doc_id, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars, CAST(max(pi) AS INTEGER) AS last FROM lines GROUP BY k",
    "text_paragraph_counts": "SELECT role, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS n FROM conversations GROUP BY role",
    "csv_records": "SELECT conv_id, turn, 3 AS n, CAST(len(text) + len(role) + 5 AS INTEGER) AS first_chars, '' AS last_record FROM conversations WHERE len(text) - len(replace(text, '\"', '')) = 0",
    "full_texts": r"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, '') , '\r+(\n|$)', '\1', 'g'), '^\n+', '') || chr(10)) AS text_md5 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, md5('') FROM documents WHERE text IS NULL",
    "verdict_labels": over(IDENTIFIERS, f"SELECT {LABEL} AS label, CASE confidence WHEN 'confirmed' THEN '확정' WHEN 'suspicious' THEN '의심' ELSE '이미 마스킹됨' END AS verdict, count(*) AS n, min({PREVIEW}) AS least FROM found GROUP BY 1, 2"),
    "csv_report_rows": over(DOCS, f"SELECT doc_id || '.txt' AS filename, coalesce({ID}, '') AS type, coalesce({LABEL}, '') AS label, CAST(coalesce(n, 0) AS INTEGER) AS count, CAST(coalesce(confirmed, 0) AS INTEGER) AS confirmed, CAST(coalesce(suspicious, 0) AS INTEGER) AS suspicious, CAST(coalesce(already_masked, 0) AS INTEGER) AS already_masked, coalesce(rc, 0) AS residual_confirmed, coalesce(rs, 0) AS residual_suspicious, coalesce(preview, '') AS preview FROM documents LEFT JOIN (SELECT k, r, count(*) AS n, {COUNTS}, arg_min({LINE}, pi * 1000000 + s) AS preview FROM found GROUP BY k, r) g ON doc_id = g.k LEFT JOIN left_over ON doc_id = left_over.k", masked("full"), LEFT),
    "process_text_files": over(
        DOCS,
        "SELECT doc_id, doc_id || '.txt' AS filename, 'txt' AS format, CAST(n AS INTEGER) AS paragraph_count, CAST(coalesce(confirmed, 0) AS INTEGER) AS confirmed, CAST(coalesce(suspicious, 0) AS INTEGER) AS suspicious, CAST(coalesce(already_masked, 0) AS INTEGER) AS already_masked, coalesce(rc, 0) AS residual_confirmed, coalesce(rs, 0) AS residual_suspicious, CAST(changed AS INTEGER) AS n_diffs, md5(out) AS masked_md5, doc_id || '.txt' AS output_name FROM documents JOIN whole ON doc_id = whole.k LEFT JOIN counts ON doc_id = counts.k LEFT JOIN left_over ON doc_id = left_over.k",
        masked("partial"),
        LEFT,
        FILE_COUNTS,
        WHOLE,
    ),
    "written_files": over(DOCS, "SELECT doc_id || '.txt' AS filename, md5(out) AS masked_md5, CAST(strlen(out) AS BIGINT) AS length FROM documents JOIN whole ON doc_id = whole.k", masked("partial"), WHOLE),
    "findings_by_lang": over(DOCS, f"SELECT lang, {ID} AS rule_id, count(*) AS n, count(DISTINCT k) AS docs FROM found JOIN documents ON k = doc_id GROUP BY 1, 2"),
    "findings_by_source": over(DOCS, "SELECT source, " + ", ".join(f"count(*) FILTER (id = '{r.id}') AS {r.id}" for r in RULES) + f" FROM (SELECT k, {ID} AS id FROM found) JOIN documents ON k = doc_id GROUP BY 1"),
    "findings_with_labels": over(DOCS, "SELECT quality, toxic, count(*) AS docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings FROM labels LEFT JOIN (SELECT k, count(*) AS n FROM found GROUP BY k) ON k = doc_id GROUP BY 1, 2"),
    "overlay_rule": over("SELECT c_custkey AS k, c_name AS text FROM customer", "SELECT m.k AS c_custkey, m.after, CAST(count(f.r) AS INTEGER) AS n, min(f.confidence) AS confidence FROM masked m LEFT JOIN found f ON m.k = f.k AND m.pi = f.pi GROUP BY 1, 2", masked("replace", rules=OVER_RULES), rules=OVER_RULES),
    "own_rules_documents": over(DOCS, f"SELECT k AS doc_id, CAST(pi AS INTEGER) AS paragraph_index, {by_rule(OWN_RULES, lambda r: q(r.id))} AS rule_id, raw, confidence, s AS char_start, e AS char_end FROM found", rules=OWN_RULES),
    "many_rules_documents": "SELECT w AS rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z*]+')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{5,}') GROUP BY w ORDER BY n DESC, w LIMIT 2000",
    "split_csv_records": "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(len(c) - len(replace(c, chr(10), '')) AS INTEGER) AS n_feeds, md5(c) AS cell_md5 FROM (SELECT conv_id, turn, '\"' || replace(coalesce(text, '') || chr(10) || role, '\"', '\"\"') || '\"' AS c FROM conversations)",
    "rule_catalog": "SELECT * FROM (VALUES " + ", ".join(f"({q(r.id)}, {r.priority}, {q(r.validator)}, {q(r.partial)}, {len(r.patterns)}, {i})" for i, r in enumerate(RULES)) + ") AS t(id, priority, validator, partial, n_patterns, ord)",
    "check_digits": f"SELECT o_orderkey, {rrn_ok('t')} AS rrn, {corp_ok('t')} AS corp, {biz_ok('substr(t, 1, 10)')} AS biz, {luhn_ok('card')} AS luhn, {date_ok('t')} AS date_ok FROM (SELECT *, '4' || t AS card FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + o_custkey * 104729 AS VARCHAR), 13, '9') AS t FROM orders))",
    "escaped_texts": f"SELECT page_id, md5({chain('html', ESC['xml'])}) AS xml, md5({chain('html', ESC['unxml'])}) AS unxml, md5({chain('html', ESC['html'])}) AS html, md5({JSON}) AS json, md5(CASE WHEN contains(html, '\"') OR contains(html, ',') OR contains(html, chr(10)) OR contains(html, chr(13)) THEN '\"' || replace(html, '\"', '\"\"') || '\"' ELSE html END) AS csv FROM pages",
    "output_names": r"SELECT page_id, regexp_replace(url, '\.[^.]*$', '') || '.txt' AS name FROM pages",
    "windowed_findings": over(
        "SELECT {'ts': ts, 'id': event_id} AS k, 'ip 10.0.' || user_id % 256 || '.' || event_id % 256 || ' ' || props AS text FROM events",
        f"SELECT date_trunc('hour', k.ts) AS window_start, date_trunc('hour', k.ts) + INTERVAL 1 HOUR AS window_end, {ID} AS rule_id, confidence, count(*) AS n FROM found GROUP BY 1, 2, 3, 4",
    ),
    "container_round_trip": over(
        IDENTIFIERS,
        "SELECT c_custkey, 'docx' AS format, 12 AS paragraph_count, CAST(coalesce(confirmed, 0) AS INTEGER) AS confirmed, CAST(coalesce(suspicious, 0) AS INTEGER) AS suspicious, CAST(coalesce(already_masked, 0) AS INTEGER) AS already_masked, coalesce(rc, 0) AS residual_confirmed, c_custkey || '.docx' AS output_name FROM customer LEFT JOIN counts ON c_custkey = counts.k LEFT JOIN left_over ON c_custkey = left_over.k",
        masked("full"),
        LEFT,
        FILE_COUNTS,
    ),
    "json_report_rows": over(
        DOCS,
        "SELECT doc_id || '.txt' AS filename, 'txt' AS format, CAST(w.n AS INTEGER) AS paragraph_count, CAST(coalesce(confirmed, 0) AS INTEGER) AS confirmed, coalesce(rc, 0) AS residual_confirmed, CAST(coalesce(f.n, 0) AS INTEGER) AS n_findings, CAST(coalesce(f.rules, 0) AS INTEGER) AS n_rules, CAST(coalesce(changed, 0) AS INTEGER) AS n_diffs, f.raw AS first_raw FROM documents LEFT JOIN counts ON doc_id = counts.k LEFT JOIN left_over ON doc_id = left_over.k LEFT JOIN f ON doc_id = f.k LEFT JOIN w ON doc_id = w.k",
        masked("full"),
        LEFT,
        FILE_COUNTS,
        "f AS (SELECT k, count(*) AS n, count(DISTINCT r) AS rules, arg_min(raw, pi * 1000000 + s) AS raw FROM found GROUP BY k), w AS (SELECT k, count(*) AS n, count(*) FILTER (before <> after) AS changed FROM masked GROUP BY k)",
    ),
    "html_report_rows": over(
        IDENTIFIERS,
        "SELECT m.k || '.txt' AS filename, CAST((SELECT count(DISTINCT r) FROM found f WHERE f.k = m.k) AS INTEGER) AS n_rules, CAST(count(*) FILTER (before <> after) AS INTEGER) AS n_changed, arg_min(after, pi) FILTER (before <> after) AS first_line FROM masked m GROUP BY m.k",
        masked("full"),
    ),
    **{f"format_{kind}": round_trip(kind) for kind in BUILDERS},
}
