"""DuckDB SQL for the corpus queries that SQL can express: archives, quality rules, chats, repaired conversations and shared lines. The others hash
with functions that DuckDB lacks, train a model, tokenize or walk markup; tests hold them against brute force."""

from .chat import _LAST, PART
from .line_dedup import MIN_CHARS, MIN_DOCS
from .quality_rules import FAR, GAMMA, LEAST, NARROW, OF_ALL, OF_POSITIVE, PRIOR, WIDE, ZERO

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '')"

OP1 = f"""SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM (
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS n, sha1(body) AS h, row_number() OVER (PARTITION BY body ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY body) AS first FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""

_SPACE = r"[\x20\x09-\x0D]"
_VALUES = {"symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}


def _weights(groups: str, of: str, prior_of: str, on: str, rows_of: str) -> str:
    """Bins of groups: their own weights and the larger groups' as PRIOR rows."""
    return f"""SELECT {groups}, measure, bin, sum(w) AS w FROM (SELECT {groups}, measure, bin, w FROM {of} UNION ALL
        SELECT {", ".join(f"g.{x}" for x in groups.split(", "))}, g.measure, p.bin, p.w * {PRIOR} / p.total FROM (SELECT DISTINCT {groups}, measure FROM {of}) g JOIN (SELECT *, sum(w) OVER (PARTITION BY {rows_of}) AS total FROM {prior_of}) p ON {on}) GROUP BY ALL"""


def _quantile(q: float, cum: str = "cum", total: str = "total") -> str:
    reached = f"min(bin) FILTER (WHERE {cum} > 0 AND {cum} >= CAST('{q!r}' AS DOUBLE) * {total} * (1 - 1e-9))"
    return f"(CASE WHEN {reached} = {ZERO} THEN 0.0 ELSE 2 * pow({GAMMA!r}, CAST({reached} AS DOUBLE)) / {1 + GAMMA!r} END)"


_QUANTILES = ", ".join([*(f"{_quantile(q)} AS q{round(100 * q)}" for q in OF_ALL), *(f"{_quantile(q, 'pcum', 'ptotal')} AS p{round(100 * q)}" for q in OF_POSITIVE)])
_LIMITS = f"""SELECT q.l, q.s, q.measure, CASE WHEN q.measure = 'word_length' THEN q.q20 - {WIDE} * spread ELSE -1.0 END / {GAMMA!r} AS low,
        {GAMMA!r} * CASE q.measure WHEN 'word_length' THEN q.q80 + {WIDE} * spread WHEN 'symbol_share' THEN q.q80 + {NARROW} * spread ELSE {FAR} * q.p95 END AS high
        FROM quantiles q JOIN (SELECT l, s, greatest((q80 - q20) / 2, {LEAST} * w) AS spread FROM quantiles, (SELECT ({_quantile(OF_ALL[1])} - {_quantile(OF_ALL[0])}) / 2 AS w FROM (SELECT *, sum(w) OVER (ORDER BY bin) AS cum, sum(w) OVER () AS total FROM overall WHERE measure = 'word_length')) WHERE measure = 'word_length') w ON w.l = q.l AND w.s = q.s"""

_ROWS = " UNION ALL ".join(f"SELECT doc_id, l, s, '{m}' AS measure, CAST({c} AS DOUBLE) / greatest({by}, 1) AS v, base_failed FROM measured" for m, (c, by) in _VALUES.items())
OP3 = f"""WITH words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '{_SPACE}+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL)),
    windows AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    repeated AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS r FROM windows),
    covered AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n FROM (SELECT doc_id, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM repeated) GROUP BY 1),
    lines AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
    counted AS (SELECT d.doc_id, coalesce(lang, '') || '=' AS l, coalesce(source, '') || '=' AS s, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')) AS n_words,
        length(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM documents d JOIN lines USING (doc_id) LEFT JOIN covered c ON c.doc_id = d.doc_id),
    measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
    valued AS ({_ROWS}),
    binned AS (SELECT l, s, measure, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln({GAMMA!r})) AS INT) ELSE {ZERO} END AS bin, CAST(count(*) AS DOUBLE) AS w FROM valued WHERE NOT base_failed GROUP BY ALL),
    by_lang AS (SELECT l, measure, bin, sum(w) AS w FROM binned GROUP BY ALL), overall AS (SELECT measure, bin, sum(w) AS w FROM binned GROUP BY ALL),
    lang AS ({_weights('l', 'by_lang', 'overall', 'p.measure = g.measure', 'measure')}),
    own AS ({_weights('l, s', 'binned', 'lang', 'p.measure = g.measure AND p.l = g.l', 'l, measure')}),
    summed AS (SELECT *, sum(w) OVER (PARTITION BY l, s, measure ORDER BY bin) AS cum, sum(w) OVER (PARTITION BY l, s, measure) AS total, sum(CASE WHEN bin = {ZERO} THEN 0 ELSE w END) OVER (PARTITION BY l, s, measure ORDER BY bin) AS pcum, sum(CASE WHEN bin = {ZERO} THEN 0 ELSE w END) OVER (PARTITION BY l, s, measure) AS ptotal FROM own),
    quantiles AS (SELECT l, s, measure, {_QUANTILES} FROM summed GROUP BY ALL),
    limits AS ({_LIMITS}),
    judged AS (SELECT v.doc_id, bool_and(coalesce(v.v <= o.high AND v.v >= o.low, true)) AS inside FROM valued v LEFT JOIN limits o ON o.l = v.l AND o.s = v.s AND o.measure = v.measure GROUP BY 1)
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM measured m JOIN judged USING (doc_id)"""


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


_MARKS = rf"^{_SPACE}*(?:>{_SPACE}?)*"
_BLANK = rf"\n{_SPACE}*\n"
#: Every quote against every earlier message of its conversation. Messages of one turn come by role and text here.
OP6 = f"""WITH m AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
    lines AS (SELECT r, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM m)),
    cut AS (SELECT *, length(regexp_replace(regexp_extract(x, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_MARKS}', '') AS plain FROM lines),
    own AS (SELECT r, regexp_replace(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^{_SPACE}+', ''), '{_SPACE}+$', '') AS content FROM cut GROUP BY r),
    passage AS (SELECT r, conv_id, turn, level, min(i) AS k, string_agg(plain, chr(10) ORDER BY i) AS text FROM (SELECT cut.*, conv_id, turn, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS g FROM cut JOIN m USING (r) WHERE level > 0 AND turn IS NOT NULL AND conv_id IS NOT NULL) GROUP BY r, conv_id, turn, level, g),
    unit AS (SELECT DISTINCT conv_id, turn, {_normal('u')} AS u FROM (SELECT conv_id, turn, unnest([content] || string_split_regex(content, '{_BLANK}') || string_split(content, chr(10))) AS u FROM own JOIN m USING (r) WHERE turn IS NOT NULL) WHERE {_normal('u')} <> ''),
    whole AS (SELECT p.*, CASE WHEN f.first < p.turn THEN f.first END AS whole_at FROM passage p LEFT JOIN (SELECT conv_id, u, min(turn) AS first FROM unit GROUP BY 1, 2) f ON f.conv_id = p.conv_id AND f.u = {_normal('p.text')}),
    block AS (SELECT r, k, conv_id, turn, unnest(bs) AS b, generate_subscripts(bs, 1) AS bi FROM (SELECT *, string_split_regex(text, '{_BLANK}') AS bs FROM whole WHERE whole_at IS NULL)),
    line AS (SELECT r, k, conv_id, turn, {_normal('b')} AS block, bi, li, {_normal('x')} AS line FROM (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) AS li FROM (SELECT *, string_split(b, chr(10)) AS xs FROM block)) WHERE {_normal('x')} <> ''),
    score AS (SELECT line.r, line.k, unit.turn AS said_at, count(DISTINCT (bi, li)) AS s FROM line JOIN unit ON unit.conv_id = line.conv_id AND unit.turn < line.turn AND unit.u IN (line.block, line.line) GROUP BY 1, 2, 3),
    partly AS (SELECT r, k, arg_max(said_at, (s, said_at)) AS partly_at FROM score JOIN (SELECT r, k, count(*) AS n FROM line GROUP BY 1, 2) USING (r, k) WHERE 2 * s > n GROUP BY 1, 2),
    linked AS (SELECT w.r, w.level, coalesce(whole_at, partly_at) AS said_at FROM whole w LEFT JOIN partly USING (r, k)),
    reply AS (SELECT r, count(*) AS n_quotes, count(said_at) AS n_linked, arg_min(said_at, (level, -said_at)) FILTER (WHERE said_at IS NOT NULL) AS reply_to FROM linked GROUP BY r),
    placed AS (SELECT conv_id, turn, role, content, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(reply_to, turn - 1, {_LAST}), turn NULLS FIRST, role, text) AS place FROM m JOIN own USING (r) LEFT JOIN reply USING (r))
    SELECT conv_id, (place - 1) // {PART} AS part, count(*) AS n_messages, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(sum(n_linked) AS BIGINT) AS n_linked, string_agg(coalesce(CAST(turn AS VARCHAR), '?'), ' ' ORDER BY place) AS turns,
        string_agg('<|' || role || '|>' || chr(10) || content || '<|end|>' || chr(10), '' ORDER BY place) AS chat FROM placed GROUP BY 1, 2"""


#: The contract's faults, then one turn of every conversation a recursion; the repaired turns are carried with the edits.
OP12 = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    faulty AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS f FROM named, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM faulty WHERE f <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos, substr(role, 1, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
    first AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM placed),
    judged AS (SELECT *, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM first),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate, count_if(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
    inserts(p, q, c, a, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'user:|'), (1, 2, 3, 'I', 'user:|'), (3, 2, 3, 'I', 'user:|'), (2, 3, 3, 'I', 'assistant:|'), (0, 3, 6, 'II', 'user:|assistant:|'), (1, 3, 6, 'II', 'user:|assistant:|'), (3, 3, 6, 'II', 'user:|assistant:|'), (2, 2, 6, 'II', 'assistant:|user:|')),
    moves(p, i, q, role) AS (VALUES (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')),
    edits AS (SELECT conv_id, pos, p, p AS q, 4 AS c, 'D' AS a, '' AS o FROM judged, (SELECT unnest([0, 1, 2, 3]) AS p)
        UNION ALL SELECT conv_id, pos, p, q, CASE WHEN cut THEN 3 ELSE 0 END, 'K', j.role || ':' || text || chr(10) FROM judged j JOIN moves m ON m.i = j.i WHERE NOT blank AND NOT again
        UNION ALL SELECT conv_id, pos, p, q, CASE WHEN cut THEN 6 ELSE 3 END, 'R', m.role || ':' || text || chr(10) FROM judged j JOIN moves m ON m.i <> 's' WHERE NOT blank AND NOT again),
    best AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, n, 0 AS q, {'c': 0, 'a': '', 'o': ''} AS b FROM counted
        UNION ALL SELECT x.conv_id, x.pos + 1, x.n, e.q, min({'c': x.b.c + i.c + e.c, 'a': x.b.a || i.a || e.a, 'o': x.b.o || replace(i.o, '|', chr(10)) || e.o}) FROM best x JOIN inserts i ON i.p = x.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.pos = x.pos AND e.p = i.q GROUP BY 1, 2, 3, 4),
    cheapest AS (SELECT conv_id, min({'c': b.c + i.c, 'a': b.a || i.a, 'o': b.o || replace(i.o, '|', chr(10))}) AS b FROM best JOIN inserts i ON i.p = best.q WHERE pos = n AND i.q IN (0, 3) GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(x.b.c, 0) AS BIGINT) AS cost, coalesce(x.b.a, '') AS audit, sha256(coalesce(substr(x.b.o, 1, greatest(length(x.b.o) - 1, 0)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN cheapest x ON x.conv_id IS NOT DISTINCT FROM o.conv_id"""

_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP13 = f"""WITH lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    keyed AS (SELECT *, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    shared AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {MIN_DOCS}),
    judged AS (SELECT r, k.doc_id, line, i, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.holder AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op3_quality_rules": OP3, "op6_chat_formatting": OP6, "op12_repair": OP12, "op13_line_dedup": OP13}
