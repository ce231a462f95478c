"""The queries again as DuckDB SQL, where SQL can express them."""

OP2 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS width, list_aggregate(ws[i:i + least(len(ws), 10) - 1], 'string_agg', ' ') AS win
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)
), widths AS (
    SELECT DISTINCT width FROM bw
), dw AS (
    SELECT doc_id, i, width, list_aggregate(ws[i:i + width - 1], 'string_agg', ' ') AS win
    FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, widths WHERE len(ws) >= width)
), hits AS (
    SELECT doc_id, i, width, item_id FROM dw JOIN bw USING (width, win)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT doc_id, i, width FROM hits)) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           coalesce('s' || source, 't') AS key, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt
    FROM documents
), s AS (
    SELECT key, source_size, w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
    FROM (SELECT key, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY key)
), ranked AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
           sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s
), levels AS (
    SELECT *, CASE WHEN (total - full_) * w < cap * rest THEN (total - full_) / rest END AS lv FROM ranked
), t AS (
    SELECT key, source_size, CASE WHEN lv IS NULL THEN cap ELSE (SELECT arg_min(lv, cap / w) FROM levels WHERE lv IS NOT NULL) * w END AS target FROM levels
), placed AS (
    SELECT doc_id, source, key, size,
           row_number() OVER (PARTITION BY key ORDER BY CASE WHEN size < 16 THEN size ELSE len(bin(size)) * 16 + (size >> (len(bin(size)) - 5)::INT) - 16 END, salt, size, doc_id) - 1 AS pos
    FROM d
), rated AS (
    SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix:' || key), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
    FROM placed p JOIN t USING (key)
)
SELECT doc_id, size, source_size, target, ((floor((pos + 1)::DOUBLE * rate + u) - floor(pos::DOUBLE * rate + u)) * size)::BIGINT AS taken FROM rated
"""

OP6 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), half AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), links AS (
    SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(node, low) AS (
    SELECT DISTINCT a, a FROM links
    UNION
    SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), component AS (
    SELECT node, min(low) AS low FROM reach GROUP BY node
), degree AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(low, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN degree ON a = doc_id LEFT JOIN component ON node = doc_id
"""

OP8 = r"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
           lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path,
           regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query, strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS ts
    FROM pages
), k AS (
    SELECT *, array_to_string(list_reverse(string_split(regexp_replace(host, '^www[.]', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '?' THEN '' ELSE query END AS urlkey FROM p
), f AS (
    SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to, urlkey, ts, (row_number() OVER (ORDER BY urlkey, ts, page_id) - 1)::BIGINT AS place
FROM k LEFT JOIN f USING (payload_digest)
"""

OP9 = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
    SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (
    SELECT win, min(doc_id) AS low FROM starts GROUP BY win
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
    FROM starts JOIN firsts USING (win) WHERE low < doc_id
), every AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP1 = r"""
WITH l AS (
    SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), x AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l
), runs AS (
    SELECT doc_id, i, 1 AS h, line AS run, length(line) >= 200 AS fit FROM x
    UNION ALL
    SELECT a.doc_id, a.i, 2, a.line || chr(10) || b.line, true FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.i = a.i + 1
), firsts AS (
    SELECT h, run, min((doc_id, i)) AS first FROM runs GROUP BY h, run
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + h)) AS i FROM runs JOIN firsts USING (h, run) WHERE fit AND first < (doc_id, i)
), deep AS (
    SELECT doc_id, i, h, hash(ls[i + 1:i + h]) AS a, md5(array_to_string(ls[i + 1:i + h], chr(10))) AS b
    FROM (SELECT doc_id, ls, h, unnest(range(len(ls) - h + 1)) AS i
          FROM l, (SELECT unnest(list_transform(range(1, greatest(2, 1 + floor(log2(greatest(1, (SELECT max(len(ls)) FROM l))))::INT)), lambda k: (2 ** k)::BIGINT)) AS h) WHERE len(ls) >= h)
), longest AS (
    SELECT doc_id, max(h) AS longest_run FROM (SELECT doc_id, h, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY h, a, b) AS later FROM deep) WHERE later GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_removed,
       coalesce(longest_run, CASE WHEN len(ls) > coalesce(n, 0) THEN 1 ELSE 0 END)::BIGINT AS longest_run,
       sha256(coalesce(CASE WHEN len(ls) = coalesce(n, 0) THEN l.text ELSE kept.text END, '')) AS kept_sha256
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id LEFT JOIN longest ON l.doc_id = longest.doc_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(({text})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda s, b: {step}), 4294967295)"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_DIGITS = "regexp_replace(regexp_extract(m, '[0-9][0-9 -]*$'), '[^0-9]', '', 'g')"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TOKEN = "list_aggregate(list_transform(range(5, -1, -1), lambda e: substr('{digits}', 1 + ((crc // (62 ** e)::BIGINT) % 62)::INT, 1)), 'string_agg', '')".replace("{digits}", _BASE62)
_SPANS = {
    "assign": (rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    "access": ("AKIA[A-Z0-9]{16,}", "true"),
    "hex": ("[0-9a-f]{24,}", "true"),
    "github": ("gh[pousr]_[A-Za-z0-9]+", "length(m) = 40 AND token = substr(m, 35)"),
    "npm": ("npm_[A-Za-z0-9]+", "length(m) = 40 AND token = substr(m, 35)"),
    "card": (_either_case("card") + r"[^0-9\n]{0,20}[0-9](?:[ -]?[0-9])*", "length(digits) BETWEEN 13 AND 19 AND regexp_replace(digits, substr(digits, 1, 1), '', 'g') <> '' AND luhn % 10 = 0"),
}
_LUHN = "list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT ELSE digits[length(digits) - i]::INT * 2 - CASE WHEN digits[length(digits) - i]::INT > 4 THEN 9 ELSE 0 END END))"

OP11 = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
    {" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM d" for k, (kind, (pattern, _)) in enumerate(_SPANS.items()))}
), spans AS (
    SELECT doc_id, kind, k, ms[j] AS m, (list_sum(list_transform(gs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM found)
), checked AS (
    SELECT *, {_LUHN} AS luhn, {_TOKEN} AS token
    FROM (SELECT *, CASE WHEN kind = 'card' THEN {_DIGITS} END AS digits, CASE WHEN kind IN ('github', 'npm') AND length(m) = 40 THEN {_crc32("substr(m, 5, 30)")} END AS crc FROM spans)
), fit AS (
    SELECT doc_id, kind, k, a, kind || ':' || a || ':' || a + length(m) AS span FROM checked
    WHERE CASE kind {" ".join(f"WHEN '{kind}' THEN {test}" for kind, (_, test) in _SPANS.items())} END
), summed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans
    FROM fit GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (doc_id)
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, levels: int) -> str:
    """CTEs {name}1 ... of the levels over {name}0(grp, p, n, node), {name}_s of the siblings in all of them and {name}root of each group's last node."""
    up = [f"{name}{k + 1} AS (SELECT grp, p // 8 AS p, (max(n) + 7) // 8 AS n, sha256(string_agg(node, '' ORDER BY p)) AS node FROM {name}{k} WHERE n > 1 GROUP BY grp, p // 8)" for k in range(levels)]
    every = " UNION ALL ".join(f"SELECT {k} AS level, grp, p, n, node FROM {name}{k}" for k in range(levels + 1))
    side = "coalesce(string_agg(node, '') OVER (PARTITION BY level, grp, p // 8 ORDER BY p ROWS BETWEEN {}), '')"
    beside = f"{side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after"
    return ", ".join([*up, f"{name}_s AS (SELECT *, {beside} FROM ({every}))", f"{name}root AS (SELECT grp, node FROM {name}_s WHERE n = 1)"])


def _folds(frm: str, table: str, to: str, key: str, levels: int) -> str:
    """CTEs from {frm} to {to}: fold and proof taken through the levels of {table}_s."""
    out, last = [], frm
    for k in range(levels):
        step = f"SELECT x.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.before || x.fold || s.after) ELSE x.fold END AS fold, CASE WHEN s.n > 1 THEN x.proof || s.before || s.after ELSE x.proof END AS proof)"
        name = f"{frm}_{k}" if k < levels - 1 else to
        out.append(f"{name} AS ({step} FROM {last} x LEFT JOIN {table}_s s ON s.level = {k} AND s.grp = x.{key} AND s.p = x.{key}_p // {8**k})")
        last = name
    return ", ".join(out)


OP12 = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf("text")} AS node,
           CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '-')")} % 3 = 0 AND doc_id IS NOT NULL THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
    FROM documents
), a0 AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS p, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), {_tree("a", 7)}, b0 AS (
    SELECT '' AS grp, grp AS of_, node, row_number() OVER (ORDER BY grp) - 1 AS p, count(*) OVER () AS n FROM aroot
), {_tree("b", 4)}, x AS (
    SELECT a0.doc_id, a0.node AS leaf, a0.grp AS low, a0.p AS low_p, b0.node AS subroot, '' AS high, b0.p AS high_p, coalesce(tampered, a0.node) AS fold, '' AS proof
    FROM a0 JOIN b0 ON b0.of_ = a0.grp
), {_folds("x", "a", "y", "low", 7)}, {_folds("y", "b", "z", "high", 4)}
SELECT doc_id, leaf, subroot, broot.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = broot.node AS verified FROM z, broot
"""

_INSERTS = """(VALUES ('', '', 0, '', ''), ('', 'u', 3, 'I', 'user:' || chr(10)), ('', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', 'user:' || chr(10)), ('s', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', 'assistant:' || chr(10)), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', 'user:' || chr(10)))"""

OP13 = f"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), r AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM c WHERE kind <> 0
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS short FROM r
), f AS (
    SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini,
           CASE WHEN short = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(short, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM o
), g AS (
    SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM g GROUP BY conv_id
), ins AS (
    SELECT * FROM {_INSERTS} t(p, q, cost, letters, words)
), acts AS (
    SELECT conv_id, i, q, 'D' AS letter, 4 AS cost, q AS then_, '' AS words FROM f, (VALUES (''), ('s'), ('u'), ('a')) t(q)
    UNION ALL
    SELECT conv_id, i, q, 'K', CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, ini, role || ':' || text || chr(10)
    FROM f JOIN (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) t(q, r) ON ini = r WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT conv_id, i, q, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, r, name || ':' || text || chr(10)
    FROM f, (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) t(q, r, name) WHERE fault NOT IN ('blank', 'duplicate')
), best(conv_id, i, q, b) AS (
    SELECT conv_id, 0::BIGINT, '', {{'cost': 0, 'audit': '', 'words': ''}} FROM facts
    UNION ALL
    SELECT best.conv_id, best.i + 1, acts.then_, min({{'cost': b.cost + ins.cost + acts.cost, 'audit': b.audit || ins.letters || acts.letter, 'words': b.words || ins.words || acts.words}})
    FROM best JOIN ins ON ins.p = best.q JOIN acts ON acts.conv_id IS NOT DISTINCT FROM best.conv_id AND acts.i = best.i + 1 AND acts.q = ins.q
    GROUP BY best.conv_id, best.i, acts.then_
), done AS (
    SELECT facts.conv_id, min({{'cost': b.cost + ins.cost, 'audit': b.audit || ins.letters, 'words': b.words || ins.words}}) AS b
    FROM best JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = facts.n JOIN ins ON ins.p = best.q AND ins.q IN ('', 'a') GROUP BY facts.conv_id
)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.words[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM x.conv_id
"""
