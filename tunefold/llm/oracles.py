"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""
from __future__ import annotations

from . import mixing, pii, sharding


def draw(seed: str, *parts: str, digits: int = 13) -> str:
    text = " || '|' || ".join([f"'{seed}'", *parts])
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def tree(layout: sharding.Layout, seed: str, key: str) -> str:
    """Shard by the draws of the tree: argmin per level, as nested CASEs over the generations and nodes."""
    def below(level: int, parent: tuple[int, int] | None) -> str:
        nodes = sorted(layout.children(level, parent).items())
        leaf = lambda g, n: str(n) if level == 2 else below(level + 1, (g, n))
        if len(nodes) == 1:
            return leaf(*nodes[0][0])
        u = [f"-ln(({draw(seed, repr(sharding.LEVELS[level]), repr(str(g)), repr(str(n)), key)} + 0.5) / 4503599627370496.0) / {w}" for (g, n), w in nodes]
        arms = " ".join(f"WHEN {i} THEN {leaf(g, n)}" for i, ((g, n), _) in enumerate(nodes, 1))
        return f"(CASE list_position([{', '.join(u)}], list_min([{', '.join(u)}])) {arms} END)"
    return f"CAST({below(0, None)} AS INTEGER)"


OP1 = f"""
WITH t AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS step),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, key, size, list_transform(range(1, size - 7), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, {tree(sharding.Layout.of(24), 's', 'key')} AS shard, {tree(sharding.Layout.of(25), 's', 'key')} AS grown_shard, {draw('s', "'slice'", 'key', digits=12)} % 1024 AS slice FROM c)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

OP3 = """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM e
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
w(a, c) AS (SELECT r, vec_id FROM v UNION SELECT l.b, w.c FROM w JOIN l ON w.a = l.a),
k AS (SELECT a, min(c) AS c FROM w GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(k.c, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(k.c, e.vec_id), true) AS kept
FROM e LEFT JOIN k ON k.a = e.r LEFT JOIN n ON n.a = e.r
"""

#: The base patterns as they are defined, and the further kinds, in the order of the output; of iban only how a code begins.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
            "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}


def op5() -> str:
    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    for rank, (k, p) in enumerate(PATTERNS.items()):
        ctes.append(f"{k}_m AS (SELECT r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d)")
        ctes.append(f"""{k}_u AS (SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'at': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            'm': m[i], 'before': g[i], 'after': g[i + 1]}})) AS s FROM {k}_m WHERE len(m) > 0)""")
    sizes = " ".join(f"WHEN left(tail, 2) IN ({', '.join(repr(c) for c in cs.split())}) THEN {n}" for n, cs in pii.LENGTHS.items())
    code_of = "'^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])"
    # where a code begins: its country's length if a word ends there, else the longest run; then from left to right without overlap
    ctes += ["iban_q AS (SELECT r, s.at::BIGINT AS pos, substr(t, s.at::BIGINT + 1, 80) AS tail FROM iban_u JOIN d USING (r))",
             f"iban_e AS (SELECT *, regexp_extract(tail, {code_of}{{' || (CASE {sizes} ELSE 99 END - 4) || '}}') AS exact, regexp_extract(tail, {code_of}{{11,30}}') AS longest FROM iban_q)",
             "iban_x AS (SELECT r, pos, row_number() OVER (PARTITION BY r ORDER BY pos) AS k, CASE WHEN exact <> '' AND NOT regexp_matches(substr(tail, length(exact) + 1, 1), '[A-Za-z0-9-]') THEN exact ELSE longest END AS m FROM iban_e)",
             """iban_k(r, k, pos, m, done) AS (SELECT r, 0::BIGINT, -1::BIGINT, '', 0::BIGINT FROM iban_x WHERE k = 1 UNION ALL
            SELECT x.r, x.k, x.pos, CASE WHEN x.pos >= c.done THEN x.m ELSE '' END, CASE WHEN x.pos >= c.done THEN greatest(c.done, x.pos + length(x.m)) ELSE c.done END FROM iban_k c JOIN iban_x x ON x.r = c.r AND x.k = c.k + 1)""",
             "iban_n AS (SELECT *, coalesce(lag(pos + length(m)) OVER w, 0) AS was, coalesce(lead(pos) OVER w, 1::BIGINT << 31) AS next FROM iban_k WHERE m <> '' WINDOW w AS (PARTITION BY r ORDER BY pos))",
             """iban_v AS (SELECT r, {'at': pos, 'm': m, 'before': substr(t, was + 1, pos - was), 'after': substr(t, pos + length(m) + 1, next - pos - length(m))} AS s FROM iban_n JOIN d USING (r))"""]
    digits = "regexp_replace(s.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (reverse({digits})[i])::INT ELSE (reverse({digits})[i])::INT * 2 % 10 + (reverse({digits})[i])::INT // 5 END)) % 10 = 0"
    code = "replace(s.m, ' ', '')"
    turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii({turned}[i])::INT)), lambda a, x: CASE WHEN x < 58 THEN (a * 10 + x - 48) % 97 ELSE (a * 100 + x - 55) % 97 END) = 1"
    alone = "NOT regexp_matches(s.before, '[A-Za-z0-9-]$') AND NOT regexp_matches(s.after, '^[A-Za-z0-9-]')"
    near = "lower(right(s.before, 32) || ' ' || left(s.after, 32))"
    words = {k.name: k for k in pii.KINDS}
    score = lambda k: f"{words[k].start} + CASE WHEN regexp_matches({near}, '\\b(?:{words[k].words})') THEN 0.3 ELSE 0.0 END - CASE WHEN regexp_matches({near}, '\\b(?:{words[k].against})') THEN 0.2 ELSE 0.0 END >= {pii.SURE}"
    rules = {"email": "true", "ip": "len(list_filter(string_split(s.m, '.'), lambda x: x::HUGEINT > 255)) = 0", "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
             "iban": f"{alone} AND length({code}) BETWEEN 15 AND 34 AND {mod97} AND {score('iban')}", "ssn": f"{alone} AND NOT regexp_matches(s.m, '^(000|666|9)|-00-|-0000$') AND {score('ssn')}"}
    parts = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {i} AS rank, s.at AS a, s.at + length(s.m) AS b FROM {'iban_v' if k == 'iban' else k + '_u'} WHERE {rules[k]}" for i, k in enumerate(PATTERNS))
    ctes.append(f"f AS ({parts})")
    ctes.append("j AS (SELECT r, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p, "
                "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM f GROUP BY r)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)"


def op7(weights: dict, share: float, epochs: int) -> str:
    def weight(level: str) -> str:
        arms = " ".join(f"WHEN {level} = '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.get(level, {}).items())
        return f"CASE {arms} ELSE 1.0::DOUBLE END" if arms else "1.0::DOUBLE"

    ctes = [f"""d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'family' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4) ELSE 'other' END AS domain,
        coalesce(lang, '{mixing.MISSING}') AS lang, coalesce(source, '{mixing.MISSING}') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens, count(*) AS n_rows FROM documents GROUP BY ALL)""",
            f"l AS (SELECT domain, lang, source, sum(n_tokens * n_rows)::BIGINT AS tokens, tokens * {float(epochs)}::DOUBLE AS cap FROM d GROUP BY ALL)",
            f"b0 AS (SELECT floor(sum(cap) / {epochs} * {share})::DOUBLE AS budget FROM l)"]
    levels = mixing.LEVELS
    for i, child in enumerate(levels, 1):
        keys, parent = ", ".join(levels[:i]), ", ".join(levels[: i - 1])
        part = f"PARTITION BY {parent} " if parent else ""
        using = f"JOIN b{i - 1} USING ({parent})" if parent else f"CROSS JOIN b{i - 1}"
        before = f"OVER ({part}ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ctes.append(f"n{i} AS (SELECT *, {weight(child)} AS weight FROM (SELECT {keys}, sum(cap) AS cap FROM l GROUP BY ALL) {using})")
        ctes.append(f"f{i} AS (SELECT *, cap * (sum(weight) OVER ({part}) - coalesce(sum(weight) {before}, 0)) <= weight * (budget - coalesce(sum(cap) {before}, 0)) AS is_full FROM n{i} WHERE weight > 0)")
        ctes.append(f"b{i} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0)) / sum(weight) FILTER (NOT is_full) OVER ({part}) END AS budget FROM f{i})")
    ctes += [f"p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(floor(budget) / tokens)::BIGINT ELSE 1 END AS whole, floor(budget)::BIGINT - whole * tokens AS rest FROM l JOIN b3 USING (domain, lang, source))",
             "o AS (SELECT *, md5('0|' || whole || '|' || coalesce(doc_id::VARCHAR, 'null') || '|' || digest) AS h FROM d JOIN p USING (domain, lang, source))",
             "c AS (SELECT *, rest - coalesce(sum(n_tokens * n_rows) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM o)"]
    more = "CASE WHEN room <= 0 THEN 0 WHEN n_tokens = 0 THEN n_rows ELSE least(n_rows, ceil(room / n_tokens)::BIGINT) END"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, digest, domain, lang, source, n_tokens, n_rows, (whole * n_rows + {more})::BIGINT AS taken FROM c WHERE whole * n_rows + {more} > 0"


OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(t)) AS n, sha1(t) AS h FROM pages),
d AS (SELECT page_id, n, {' || '.join(f"{BASE32}[(('0x' || substr(h, {10 * part + 1}, 10))::BIGINT >> {35 - 5 * i} & 31) + 1]" for part in range(4) for i in range(8))} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS w FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
v AS (SELECT w, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY w, n),
s AS (SELECT item_id, doc_id, sum(times * weight * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * len(t) * n // l))))::BIGINT AS score FROM q JOIN p USING (w) JOIN v USING (w) JOIN d USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def op11() -> str:
    """Faults, then the cheapest edits row by row: per state the least `cost || letters`, with costs of nine digits."""
    add = lambda x, c, letter: f"(lpad((left({x}, 9)::INT + {c})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}')"
    closed = lambda n0, n1, n2, n3: f"least({n2}, {add(n0, 5, 'I')}, {add(n1, 5, 'I')}, {add(n3, 5, 'I')})"
    from_any = "least(b0, b1, b3)"
    return f"""
WITH RECURSIVE t AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS step),
c AS (SELECT conv_id, turn, coalesce('v' || conv_id, 'null') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(named) + 1), lambda i: ascii(named[i])::BIGINT)), lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS fault FROM c, t),
x AS (SELECT key, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM x),
s AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS bad,
    i > 1 AND lag(initial) OVER (PARTITION BY key ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM o),
y AS (SELECT *, bad IN ('blank', 'duplicate') AS gone, CASE WHEN bad = 'truncated' THEN 5 ELSE 0 END AS p FROM s),
n AS (SELECT key, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bad = 'blank') AS blank, count(*) FILTER (bad = 'duplicate') AS duplicate,
    count(*) FILTER (bad = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM y GROUP BY key),
w(key, i, b0, b1, b2, b3) AS (SELECT key, 0::BIGINT, '000000000', NULL::VARCHAR, '000000005I', '000000010II' FROM n UNION ALL
    SELECT key, i, n0, n1, m2, least(n3, {add('m2', 5, 'I')}) FROM (SELECT *, {closed('n0', 'n1', 'n2', 'n3')} AS m2 FROM (SELECT w.key, y.i, {add('b0', 2, 'D')} AS n0,
        least({add('b1', 2, 'D')}, CASE WHEN NOT gone AND initial = 's' THEN {add('b0', 'p', 'K')} END) AS n1,
        least({add('b2', 2, 'D')}, CASE WHEN NOT gone THEN {add(from_any, 'p + 1', 'R')} END, CASE WHEN NOT gone AND initial = 'u' THEN {add(from_any, 'p', 'K')} END) AS n2,
        least({add('b3', 2, 'D')}, CASE WHEN NOT gone THEN {add('b2', 'p + 1', 'R')} END, CASE WHEN NOT gone AND initial = 'a' THEN {add('b2', 'p', 'K')} END) AS n3
        FROM w JOIN y ON y.key = w.key AND y.i = w.i + 1))),
z AS (SELECT w.key, left(least(b0, b3), 9)::BIGINT AS cost, substr(least(b0, b3), 10) AS audit FROM w JOIN n ON n.key = w.key AND n.n = w.i),
l AS (SELECT key, j, audit[j] AS letter FROM (SELECT key, audit, unnest(range(1, length(audit) + 1)) AS j FROM z)),
k AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY key ORDER BY j) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY key ORDER BY j) AS place FROM l),
h AS (SELECT k.key, k.j, k.letter, k.place, y.role, y.text, max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.key) AS first FROM k LEFT JOIN y ON y.key = k.key AND y.i = k.i),
r AS (SELECT key, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - first) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM h WHERE letter <> 'D' GROUP BY key),
d AS (SELECT DISTINCT conv_id, key FROM c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256 FROM d LEFT JOIN n USING (key) LEFT JOIN z USING (key) LEFT JOIN r USING (key)
"""
