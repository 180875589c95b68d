"""DuckDB SQL for the operators whose whole result SQL can express, by the definitions and without the methods.

The rest has none: BPE ids, the packing and the files of ids depend on merges,
main text and quality on fitted trees.
"""

from __future__ import annotations

from quern.llm import personal

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Of (id, c) in edges (a, b): the least id that each reaches.
_REACH = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY 1), degree AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY 1)"""

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS l FROM documents), nodes AS (SELECT id FROM w),
grams AS (SELECT DISTINCT id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1), shared AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
edges AS (SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 5 * k >= 4 * (p.n + q.n - k)), {_REACH}
SELECT id AS doc_id, c AS class_id, coalesce(n, 0) AS n_links, id = c AS kept, 1.0::DOUBLE AS audited_recall FROM least LEFT JOIN degree USING (id)"""

OP2 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, 512 * q AS lo, substr(x, 1024 * q + 1, 1122) AS y FROM (SELECT doc_id, x, unnest(range((length(x) // 2 + 511) // 512)) AS q FROM h)),
win AS (SELECT doc_id, lo + k AS p, substr(y, 2 * k + 1, 100) AS s FROM (SELECT doc_id, lo, y, unnest(range(least(512, length(y) // 2 - 49))) AS k FROM part WHERE length(y) >= 100)),
low AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), hit AS (SELECT doc_id, p FROM win JOIN low USING (s) WHERE lo < doc_id),
bytes AS (SELECT doc_id, lo + k AS p, substr(y, 2 * k + 1, 2) AS byte FROM (SELECT doc_id, lo, y, unnest(range(least(512, length(y) // 2))) AS k FROM part)),
near AS (SELECT b.doc_id, b.p, b.byte, coalesce(max(hit.p) OVER (PARTITION BY b.doc_id ORDER BY b.p) >= b.p - 49, false) AS gone FROM bytes b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.p),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM near),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM runs GROUP BY 1)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN sums USING (doc_id)"""

OP9 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents), starts AS (SELECT doc_id, unnest(range(1, len(l) - 11)) AS p, l FROM w WHERE len(l) >= 13),
win AS (SELECT doc_id, p, array_to_string(l[p:p + 12], ' ') AS s FROM starts), low AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, p FROM win JOIN low USING (s) WHERE lo < doc_id), each AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w),
near AS (SELECT e.doc_id, e.p, e.word, coalesce(max(hit.p) OVER (PARTITION BY e.doc_id ORDER BY e.p) >= e.p - 12, false) AS gone FROM each e LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.p = e.p),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM near GROUP BY 1)
SELECT doc_id, len(l) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums USING (doc_id)"""

OP10 = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
edges AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.id <> q.id WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.98), {_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, id = c AS kept, 1.0::DOUBLE AS audited_recall FROM least LEFT JOIN degree USING (id)"""

#: Draws and slots by the MD5 they are defined with; the checksum by its table.
OP8 = """WITH t AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, k, length(x) // 2 + 16 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, t),
draws AS (SELECT k, s, -ln((('0x' || left(md5(k || ':' || s), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS draw FROM (SELECT DISTINCT k FROM d), range(41) r(s)),
best AS (SELECT k, arg_min(s, draw) FILTER (s < 40) AS shard, arg_min(s, draw) AS grown_shard FROM draws GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || left(md5('slot:' || k || ':' || text_crc32), 13))::BIGINT % 64, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM b JOIN best USING (k)"""


def _op11() -> str:
    """Plain patterns; places from the lengths of matches and of what stands between."""
    digits = "regexp_replace({x}, '[^0-9]', '', 'g')"
    luhn = lambda x: f"list_sum(list_transform(range(length({x})), lambda j: CASE WHEN j % 2 = 0 THEN substr({x}, length({x}) - j, 1)::INT ELSE (2 * substr({x}, length({x}) - j, 1)::INT) // 10 + (2 * substr({x}, length({x}) - j, 1)::INT) % 10 END)) % 10 = 0"
    part = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    sizes = "map {" + ", ".join(f"'{k}': {v}" for k, v in personal.IBAN_SIZES.items()) + "}"
    d = digits.format(x="x")
    mod = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(v, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1"
    card = r"[0-9]([\x20-]?[0-9])+"
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(x, '{part}\.{part}\.{part}\.{part}')"),
        "card": (card, f"length({d}) BETWEEN 16 AND 19 AND {luhn(d)}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({d}) BETWEEN 8 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", f"v <> '' AND {mod} AND NOT regexp_matches(o, '[A-Za-z0-9+]$')"),
        "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(o, '[A-Za-z0-9+-]$') AND NOT regexp_matches(z, '^[0-9-]') AND NOT regexp_matches(x, '^(000|666|9)|-00-|-0000$')"),
        "card_short": (card, f"length({d}) BETWEEN 13 AND 15 AND {luhn(d)} AND NOT regexp_matches(o, '[A-Za-z0-9+]$')"),
    }
    near = lambda words: f"(regexp_matches(lower(o), '(^|[^a-z])({words})([^a-z]|$)') OR regexp_matches(lower(left(z, {personal.AFTER})), '(^|[^a-z])({words})([^a-z]|$)'))"
    rows = []
    for k, kind in enumerate(personal.KINDS):
        pattern, sound = plain[kind.name]
        score = f"{kind.score} + CASE WHEN {near(kind.near)} THEN {personal.MORE} ELSE 0 END - CASE WHEN {near(personal.AGAINST)} THEN {personal.LESS} ELSE 0 END >= {personal.LEAST}"
        # The country's size is not a constant of the pattern, so the longest cut that has it is looked for among all.
        value = f"coalesce(list_filter(list_transform(range(15, 43), lambda j: left(x, j)), lambda y: length(replace(y, ' ', '')) = {sizes}[left(x, 2)] AND y[-1] <> ' ' AND (length(y) = length(x) OR substr(x, length(y) + 1, 1) = ' '))[1], '')" if kind.cut else "x"
        rows.append(
            f"SELECT doc_id, {k} AS k, '{kind.name}' AS kind, pos, v, {'true' if kind.base else 'false'} AS base FROM (SELECT *, {value} AS v FROM (SELECT doc_id, m[i] AS x, right(s[i], {personal.BEFORE}) AS o, s[i + 1] AS z, "
            f"coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) + list_sum(list_transform(s[1:i], lambda y: length(y))) AS pos FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM "
            f"(SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS s FROM d) WHERE len(m) > 0))) WHERE {sound}" + ("" if kind.base else f" AND {score}")
        )
    count = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in personal.BASE)
    place = "kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + length(v) AS BIGINT)"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(rows)}), g AS (SELECT doc_id, {count}, string_agg({place}, ',' ORDER BY k, pos) FILTER (base) AS b, string_agg({place}, ',' ORDER BY k, pos) AS a FROM f GROUP BY 1) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in personal.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )


OP12 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) r(k) WHERE len(w) >= k)) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, g, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y, f AS a FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scores AS (SELECT c.lang, c.g, a, j, p.f AS l, q.f AS r, CAST(1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f) AS BIGINT) AS score FROM cuts c JOIN f p ON p.lang = c.lang AND p.g = x JOIN f q ON q.lang = c.lang AND q.g = y),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_of AS (SELECT lang, array_to_string(w[1:2], ' ') AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE k = 3),
longer AS (SELECT lang, g, max(f) AS m FROM inner_of GROUP BY 1, 2)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.g)) AS rank, s.g AS phrase, a, l, r, n, score FROM least s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g JOIN total t ON t.lang = s.lang
WHERE 100 * coalesce(m, 0) < 50 * a QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.g)) <= 2000"""

OP13 = r"""WITH t AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
v AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, l, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM v, t),
b AS (SELECT a.conv_id, list_concat(coalesce(f.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM h a LEFT JOIN h f ON f.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT conv_id, len(l) AS n, l[1:d] AS k, d FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM b)),
g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM m GROUP BY 1, 2),
up AS (SELECT c.k, c.d, c.conv_id, c.n_convs, c.ends, p.conv_id AS parent FROM g c LEFT JOIN g p ON p.d = c.d - 1 AND p.k = c.k[1:c.d - 1]),
ch AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT up.*, coalesce(n, 0) AS n_children, CASE WHEN up.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(up.k[up.d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM up LEFT JOIN ch ON ch.d = up.d AND ch.k = up.k),
sums AS (SELECT k[1:j] AS k, j AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM own) GROUP BY 1, 2)
SELECT conv_id, own.d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM own JOIN sums ON sums.d = own.d AND sums.k = own.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op2_suffix_array": OP2, "op8_sharding": OP8, "op9_substring": OP9, "op10_vector_graph": OP10, "op11_personal_data": _op11(), "op12_collocations": OP12, "op13_prefix_trie": OP13}
