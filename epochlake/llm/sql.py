"""DuckDB statements that say the same as the queries of this subpackage."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, ''))) AS place
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_index,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM src),
leveled AS (
  SELECT *, (budget - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
         2 * source_size / weight::DOUBLE AS bound_ratio
  FROM ranked
  WINDOW before AS (ORDER BY 2 * source_size / weight::DOUBLE, source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cutoff AS (SELECT arg_min(level, (bound_ratio, source_index)) AS level FROM leveled WHERE bound_ratio > level),
targets AS (
  SELECT source, source_size, source_index, weight, budget,
         CASE WHEN c.level IS NULL OR bound_ratio <= c.level THEN (2 * source_size)::DOUBLE ELSE c.level * weight END AS target
  FROM leveled, cutoff c),
copies AS (
  SELECT s.doc_id, s.source, s.size, s.place, t.source_index, t.budget, c.copy,
         (c.copy * t.source_size + sum(s.size) OVER (PARTITION BY t.source_index, c.copy ORDER BY s.place, s.doc_id)) / t.weight::DOUBLE AS finish
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) c(copy)),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_index, copy, place, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, source, sum(size) FILTER (WHERE total <= budget) AS taken FROM ordered GROUP BY doc_id, source)
SELECT s.doc_id, s.size, s.source, t.source_size::BIGINT AS source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s
JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
JOIN taken k ON s.doc_id IS NOT DISTINCT FROM k.doc_id AND s.source IS NOT DISTINCT FROM k.source
"""


def quality(common_words: dict[str, list[str]], max_chars: float, max_words: float, min_chars: int, min_words: int) -> str:
    """The quality rules; the tables of words and the limits are those of the operator."""
    every = sorted({w for ws in common_words.values() for w in ws})
    by_lang = lambda of: "CASE lang " + " ".join(f"WHEN '{k}' THEN {of(ws)}" for k, ws in common_words.items()) + f" ELSE {of(every)} END"
    listed = by_lang(lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]")
    # RE2 has no look-ahead: a mark after each word lets neighbours share one space
    pattern = by_lang(lambda ws: f"'^({'|'.join(ws)})([.,;:!?]|$)'")
    bins = lambda h, n, c: ", ".join(f"sum(coalesce({h}[{i + 1}], 0))::DOUBLE AS {c}{i}" for i in range(n))
    arr = lambda n, c: "[" + ", ".join(f"{c}{i}" for i in range(n)) + "]"
    n_chars, n_words = 6, len(every) + 1
    js = lambda a, b: f"sqrt(greatest(0, list_sum([CASE WHEN x.p > 0 THEN x.p * log2(2 * x.p / (x.p + x.q)) ELSE 0 END / 2 + CASE WHEN x.q > 0 THEN x.q * log2(2 * x.q / (x.p + x.q)) ELSE 0 END / 2 for x in [{{'p': coalesce({a}[i], 0) / list_sum({a})::DOUBLE, 'q': coalesce({b}[i], 0) / list_sum({b})}} for i in range(1, len({b}) + 1)]])))"
    far = f"(list_sum(r_chars) > 0 AND ((list_sum(chars) >= {min_chars} AND {js('chars', 'r_chars')} > {max_chars}) OR (n_words >= {min_words} AND {js('words', 'r_words')} > {max_words})))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
grams AS (
  SELECT rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) > 5)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
hits AS (SELECT rid, lang, w, {listed} AS listed, [regexp_extract(lower(x), {pattern}, 1) for x in w] AS h FROM split),
stats AS (
  SELECT s.rid, doc_id, lang, len(s.w)::BIGINT AS n_words, length(array_to_string(s.w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    [length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')), length(regexp_replace(text, '[^\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]', '', 'g')),
     length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[^.,;:?''"()-]', '', 'g')),
     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')),
     length(regexp_replace(text, '[\p{{Nd}}\p{{Lu}}\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\x20\x09-\x0D.,;:?''"()#*$%&|<>-]', '', 'g'))] AS chars
  FROM split s LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
worded AS (
  SELECT s.*, list_append([len(list_filter(h.h, lambda y: y = x)) for x in h.listed], s.n_words - len(list_filter(h.h, lambda y: y <> ''))) AS words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM stats s JOIN hits h USING (rid)),
first AS (SELECT lang AS r_lang, {arr(n_chars, 'c')} AS r_chars, {arr(n_words, 'w')} AS r_words FROM (
  SELECT lang, {bins('chars', n_chars, 'c')}, {bins('words', n_words, 'w')} FROM worded WHERE NOT base_failed GROUP BY lang)),
refs AS (SELECT lang AS r_lang, {arr(n_chars, 'c')} AS r_chars, {arr(n_words, 'w')} AS r_words FROM (
  SELECT lang, {bins('chars', n_chars, 'c')}, {bins('words', n_words, 'w')} FROM worded JOIN first ON lang IS NOT DISTINCT FROM r_lang
  WHERE NOT base_failed AND NOT {far} GROUP BY lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({far}, false) AS kept
FROM worded LEFT JOIN refs ON lang IS NOT DISTINCT FROM r_lang
"""


TOP_K = r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: SHA-1 in base32: each letter is five bits, which lie in two hexadecimal digits.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT payload, max(page_id) AS latest FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((16 * (strpos('0123456789abcdef', hex[5 * i // 4 + 1]) - 1) + strpos('0123456789abcdef', hex[5 * i // 4 + 2]) - 1) >> (3 - 5 * i % 4)) % 32, 1) for i in range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN latest IS NULL OR page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM p JOIN m USING (payload)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5
    UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid)
  JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM reached r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM d JOIN named USING (rid) LEFT JOIN n USING (rid)
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebooks by rounds of means and the codes under them, for vectors of one length that the parts divide, with an id each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT vec_id, x.part, entry, sum((v - c) * (v - c))::BIGINT AS d FROM x JOIN b{r} b ON x.part = b.part AND x.k = b.k GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT x.part, a.entry, x.k, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry AND b.k = m.k)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) // {parts} AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // size AS part, (i - 1) % size AS k, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT vec_id, size, embedding, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, k, v AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id)),
{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, k)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


SUFFIX_DEDUP = r"""
WITH t AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, b[p + 1 : p + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, greatest(n - 49, 0))) AS p FROM t)),
firsts AS MATERIALIZED (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT doc_id, p FROM w JOIN firsts USING (s) WHERE doc_id > first_id),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS starts FROM lost),
numbered AS (SELECT doc_id, p, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY doc_id, run),
sides AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
pieces AS (
  SELECT doc_id, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS head, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last
  FROM sides JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN last IS NULL THEN b ELSE unhex(head || hex(b[last + 1 : n])) END) AS kept_sha256
FROM t LEFT JOIN pieces USING (doc_id)
"""
