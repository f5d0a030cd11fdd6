"""DuckDB SQL for the registered queries of this package that SQL can express.

Written as plain definitions over whole tables, not as an execution strategy.
"""

from __future__ import annotations

from ticketspark.llm import divergence, fim, licenses, pii, pstable, quality, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HAS_WORD = r"'[^\x20\x09-\x0D]'"


def quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    lengths = [3, *(n for n, _ in limits.ngram_chars)]
    # the n-gram that starts at a word (null at the end of the text), is it found elsewhere,
    # and is a word inside such a one
    gram = ",\n".join(" || ' ' || ".join(
        ["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))]) + f" AS g{n}" for n in lengths)
    starts = ",\n".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS s{n}" for n in lengths)
    inside = ",\n".join(
        f"bool_or(s{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
        for n in lengths)
    sums = ",\n".join(f"coalesce(sum(length(word)) FILTER (WHERE c{n}), 0) AS n{n}" for n in lengths[1:])
    good = " AND ".join(f"coalesce(n{n}, 0) / greatest(word_chars, 1) <= {most}" for n, most in limits.ngram_chars)
    best = ", ".join(f"coalesce(n{n}, 0) / greatest(word_chars, 1)" for n in lengths[1:])
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
y AS (SELECT r, i, word, {gram} FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, word, {starts} FROM y),
h AS (SELECT r, word, {inside} FROM g),
k AS (SELECT r, sum(length(word)) AS word_chars, count(*) FILTER (WHERE c3) AS n_repeat_words,
  {sums} FROM h GROUP BY r),
l AS (SELECT r, count(*) AS lines, count(DISTINCT line) AS kinds, sum(strlen(line)) AS size,
  sum(first_size) AS kind_size FROM (
    SELECT r, line, CASE WHEN row_number() OVER (PARTITION BY r, line) = 1 THEN strlen(line) ELSE 0 END AS first_size
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_HAS_WORD}))
  GROUP BY r),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines - kinds, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(w) < {limits.min_words} OR 100 * coalesce(n_repeat_words, 0) > {limits.repeat_words_pct} * len(w) AS base_failed,
  greatest({best}) AS dup_ngram_chars, coalesce(size - kind_size, 0) / greatest(coalesce(size, 0), 1) AS dup_line_chars,
  {good} AS few FROM d LEFT JOIN k USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND few AND dup_line_chars <= {limits.line_chars} AS kept,
  dup_ngram_chars, dup_line_chars FROM m"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(
        str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def licenses_sql() -> str:
    """Every place of a key phrase, and there the weight of all the template's words."""
    posts = licenses._postings()
    words = "[" + ", ".join(f"'{w}'" for w in licenses.vocabulary()) + "]"
    base = _values([(p, label, len(p.split())) for p, label in licenses.BASE.items()])
    notices = _values([(t, label, key, len(key.split()), licenses._key_start(notice, key))
                       for t, (label, notice, key) in enumerate(licenses.TEMPLATES)])
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d),
base(phrase, label, n) AS (VALUES {base}),
places AS (SELECT r, i - 1 AS place, label FROM x JOIN base
  ON w[i] = string_split(phrase, ' ')[1] AND array_to_string(w[i:i + n - 1], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
  list(DISTINCT label) AS labels FROM places GROUP BY r),
vocab AS (SELECT unnest({words}) AS word),
held AS (SELECT word, count(DISTINCT r) AS n FROM (SELECT r, unnest(w) AS word FROM d) JOIN vocab USING (word) GROUP BY word),
weights AS (SELECT word, CAST(round({licenses.UNIT} * (ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1)) AS BIGINT) AS weight
  FROM vocab LEFT JOIN held USING (word)),
posts(word, t, q) AS (VALUES {_values(posts)}),
notices(t, label, key, n, skip) AS (VALUES {notices}),
wholes AS (SELECT t, sum(weight) AS whole FROM posts JOIN weights USING (word) GROUP BY t),
spots AS (SELECT r, w, t, label, i - 1 - skip AS spot FROM x JOIN notices
  ON w[i] = string_split(key, ' ')[1] AND array_to_string(w[i:i + n - 1], ' ') = key),
shares AS (SELECT r, t, spot, label, sum(weight) AS weight FROM spots JOIN posts USING (t) JOIN weights USING (word)
  WHERE spot + q >= 0 AND w[spot + q + 1] = word GROUP BY r, t, spot, label),
f AS (SELECT r, list(DISTINCT label) AS labels, max(weight / whole) AS share FROM shares JOIN wholes USING (t)
  WHERE weight / whole >= {licenses.MIN_SHARE} GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN CAST({licenses.BASE_SCORE} AS DOUBLE) ELSE 0 END, coalesce(share, 0)) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)"""


def _matches_sql(kind: int, pattern: str, group: int = 0) -> str:
    """Rows (r, kind, i, gap, m, v): matches of a pattern in each text, what stands before
    each, and a group of each."""
    p = "'" + pattern.replace("'", "''") + "'"
    return (f"SELECT r, {kind} AS kind, unnest(generate_series(1, len(regexp_extract_all(t, {p})) + 1)) AS i, "
            f"unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p})) AS m, "
            f"unnest(regexp_extract_all(t, {p}, {group})) AS v FROM d")


_PLACED = """SELECT r, kind, m, v, place - length(m) AS a, place AS z FROM (
  SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS place FROM k)
  WHERE m IS NOT NULL"""


def secrets_sql() -> str:
    # letters in either case, spelt out: no other letter folds to them
    cue = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                   for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({cue})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    least = {0: secrets.ASSIGN_CHARS, 1: secrets.ACCESS_CHARS, 2: secrets.HEX_CHARS, 3: 20}
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
k AS ({_matches_sql(0, assign, 2)}
  UNION ALL {_matches_sql(1, "AKIA[A-Z0-9]+")} UNION ALL {_matches_sql(2, "[0-9a-f]+")}
  UNION ALL {_matches_sql(3, "[A-Za-z0-9+/_=-]+")}),
placed AS (SELECT * FROM ({_PLACED})
  WHERE length(v) >= CASE kind {" ".join(f"WHEN {k} THEN {n}" for k, n in least.items())} END),
base AS (SELECT * FROM placed WHERE kind < 3),
mixed AS (SELECT * FROM placed WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]')
  AND regexp_matches(v, '[a-z]')),
loose AS (SELECT x.* FROM mixed x WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.r = x.r AND b.a < x.z AND b.z > x.a)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
chars AS (SELECT v, ch, count(*) / length(v) AS p FROM (
  SELECT v, unnest(string_split(v, '')) AS ch FROM (SELECT DISTINCT v FROM every)) GROUP BY v, ch),
bits AS (SELECT v, -sum(p * log2(p)) AS h FROM chars GROUP BY v),
cands AS (SELECT every.* FROM every JOIN bits USING (v) WHERE kind < 3 OR h >= {secrets.GENERIC_ENTROPY}),
owned AS (SELECT DISTINCT v, coalesce('=' || source, '') AS owner, doc_id FROM cands JOIN d USING (r)),
owners AS (SELECT v, count(DISTINCT owner) AS n, count(*) AS repos FROM owned GROUP BY v),
wide AS (SELECT greatest({secrets.EXAMPLE_OWNERS}, 1 + ceil(log2(greatest(count(DISTINCT coalesce('=' || source, '')), 1)))) AS least FROM d),
judged AS (SELECT c.*, {names}[kind + 1] || ':' || a || ':' || z AS span, CASE
  WHEN n >= least OR repos >= {secrets.EXAMPLE_REPOS} * n THEN 'example' WHEN h >= {secrets.LIVE_ENTROPY} THEN 'live' ELSE 'weak' END AS verdict
  FROM cands c JOIN owners USING (v) JOIN bits USING (v), wide),
f AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS k0, count(*) FILTER (WHERE kind = 1) AS k1,
  count(*) FILTER (WHERE kind = 2) AS k2, string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base,
  string_agg(span, ',' ORDER BY a, kind) AS spans, count(*) FILTER (WHERE verdict = 'live') AS live,
  count(*) FILTER (WHERE verdict = 'example') AS example
  FROM judged WHERE kind < 3 OR verdict = 'live' GROUP BY r)
SELECT doc_id, coalesce(k0, 0) AS n_assign, coalesce(k1, 0) AS n_access, coalesce(k2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example FROM d LEFT JOIN f USING (r)"""


# The plain patterns of personal data, by the order of their kinds.
_PERSONAL = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def pii_sql() -> str:
    found = " UNION ALL ".join(_matches_sql(k, p) for k, p in enumerate(_PERSONAL))
    names = "[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "]"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS k{k}" for k in range(5))
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({found}),
digits AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM ({_PLACED})),
b AS (SELECT * FROM digits WHERE CASE kind WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3
    OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0
  WHEN 2 THEN len(n) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, len(n)), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(n[len(n) + 1 - i] AS INTEGER) WHEN CAST(n[len(n) + 1 - i] AS INTEGER) > 4
    THEN 2 * CAST(n[len(n) + 1 - i] AS INTEGER) - 9 ELSE 2 * CAST(n[len(n) + 1 - i] AS INTEGER) END)) % 10 = 0
  ELSE len(n) BETWEEN 9 AND 15 END),
entity_of AS (SELECT DISTINCT r, CAST(kind AS VARCHAR) || ':' || CASE kind WHEN 0 THEN lower(v) ELSE n END AS entity FROM b),
pieces AS (SELECT r, t, unnest(generate_series(1, len(regexp_extract_all(t, '\p{{L}}{{3,}}')) + 1)) AS i,
  unnest(string_split_regex(t, '\p{{L}}{{3,}}')) AS gap, unnest(regexp_extract_all(t, '\p{{L}}{{3,}}')) AS m
  FROM d WHERE r IN (SELECT r FROM b)),
runs AS (SELECT r, t, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS z FROM pieces),
terms AS (SELECT r, t, lower(m) AS term, z - length(m) AS a, z FROM runs WHERE m IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = runs.r AND b.a < runs.z AND b.z > runs.z - length(runs.m))),
pairs AS (SELECT entity, term, count(DISTINCT r) AS n_pair, count(DISTINCT t) AS texts
  FROM entity_of JOIN terms USING (r) GROUP BY ALL),
entities AS (SELECT entity, count(DISTINCT r) AS n_entity FROM entity_of GROUP BY entity),
corpus AS (SELECT term, count(DISTINCT r) AS n_term FROM (
  SELECT r, lower(unnest(regexp_extract_all(t, '\p{{L}}{{3,}}'))) AS term FROM d) GROUP BY term),
total AS (SELECT count(*) AS n FROM d),
told_by AS (SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN corpus USING (term), total
  WHERE texts >= {pii.SUPPORT} AND n > n_entity
  AND ln(n_pair * n / (n_term * n_entity)) / ln(n / n_entity) >= {pii.DISCLOSURE}),
spans AS (SELECT r, a, kind, z FROM b
  UNION ALL SELECT DISTINCT r, a, 4, z FROM terms JOIN entity_of USING (r) JOIN told_by USING (entity, term)),
f AS (SELECT r, {counts},
  string_agg({names}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (WHERE kind < 4) AS base,
  string_agg({names}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(k0, 0) AS n_email, coalesce(k1, 0) AS n_ip, coalesce(k2, 0) AS n_card,
  coalesce(k3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(k4, 0) AS n_term FROM d LEFT JOIN f USING (r)"""


def vector_duplicates_sql() -> str:
    """All pairs of a label, compared; what is reachable by recursion."""
    return rf"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN label IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS (SELECT a.r AS r, b.r AS s FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= {pstable.COSINE}),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.s FROM reach JOIN links ON reach.s = links.r),
sets AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.s = v.r GROUP BY reach.r),
degree AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN sets USING (r) LEFT JOIN degree USING (r)"""


def divergence_sql() -> str:
    """Every source's share of every kept term, zero occurrences included."""
    unit, smooth = divergence.UNIT, divergence.SMOOTH
    share = f"1 + ({unit}::HUGEINT * (%s + {smooth})) // (%s + {smooth} * terms)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
vocab AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
every AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
every_n AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
q AS (SELECT lang, term, {share % ("n", "total")} AS q FROM every_n JOIN every USING (lang) JOIN vocab USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {share % ("coalesce(n, 0)", "coalesce(total, 0)")} AS p
  FROM groups g JOIN kept k USING (lang) JOIN vocab USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN n USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z
WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def fim_sql() -> str:
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    h = ", ".join(f"CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, n, {h} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
  WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {fim.PLAIN_FROM} THEN 'plain'
  WHEN h4 % 100 < {fim.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE WHEN a = 0 THEN '' ELSE substring(t, 1, a) END AS prefix,
  CASE WHEN a = b THEN '' ELSE substring(t, a + 1, b - a) END AS middle,
  CASE WHEN b = n THEN '' ELSE substring(t, b + 1, n - b) END AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
    ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM o"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": quality_sql(), "op5_licenses": licenses_sql(), "op7_pii": pii_sql(),
            "op10_secrets": secrets_sql(), "op11_vector_duplicates": vector_duplicates_sql(),
            "op12_divergence": divergence_sql(), "op13_fim": fim_sql()}
