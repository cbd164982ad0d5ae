"""DuckDB SQL of the longer queries, written from the contracts alone."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, Templates

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k AS size, array_to_string(unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i:i + k - 1])), ' ') AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30),
cuts AS (SELECT c.*, unnest(generate_series(1, size - 1)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.f AS l, y.f AS r, (2000000 * cuts.a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:k], ' ') AND x.size = k
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:], ' ') AND y.size = cuts.size - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM c, (SELECT unnest([2, 3]) AS n) nn, (SELECT unnest([1, 2, 3]) AS i) ii WHERE n < size AND i + n - 1 <= size) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _levels(name: str, group: str, count: int) -> str:
    """Nodes of each level of the trees in {name}0 (group, i, h): eight to one while a tree has several."""
    out = []
    for k in range(count):
        out.append(f"""
{name}{k + 1} AS (
  SELECT g, i // 8 AS i, CASE WHEN c = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) GROUP BY g, i // 8, c),
{name}p{k} AS (
  SELECT g, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
         coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi,
         count(*) OVER (PARTITION BY g) > 1 AS up FROM {name}{k}),""")
    return "".join(out)


def _climb(low: int, high: int) -> str:
    """Each leaf's digest as found, proof and tampered digest, level after level."""
    out = []
    for k in range(low + high):
        path, at = (f"ap{k}", f"a.g = p.g AND p.i = a.i // {8**k}") if k < low else (f"bp{k - low}", f"p.i = a.tree // {8 ** (k - low)}")
        out.append(f"""
c{k + 1} AS (SELECT a.* EXCLUDE (proof, now), CASE WHEN up THEN proof || lo || hi ELSE proof END AS proof, CASE WHEN up THEN sha256(lo || now || hi) ELSE now END AS now
  FROM c{k} a JOIN {path} p ON {at}),""")
    return "".join(out)


_LOW, _HIGH = 7, 3  # up to 8^7 rows a lang and 8^3 langs
_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
#: crc32 of a decimal number: each character, then eight divisions by the reversed polynomial 0xEDB88320.
_BITS = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END)"
_CRC = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda a, x: {_BITS}), 4294967295::UBIGINT)"

MERKLE = f"""
WITH leaf AS (
  SELECT doc_id, lang, sha256({_ROW} || {_FIELD.format("text")}) AS h,
         sha256({_ROW} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
         {_CRC} % 3 = 0 AS hit
  FROM documents),
a0 AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS i FROM leaf),
{_levels("a", "g", _LOW)}
b0 AS (SELECT 0 AS g, g AS i, h FROM a{_LOW}),
{_levels("b", "g", _HIGH)}
c0 AS (SELECT doc_id, h AS leaf, g, g AS tree, i, '' AS proof, CASE WHEN hit THEN low ELSE h END AS now FROM a0),
{_climb(_LOW, _HIGH)}
top AS (SELECT h AS root FROM b{_HIGH})
SELECT doc_id, leaf, a{_LOW}.h AS subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM c{_LOW + _HIGH} c JOIN a{_LOW} ON a{_LOW}.g = c.g, top
"""


def _licenses(templates: list[tuple[str, str]], threshold: float) -> str:
    known = Templates(templates, threshold)
    rows = ", ".join(f"({t}, '{label}', {window // 2}, {len(tokens)}, {least}, '{known.vocabulary[x]}')" for t, label, window, tokens, least in known.rows for x in tokens)
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
    return rf"""
WITH tokens(template, label, half, size, least, token) AS (VALUES {rows}),
phrases(label, p) AS (VALUES {phrases}),
docs AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT row, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM docs),
places AS (
  SELECT a.row, p.label, a.i FROM phrases p JOIN words a ON a.word = p.p[1] JOIN words b ON b.row = a.row AND b.i = a.i + 1 AND b.word = p.p[2]
  LEFT JOIN words c ON c.row = a.row AND c.i = a.i + 2 AND c.word = p.p[3] WHERE len(p.p) = 2 OR c.word IS NOT NULL),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row),
held AS (
  SELECT row, template, label, size, least, block, count(DISTINCT token) AS overlap
  FROM (SELECT w.row, t.*, unnest([w.i // t.half, w.i // t.half - 1]) AS block FROM words w JOIN tokens t ON w.word = t.token)
  WHERE block >= 0 GROUP BY ALL HAVING count(DISTINCT token) >= least),
more AS (SELECT row, max(overlap / size) AS share, list(DISTINCT label) AS labels FROM held GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(more.labels, []))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN more USING (row)
"""


LICENSES = _licenses(TEMPLATES, 0.9)
