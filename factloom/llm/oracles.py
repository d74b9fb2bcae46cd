"""DuckDB SQL that the queries of this subpackage must equal, where SQL can say what they compute."""

from __future__ import annotations

from factloom.llm import base, centroids, licenses, tokens
from factloom.llm.pieces import PieceModel
from factloom.llm.pii import DOUBT, RESIDUAL, SHINGLE

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM places),
starts AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
hits AS (SELECT rid, i, m, item FROM (SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM starts) JOIN windows USING (m, phrase)),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM hits) GROUP BY rid),
found AS (SELECT rid, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

OP6 = r"""
WITH RECURSIVE classes AS (SELECT coalesce(text, '') AS t, min(doc_id) AS class_id, count(*) AS copies, row_number() OVER () AS c FROM documents GROUP BY 1),
words AS (SELECT c, w, least(5, len(w)) AS k FROM (SELECT c, regexp_extract_all(lower(t), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM classes) WHERE len(w) > 0),
shingles AS (SELECT DISTINCT c, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT c, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words)),
sizes AS (SELECT c, count(*) AS n FROM shingles GROUP BY c),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.c <> b.c GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b WHERE 5 * common.n >= 4 * (x.n + y.n - common.n)),
reach AS (SELECT c, c AS other FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.other),
groups AS (SELECT reach.c, min(o.class_id) AS group_id FROM reach JOIN classes o ON o.c = reach.other GROUP BY 1),
counts AS (SELECT a AS c, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, CAST(copies AS BIGINT) AS copies, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, group_id
FROM documents JOIN classes ON coalesce(text, '') = t JOIN groups USING (c) LEFT JOIN counts USING (c)
"""


def _quoted(pieces: list[str]) -> str:
    return "'" + " ".join(pieces).replace("'", "''") + "'"


def op7(model_path: str) -> str:
    """Longest match from the left, word by word; the vocabulary comes from the tokenizer's own file."""
    with open(model_path, "rb") as f:
        start, inner = tokens.vocabulary(f.read())
    longest = max(map(len, [*start, *inner]))
    return rf"""
WITH RECURSIVE vocabulary AS (SELECT true AS head, unnest(string_split({_quoted(start)}, ' ')) AS piece UNION ALL SELECT false, unnest(string_split({_quoted(inner)}, ' '))),
docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\p{{Z}}]'), []) AS w FROM documents),
words AS (SELECT rid, word, count(*) AS times FROM (SELECT rid, unnest(w) AS word FROM docs) GROUP BY 1, 2),
steps AS (SELECT DISTINCT word, 1 AS pos, 0 AS n FROM words
  UNION ALL SELECT word, pos + max(l), n + 1 FROM (SELECT word, pos, n, unnest(range(1, least({longest}, length(word) - pos + 1) + 1)) AS l FROM steps WHERE pos <= length(word))
    JOIN vocabulary ON piece = substring(word, pos, l) AND head = (pos = 1) GROUP BY word, pos, n),
counted AS (SELECT word, max(n) FILTER (pos > length(word)) AS pieces FROM steps GROUP BY word),
sums AS (SELECT rid, sum(times * coalesce(pieces, 1)) AS n_tokens, sum(CASE WHEN pieces IS NULL THEN times ELSE 0 END) AS n_unknown FROM words JOIN counted USING (word) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown FROM docs LEFT JOIN sums USING (rid)
"""


def op8(model_path: str) -> str:
    """Merges one pair at a time (best rank, then leftmost) in every distinct word; pieces come from the model's own file."""
    with open(model_path, "rb") as f:
        model = PieceModel(f.read())
    ids = sorted(model.ids.values())
    table = f"SELECT unnest(string_split({_quoted([model.pieces[i] for i in ids])}, ' ')) AS piece, CAST(unnest(string_split('{' '.join(map(str, ids))}', ' ')) AS INT) AS id, CAST(unnest(string_split('{' '.join(str(model.rank[i]) for i in ids)}', ' ')) AS INT) AS rank"
    text = "trim(regexp_replace(text, ' +', ' ', 'g'), ' ')" if model.squeeze else "text"
    other = "unnest(list_transform(range(CAST(strlen(piece) AS INT)), lambda k: bytes[CAST(('0x' || substr(hex(encode(piece)), 2 * k + 1, 2)) AS INT) + 1]))" if model.byte_fallback else str(model.unk)
    prefix = "'▁'" if model.add_prefix else "''"
    return rf"""
WITH RECURSIVE vocabulary AS MATERIALIZED ({table}),
docs AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN coalesce({text}, '') = '' THEN '' ELSE {prefix} || replace({text}, ' ', '▁') END AS t FROM documents),
places AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT rid, regexp_extract_all(t, '▁+[^▁]*|[^▁]+') AS w FROM docs)),
merged AS (SELECT DISTINCT word, string_split(word, '') AS s, true AS more FROM places
  UNION ALL SELECT word, CASE WHEN best IS NULL THEN s ELSE s[: best.i - 1] || [s[best.i] || s[best.i + 1]] || s[best.i + 2 :] END, best IS NOT NULL FROM (
    SELECT word, any_value(s) AS s, min(CASE WHEN rank IS NOT NULL THEN {{'rank': rank, 'i': i}} END) AS best FROM (SELECT word, s, unnest(range(1, greatest(len(s), 2))) AS i FROM merged WHERE more)
    LEFT JOIN vocabulary ON piece = s[i] || s[i + 1] GROUP BY word)),
bytes AS (SELECT list(CAST(id AS INT) ORDER BY b) AS bytes FROM (SELECT unnest(range(256)) AS b, unnest([{", ".join(map(str, model.byte_ids))}]) AS id)),
cut AS (SELECT word, unnest(s) AS piece, unnest(range(len(s))) AS k FROM merged WHERE NOT more),
known AS (SELECT word, k, piece, id FROM cut LEFT JOIN vocabulary USING (piece)),
named AS (SELECT word, k, 0 AS b, id FROM known WHERE id IS NOT NULL
  UNION ALL SELECT word, k, unnest(range(CAST(strlen(piece) AS INT))) AS b, {other} AS id FROM known, bytes WHERE id IS NULL),
ids AS (SELECT word, list(id ORDER BY k, b) AS ids FROM named GROUP BY word),
encoded AS (SELECT rid, flatten(list(ids ORDER BY place)) AS ids FROM places JOIN ids USING (word) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_tokens, sha256(coalesce(array_to_string(ids, ','), '')) AS ids_sha256,
  sha256(replace(CASE WHEN {str(model.add_prefix).lower()} THEN substr(t, 2) ELSE t END, '▁', ' ')) AS decoded_sha256 FROM docs LEFT JOIN encoded USING (rid)
"""


def _spans(kind: str, pattern: str, source: str, check: str) -> str:
    """(rid, kind, s, e, v) of the leftmost non-overlapping matches that pass ``check``: marks around them, then lengths summed."""
    return rf"""SELECT rid, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
  SELECT rid, v, k, CAST(sum(CASE WHEN k = 0 THEN length(part) ELSE length(part) - 1 END) OVER (PARTITION BY rid ORDER BY k) - CASE WHEN k = 0 THEN 0 ELSE length(part) - 1 END AS BIGINT) AS s FROM (
    SELECT rid, part, k, split_part(part, chr(57345), 1) AS v FROM (
      SELECT rid, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (SELECT rid, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS parts FROM {source})))
) WHERE k > 0 AND ({check})"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(len({_DIGITS})), lambda k: CASE WHEN k % 2 = 0 THEN CAST({_DIGITS}[-1 - k] AS INT) ELSE 2 * CAST({_DIGITS}[-1 - k] AS INT) - CASE WHEN CAST({_DIGITS}[-1 - k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_ALNUM = "regexp_replace(v, '[^A-Za-z0-9]', '', 'g')"

OP1 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, text IS NOT NULL AS given FROM documents),
base AS MATERIALIZED ({_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "docs", "true")}
  UNION ALL {_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "docs", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0")}
  UNION ALL {_spans("card", r"[0-9](?:[\x20-]?[0-9])+", "docs", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")}
  UNION ALL {_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "docs", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
likely AS MATERIALIZED ({_spans("secret", r"[A-Za-z0-9_+/=-]{20,}", "docs", f"len(list_filter(range(1, length({_ALNUM})), lambda i: regexp_matches({_ALNUM}[i], '[0-9]') <> regexp_matches({_ALNUM}[i + 1], '[0-9]'))) >= 4")}),
informed AS (SELECT v, sum(n * log2(length(v) / n)) AS bits FROM (SELECT v, c, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM likely)) GROUP BY v, c) GROUP BY v),
secrets AS (SELECT l.* FROM likely l JOIN informed USING (v) WHERE bits >= 64 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = l.rid AND b.s < l.e AND l.s < b.e)),
spans AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM secrets),
words AS MATERIALIZED ({_spans("term", r"[\p{L}\p{N}_]+", "docs", "true")}),
free AS MATERIALIZED (SELECT rid, s, e, lower(v) AS term FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
entities AS (SELECT DISTINCT rid, unnest([kind || ':' || lower(v), kind || '*' || CASE kind WHEN 'email' THEN split_part(lower(v), '@', -1) WHEN 'ip' THEN regexp_replace(v, '\.[^.]*$', '')
  WHEN 'card' THEN left({_DIGITS}, 6) WHEN 'phone' THEN left({_DIGITS}, 5) END]) AS entity FROM spans),
uniq AS MATERIALIZED (SELECT min(rid) AS rid FROM docs GROUP BY t),
own AS MATERIALIZED (SELECT DISTINCT rid, entity FROM entities JOIN uniq USING (rid) WHERE entity IS NOT NULL),
listed AS (SELECT rid, list(term ORDER BY s) AS w FROM free WHERE rid IN (SELECT rid FROM own) GROUP BY rid),
near AS MATERIALIZED (SELECT rid, coalesce(min(md5(array_to_string(w[i : i + least({SHINGLE}, len(w)) - 1], ' '))), '') AS near FROM (SELECT rid, w, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM listed) GROUP BY rid),
mention AS (SELECT entity, count(*) AS e, greatest(pow(2, -{RESIDUAL}), sqrt(count(*) / (SELECT count(*) FROM uniq))) AS least FROM own GROUP BY 1),
together AS (SELECT entity, term, count(*) AS k, count(DISTINCT coalesce(near, '')) AS c FROM own JOIN (SELECT DISTINCT rid, term FROM free) USING (rid) LEFT JOIN near USING (rid) GROUP BY 1, 2),
attempts AS (SELECT entity, count(*) AS tried FROM together GROUP BY 1),
anywhere AS (SELECT term, count(*) AS m FROM (SELECT DISTINCT rid, lower(v) AS term FROM words JOIN uniq USING (rid)) GROUP BY 1),
rated AS (SELECT term, c AS k, m - (k - c) AS m, least, tried FROM together JOIN mention USING (entity) JOIN attempts USING (entity) JOIN anywhere USING (term) WHERE least < 1 AND k > least * m),
telling AS (SELECT DISTINCT term FROM rated WHERE list_sum(list_transform(range(k, m + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(least) + (m - i) * ln(1 - least)))) <= {DOUBT} / tried),
found AS (SELECT rid, s, e FROM free JOIN telling USING (term)),
every AS (SELECT rid, 1 AS part, CASE kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 WHEN 'phone' THEN 3 ELSE 4 END AS o, s, kind || ':' || s || ':' || e AS x, kind FROM spans
  UNION ALL SELECT rid, 2, 5, s, 'term:' || s || ':' || e, 'term' FROM found),
lists AS (SELECT rid, string_agg(x, ',' ORDER BY o, s) AS spans, coalesce(string_agg(x, ',' ORDER BY o, s) FILTER (o < 4), '') AS base, count(*) AS n,
  count(*) FILTER (kind = 'email') AS a, count(*) FILTER (kind = 'ip') AS b, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS d, count(*) FILTER (kind = 'secret') AS f, count(*) FILTER (kind = 'term') AS g FROM every GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(d, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(f, 0) AS n_secret, coalesce(g, 0) AS n_term, coalesce(n, 0) AS n_spans FROM docs LEFT JOIN lists USING (rid)
"""


def op4() -> str:
    """Every run of lines against every template text, without the screens the operator uses."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {k}, {quote(x)})" for name, xs in licenses.TEMPLATES.items() for k, x in enumerate(xs))
    tokens_of = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    named = licenses.LICENSE_FILE
    return rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, text, CASE WHEN doc_id IS NOT NULL THEN coalesce(source, 'none') || '/' || CAST(floor(doc_id / 1000) AS BIGINT) || '/' || CAST(floor(doc_id / 50) AS BIGINT) || '/'
  || CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE 'doc-' || doc_id || '.txt' END END AS path FROM documents),
templates AS (SELECT license, k, {tokens_of("x")} AS t FROM (VALUES {rows}) v(license, k, x)),
tf AS (SELECT license, k, term, count(*) AS tf FROM (SELECT license, k, unnest(t) AS term FROM templates) GROUP BY ALL),
seen AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT rid, unnest({tokens_of("text")}) AS term FROM docs) GROUP BY 1),
total AS (SELECT count(*) AS total FROM docs),
idf AS MATERIALIZED (SELECT term, ln((total + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tf) LEFT JOIN seen USING (term), total),
vector AS MATERIALIZED (SELECT license, k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license, k)) AS w FROM tf JOIN idf USING (term)),
lines AS (SELECT path, text, n, {tokens_of("content")} AS t FROM (SELECT path, text, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS n FROM (SELECT DISTINCT path, text FROM docs WHERE path IS NOT NULL))),
placed AS MATERIALIZED (SELECT *, sum(len(t)) OVER (PARTITION BY path, text ORDER BY n) - len(t) AS before FROM lines WHERE len(t) > 0),
pairs AS (SELECT a.path, a.text, a.n AS n, b.n AS last FROM placed a JOIN placed b ON a.path = b.path AND a.text = b.text AND b.n >= a.n AND b.before - a.before < (SELECT max(len(t)) FROM templates)),
units AS MATERIALIZED (SELECT row_number() OVER () AS u, path, t FROM (
  SELECT p.path, flatten(list(l.t ORDER BY l.n)) AS t FROM pairs p JOIN placed l ON l.path = p.path AND l.text = p.text AND l.n BETWEEN p.n AND p.last GROUP BY p.path, p.text, p.n, p.last
  UNION ALL SELECT path, {tokens_of("text")} FROM docs WHERE text IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{named}'))),
counted AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(t) AS term FROM units) GROUP BY 1, 2),
weighed AS MATERIALIZED (SELECT u, term, tf * coalesce(idf, ln(total + 1) + 1) AS x FROM counted LEFT JOIN idf USING (term), total),
norms AS (SELECT u, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY 1),
dots AS (SELECT u, license, k, sum(x * w) AS dot FROM weighed JOIN vector USING (term) GROUP BY 1, 2, 3),
scored AS (SELECT path, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (u) JOIN units USING (u)),
found AS MATERIALIZED (SELECT path, arg_min(license, (-score, license)) AS license, max(score) AS score FROM scored WHERE score >= {licenses.LEAST} GROUP BY path),
holders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS holder, arg_min(license, path) AS inherited FROM found WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{named}') GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM docs WHERE path IS NOT NULL),
nearest AS (SELECT dir, arg_max(holder, length(holder)) AS holder, arg_max(inherited, length(holder)) AS inherited FROM dirs JOIN holders ON holder = '' OR dir = holder OR starts_with(dir, holder || '/') GROUP BY dir)
SELECT doc_id, path, f.license AS own_license, f.score AS own_score, coalesce(f.license, inherited) AS license, CASE WHEN f.license IS NULL THEN holder END AS inherited_from
FROM docs LEFT JOIN found f USING (path) LEFT JOIN nearest ON dir = regexp_replace(path, '/[^/]*$', '')
"""


OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""


def op13(rounds: int = centroids.ROUNDS) -> str:
    """Every vector against every centroid, in whole numbers."""
    nearest = """dist{r} AS (SELECT v.i, c.k, sum((v.x - c.x) * (v.x - c.x)) AS q FROM parts v JOIN cent{r} c USING (d) GROUP BY 1, 2),
near{r} AS MATERIALIZED (SELECT i, arg_min(k, (q, k)) AS k, min(q) AS q FROM dist{r} GROUP BY i)"""
    mean = """cent{n} AS MATERIALIZED (SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM cent{r} c LEFT JOIN (SELECT k, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM near{r} JOIN parts USING (i) GROUP BY k, d) m ON m.k = c.k AND m.d = c.d)"""
    steps = ",\n".join(nearest.format(r=r) + ",\n" + mean.format(r=r, n=r + 1) for r in range(rounds)) + ",\n" + nearest.format(r=rounds)
    return f"""
WITH vecs AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {centroids.SCALE}) AS BIGINT)) AS v, sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h
  FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {centroids.DIMENSIONS}),
parts AS MATERIALIZED (SELECT i, unnest(range({centroids.DIMENSIONS})) AS d, unnest(v) AS x FROM vecs),
cent0 AS MATERIALIZED (SELECT k, unnest(range({centroids.DIMENSIONS})) AS d, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM vecs) WHERE k < {centroids.CENTROIDS}),
{steps},
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(q AS BIGINT) AS distance, CAST(sum(q) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(q) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN vecs USING (i) JOIN named USING (k)
"""


def all_of(pieces: str) -> dict[str, str]:
    path = base.tokenizer_path(pieces)
    return {"op1_pii": OP1, "op4_licenses": op4(), "op6_ngram_jaccard": OP6, "op7_token_counts": op7(path), "op8_pieces": op8(path), "op10_decontaminate": OP10, "op12_infill": OP12, "op13_centroids": op13()}
