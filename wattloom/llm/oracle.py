"""DuckDB SQL for the registered operators that SQL can express.

Left out: the classifier, the language model, the packing program and sharding (no CRC-32 there); tests compare
those with brute force, held-out labels or exact round trips.
"""

from itertools import chain

from wattloom.llm import chat, licenses
from wattloom.llm.quality_rules import Risk
from wattloom.llm.spelling import Variants
from wattloom.llm.vector_codes import Coding

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _quality_rules(risk: Risk = Risk()) -> str:
    rules = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"),
             "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    share, level = risk.alpha / len(rules), risk.delta / (len(rules) * (len(risk.bands) + 1))
    values = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{name}' AS rule, coalesce({a} / nullif({b}, 0)::double, 0.0) AS value FROM judged"
        for name, (a, b) in rules.items())
    stratum = " + ".join(f"(n_words >= {b})::int" for b in risk.bands)
    grid = ", ".join(f"({i}, {c})" for i, c in enumerate(risk.grid))
    return rf"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
split_up AS (
  SELECT doc_id, body, list_filter(regexp_split_to_array(body, '{_SPACE}'), lambda x: x <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM bodies),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM split_up WHERE len(words) >= 3),
three AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM windows),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM three) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
statistics AS (
  SELECT s.doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
    coalesce(c.n, 0)::bigint AS n_repeat_words, len(lines)::bigint AS n_lines,
    (length(body) - length(regexp_replace(body, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::bigint AS n_capitals
  FROM split_up s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
  SELECT *, {stratum} AS stratum, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM statistics),
valued AS ({values}),
good AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = max(quality)),
grid(step, cutoff) AS (VALUES {grid}),
held AS (
  SELECT v.stratum, v.rule, v.value, g.quality FROM valued v JOIN good g ON v.doc_id = g.doc_id
  JOIN judged j ON j.doc_id = v.doc_id WHERE NOT j.base_failed),
cells AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n,
    count(*) FILTER (quality = 1 AND value > cutoff) AS k,
    count(*) FILTER (quality = 0 AND value > cutoff) AS bad
  FROM held, grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN k <= n * {share!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) <= {level!r}
    ELSE false END AS ok
  FROM (SELECT * REPLACE (n::double AS n, k AS k) FROM cells)),
certain AS (
  SELECT *, bad - {risk.weight} * k AS gain FROM (
    SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS held_up FROM tested) WHERE held_up),
chosen AS (
  SELECT stratum, rule, cutoff FROM certain WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
rejected AS (
  SELECT v.doc_id, string_agg(v.rule, ',' ORDER BY v.rule) AS rules
  FROM valued v JOIN chosen c ON v.stratum = c.stratum AND v.rule = c.rule AND v.value > c.cutoff GROUP BY v.doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.rules IS NULL AS kept, coalesce(r.rules, '') AS rules
FROM judged j LEFT JOIN rejected r ON j.doc_id = r.doc_id"""


def _ngram_join(width: int = 4, per_cent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {width} THEN array_to_string(w, ' ') ELSE {shingle} END AS s
  FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {per_cent} * (x.n + y.n - count(*))),
reach AS (
  SELECT u AS doc_id, u AS other FROM (SELECT DISTINCT u FROM links)
  UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(s.n, 0)::bigint AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN named c ON c.doc_id = w.doc_id"""


def _chat_format(template: chat.Template = chat.Template()) -> str:
    fixed = len(template.turn) + len(template.body) + len(template.end) + 1
    control = r"([<\[])(\\*)(/?s>|/?INST\]|\|)"
    return rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '{control}', '\1\\\2\3', 'g') AS e,
    regexp_replace(role, '{control}', '\1\\\2\3', 'g') AS r FROM said)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, e)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, e) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(template.opening)} + sum(length(e) + length(r) + {fixed}))::bigint AS formatted_chars
FROM escaped GROUP BY conv_id"""


def _decontaminate(width: int = 5, per_cent: int = 80) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))

    def sets(table: str, key: str) -> str:
        return rf"""
  SELECT DISTINCT id, CASE WHEN len(w) < {width} THEN '#' || array_to_string(w, ' ') ELSE {shingle} END AS s FROM (
    SELECT id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM (
      SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}) WHERE len(w) > 0)"""

    return f"""
WITH items AS ({sets("benchmark", "item_id")}),
docs AS ({sets("documents", "doc_id")}),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::bigint AS shared, z.n::bigint AS item_shingles,
  count(*) / z.n::double AS containment
FROM docs d JOIN items i ON d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING 100 * count(*) >= {per_cent} * z.n"""


_WARC = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (
  SELECT page_id, strlen(body)::bigint AS payload_bytes, sha256(body) AS payload_digest FROM bodies),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM digests WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, {_quoted(licenses.COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, ' ', 'g')"
    for pattern, same in licenses.EQUIVALENT:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(same)}, 'g')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _license_scan() -> str:
    def known(texts: dict[str, list[str]]) -> str:
        rows = ", ".join(f"({_quoted(name.split(' (')[0])}, {_quoted(t)})"
                         for name, t in chain.from_iterable(((n, t) for t in ts) for n, ts in texts.items()))
        return (f"SELECT sha256({_canonical('t')}) AS digest, string_agg(DISTINCT n, ',' ORDER BY n) AS license_id "
                f"FROM (VALUES {rows}) AS k(n, t) GROUP BY 1")

    return f"""
WITH whole AS ({known({k: [v] for k, v in licenses.LICENCES.items()})}),
notice AS ({known(licenses.NOTICES)}),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
named AS (
  SELECT l.doc_id, string_agg(DISTINCT n.license_id, ',' ORDER BY n.license_id) AS notices, count(*) AS c
  FROM lines l JOIN notice n ON sha256({_canonical('l.line')}) = n.digest
  WHERE regexp_matches(lower(l.line), '{licenses.MENTIONS}') GROUP BY l.doc_id),
scanned AS (SELECT doc_id, sha256({_canonical('text')}) AS canonical_digest FROM documents)
SELECT s.doc_id, s.canonical_digest, w.license_id, coalesce(n.notices, '') AS notices,
  coalesce(n.c, 0)::bigint AS n_notice_lines
FROM scanned s LEFT JOIN whole w ON s.canonical_digest = w.digest LEFT JOIN named n ON s.doc_id = n.doc_id"""


def _vector_codes(coding: Coding = Coding()) -> str:
    def assigned(turn: int) -> str:
        return f"""
near{turn} AS (
  SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT a.r, a.p, b.e, (a.xx - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x))::bigint AS d
    FROM pieces a JOIN book{turn} b ON a.p = b.p) GROUP BY r, p)"""

    rounds = "".join(f""",{assigned(turn)},
mean{turn} AS (
  SELECT p, e, list(x ORDER BY i) AS x FROM (
    SELECT n.p, n.best.e AS e, i, floor(sum(a.x[i]) / count(*)) AS x
    FROM near{turn} n JOIN pieces a ON a.r = n.r AND a.p = n.p, unnest(range(1, len(a.x) + 1)) AS t(i)
    GROUP BY n.p, n.best.e, i) GROUP BY p, e),
book{turn + 1} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{turn} b LEFT JOIN mean{turn} m ON m.p = b.p AND m.e = b.e)"""
                     for turn in range(coding.rounds))
    last = coding.rounds
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({coding.scale} * x::double)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT r, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT r, p, v[p * (len(v) // {coding.parts}) + 1:(p + 1) * (len(v) // {coding.parts})] AS x
    FROM kept, unnest(range({coding.parts})) AS t(p))),
book0 AS (SELECT p, r - 1 AS e, x FROM pieces WHERE r <= {coding.entries}){rounds},{assigned(last)},
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::bigint AS error
  FROM near{last} GROUP BY r),
book AS (
  SELECT sha256(string_agg(x::bigint::varchar, ',' ORDER BY p, e, i)) AS digest FROM (
    SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM book{last}))
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::bigint AS label_error,
  book.digest AS codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r, book"""


def _crc32(letters: str) -> str:
    """CRC-32 of a text of code points up to U+00FF, bit by bit."""
    code = f"list_transform(string_split({letters}, ''), lambda x: unicode(x))"
    octets = f"flatten(list_transform({code}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    bits = f"flatten(list_transform({octets}, lambda o: list_transform(range(8), lambda i: ((o >> i) & 1)::bigint)))"
    register = f"list_concat([4294967295::bigint], {bits})"
    return (f"xor(list_reduce({register}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), "
            "4294967295::bigint)")


def _spelling(variants: Variants = Variants(), typo_every: int = 97) -> str:
    return rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per_doc AS (
  SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {variants.least_length} GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32("concat(doc_id, ':', run)")} AS h FROM per_doc),
made AS (
  SELECT CASE WHEN h % {typo_every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
    ELSE run END AS word, c FROM hashed),
words AS (
  SELECT word, sum(c)::bigint AS n FROM made WHERE length(word) >= {variants.least_length} GROUP BY word
  HAVING sum(c) >= {variants.least_count}),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
    ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n,
    arg_min(other, {{'n': -other_n, 'other': other}}) AS form FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::bigint AS n_near,
    CASE WHEN form_n >= {variants.ratio} * w.n THEN form END AS form,
    CASE WHEN form_n >= {variants.ratio} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
ended AS (SELECT k.word, k.at FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ended e ON e.word = f.word"""


def statements() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_rules(),
        "op2_ngram_join": _ngram_join(),
        "op4_chat_format": _chat_format(),
        "op5_decontaminate": _decontaminate(),
        "op9_warc": _WARC,
        "op10_license_scan": _license_scan(),
        "op11_vector_codes": _vector_codes(),
        "op12_spelling_variants": _spelling(),
    }
