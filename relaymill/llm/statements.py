"""SQL for DuckDB of those queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

# Sets of 4-word shingles, the pairs that link, and the least id each document can reach: along
# a way from the least id of a component all other ids are larger.
_JACCARD = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * n_both >= 85 * (a.n + b.n - n_both)), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.doc_id WHERE r.root < b.y), c AS (
  SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_HOST_RULES = ("short", "repeated", "symbols", "lines")


def _hosts() -> str:
    """Shrunk failure rates per host by the method of moments, as in the operator."""
    refused = []
    columns = []
    for rule in _HOST_RULES:
        mean = f"least(greatest(coalesce(mean_{rule}, 0.0), 1e-4), 1 - 1e-4)"
        spread = f"({mean} * (1 - {mean}))"
        between = f"greatest(coalesce(var_{rule}, 0.0) - {spread} * coalesce(sampling, 0.0), {spread} / 1000)"
        strength = f"greatest({spread} / {between} - 1, 1.0)"
        refused.append(f"(n_{rule} + {mean} * {strength}) / (n_docs + {strength}) > 0.5")
        columns += [
            f"avg(n_{rule} / n_docs) FILTER (n_docs >= 5) AS mean_{rule}",
            f"var_samp(n_{rule} / n_docs) FILTER (n_docs >= 5) AS var_{rule}",
        ]
    return f"""h AS (
  SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({r}) AS n_{r}" for r in _HOST_RULES)}
  FROM f GROUP BY source), q AS (
  SELECT {", ".join(columns)}, avg(1 / n_docs) FILTER (n_docs >= 5) AS sampling FROM h), v AS (
  SELECT source, {" OR ".join(refused)} AS host_refused FROM h, q)"""


_QUALITY = f"""WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five
  FROM d, unnest(range(1, len(w) - 3)) u(i)), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) o(k) GROUP BY doc_id), m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)), f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeated,
         100 * n_symbols > 10 * greatest(word_chars, 1) AS symbols,
         100 * n_dup_lines > 30 * n_words AS lines
  FROM m), {_hosts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short OR repeated AS base_failed, NOT (short OR repeated) AND NOT host_refused AS kept, host_refused
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""


# The level is the one at which all sources together, each filled up to twice its size, hold the budget;
# a source is full if the budget suffices to fill all up to where it is full. The queues are
# merged by finish time and the budget runs out at `floor(total)`.
_MIXING = f"""WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))) AS drawn
  FROM documents), s AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM d GROUP BY source)), b AS (
  SELECT 1.5::DOUBLE * CAST(sum(size) AS BIGINT) AS total FROM d), f AS (
  SELECT a.source, sum(least(2.0::DOUBLE * o.source_size, a.full_at * o.weight)) < (SELECT total FROM b) AS is_full
  FROM s a, s o GROUP BY a.source), l AS (
  SELECT ((SELECT total FROM b) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (is_full), 0))
           / sum(weight) FILTER (NOT is_full) AS level
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source), t AS (
  SELECT source, source_size, weight, least(2.0::DOUBLE * source_size, level * weight) AS target FROM s, l), q AS (
  SELECT d.*, source_size, weight, target, round,
         round * source_size + coalesce(sum(size) OVER (
           PARTITION BY d.source, round ORDER BY drawn, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) r(round)), w AS (
  SELECT *, CAST(greatest(0, least(size, ceil(target - ahead))) AS BIGINT) AS words FROM q), p AS (
  SELECT *, coalesce(sum(words) OVER (
           ORDER BY CAST(ahead + words AS DOUBLE) / weight, source NULLS LAST, drawn, doc_id, round
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM w WHERE words > 0)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(coalesce(sum(greatest(0, least(words, floor(total) - place))), 0) AS BIGINT) AS taken
FROM b, d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY ALL"""

_CRC = """CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bytes}, lambda x: x::BIGINT)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, _: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS BIGINT)"""
# Checksum of a decimal number: the bits of each digit's code pushed through one by one.
_CRC_OF_ID = _CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))")


def _cells(n_chars: str) -> str:
    def cell(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    return f"sha256({' || '.join(map(cell, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# Both trees level by level; a node's siblings are found by its number at every level.
_MERKLE = f"""WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_cells("n_chars")} AS leaf,
           CASE WHEN {_CRC_OF_ID} % 7 = 0 THEN {_cells("n_chars + 1")} END AS altered
    FROM documents)), lower_levels(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM d
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM lower_levels WHERE n > 1 GROUP BY tree, level, pos // 2), tops AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM lower_levels WHERE n = 1), upper_levels(level, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM upper_levels WHERE n > 1 GROUP BY level, pos // 2), lower_ways AS (
  SELECT d.tree, d.pos, list(struct_pack(h := coalesce(s.h, ''), l := (d.pos >> l.level) % 2 = 1) ORDER BY l.level) AS way
  FROM d JOIN (SELECT DISTINCT tree, level FROM lower_levels WHERE n > 1) l USING (tree)
  LEFT JOIN lower_levels s ON s.tree = d.tree AND s.level = l.level AND s.pos = xor(d.pos >> l.level, 1) GROUP BY ALL), upper_ways AS (
  SELECT t.tree, list(struct_pack(h := coalesce(s.h, ''), l := (t.pos >> l.level) % 2 = 1) ORDER BY l.level) AS way
  FROM tops t, (SELECT DISTINCT level FROM upper_levels WHERE n > 1) l
  LEFT JOIN upper_levels s ON s.level = l.level AND s.pos = xor(t.pos >> l.level, 1) GROUP BY ALL), p AS (
  SELECT d.doc_id, d.leaf, t.h AS subroot, (SELECT h FROM upper_levels WHERE n = 1) AS root,
         coalesce(altered, leaf) AS start, list_concat(coalesce(a.way, []), coalesce(b.way, [])) AS way
  FROM d JOIN tops t USING (tree) LEFT JOIN lower_ways a ON a.tree = d.tree AND a.pos = d.pos
  LEFT JOIN upper_ways b ON b.tree = d.tree), climb(doc_id, step, h) AS (
  SELECT doc_id, 1, start FROM p
  UNION ALL
  SELECT doc_id, step + 1, sha256(CASE WHEN way[step].l THEN way[step].h || c.h ELSE c.h || way[step].h END)
  FROM climb c JOIN p USING (doc_id) WHERE step <= len(way)), folded AS (
  SELECT doc_id, arg_max(h, step) AS h FROM climb GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.h), ''), '')) AS proof_sha256,
       h AS folded_root, h = root AS verified
FROM p JOIN folded USING (doc_id)"""


_CRC_OF_TURN = _CRC.format(
    bytes="list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || "
    "coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ascii(c))"
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DUE = "CASE WHEN n.q2 = 2 THEN 'assistant' ELSE 'user' END"

# Row by row the best (cost, edits) for each state of the grammar: 0 nothing yet, 1 system,
# 2 user, 3 assistant. More than two insertions in a row come back to a state for more.
_REPAIR = f"""WITH RECURSIVE d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF_TURN} % 20 AS harm
        FROM conversations), unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS i,
         left(role, 1) AS c, rtrim(text, {_BLANKS}) AS t
  FROM d), f AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair,
         CASE WHEN t = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault
  FROM o), s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id), n(q, k, q2, put) AS (VALUES
  (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])), p(conv_id, i, q, cost, audit, lines) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', []::VARCHAR[] FROM s
  UNION ALL
  SELECT conv_id, i + 1, q2, CAST(left(min(k), 9) AS BIGINT), substr(min(k), 10), arg_min(lines, k)
  FROM (
    SELECT p.conv_id, p.i, CASE op WHEN 'D' THEN n.q2 WHEN 'R' THEN CASE WHEN n.q2 = 2 THEN 3 ELSE 2 END
             ELSE CASE WHEN f.c = 's' AND n.q2 = 0 THEN 1 WHEN f.c = 'u' AND n.q2 IN (0, 1, 3) THEN 2
                       WHEN f.c = 'a' AND n.q2 = 2 THEN 3 END END AS q2,
           lpad(CAST(p.cost + 2 * n.k + price + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS VARCHAR), 9, '0')
             || p.audit || repeat('I', n.k) || op AS k,
           list_concat(list_concat(p.lines, put), CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                       ELSE [{_DUE} || ':' || text] END) AS lines
    FROM p JOIN n USING (q) JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i,
         (VALUES ('K', 0), ('R', 2), ('D', 3)) e(op, price)
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate'))
  WHERE q2 IS NOT NULL GROUP BY conv_id, i, q2), g AS (
  SELECT p.conv_id, min(k) AS k, arg_min(lines, k) AS lines
  FROM (SELECT p.conv_id, p.i, n.q2, list_concat(p.lines, put) AS lines,
               lpad(CAST(p.cost + 2 * n.k AS VARCHAR), 9, '0') || p.audit || repeat('I', n.k) AS k
        FROM p JOIN n USING (q)) p
  JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.i
  WHERE q2 IN (0, 3) GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(k, 9) AS BIGINT), 0) AS cost, coalesce(substr(k, 10), '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id"""


def statements() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": _JACCARD,
        "op7_quality_rules": _QUALITY,
        "op11_mixing": _MIXING,
        "op12_merkle": _MERKLE,
        "op13_conversation_repair": _REPAIR,
    }
