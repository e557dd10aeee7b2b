"""SQL that states the results of the queries SQL can express."""

from __future__ import annotations

from tillwise.llm.mixing import LEAF, PRODUCTION, Mix

LINE_DEDUP = r"""
WITH shown AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'),
      '(?i)</?(?:title|p|div|li|ul|nav|article|footer|header|h[1-6]|br|td|tr|table|pre|body)(?:[ /][^>]*)?>', chr(10), 'g'),
      '(?s)<[^>]*>', '', 'g') AS body,
    row_number() OVER () AS row_id
  FROM pages
), body AS (
  SELECT host, body, row_number() OVER () AS body_id
  FROM (SELECT DISTINCT host, coalesce(body, '') AS body FROM shown)
), own_line AS (
  SELECT DISTINCT host, body_id, trim(line, ' ') AS key
  FROM (SELECT host, body_id, unnest(string_split(body, chr(10))) AS line FROM body) WHERE trim(line, ' ') <> ''
), frequent AS (
  SELECT host, key
  FROM (SELECT host, key, count(*) AS n FROM own_line GROUP BY ALL)
  JOIN (SELECT host, count(*) AS pages FROM body GROUP BY host) USING (host)
  WHERE n > 0.02 * pages AND n >= least(5, greatest(3, pages // 2 + 1))
), line AS (
  SELECT row_id, host, unnest(string_split(body, chr(10))) AS line,
    generate_subscripts(string_split(body, chr(10)), 1) AS k
  FROM shown WHERE body IS NOT NULL
), marked AS (
  SELECT line.*, frequent.key IS NOT NULL AS f
  FROM line LEFT JOIN frequent ON line.host = frequent.host AND trim(line.line, ' ') = frequent.key
), page AS (
  SELECT row_id, count(*) FILTER (trim(line, ' ') <> '') AS n_lines, count(*) FILTER (f) AS dropped,
    string_agg(line, chr(10) ORDER BY k) FILTER (NOT f) AS kept
  FROM marked GROUP BY row_id
)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(dropped, 0) AS n_dropped, md5(coalesce(kept, '')) AS kept_md5
FROM shown LEFT JOIN page USING (row_id)
"""


def _case(values: dict, key: str, default: object) -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + "".join(f"WHEN {key} = '{k}' THEN {literal(v)} " for k, v in values.items()) + (
        f"ELSE {literal(default)} END" if values else f"ELSE {literal(default)} END".replace("ELSE ", "WHEN true THEN ")
    )


def mixing(mix: Mix) -> str:
    """One common table per level of the tree: each divides its parents' budgets."""
    home = {s: domain for domain, sources in mix.domains.items() for s in sources}
    parts = [
        f"""sized AS (SELECT doc_id AS id, {_case(home, "coalesce(source, '')", "other")} AS domain,
          coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents)""",
        f"leaves AS (SELECT {', '.join(LEAF)}, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY ALL)",
        f"""level0 AS (SELECT least(coalesce(sum(tokens), 0) * {mix.share} // 100,
          sum(tokens) * {mix.max_epochs})::BIGINT AS budget FROM leaves)""",
    ]
    for depth, level in enumerate(LEAF):
        parents = LEAF[:depth]
        own = ", ".join([*parents, level])
        family = f"PARTITION BY {', '.join(parents)}" if parents else ""
        before = f"({family} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"""level{depth + 1} AS (
          SELECT {own}, CASE WHEN filled THEN cap ELSE weight * (budget - sum(CASE WHEN filled THEN cap ELSE 0 END)
              OVER ({family})) // sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({family}) END::BIGINT AS budget
          FROM (SELECT *, cap * (sum(weight) OVER ({family}) - coalesce(sum(weight) OVER {before}, 0))
                <= weight * (budget - coalesce(sum(cap) OVER {before}, 0)) AS filled
            FROM (SELECT {own}, sum(tokens) * {mix.max_epochs} AS cap, {_case(mix.weights(level), level, 1)} AS weight
              FROM leaves GROUP BY ALL) {f"JOIN level{depth} USING ({', '.join(parents)})" if parents else ", level0"}))""")
    return "WITH " + ",\n".join(parts) + f""",
    planned AS (SELECT {', '.join(LEAF)}, tokens AS held, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
      CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN level3 USING ({', '.join(LEAF)})),
    placed AS (SELECT sized.*, epochs, rest, held, sum(tokens) OVER (PARTITION BY {', '.join(LEAF)}
        ORDER BY md5(concat('{mix.seed}:', epochs, ':', coalesce(id::VARCHAR, '')))) AS until
      FROM sized JOIN planned USING ({', '.join(LEAF)}))
    SELECT * FROM (SELECT id AS doc_id, {', '.join(LEAF)}, tokens::BIGINT AS tokens,
      (epochs + CASE WHEN held > 0 AND until <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed) WHERE copies > 0"""


CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_concat([k::BIGINT], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY k) AS entries
  FROM (SELECT unnest(range(256)) AS k)
)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``entries`` must be a column.  The number of a byte is in its hex digits."""
    code = f"encode({text})"
    byte = f"(instr('0123456789ABCDEF', substring(hex({code}), 2 * i - 1, 1)) * 16 + instr('0123456789ABCDEF', substring(hex({code}), 2 * i, 1)) - 17)"
    steps = f"list_transform(range(1, octet_length({code}) + 1), lambda i: {byte}::BIGINT)"
    step = "xor(c >> 8, entries[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, b: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _record(size: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', size, 'text')))})"


def _tree(name: str, leaves: str) -> str:
    """Tables ``name_node(tree, level, place, hash)`` of all trees over ``leaves(tree, place, hash)``, and ``name_top``."""
    return f"""
{name}_total AS (SELECT tree, CASE WHEN count(*) > 1 THEN length(bin(count(*) - 1)) ELSE 0 END AS height FROM {leaves} GROUP BY tree),
{name}_node AS (
  SELECT tree, 0 AS level, place, hash FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM (
    SELECT {name}_node.*, height FROM {name}_node JOIN {name}_total ON {name}_node.tree IS NOT DISTINCT FROM {name}_total.tree
  ) WHERE level < height GROUP BY tree, level, place // 2
),
{name}_top AS (
  SELECT n.tree, n.hash, height FROM {name}_node n JOIN {name}_total t ON n.tree IS NOT DISTINCT FROM t.tree AND n.level = t.height
)"""


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE}, leaf AS (
  SELECT doc_id, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place,
    {_record("n_chars")} AS hash,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_record("(n_chars + 1)")} END AS changed
  FROM documents, crc_table
), {_tree("a", "leaf")}, subroot AS (
  SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, hash, tree AS lang FROM a_top
), {_tree("b", "subroot")}, way AS (
  SELECT doc_id, l.tree, level, a_node.hash AS sibling, a_node.place < (l.place >> level) AS before
  FROM leaf l JOIN a_node ON l.tree IS NOT DISTINCT FROM a_node.tree AND a_node.place = xor(l.place >> level, 1)
  UNION ALL
  SELECT doc_id, l.tree, a_top.height + level, b_node.hash, b_node.place < (s.place >> level)
  FROM leaf l JOIN a_top ON l.tree IS NOT DISTINCT FROM a_top.tree JOIN subroot s ON l.tree IS NOT DISTINCT FROM s.lang
    JOIN b_node ON b_node.place = xor(s.place >> level, 1)
), fold AS (
  SELECT doc_id, l.tree, coalesce(changed, hash) AS hash, 0 AS level, a_total.height + (SELECT height FROM b_total) AS height
  FROM leaf l JOIN a_total ON l.tree IS NOT DISTINCT FROM a_total.tree
  UNION ALL
  SELECT f.doc_id, f.tree, sha256(CASE WHEN before THEN sibling || f.hash ELSE f.hash || coalesce(sibling, '') END), f.level + 1, height
  FROM fold f LEFT JOIN way w ON f.doc_id = w.doc_id AND f.level = w.level
  WHERE f.level < height
)
SELECT l.doc_id, l.hash AS leaf, a_top.hash AS subroot, (SELECT hash FROM b_top) AS root,
  sha256(coalesce((SELECT string_agg(sibling, '' ORDER BY level) FROM way w WHERE w.doc_id = l.doc_id), '')) AS proof_sha256,
  f.hash AS folded_root, f.hash = (SELECT hash FROM b_top) AS verified
FROM leaf l JOIN a_top ON l.tree IS NOT DISTINCT FROM a_top.tree JOIN fold f ON l.doc_id = f.doc_id AND f.level = f.height
"""

VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE}, run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), hashed AS (
  SELECT run, {crc32("concat(doc_id, ':', run)")} AS h FROM run, crc_table WHERE length(run) >= 7
), occurrence AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed
), word AS (
  SELECT word, count(*) AS n FROM occurrence WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM word)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, cut.n, word.word, word.n FROM cut JOIN word ON cut.rest = word.word
  UNION SELECT word.word, word.n, cut.word, cut.n FROM cut JOIN word ON cut.rest = word.word
), best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM near
), formed AS (
  SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * word.n THEN other END AS form,
    CASE WHEN other_n >= 10 * word.n THEN other_n END AS form_n
  FROM word LEFT JOIN best ON word.word = best.word AND place = 1
), step AS (
  SELECT word, word AS place, 0 AS depth FROM formed
  UNION ALL SELECT step.word, form, depth + 1 FROM step JOIN formed ON step.place = formed.word WHERE form IS NOT NULL
)
SELECT formed.word, form, reached AS root, n, n_near, form_n
FROM formed JOIN (SELECT word, max_by(place, depth) AS reached FROM step GROUP BY word) last ON formed.word = last.word
"""

ORACLES = {"op13_spelling_variants": VARIANTS, "op11_merkle_manifest": MERKLE, "op6_source_mixing": mixing(PRODUCTION), "op7_line_dedup": LINE_DEDUP}
