"""DuckDB SQL for the manifest, the ranked search and the shards."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, byte by byte and bit by bit."""
    step = "a"
    for _ in range(8):
        step = f"xor({step} >> 1, CASE WHEN {step} & 1 = 1 THEN 3988292384 ELSE 0 END)" if step == "a" else f"list_transform([{step}], lambda v: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce({octets}, lambda s, b: list_transform([xor(s, b)], lambda a: {step})[1], 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"


def _part(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_part(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_PAIRED = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
_STEPS = (
    "coalesce(list_transform(list_filter({levels}, lambda x: len(x.l) > 1), lambda x: CASE WHEN x.l[xor({pos} >> x.k, 1) + 1] IS NULL THEN '-' "
    "WHEN ({pos} >> x.k) & 1 = 1 THEN 'L' || x.l[xor({pos} >> x.k, 1) + 1] ELSE 'R' || x.l[xor({pos} >> x.k, 1) + 1] END), [])"
)
MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars, {_leaf('n_chars')} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), trees AS (
  SELECT lang, list(leaf ORDER BY pos) AS l FROM placed GROUP BY lang
), grown(lang, k, l) AS (
  SELECT lang, 0, l FROM trees UNION ALL SELECT lang, k + 1, {_PAIRED} FROM grown WHERE len(l) > 1
), levels AS (
  SELECT lang, list({{'k': k, 'l': l}} ORDER BY k) AS levels, max_by(l, k)[1] AS subroot FROM grown GROUP BY lang
), subs AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM levels
), joined(k, l) AS (
  SELECT 0, (SELECT list(subroot ORDER BY pos) FROM subs) UNION ALL SELECT k + 1, {_PAIRED} FROM joined WHERE len(l) > 1
), top AS (
  SELECT list({{'k': k, 'l': l}} ORDER BY k) AS levels, max_by(l, k)[1] AS root FROM joined
), proved AS (
  SELECT p.*, s.subroot, top.root, {_STEPS.format(levels='s.levels', pos='p.pos')} || {_STEPS.format(levels='top.levels', pos='s.pos')} AS steps
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang, top
), folded AS (
  SELECT *, list_reduce(steps, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END), coalesce(tampered, leaf)) AS folded_root FROM proved
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

_TERMS = (
    "list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')"
)
RANKED_SQL = f"""
WITH told AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_TERMS.format(text='text')} AS t FROM documents
), sizes AS (
  SELECT row_id, doc_id, len(t)::BIGINT AS n, t FROM told WHERE len(t) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format(text='text')}) AS term FROM benchmark
), held AS (
  SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(t) AS term FROM sizes) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus GROUP BY term, big_n
), impacts AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS impact FROM held JOIN weights USING (term), corpus
), scores AS (
  SELECT item_id, row_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""

SHARDED_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size FROM documents
), summed AS (
  SELECT body, sum(size)::BIGINT AS total FROM sized GROUP BY body
), weighed AS (
  SELECT body, (total >> greatest(length(bin(total)) - 16, 0)) << greatest(length(bin(total)) - 16, 0) AS weight FROM summed
), ranked AS (
  SELECT body, weight, row_number() OVER (ORDER BY weight DESC, sha256(body)) AS place FROM weighed
), slim AS (
  SELECT place, weight FROM ranked
), dealt(place, shard, loads) AS (
  SELECT 0::BIGINT, NULL::INTEGER, list_transform(range(24), lambda i: 0::BIGINT)
  UNION ALL
  SELECT place, shard, list_transform(range(24), lambda i: loads[i + 1] + CASE WHEN i = shard THEN weight ELSE 0 END) FROM (
    SELECT s.place, s.weight, d.loads, (list_position(d.loads, list_min(d.loads)) - 1)::INTEGER AS shard FROM dealt d JOIN slim s ON s.place = d.place + 1)
), placed AS (
  SELECT doc_id, size, row_id, {crc32('sized.body')} AS text_crc32, shard FROM sized JOIN ranked ON sized.body = ranked.body JOIN dealt USING (place)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, row_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM placed
"""
