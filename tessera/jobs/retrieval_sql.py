"""DuckDB SQL for the registered retrieval queries."""

from __future__ import annotations

from tessera.operators.recall import HEADER

#: The letters with a diacritic that the given tables may hold, and what they fold to: the SQL is no second folding.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
_HEADER = len(HEADER)


def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(translate(lower(coalesce({text}, '')), '{ACCENTED}', '{PLAIN}'), "
        "'[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '')"
    )


_CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, {_tokens('text')} AS t FROM documents)"
_LINES = (
    "raw AS (SELECT doc_id, unnest(l) AS content, unnest(range(len(l))) AS chunk_idx FROM (SELECT doc_id, "
    "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)), "
    f"chunks AS (SELECT doc_id * 1048576 + chunk_idx AS chunk_id, {_tokens('content')} AS t FROM raw)"
)
_INDEX = (
    "post AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM chunks), "
    "stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM chunks), "
    f"items AS (SELECT item_id AS query_id, {_tokens('text')} AS t FROM benchmark)"
)


def _asked(*spans: tuple[int, int]) -> str:
    parts = [
        f"SELECT query_id, {k} AS phrase_id, len(t[{a}:{a + n - 1}]) AS n_terms, unnest(t[{a}:{a + n - 1}]) AS term, "
        f"unnest(range(len(t[{a}:{a + n - 1}]))) AS shift FROM items"
        for k, (a, n) in enumerate(spans)
    ]
    return f"asked AS ({' UNION ALL '.join(parts)})"


_SCORED = (
    "starts AS (SELECT query_id, phrase_id, n_terms, chunk_id, dl, pos - shift AS start FROM post JOIN asked USING (term)), "
    "met AS (SELECT query_id, phrase_id, chunk_id, dl, start FROM starts GROUP BY query_id, phrase_id, n_terms, chunk_id, dl, start HAVING count(*) = n_terms), "
    "hits AS (SELECT query_id, phrase_id, chunk_id, dl, count(*) AS tf FROM met GROUP BY ALL), "
    "dfs AS (SELECT query_id, phrase_id, count(*) AS df FROM hits GROUP BY ALL), "
    "scored AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), {digits}) AS score "
    "FROM hits JOIN dfs USING (query_id, phrase_id), stats GROUP BY query_id, chunk_id)"
)


def _bm25(*spans: tuple[int, int], chunks: str = _CHUNKS, digits: int = 6) -> str:
    return f"{chunks}, {_INDEX}, {_asked(*spans)}, {_SCORED.format(digits=digits)}"


def _top(rows: str, limit: int) -> str:
    return (
        f"SELECT query_id, rank, chunk_id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank "
        f"FROM {rows}) WHERE rank <= {limit}"
    )


_VECTORS = (
    "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
)


def _near(name: str, asked: str, limit: int, where: str = "true", least: str = "true") -> str:
    return (
        f"{name}_all AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(greatest(list_inner_product(q.v, d.v), 0), 6) AS score "
        f"FROM (SELECT * FROM unit WHERE {asked}) q, (SELECT * FROM unit WHERE {where}) d), "
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_all WHERE {least}) WHERE rank <= {limit})"
    )


def _knn(limit: int, where: str = "true", least: str = "true") -> str:
    return f"WITH {_VECTORS}, {_near('near', 'vec_id % 20 = 0', limit, where, least)} SELECT query_id, rank, chunk_id AS vec_id, score FROM near"


_ITEM_VECTORS = "vec_id IN (SELECT item_id FROM benchmark)"


def _list(i: int, rows: str, weight: float, limit: int = 40) -> str:
    return (
        f"SELECT query_id, chunk_id, score, {i} AS list_ord, {weight}::DOUBLE AS weight, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score DESC, chunk_id) - 1 AS r FROM {rows}) WHERE r < {limit}"
    )


_FUSE = (
    "fused AS (SELECT query_id, chunk_id, sum(weight / (61 + r)) + max(CASE WHEN r = 0 THEN 0.05 WHEN r <= 2 THEN 0.02 ELSE 0 END)::DOUBLE AS score, "
    "min(list_ord * 1000 + r) AS first FROM lists GROUP BY query_id, chunk_id), "
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused)"
)
_FUSED_OUT = " SELECT query_id, rank, chunk_id AS doc_id, round(score, 6) AS score FROM ordered WHERE rank <= 10"

_TWO = (
    f"{_bm25((2, 1))}, {_VECTORS}, {_near('near', _ITEM_VECTORS, 40)}, lists AS ({_list(0, 'scored', 2)} UNION ALL {_list(1, 'near', 2)}), {_FUSE}"
)
_LINE_HITS = (
    f"{_bm25((2, 1), chunks=_LINES)}, line_hits AS (SELECT query_id, chunk_id, chunk_id // 1048576 AS doc_id, score, rank AS chunk_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored))"
)
_PATH = "'/' || source || '/' || doc_id || '.txt'"
_JUDGED = (
    "run AS (" + _top("scored", 10) + "), n_items AS (SELECT count(*) AS n FROM benchmark), judged AS (SELECT DISTINCT * FROM (SELECT unnest([doc_id % n, doc_id % 7, 0]) AS query_id, "
    "doc_id, quality * (1 + doc_id % 2) AS relevance FROM labels, n_items) WHERE query_id IN (SELECT item_id FROM benchmark)), "
    "ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judged), "
    "wanted AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (2 ** relevance - 1) / log2(place + 1) ELSE 0 END) AS best, count(*) FILTER (relevance > 0) AS positives FROM ideal GROUP BY query_id), "
    "got AS (SELECT r.query_id, sum((2 ** coalesce(relevance, 0) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (relevance > 0) AS hits, count(*) AS returned, "
    "min(rank) FILTER (relevance > 0) AS first FROM run r LEFT JOIN judged j ON r.query_id = j.query_id AND r.doc_id = j.doc_id GROUP BY r.query_id), "
    "metrics AS (SELECT w.query_id, positives, CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END AS ndcg, "
    "CASE WHEN positives > 0 THEN coalesce(hits, 0) / positives ELSE 0 END AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, "
    "CASE WHEN coalesce(returned, 0) > 0 THEN coalesce(hits, 0) / least(10, returned) ELSE 0 END AS \"precision\", "
    "CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM wanted w LEFT JOIN got g ON w.query_id = g.query_id)"
)
_PROMPTS = (
    "prompts AS (SELECT conv_id, turn, role, text AS prompt FROM conversations), "
    "clean AS (SELECT *, trim(regexp_replace(regexp_replace(prompt, '^[\\s*-]+', ''), '\\s+', ' ', 'g')) AS p FROM prompts)"
)
_BURSTS = (
    "ev AS (SELECT '/u/' || user_id AS path, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS op, ts FROM events), "
    "marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ev), "
    "grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked), "
    "bursts AS (SELECT path, epoch_us(min(ts)) AS opened, epoch_us(max(ts) + INTERVAL 1 HOUR) AS closed, arg_max(op, (ts, op)) AS op, count(*) AS changes FROM grouped GROUP BY path, burst)"
)
_CHUNKED = """
WITH RECURSIVE seg AS (
  SELECT doc_id, regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE regexp_matches(text, '\\S')
), body AS (SELECT doc_id, t, length(t) AS n, length(t) - length(replace(t, chr(10), '')) AS breaks FROM seg
), walk AS (
  SELECT doc_id, 0 AS idx, 0 AS place FROM body
  UNION ALL
  SELECT doc_id, idx + 1, next FROM (
    SELECT w.doc_id, idx, n, CASE WHEN place + 3060 >= n THEN n ELSE place + 3060 + length(regexp_extract(substr(t, place + 3061, 4000), '^\\S*\\s*')) END AS next
    FROM walk w JOIN body b ON w.doc_id = b.doc_id WHERE n > 4096
  ) WHERE next < n
), chunk AS (
  SELECT w.doc_id, idx AS chunk_idx, CAST(CASE WHEN n > 4096 THEN floor(1 + place::DOUBLE / n * breaks + 0.5) ELSE 1 END AS INTEGER) AS start_line,
         CAST(1 + breaks AS INTEGER) AS end_line, regexp_replace(regexp_replace(CASE WHEN n > 4096 THEN substr(t, place + 1, 3600) ELSE t END, '^\\s+', ''), '\\s+$', '') AS content
  FROM walk w JOIN body b ON w.doc_id = b.doc_id
)
"""
#: The chunks of all documents with their lines, and each whole item as one phrase.
_PIECES = f"{_CHUNKED}, pieces AS (SELECT doc_id * 1048576 + chunk_idx AS chunk_id, * FROM chunk), chunks AS (SELECT chunk_id, {_tokens('content')} AS t FROM pieces), {_INDEX}"
_WHOLE = f"{_PIECES}, asked AS (SELECT query_id, 0 AS phrase_id, len(t) AS n_terms, unnest(t) AS term, unnest(range(len(t))) AS shift FROM items), "
_STATUS = (
    "lines AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS k FROM documents), "
    "stat AS (SELECT source AS name, count(DISTINCT d.doc_id) AS doc_count, CAST(coalesce(sum(k), 0) AS BIGINT) AS chunk_count, max(n_chars) AS last_indexed "
    "FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id GROUP BY source)"
)
_CACHE = (
    "c AS (SELECT event_type || ':' || user_id AS cache_key, event_id AS response, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events), "
    "last AS (SELECT cache_key, arg_max(response, (created_at, response)) AS response, max(created_at) AS created_at FROM c GROUP BY cache_key), "
    "clock AS (SELECT max(created_at) AS t FROM c)"
)
_RECALL = (
    f"{_LINE_HITS}, res AS (SELECT query_id, h.doc_id, '/' || source || '/' || h.doc_id || '.txt' AS path, source AS collection, content, "
    "round(score / max(score) OVER (PARTITION BY query_id), 2) AS score, chunk_rank FROM line_hits h JOIN documents d ON h.doc_id = d.doc_id "
    "JOIN raw ON h.chunk_id = raw.doc_id * 1048576 + raw.chunk_idx), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_rank) AS k FROM res WHERE score >= 0.2) WHERE k = 1), "
    "chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM best) WHERE rank <= 3)"
)

ORACLE_SQL: dict[str, str] = {
    "bm25_single_term": f"WITH {_bm25((2, 1))} {_top('scored', 10)}",
    "bm25_phrase": f"{_WHOLE}{_SCORED.format(digits=6)} SELECT query_id, rank, doc_id // 1048576 AS doc_id, CAST(doc_id % 1048576 AS INTEGER) AS chunk_idx, score FROM ({_top('scored', 10)})",
    "bm25_or_phrases": f"WITH {_bm25((1, 2), (5, 1))} {_top('scored', 10)}",
    "bm25_collection_filter": f"WITH {_bm25((2, 1))}, kept AS (SELECT * FROM scored WHERE chunk_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src3', 'src5'))) {_top('kept', 10)}",
    "bm25_idf_floor": f"WITH {_CHUNKS}, {_INDEX}, common AS (SELECT term FROM post, stats GROUP BY term, n HAVING count(DISTINCT chunk_id) * 2 >= n), "
    f"asked AS (SELECT term AS query_id, 0 AS phrase_id, 1 AS n_terms, term, 0 AS shift FROM common), {_SCORED.format(digits=10)} "
    "SELECT query_id AS term, rank, chunk_id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10",
    "fts_stats": f"WITH {_CHUNKS} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl, CAST(sum(len(t)) AS BIGINT) AS tokens FROM chunks",
    "postings_df": f"WITH {_CHUNKS}, {_INDEX} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM post GROUP BY term",
    "tokenize_counts": f"WITH {_CHUNKS} SELECT chunk_id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM chunks",
    "chunk_plain_documents": f"{_CHUNKED} SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, start_line, end_line, CAST(ceil(length(content) / 4) AS INTEGER) AS token_count, md5(content) AS content_md5 FROM chunk",
    "chunk_token_counts": f"{_CHUNKED} SELECT doc_id, count(*) AS n_chunks, CAST(sum(ceil(length(content) / 4)) AS BIGINT) AS tokens FROM chunk GROUP BY doc_id",
    "chunk_overlap": f"{_CHUNKED}, pairs AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS before FROM chunk) "
    "SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(coalesce(list_max(list_filter(range(1, 601), lambda n: suffix(before, content[1:n]))), 0) AS INTEGER) AS repeated FROM pairs WHERE before IS NOT NULL",
    "knn_topk": _knn(5),
    "knn_min_score": _knn(10, least="score >= 0.3"),
    "knn_label_filter": _knn(5, where="label IN (1, 3)"),
    "knn_batch_queries": f"WITH {_VECTORS}, {_near('near', 'vec_id % 20 = 0', 10)} SELECT query_id, count(*) FILTER (d.label = q.label) AS same_label, round(avg(score), 5) AS mean_score "
    "FROM near n JOIN embeddings d ON n.chunk_id = d.vec_id JOIN embeddings q ON n.query_id = q.vec_id GROUP BY query_id",
    "l2_normalize": f"WITH {_VECTORS} SELECT u.vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length, round(v[1], 4) AS first, round(v[-1], 4) AS last FROM unit u JOIN embeddings USING (vec_id)",
    "rrf_two_lists": f"WITH {_TWO}{_FUSED_OUT}",
    "rrf_weighted_expanded": f"WITH {_bm25((1, 2))}, first AS (SELECT * FROM scored), "
    + f"{_asked((5, 1))}, {_SCORED.format(digits=6)}".replace("asked", "asked2").replace("starts", "starts2").replace("met AS", "met2 AS").replace("FROM met", "FROM met2")
    .replace("hits", "hits2").replace("dfs", "dfs2").replace("scored", "scored2")
    + f", {_VECTORS}, {_near('near', _ITEM_VECTORS, 40, least='score >= 0.3')}, lists AS ({_list(0, 'first', 2)} UNION ALL {_list(1, 'scored2', 1)} UNION ALL {_list(2, 'near', 2)}), {_FUSE}{_FUSED_OUT}",
    "rrf_single_list_fast_path": f"WITH {_VECTORS}, {_near('near', _ITEM_VECTORS, 40, least='score >= 0.3')} SELECT query_id, rank, chunk_id AS doc_id, score FROM near WHERE rank <= 10",
    "rrf_empty_bm25_plus_vector": f"WITH {_VECTORS}, {_near('near', _ITEM_VECTORS, 40, least='score >= 0.3')}, lists AS ({_list(1, 'near', 2)}), {_FUSE}{_FUSED_OUT}",
    "hybrid_search": f"{_WHOLE}{_SCORED.format(digits=12)}, {_VECTORS}, "
    f"{_near('near', _ITEM_VECTORS, 40, where='vec_id * 1048576 IN (SELECT chunk_id FROM pieces)', least='score >= 0.3').replace('d.vec_id AS chunk_id', 'd.vec_id * 1048576 AS chunk_id')}, "
    f"lists AS ({_list(0, 'scored', 2)} UNION ALL {_list(1, 'near', 2)}), {_FUSE}, best AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share FROM ordered) "
    f"SELECT query_id, rank, lower(lpad(hex(d.doc_id), 6, '0')) AS docid, {_PATH.replace('doc_id', 'd.doc_id')} AS file, source AS collection, round(share, 6) AS score, start_line, end_line "
    "FROM best JOIN pieces p USING (chunk_id) JOIN documents d ON p.doc_id = d.doc_id WHERE rank <= 10 AND share >= 0.01",
    "rerank_blend": f"WITH {_TWO}, cand AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, max(score) OVER (PARTITION BY query_id) AS best, "
    "CASE WHEN chunk_id % 5 <> 0 THEN 1.0::DOUBLE / (1 + chunk_id % 7) END AS rerank FROM ordered WHERE rank <= 40), "
    "sized AS (SELECT *, count(rerank) OVER (PARTITION BY query_id) AS answered, greatest(max(rerank) OVER (PARTITION BY query_id), 1e-9) AS top_rerank, "
    "CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END::DOUBLE AS share FROM cand), "
    "mixed AS (SELECT query_id, chunk_id, rank AS was, CASE WHEN n >= 2 AND answered > 0 THEN share * score / best + (1 - share) * rerank / top_rerank ELSE score END AS score, "
    "CASE WHEN n >= 2 AND answered > 0 THEN rerank END AS rerank FROM sized WHERE n < 2 OR answered = 0 OR rerank IS NOT NULL) "
    "SELECT query_id, chunk_id AS doc_id, round(score, 6) AS score, round(rerank, 6) AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rerank DESC NULLS LAST, was) AS k FROM mixed) WHERE k <= 10",
    "normalize_min_result_score": f"WITH {_bm25((1, 1), (2, 1))}, r AS ({_top('scored', 10)}) SELECT * FROM (SELECT query_id, rank, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM r) WHERE score >= 0.8",
    "docid_codec": "SELECT doc_id, lower(CASE WHEN length(h) < 6 THEN lpad(h, 6, '0') ELSE h END) AS docid, doc_id * 4099 AS back FROM (SELECT doc_id, hex(doc_id * 4099) AS h FROM documents)",
    "sha1_change_detection": "SELECT sha1(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "change_status_four_way": f"WITH cur AS (SELECT source AS collection, {_PATH} AS path, n_chars::DOUBLE AS mtime, sha1(text) AS hash FROM documents), "
    f"sto AS (SELECT source AS collection, {_PATH} AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars - 1 ELSE n_chars END::DOUBLE AS mtime, "
    "CASE WHEN doc_id % 5 = 0 THEN sha1(text || '!') ELSE sha1(text) END AS hash FROM documents WHERE doc_id % 7 <> 0 "
    f"UNION ALL SELECT 'gone', {_PATH}, 1.0, sha1(text) FROM documents WHERE doc_id % 11 = 0) "
    "SELECT coalesce(c.collection, s.collection) AS collection, coalesce(c.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' "
    "WHEN c.mtime = s.mtime THEN 'skipped' WHEN c.hash = s.hash THEN 'mtime_only' ELSE 'changed' END AS status FROM cur c FULL JOIN sto s ON c.collection = s.collection AND c.path = s.path",
    "title_extract": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title FROM documents",
    "snippet_fallback": "WITH w AS (SELECT doc_id, text, regexp_split_to_array(text, '[ \\n]+') AS parts FROM documents WHERE length(text) > 0), "
    "q AS (SELECT doc_id, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(concat_ws(' ', 'x', CASE WHEN len(parts) > 1 THEN parts[-2] END, 'the')), '\\s+'), lambda x: length(x) > 1) AS terms FROM w), "
    "p AS (SELECT *, list_filter(list_transform(terms, lambda x: instr(low, x)), lambda x: x > 0) AS places FROM q), "
    "s AS (SELECT *, greatest(0, coalesce(places[1] - 1, 0) - 60) AS start FROM p) "
    "SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || trim(replace(substr(text, start + 1, 180), chr(10), ' ')) || CASE WHEN start + 180 < length(text) THEN '…' ELSE '' END AS snippet FROM s",
    "collection_status": f"WITH {_STATUS} SELECT * FROM stat",
    "collection_stats_empty_left_join": f"WITH {_STATUS} SELECT * FROM stat UNION ALL SELECT DISTINCT 'empty-' || lang, 0, 0, NULL FROM documents",
    "upsert_documents": f"WITH d AS (SELECT source AS collection, {_PATH} AS path, n_chars, doc_id FROM documents), sto AS (SELECT * FROM d WHERE doc_id % 4 <> 0), "
    "ch AS (SELECT * FROM d WHERE doc_id % 2 = 0), last AS (SELECT coalesce(max(doc_id), 0) AS m FROM sto) "
    "SELECT collection, path, doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS size, 0 AS created_at FROM sto UNION ALL "
    "SELECT collection, path, m + row_number() OVER (ORDER BY collection, path), n_chars + 1, 9 FROM ch, last WHERE doc_id % 4 = 0",
    "cascade_delete": "WITH gone AS (SELECT doc_id FROM documents WHERE source = 'src1'), lines AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS k FROM documents) "
    "SELECT 'documents' AS kept_in, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'chunks', CAST(sum(k) AS BIGINT) FROM lines WHERE doc_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone)",
    "llm_cache_live": f"WITH {_CACHE} SELECT cache_key, response, created_at FROM last, clock WHERE created_at + 86400 > t",
    "llm_cache_evict": f"WITH {_CACHE} SELECT split_part(cache_key, ':', 1) AS kind, count(*) FILTER (created_at + 86400 <= t) AS evicted, count(*) AS entries FROM last, clock GROUP BY 1",
    "query_expansion_dedupe": "WITH b AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS first, string_split(text, chr(10)) AS l FROM benchmark), "
    "u AS (SELECT item_id, unnest(list_concat([first], l, [first], l)) AS query, unnest(range(2 + 2 * len(l))) AS k FROM b), "
    "f AS (SELECT item_id, query, min(k) AS k FROM u GROUP BY item_id, query) "
    "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS INTEGER) AS position, query FROM f",
    "doc_collapse_best_chunk": f"WITH {_LINE_HITS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_rank) AS k FROM line_hits) WHERE k = 1) "
    "SELECT query_id, rank, doc_id, score, chunk_id, chunk_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_rank, doc_id) AS rank FROM best) WHERE rank <= 10",
    "files_distinct_first": f"WITH {_LINE_HITS} SELECT query_id, source AS file, min(chunk_rank) AS rank FROM line_hits h JOIN documents d ON h.doc_id = d.doc_id GROUP BY query_id, source",
    "eval_ndcg_recall": f"WITH {_bm25((2, 1))}, {_JUDGED} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM metrics",
    "eval_mrr_p_hit": f"WITH {_bm25((2, 1))}, {_JUDGED} SELECT 'positive' AS averaged, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(\"precision\"), 6) AS \"precision\", round(avg(hit), 6) AS hit FROM metrics WHERE positives > 0 "
    "UNION ALL SELECT 'all', count(*), round(avg(mrr), 6), round(avg(\"precision\"), 6), round(avg(hit), 6) FROM metrics",
    "trec_run_lines": f"WITH {_bm25((2, 1))}, run AS ({_top('scored', 10)}) SELECT printf('%d Q0 %d %d %.10f tessera', query_id, doc_id, rank, score) AS line FROM run",
    "recall_decision": f"WITH {_PROMPTS} SELECT conv_id, turn, CASE WHEN coalesce(role, '') <> '' AND role <> 'user' THEN 'non_user_trigger' WHEN length(p) < 4 THEN 'prompt_too_short' "
    "WHEN regexp_matches(p, '(?i)^(memory_search\\s*\\(|memory_get\\s*\\(|HEARTBEAT_OK$|Read HEARTBEAT\\.md\\b)') THEN 'explicit_memory_tool_call' "
    "WHEN NOT regexp_matches(p, '(?i)\\b(remember(ed)?|previous(ly)?|before|earlier|decid(e|ed)|we decided|preferences?|todos?|what did (i|we) say|search (my|our) (memory|notes))\\b') THEN 'non_memory_prompt' ELSE 'memory_prompt' END AS reason FROM clean",
    "recall_query_rewrite": f"WITH {_PROMPTS} SELECT conv_id, turn, CASE WHEN p = '' THEN p WHEN length(p) <= 24 THEN 'previously recorded ' || p ELSE p END AS query FROM clean",
    "recall_select_top": f"WITH {_RECALL} SELECT query_id, rank, path, score FROM chosen",
    "recall_context_budget": f"WITH {_RECALL}, notes AS (SELECT query_id, rank, printf('%d. [score=%.2f] ', rank, score) || path || ' [' || collection || ']' || chr(10) || '   ' || "
    "trim(regexp_replace(content, '\\s+', ' ', 'g'))[1:280] || chr(10) AS block FROM chosen), used AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM notes) "
    f"SELECT query_id, count(*) AS injected, CAST({_HEADER} + length(rtrim(string_agg(block, '' ORDER BY rank), ' ' || chr(10))) AS INTEGER) AS n_chars FROM used WHERE n + {_HEADER} <= 600 GROUP BY query_id",
    "ignore_filter": "WITH p AS (SELECT page_id, regexp_extract(url, '://(.*)', 1) AS path FROM pages) SELECT page_id, (suffix(path, '.html') OR path = 'en' OR starts_with(path, 'en/') OR contains(path, '/en/') "
    "OR path = 'blog.tionsh.example.com' OR starts_with(path, 'blog.tionsh.example.com/') OR contains(path, '/blog.tionsh.example.com/')) AS ignored, regexp_matches(path, '(?i)\\.(md|markdown|txt)$') AS indexable FROM p",
    "debounce_sessions": f"WITH {_BURSTS} SELECT path, opened, closed, op, changes FROM bursts",
    "cache_stream": "WITH c AS (SELECT event_type || ':' || user_id AS cache_key, event_id AS response, epoch_us(ts) // 1000 AS t FROM events), "
    "last AS (SELECT cache_key, arg_max(response, (epoch, r)) AS response, max(t) AS t FROM (SELECT event_type || ':' || user_id AS cache_key, event_id AS response, epoch_us(ts) AS epoch, CAST(event_id AS VARCHAR) AS r, epoch_us(ts) // 1000 AS t FROM events) GROUP BY cache_key) "
    "SELECT cache_key, CASE WHEN t + 86400000 < (SELECT max(t) FROM c) - 600000 THEN 'expired' ELSE 'put' END AS event, response FROM last",
    "stream_equals_batch": f"WITH {_BURSTS} SELECT path, arg_max(op, (closed, op)) AS op, max(closed) AS closed FROM bursts GROUP BY path",
}
