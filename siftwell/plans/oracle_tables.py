"""DuckDB SQL of the derived tables, as common table expressions with their dependencies."""

from __future__ import annotations

import re

from siftwell.functions.text import ACCENTED, PLAIN, SPACES

WORD = r"\w{2,50}"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '{ACCENTED}', '{PLAIN}')), '{SPACES}', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def deviation(n: str) -> str:
    return f"sqrt(-ln(0.45) / (2 * ({n})))"


CONTENT_ID = "sha1(regexp_replace(text, '\\r\\n?', chr(10), 'g'))"

CTES: dict[str, str] = {
    "ext": f"""SELECT doc_id AS file_id, '/' || source || '/' || doc_id || '.txt' AS file_name, 1600000000 + doc_id * 3600 AS file_time,
        CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 4 END AS state, 1 AS file_state,
        CASE WHEN doc_id % 5 = 0 THEN 'text/html' ELSE 'text/plain' END AS mime_type, substr(text, 1, 60) AS title, text, {CONTENT_ID} AS document_id FROM documents""",
    "docs": """SELECT min(file_id) AS db_document_id, document_id, arg_min(mime_type, file_id) AS mime_type, arg_min(title, file_id) AS title,
        arg_min(strlen(text), file_id)::BIGINT AS size, arg_min(text, file_id) AS text, max(file_time) AS publication_time, arg_max(state, file_time) AS state,
        0.0::DOUBLE AS download_count, base64(encode(arg_min(file_name, file_id))) AS url, 0.0::DOUBLE AS matching FROM ext GROUP BY document_id""",
    "files": "SELECT file_name, file_time, db_document_id, ext.state, file_state FROM ext JOIN docs USING (document_id)",
    "crawl": """SELECT file_name, file_time + CASE WHEN file_id % 5 = 0 THEN 10 ELSE 0 END AS file_time, CASE WHEN file_id % 9 = 0 THEN 1 ELSE state END AS state FROM ext WHERE file_id % 7 != 0
        UNION ALL SELECT '/new' || file_name, file_time, 1 FROM ext WHERE file_id % 10 = 3""",
    "normed": f"SELECT db_document_id, {norm("title || ' ' || text")} AS n FROM docs",
    "toks0": f"SELECT db_document_id, {tokens('n')} AS ws, string_split_regex(n, '{WORD}') AS gs FROM normed",
    "toks": """SELECT db_document_id, i - 1 AS n, word, (sum(length(gap) + length(word)) OVER (PARTITION BY db_document_id ORDER BY i) - length(word))::INTEGER AS position
        FROM (SELECT db_document_id, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap, unnest(range(1, len(ws) + 1)) AS i FROM toks0)""",
    "postings": "SELECT db_document_id, word, min(position) AS position, 0.0::DOUBLE AS download_count, 0.0::DOUBLE AS relevance, 0.0::DOUBLE AS popularity FROM toks GROUP BY ALL",
    "words": "SELECT DISTINCT word, 0.0::DOUBLE AS claim_count, 0.0::DOUBLE AS download_count FROM postings",
    "nodes": """SELECT sha1(user_id::VARCHAR) AS node_id, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip, (user_id % 3 + 6446)::INTEGER AS port,
        coalesce(floor(epoch(max(ts) FILTER (event_type <> 'error')))::BIGINT, 0) AS last_seen_time, coalesce(floor(epoch(max(ts) FILTER (event_type = 'error')))::BIGINT, 0) AS last_sleep_time,
        0.0::DOUBLE AS claim_count, 0.0::DOUBLE AS affinity, (user_id % 7 + 1)::INTEGER AS bandwidth FROM events GROUP BY user_id""",
    "ntok": f"SELECT file_id AS on_doc, document_id, {tokens(norm("title || ' ' || text"))} AS ts_ FROM ext",
    "evw": """SELECT event_id, ts, sha1(user_id::VARCHAR) AS node_id, event_type, document_id, CASE WHEN ts_[(k % len(ts_)) + 1] = ts_[((k * k + 7) % len(ts_)) + 1] THEN [ts_[(k % len(ts_)) + 1]] ELSE [ts_[(k % len(ts_)) + 1], ts_[((k * k + 7) % len(ts_)) + 1]] END AS words
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % (SELECT count(*) FROM documents) AS on_doc FROM events) JOIN ntok USING (on_doc) WHERE len(ts_) > 0 AND k IS NOT NULL""",
    "qlog": "SELECT event_id, ts, node_id, words FROM evw WHERE event_type = 'view'",
    "qs": "SELECT event_id AS query_id, words, node_id AS sender FROM qlog",
    "qw": "SELECT query_id, unnest(words) AS word, len(words) AS n_words FROM qs",
    "dlog": "SELECT event_id, ts, node_id, db_document_id, words, CASE WHEN event_type = 'purchase' THEN 10 ELSE 1 END AS weight FROM evw JOIN docs USING (document_id) WHERE event_type IN ('click', 'purchase')",
    "dshare": "SELECT event_id, ts, db_document_id, unnest(words) AS word, weight::DOUBLE / len(words) AS share, 1.0::DOUBLE / len(words) AS one FROM dlog",
    "dcount": "SELECT event_id, count(*) OVER (PARTITION BY db_document_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS of_document FROM dlog",
    "drun": """SELECT db_document_id, word, of_document, sum(one) OVER (PARTITION BY word ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS of_word,
        sum(one) OVER (PARTITION BY db_document_id, word ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS of_pair,
        row_number() OVER (PARTITION BY db_document_id, word ORDER BY ts DESC, event_id DESC) AS place FROM dshare JOIN dcount USING (event_id)""",
    "learnt": f"""SELECT db_document_id, word, greatest(of_pair / of_word - {deviation('of_word')}, 1e-6) AS popularity, greatest(of_pair / of_document - {deviation('of_document')}, 1e-6) AS relevance FROM drun WHERE place = 1""",
    "spost": """SELECT db_document_id, word, position, download_count, coalesce(l.relevance, 1.0::DOUBLE / (position + 10.37::DOUBLE)) AS relevance, coalesce(l.popularity, 1.0::DOUBLE / (position + 10.37::DOUBLE) * 0.5317::DOUBLE) AS popularity
        FROM postings LEFT JOIN learnt l USING (db_document_id, word)""",
    "hits0": "SELECT query_id, db_document_id, sum(relevance) AS relevance, sum(popularity) AS popularity FROM qw JOIN spost USING (word) GROUP BY ALL HAVING count(*) = min(n_words)",
    "hits1": """SELECT h.*, document_id, mime_type, title, size, publication_time, state, url, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, h.db_document_id) AS rank
        FROM hits0 h JOIN docs d ON d.db_document_id = h.db_document_id""",
    "hits": "SELECT * FROM hits1 WHERE rank <= 50",
    "results": """SELECT document_id, query_id, sha1(q.node_id || ':' || copy) AS node_id, mime_type, title, size, publication_time, state, round(relevance, 6) AS relevance, round(popularity, 6) AS popularity, url,
        CASE WHEN copy = 0 THEN 'localhost' ELSE '10.1.1.' || copy END AS host, CASE WHEN copy = 0 THEN 0 ELSE 6446 END AS port, '' AS login, to_timestamp(floor(epoch(q.ts))::BIGINT + copy)::TIMESTAMP AS record_ts
        FROM hits JOIN qlog q ON q.event_id = query_id, (SELECT unnest([0, 1, 2]) AS copy) WHERE copy <= query_id % 3""",
    "arrival": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY record_ts, node_id) AS a FROM results) WHERE a = 1",
    "providers": "SELECT db_document_id, node_id, floor(epoch(max(ts)))::BIGINT AS last_providing_time FROM dlog GROUP BY ALL",
    "claims": "SELECT node_id, unnest(words) AS word, 1.0::DOUBLE / len(words) AS claim FROM qlog WHERE len(words) > 0",
    "interests": """SELECT node_id, word, claim_count, claim_count / sum(claim_count) OVER (PARTITION BY node_id) AS specialisation, claim_count / sum(claim_count) OVER (PARTITION BY word) AS expertise
        FROM (SELECT node_id, word, sum(claim) AS claim_count FROM claims GROUP BY ALL)""",
    "plog": """SELECT ts, event_id, node_id, CASE WHEN event_type = 'signup' THEN 'notify' ELSE 'logout' END AS action, ip, port, bandwidth
        FROM (SELECT *, sha1(user_id::VARCHAR) AS node_id FROM events WHERE event_type IN ('signup', 'error')) JOIN nodes USING (node_id)""",
    "aff": """SELECT n.node_id AS other, coalesce(sum(m.specialisation * o.expertise), 0) AS affinity FROM nodes n LEFT JOIN interests o ON o.node_id = n.node_id
        LEFT JOIN (SELECT * FROM interests WHERE node_id = sha1('1')) m ON m.word = o.word GROUP BY ALL""",
}


def sql(body: str) -> str:
    """``body`` behind the tables it uses, in order of definition."""
    needed: set[str] = set()

    def want(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+\(*{name}\b", text):
                needed.add(name)
                want(CTES[name])

    want(body)
    head = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in CTES.items() if name in needed)
    return (f"WITH {head}\n{body}" if head else body) if not body.lstrip().startswith("WITH ") else (f"WITH {head},\n{body.lstrip()[5:]}" if head else body)
