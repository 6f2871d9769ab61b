"""The queries of claims.py in SQL."""

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_TURNS = "t AS (SELECT conv_id AS request_id, conv_id * 1000 + turn AS claim_id, text FROM conversations WHERE role = 'user')"
_TITLES = "p AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
_BOTH = f"{_TURNS}, {_TITLES}, j AS (SELECT *, {_W.format('text')} AS q, {_W.format('title')} AS w FROM t JOIN p ON request_id = page_id)"
_SCORES = f"""{_TURNS}, {_TITLES}, qw AS (SELECT DISTINCT claim_id, unnest({_W.format('text')}) AS word FROM t), pw AS (SELECT DISTINCT page_id, unnest({_W.format('title')}) AS word FROM p),
        s AS (SELECT claim_id, page_id, CAST(count(*) AS DOUBLE) AS score FROM qw JOIN pw USING (word) GROUP BY ALL),
        nom AS (SELECT DISTINCT claim_id, unnest([request_id % 40, request_id % 7]) AS page_id FROM t)"""
_PROPOSED = f"""{_TURNS}, pr AS (SELECT *, CASE WHEN claim_id % 7 = 0 THEN 'not in the text' ELSE substring(text, low + 1, high - low) END AS source, low + claim_id % 2 AS "start", high + claim_id % 2 AS "end"
            FROM (SELECT *, length(text) // 4 AS low, length(text) // 2 AS high FROM t WHERE length(text) > 8)),
        r AS (SELECT *, CASE WHEN "start" < "end" AND "end" <= length(text) AND substring(text, "start" + 1, "end" - "start") = source THEN "start" WHEN instr(text, source) > 0 THEN instr(text, source) - 1 END AS s FROM pr)"""
_EXACT = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS dw FROM documents), rec AS (SELECT min(item_id) AS item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS rw FROM benchmark GROUP BY 2),
        pl AS (SELECT doc_id, dw, unnest(range(1, len(dw) + 1)) AS start FROM d), fw AS (SELECT doc_id, start, dw, dw[start] AS w FROM pl),
        e AS (SELECT doc_id, item_id, start, len(rw) AS n FROM fw JOIN rec ON fw.w = rw[1] WHERE dw[start:start + len(rw) - 1] = rw)"""
_VERDICTS = """v AS (SELECT item_id AS claim_id, text, CASE WHEN item_id % 11 = 0 THEN 'unknown_record' WHEN item_id % 5 = 0 THEN 'different_text' WHEN item_id % 7 = 0 THEN 'other_source'
            WHEN item_id % 4 = 0 THEN 'incomplete_grading' WHEN item_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src1') THEN 'host_not_permitted' ELSE 'ok' END AS verdict FROM benchmark)"""
_URL = r"""u AS (SELECT page_id, url, starts_with(url, 'https://') AND NOT regexp_matches(url, '\s') AS https, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^/:?#]+:?([0-9]*)', 1) AS port FROM pages),
        k AS (SELECT *, https AND port IN ('', '443') AND NOT regexp_matches(path, '[%\\]') AND NOT list_has_any(string_split(path, '/'), ['.', '..']) AS ok FROM u)"""

SQL = {
    "comparison_keys": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\p{Cf}', '', 'g'), '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]+', ' ', 'g'))) AS key FROM documents",
    "routing_keys": r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '\p{Cf}', '', 'g'), '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]+', ' ', 'g')))) AS key FROM documents",
    "offset_tokens": r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(list_sum(list_transform(list_concat(w, ['']), lambda x: length(x))) AS BIGINT) AS chars,
            CASE WHEN len(w) = 0 THEN 0 ELSE length(text) - length(regexp_extract(text, '[^\p{L}\p{N}]*$')) END AS last FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)""",
    "language_flags": "SELECT lang, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS flag, count(*) AS n FROM documents GROUP BY ALL",
    "english_items": f"WITH {_TITLES} SELECT page_id, CASE WHEN len(regexp_extract_all(title, '[A-Za-z]')) - 7 * len(regexp_extract_all(title, '(?i)english')) >= 2 THEN 'English: ' || title END AS item FROM p",
    "verse_references": """SELECT conv_id, turn, CASE WHEN conv_id % 130 BETWEEN 1 AND 114 AND turn - 1 BETWEEN 1 AND 999 THEN conv_id % 130 END AS surah,
            CASE WHEN conv_id % 130 BETWEEN 1 AND 114 AND turn - 1 BETWEEN 1 AND 999 THEN CAST(turn - 1 AS BIGINT) END AS ayah FROM conversations""",
    "claim_flags": r"""WITH h AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:turn], ' ') || CASE WHEN turn % 2 = 0 THEN '!' ELSE '?' END AS said FROM conversations)
        SELECT conv_id, turn, regexp_matches(said, '[?؟]') AS question, NOT regexp_matches(said, '[?؟]') AND len(string_split_regex(trim(said, E' \n\t'), '\s+')) <= 5 AND turn % 2 = 0 AS fragment, true AS unresolved FROM h""",
    "title_shares": f"""WITH {_BOTH} SELECT claim_id, round(CASE WHEN len(q) >= 2 THEN len(list_filter(q, lambda x: list_contains(w, x) OR (length(x) > 4 AND list_contains(list_transform(list_filter(w, lambda y: length(y) > 4), lambda y: left(y, 4)), left(x, 4))))) / len(q) END, 6) AS share,
            list_has_any(list_filter(q, lambda x: length(x) > 2), w) AS overlap FROM j""",
    "term_mentions": f"WITH {_BOTH} SELECT claim_id, coalesce(list_contains(q, lower(string_split(title, ' ')[1])), false) AS mentioned FROM j",
    "relevant_rows": f"WITH {_BOTH} SELECT claim_id, page_id FROM j WHERE list_has_any(list_filter(q, lambda x: length(x) > 2), w) OR q = w",
    "topic_queries": """WITH ph AS (SELECT source AS topic, 'about ' || min(lang) AS phrase FROM documents GROUP BY source UNION ALL SELECT lang, 'in ' || max(source) FROM documents GROUP BY lang),
        a AS (SELECT DISTINCT doc_id AS claim_id, source, unnest([source, lang]) AS topic FROM documents),
        g AS (SELECT claim_id, source, list(phrase ORDER BY topic, phrase) AS l FROM a JOIN ph USING (topic) GROUP BY ALL),
        s AS (SELECT claim_id, source, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS query FROM g)
        SELECT claim_id, CASE WHEN NOT contains(query, source) THEN query END AS query FROM s""",
    "relocated_claims": f'WITH {_PROPOSED} SELECT claim_id, s AS "start", s + length(source) AS "end" FROM r',
    "claim_repair": f'WITH {_PROPOSED} SELECT claim_id AS request_id, coalesce(s, 0) AS "start", CASE WHEN s IS NULL THEN length(text) ELSE s + length(source) END AS "end", \'premise\' AS origin, s IS NULL AS ungrounded, CAST(2 AS BIGINT) AS copies FROM r',
    "field_repair": "SELECT event_id, CASE WHEN length(CAST(user_id AS VARCHAR)) > 1 THEN event_type || '|' || user_id ELSE event_type || '|' || event_type END AS kinds, CASE WHEN value BETWEEN 0 AND 50 THEN value ELSE 0.0 END AS value FROM events",
    "claim_numbers": f"WITH {_TURNS} SELECT request_id, count(*) AS claims FROM t GROUP BY request_id",
    "question_context": f"""WITH {_TURNS}, h AS (SELECT *, length(text) // 2 AS half, CASE WHEN claim_id % 3 = 0 THEN 3 ELSE 0 END AS skip FROM t WHERE length(text) > 8)
        SELECT claim_id, trim(substring(text, half + 1, skip), ' ') = '' AS complete FROM h""",
    "level_families": """SELECT doc_id, CASE WHEN (contains(k, 'the') AND regexp_matches(k, 'idiot|stupid')) OR contains(k, 'password') THEN 'D' WHEN contains(k, 'license') THEN 'C' WHEN contains(k, 'token') THEN 'B' ELSE 'A' END AS level
        FROM (SELECT doc_id, lower(text) AS k FROM documents)""",
    "nominated_scores": f"WITH {_SCORES} SELECT claim_id, page_id, coalesce(score, 0) AS score FROM nom LEFT JOIN s USING (claim_id, page_id)",
    "offered_records": f"""WITH {_SCORES}, f AS (SELECT claim_id, page_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, page_id) AS r FROM s QUALIFY r <= 50),
        u AS (SELECT claim_id, page_id, 0 AS p, 0 AS r FROM nom UNION ALL SELECT claim_id, page_id, 1, r FROM f), m AS (SELECT claim_id, page_id, min(p * 100 + r) AS o FROM u GROUP BY ALL)
        SELECT claim_id, page_id, row_number() OVER (PARTITION BY claim_id ORDER BY o, page_id) AS place FROM m QUALIFY place <= 5""",
    "routed_candidates": f"""WITH {_SCORES} SELECT s.claim_id, s.page_id AS corpus_id, CASE WHEN s.claim_id % 2 = 0 THEN 'term' ELSE 'doubt' END AS route FROM s JOIN p USING (page_id)
        WHERE (s.claim_id // 1000) % 5 <> 0 AND s.page_id % 6 <> 0 AND trim(title) <> '' AND (s.claim_id % 2 <> 0 OR s.page_id % 2 = 0)""",
    "unambiguous_aliases": f"WITH {_TITLES}, a AS (SELECT DISTINCT unnest({_W.format('title')}) AS alias, page_id FROM p) SELECT alias, min(page_id) AS corpus_id FROM a GROUP BY alias HAVING count(*) = 1",
    "union_first": """WITH u AS (SELECT item_id AS doc_id, 'item' AS part FROM benchmark UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
            UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM u GROUP BY part""",
    "twin_pairs": """WITH f AS (SELECT text, source AS peer_source, min(doc_id) AS peer FROM documents GROUP BY ALL) SELECT doc_id, peer, peer_source FROM documents JOIN f USING (text) WHERE source <> peer_source""",
    "spans_in_claims": f"""WITH {_EXACT}, s AS (SELECT DISTINCT doc_id, start, start + n AS stop FROM e), c AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS claim_id)
        SELECT doc_id, claim_id, count(*) AS spans FROM s, c WHERE start >= claim_id * 50 AND stop <= claim_id * 50 + 60 GROUP BY ALL""",
    "outside_marked": """WITH x AS (SELECT user_id, event_type, CAST(epoch(ts) AS BIGINT) AS t, floor(value / 20) AS c FROM events)
        SELECT user_id, count(*) AS n FROM x v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM x k WHERE k.event_type = 'click' AND k.user_id = v.user_id AND k.c = v.c AND v.t >= k.t - 1800 AND v.t + 3600 <= k.t + 5400) GROUP BY user_id""",
    "positions_in_order": f"""WITH {_SCORES}, m AS (SELECT claim_id, list_sort(list(page_id)) AS l FROM nom GROUP BY claim_id)
        SELECT claim_id, CAST(i AS BIGINT) AS position, l[i] AS record FROM m, unnest(range(1, len(l) + 1)) AS x(i)""",
    "publisher_answers": f"""WITH {_SCORES}, b AS (SELECT claim_id, page_id, score, CASE WHEN page_id % 3 <> 0 AND score / 8 >= 0.6 THEN 1 WHEN page_id % 3 = 0 AND score > 3 THEN 2 WHEN page_id % 3 <> 0 THEN 3 END AS branch FROM s)
        SELECT claim_id, page_id, CAST(branch AS BIGINT) AS branch FROM b WHERE branch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY branch, score DESC, page_id) = 1""",
    "abstentions": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'LEVEL_RESTRICTED' WHEN n_chars < 200 THEN 'NO_MATCHING_EVIDENCE' WHEN quality = 0 THEN 'INSUFFICIENT_AGREEMENT' END AS reason,
            CASE WHEN quality = 1 THEN CASE WHEN lang = 'en' THEN 'supported_confirms' ELSE 'supported_undetermined' END ELSE 'cannot_confirm' END AS label FROM documents LEFT JOIN labels USING (doc_id)""",
    "term_blocks": f"""WITH {_BOTH}, b AS (SELECT claim_id, text, string_split(title, ' ') AS w2 FROM j)
        SELECT claim_id, CASE WHEN trim(w2[1]) <> '' THEN w2[1] END AS term, CASE WHEN trim(w2[1]) <> '' THEN nullif(trim(w2[2]), '') END AS equivalent, CASE WHEN trim(w2[1]) <> '' THEN contains(text, w2[1]) END AS attested,
            CASE WHEN contains(text, w2[1]) THEN 'exact' ELSE 'same_meaning' END AS kind FROM b""",
    "state_facts": f"""WITH {_SCORES}, e AS (SELECT claim_id, count(*) AS evidence FROM s GROUP BY 1), o AS (SELECT claim_id, count(DISTINCT page_id % 3) AS positions FROM nom GROUP BY 1),
        f AS (SELECT claim_id, coalesce(evidence, 0) AS evidence, coalesce(positions, 0) AS positions FROM t LEFT JOIN e USING (claim_id) LEFT JOIN o USING (claim_id))
        SELECT claim_id, evidence, positions, CASE WHEN evidence >= 2 AND positions >= 2 THEN 'DISPUTED' WHEN evidence >= 1 AND claim_id % 2 <> 0 THEN 'SUPPORTED' ELSE 'CANNOT_CONFIRM' END AS state FROM f""",
    "received_layers": f"""WITH {_TITLES}, r AS (SELECT page_id % 50 AS request_id, 's' || page_id % 4 AS source_id, length(title) AS ref, title FROM p),
        c AS (SELECT *, count(*) OVER (PARTITION BY request_id, source_id, ref) AS n FROM r)
        SELECT 'live:' || source_id || ':' || ref AS key, CASE WHEN source_id <> 's3' AND length(trim(title)) BETWEEN 1 AND 60 AND n = 1 THEN 'quote' ELSE 'scan_only' END AS use, count(*) AS n FROM c GROUP BY ALL""",
    "evidence_verdicts": f"WITH {_VERDICTS} SELECT claim_id, verdict FROM v",
    "published_titles": f"""WITH {_VERDICTS} SELECT claim_id, claim_id AS corpus_id, CASE WHEN claim_id % 2 <> 0 AND trim(left(text, 20)) <> '' THEN left(text, 20) ELSE 'the publisher' END AS title FROM v WHERE verdict = 'ok'""",
    "dependency_records": f"WITH {_EXACT} SELECT doc_id AS text_id, 2 * count(DISTINCT item_id) AS records FROM e GROUP BY doc_id",
    "source_url_rules": f"WITH {_URL} SELECT page_id, https, ok AS source, ok AND (path = '/en' OR starts_with(path, '/en/')) AS section FROM k",
    "contract_violations": """WITH d AS (SELECT doc_id, text, doc_id % 2 = 0 AS h, source FROM documents), r AS (
            SELECT doc_id, unnest(list_filter([CASE WHEN NOT h THEN 'source_domain' END, CASE WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 'source_url' END, CASE WHEN source <> 'source' AND false THEN 'x' END,
                CASE WHEN h AND doc_id % 13 = 0 THEN 'grading_complete' END, CASE WHEN h AND doc_id % 17 = 0 THEN 'grading_provenance' END, CASE WHEN trim(text) = '' THEN 'text_present' END,
                CASE WHEN doc_id % 19 = 0 THEN 'english_checksum' END, CASE WHEN doc_id % 23 = 0 THEN 'license' END, CASE WHEN source = 'src6' THEN 'clearance' END, CASE WHEN source = 'src7' THEN 'public_display' END,
                CASE WHEN doc_id % 37 = 0 THEN 'approval' END, CASE WHEN doc_id % 41 = 0 THEN 'ref' END], lambda x: x IS NOT NULL)) AS rule FROM d)
        SELECT rule, count(*) AS n, min(doc_id) AS first_row FROM r GROUP BY rule""",
    "category_members": "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS categories FROM events GROUP BY user_id",
    "pagination_complete": """WITH g AS (SELECT l_orderkey, count(*) AS items, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
        SELECT l_orderkey, items, items + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS total, d = hi AND items = d AND l_orderkey % 9 <> 0 AS complete FROM g""",
    "number_gaps": "SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1",
    "assembled_runs": """SELECT source AS source_id, count(DISTINCT doc_id % 5) AS runs, count(*) AS records,
            CASE WHEN source = 'src2' AND bool_or(doc_id % 5 = 1) THEN 'mismatch' WHEN bool_or(doc_id % 5 = 3) THEN 'partial' ELSE 'complete' END AS status FROM documents GROUP BY source""",
    "item_health": "SELECT source, count(*) AS items, count(*) FILTER (WHERE quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "tagged_blocks": "SELECT page_id, CASE WHEN len(f) = 1 AND length(trim(f[1])) <= 60 THEN trim(f[1]) END AS block FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) AS f FROM pages)",
    "response_rows": """WITH r AS (SELECT page_id % 60 AS request_id, CAST(page_id AS VARCHAR) AS id, 'u' || page_id AS url FROM pages WHERE page_id % 4 <> 0)
        SELECT request_id, id, url FROM r QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id) <= 2""",
    "landed_items": "SELECT CAST(doc_id AS VARCHAR) AS id, trim(lang) AS title, md5(trim(text)) AS hadeeth FROM documents WHERE doc_id % 6 <> 0 AND length(trim(lang)) BETWEEN 1 AND 10 AND length(trim(text)) BETWEEN 1 AND 2000",
    "receipts_in_time": """WITH a AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
        j AS (SELECT a.user_id, c.ts AS got FROM a LEFT JOIN c ON c.user_id = a.user_id AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 1 HOUR)
        SELECT user_id AS request_id, count(got) AS receipts, count(*) FILTER (WHERE got IS NULL) AS without FROM j GROUP BY 1""",
    "sealed_progress": """WITH s AS (SELECT user_id, min(ts) AS sealed FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT user_id AS request_id, count(*) FILTER (WHERE sealed IS NULL OR ts <= sealed) AS accepted, count(*) FILTER (WHERE ts > sealed) AS refused FROM events LEFT JOIN s USING (user_id) WHERE event_type = 'click' GROUP BY 1""",
    "short_index_rules": f"""WITH {_TITLES}, r AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM p), c AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM r),
        x AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(path, '[%\\s\\\\]') OR list_has_any(string_split(path, '/'), ['.', '..']) THEN 'url' END, CASE WHEN NOT regexp_matches(path, '^/en/[0-9]+/?$') THEN 'path' END, CASE WHEN n > 1 THEN 'id_unique' END,
            CASE WHEN trim(title) = '' OR length(title) > 12000 THEN 'text:title' END, CASE WHEN page_id % 5 = 0 THEN 'text:question_text' END, CASE WHEN trim(html) = '' OR length(html) > 200000 OR html IS NULL THEN 'text:detailed_answer' END], lambda x: x IS NOT NULL)) AS rule FROM c)
        SELECT rule, count(*) AS n FROM x GROUP BY rule""",
    "shared_deadlines": """
        WITH e AS (SELECT user_id AS q, epoch_us(ts) AS us, event_type AS kind, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS state FROM events),
        a AS (SELECT q, min(us) AS asked, min(us) + 864000000000 AS deadline FROM e WHERE kind = 'signup' GROUP BY q),
        s AS (SELECT a.q, asked, deadline, coalesce(min(us), deadline) AS sealed FROM a LEFT JOIN e ON e.q = a.q AND kind = 'purchase' AND us BETWEEN asked AND deadline GROUP BY a.q, asked, deadline),
        r AS (SELECT DISTINCT s.q, name FROM s JOIN e ON e.q = s.q AND kind = 'error' AND us BETWEEN asked AND deadline),
        c AS (SELECT DISTINCT s.q, name FROM s JOIN e ON e.q = s.q AND kind = 'click' AND us BETWEEN asked AND sealed),
        d AS (SELECT s.q, name, (max(struct_pack(us := us, state := state))).state AS state FROM s JOIN e ON e.q = s.q AND kind = 'view' AND us BETWEEN asked AND sealed GROUP BY s.q, name),
        rs AS (SELECT q, string_agg(name, ',' ORDER BY name) AS sources FROM r GROUP BY q),
        cs AS (SELECT c.q, string_agg(c.name || ':' || state, ',' ORDER BY c.name) FILTER (WHERE state IS NOT NULL) AS cards, string_agg(c.name, ',' ORDER BY c.name) FILTER (WHERE state IS NULL) AS retryable FROM c LEFT JOIN d USING (q, name) GROUP BY c.q)
        SELECT s.q AS request_id, asked, sealed, coalesce(sources, '') AS sources, coalesce(cards, '') AS cards, coalesce(retryable, '') AS retryable FROM s LEFT JOIN rs USING (q) LEFT JOIN cs USING (q)""",
    "english_mentions": """WITH t AS (SELECT conv_id * 1000 + turn AS claim_id, conv_id AS page_id, text FROM conversations WHERE role = 'user'),
            p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) = 'en' AS en FROM pages)
        SELECT claim_id, CASE WHEN (en AND trim(title) <> '') OR len(regexp_extract_all(regexp_replace(title, 'english', '', 'gi'), '[A-Za-z]')) >= 2
            THEN len(list_intersect(regexp_extract_all(lower(regexp_replace(title, 'english', '', 'gi')), '[a-z]{4,}'), regexp_extract_all(lower(text), '[a-z]+'))) > 0 ELSE false END AS mentioned FROM t JOIN p USING (page_id)""",
}
