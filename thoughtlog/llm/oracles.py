"""SQL that gives the same rows as the queries of this subpackage, where SQL can say it.

The others have a trained model, a tokenizer's vocabulary or 64-bit hashes in them; they are
tested against brute-force versions.
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        keyed AS (
            SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
        repeated AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, top IS NOT NULL AND doc_id <> top AS gone FROM keyed k LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_decontaminate": rf"""
        WITH item AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        sized AS (SELECT *, least(len(ws), 10) AS n FROM item WHERE len(ws) > 0),
        phrase AS (
            SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k
            FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
        doc AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        place AS (
            SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                  FROM doc, (SELECT DISTINCT n FROM phrase))),
        found AS (SELECT doc_id, i, n, item_id FROM place JOIN phrase USING (n, k)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH doc AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        place AS (
            SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS k
            FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS i FROM doc)),
        repeated AS (SELECT k FROM place GROUP BY k HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM place JOIN repeated USING (k)),
        word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM doc),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t
            FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)""",
}
