"""DuckDB SQL for the queries, written from the definitions of the operators."""

from __future__ import annotations

import re

# Written out here, so that an error in the library's own constants does not agree with itself.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\p{Z}]"
PROMPT = (
    "Escreva o dia %d/%d do diário de: %s. Requisito: Retorne estritamente o texto narrativo "
    "em primeira pessoa, com pelo menos 150 palavras, citando locais e pessoas. Sem aspas ou prefixos."
)
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}_]"
CLOCKS = r"\p{Nd}{1,2}h(?:oras?)?|\p{Nd}{1,2}:\p{Nd}{2}"
NAMES = "MAP {'POSITIVE': 'Positivo', 'NEUTRAL': 'Neutro', 'NEGATIVE': 'Negativo'}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def cap(x: str) -> str:
    first = f"substr({x}, 1, 1)"
    return f"(CASE WHEN {first} = 'ß' THEN 'Ss' ELSE upper({first}) END || lower(substr({x}, 2)))"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> ''))::BIGINT"


def anchor(x: str, terms: str) -> str:
    found = f"regexp_extract({x}, '(?i)(?:^|{NOT_WORD})({terms}|{CLOCKS})(?:$|{NOT_WORD})', 1)"
    return f"CASE WHEN {found} = '' THEN 'Não relatado' ELSE {cap(found)} END"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def six(*xs: str) -> str:
    return " || ' ' || ".join(f"printf('%.6f', {x}::DOUBLE)" for x in xs)


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def windows(window: int, overlap: int) -> str:
    step = window - overlap
    return f"""
        SELECT entry_id, k AS window_no, k * {step} AS start_tok,
               least(k * {step} + {window}, n) AS end_tok,
               ids[k * {step} + 1 : least(k * {step} + {window}, n)] AS ids
        FROM (SELECT entry_id, ids, len(ids) AS n, unnest(generate_series(0,
              greatest(0, ceil((len(ids) - {window}) / {step}.0)::BIGINT))) AS k FROM ids)"""


CTES = {
    "e": "SELECT doc_id AS entry_id, source AS persona, text FROM documents",
    "ids": f"""
        SELECT entry_id, persona, list_transform(regexp_extract_all(text, '{WORD}'),
               lambda w: length(w)) AS ids FROM e""",
    "s": r"""
        SELECT entry_id, unnest(x) AS raw, generate_subscripts(x, 1) AS sent_no
        FROM (SELECT entry_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS x FROM e)""",
    "st": f"SELECT entry_id, sent_no, {strip('raw')} AS sentence FROM s",
    "t": f"""
        SELECT entry_id, sent_no, tok_no,
               CASE WHEN place // 2 > 0 THEN tok_no - place + place // 2 ELSE 0 END AS head,
               text, ' ' AS ws, lower(text) AS lemma,
               (['NOUN', 'VERB', 'ADJ', 'ADV', 'AUX'])[length(text) % 5 + 1] AS pos,
               (['ccomp', 'xcomp', 'obl', 'nsubj'])[place % 4 + 1] AS dep,
               CASE WHEN place > 1 AND substr(text, 1, 1) <> lower(substr(text, 1, 1))
                    THEN tok_no END AS ent_id,
               CASE WHEN place > 1 AND substr(text, 1, 1) <> lower(substr(text, 1, 1))
                    THEN 'PER' END AS ent_label
        FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY sent_no, place) AS tok_no
              FROM (SELECT entry_id, sent_no, unnest(w) AS text, generate_subscripts(w, 1) AS place
                    FROM (SELECT entry_id, sent_no, regexp_extract_all(raw, '{WORD}') AS w FROM s)))""",
    "win": windows(400, 50),
    "sc": """
        SELECT entry_id, window_no, len(list_filter(ids, lambda x: x % 3 = 0)) AS l0,
               len(list_filter(ids, lambda x: x % 3 = 1)) AS l1,
               len(list_filter(ids, lambda x: x % 3 = 2)) AS l2 FROM win""",
    "ml": """
        SELECT entry_id, avg(l0) AS l0, avg(l1) AS l1, avg(l2) AS l2, count(*) AS n_windows
        FROM sc GROUP BY entry_id""",
    "best": """
        SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS winner
        FROM ml""",
    "cl": """
        SELECT entry_id, persona, (['NEGATIVE', 'NEUTRAL', 'POSITIVE'])[winner + 1] AS polarity
        FROM e JOIN best USING (entry_id)""",
    "num": """
        SELECT *, (day_no - 1) // 7 + 1 AS week_no, (day_no - 1) % 7 + 1 AS day_of_week,
               CASE polarity WHEN 'POSITIVE' THEN 1 WHEN 'NEUTRAL' THEN 0
                             WHEN 'NEGATIVE' THEN -1 END::BIGINT AS polarity_value
        FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY entry_id) AS day_no
              FROM cl)""",
    "gp": """
        SELECT 'src' || i AS persona, CASE WHEN i < 5 THEN 'POSITIVE' WHEN i < 10 THEN 'NEGATIVE'
               ELSE 'NEUTRAL' END AS expected FROM range(15) AS r(i)""",
    "ge": """
        SELECT doc_id AS entry_id, CASE WHEN toxic = 1 THEN 'NEGATIVE'
               WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS expected FROM labels""",
    "pairs": "SELECT expected, polarity AS predicted FROM cl JOIN ge USING (entry_id)",
    "cnt": "SELECT expected, predicted, count(*) AS n FROM pairs GROUP BY ALL",
    "lab": "SELECT expected AS label FROM cnt UNION SELECT predicted FROM cnt",
    "cm": """
        SELECT a.label AS expected, b.label AS predicted, coalesce(n, 0) AS n
        FROM lab a CROSS JOIN lab b
        LEFT JOIN cnt ON cnt.expected = a.label AND cnt.predicted = b.label""",
    "cn": f"""
        SELECT *, {ratio('n', 'sum(n) OVER (PARTITION BY expected)')} AS share FROM cm""",
    "rep": f"""
        SELECT label, {ratio('hits', 'predicted')} AS precision, {ratio('hits', 'support')} AS recall,
               {ratio('2 * hits', 'support + predicted')} AS f1, support::BIGINT AS support
        FROM (SELECT label, sum(CASE WHEN expected = label THEN n ELSE 0 END) AS support,
                     sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS predicted,
                     sum(CASE WHEN expected = label AND predicted = label THEN n ELSE 0 END) AS hits
              FROM lab CROSS JOIN cnt GROUP BY label)""",
    "kwt": """
        SELECT entry_id, tok_no, lemma AS keyword FROM t
        WHERE pos IN ('NOUN', 'ADJ', 'ADV') AND length(lemma) > 2
          AND lemma NOT IN ('tion', 'ther', 'thon')""",
    "kw": """
        SELECT entry_id, string_agg(keyword, ' ' ORDER BY tok_no) AS keywords FROM kwt
        GROUP BY entry_id""",
    "tf": """
        SELECT persona, keyword AS term, count(*) AS n FROM kwt JOIN e USING (entry_id)
        GROUP BY ALL""",
    "top": """
        SELECT persona, term, n, row_number() OVER (PARTITION BY persona ORDER BY n DESC, term) AS rank
        FROM tf QUALIFY rank <= 70""",
    "ph": """
        SELECT entry_id, p.phrase_no::BIGINT AS phrase_no, p.category, a.tok_no AS start_tok, a.tok_no + CASE WHEN p.w3 = '' THEN 2 ELSE 3 END
               AS end_tok
        FROM (VALUES (1, 'alpha', 'the', 'and', ''), (2, 'beta', 'thanedble', 'the', 'anea'),
                     (3, 'gamma', 'that', 'the', ''), (4, 'gamma', 'for', 'the', ''),
                     (5, 'delta', 'with', 'the', '')) AS p(phrase_no, category, w1, w2, w3)
        JOIN t a ON a.lemma = p.w1
        JOIN (SELECT entry_id, tok_no, lemma FROM t) b USING (entry_id)
        WHERE b.tok_no = a.tok_no + 1 AND b.lemma = p.w2
          AND (p.w3 = '' OR EXISTS (SELECT 1 FROM t d WHERE d.entry_id = a.entry_id
               AND d.tok_no = a.tok_no + 2 AND d.lemma = p.w3))""",
    "emo": """
        SELECT entry_id, string_agg(category, ', ' ORDER BY category) AS emotions
        FROM (SELECT DISTINCT entry_id, category FROM ph) GROUP BY entry_id""",
    "ctx": """
        SELECT DISTINCT entry_id, sent_no FROM t WHERE lemma IN ('anea', 'than', 'then')""",
    "tst": f"""
        SELECT entry_id, sent_no, string_agg(text, ' ' ORDER BY tok_no) AS sentence
        FROM t GROUP BY ALL""",
    "sit": """
        SELECT entry_id, string_agg(sentence, ' | ' ORDER BY sent_no) AS situations
        FROM (SELECT entry_id, sentence, min(sent_no) AS sent_no FROM tst
              WHERE (entry_id, sent_no) IN (SELECT (entry_id, sent_no) FROM ctx UNION ALL
                     SELECT (entry_id, sent_no) FROM t WHERE ent_label = 'PER')
              GROUP BY ALL) GROUP BY entry_id""",
    "trg": """
        SELECT entry_id, string_agg(text, ', ' ORDER BY tok_no) AS triggers
        FROM (SELECT entry_id, text, min(tok_no) AS tok_no FROM t WHERE ent_label = 'PER'
              GROUP BY ALL) GROUP BY entry_id""",
    "seeds": """
        SELECT c.entry_id, c.sent_no, c.tok_no AS seed, v.tok_no AS verb_tok, v.text AS verb_text,
               CASE WHEN v.lemma IN ('that', 'this') THEN 'thought' ELSE 'reaction' END AS kind
        FROM t v JOIN t c ON c.entry_id = v.entry_id AND c.sent_no = v.sent_no AND c.head = v.tok_no
        WHERE v.pos IN ('VERB', 'AUX')
          AND ((v.lemma IN ('that', 'this') AND c.dep = 'ccomp')
            OR (v.lemma IN ('with', 'from') AND c.dep IN ('xcomp', 'dobj', 'obl')))""",
    "tree": """
        SELECT entry_id, sent_no, seed, seed AS tok_no FROM seeds
        UNION ALL
        SELECT tree.entry_id, tree.sent_no, tree.seed, t.tok_no FROM tree
        JOIN t ON t.entry_id = tree.entry_id AND t.sent_no = tree.sent_no AND t.head = tree.tok_no""",
    "sub": """
        SELECT tree.entry_id, tree.sent_no, seed, string_agg(text, ' ' ORDER BY tok_no) AS subtree
        FROM tree JOIN t USING (entry_id, sent_no, tok_no) GROUP BY ALL""",
    "cla": f"""
        SELECT entry_id, kind, value, min(verb_tok * 100000 + seed) AS ord
        FROM (SELECT *, {cap("CASE kind WHEN 'thought' THEN subtree ELSE verb_text || ' ' || subtree END")}
                     AS value
              FROM sub JOIN seeds USING (entry_id, sent_no, seed)
              WHERE {words('subtree')} > CASE kind WHEN 'thought' THEN 2 ELSE 1 END)
        GROUP BY ALL""",
    "tho": """
        SELECT entry_id, string_agg(value, ' | ' ORDER BY ord) AS thoughts FROM cla
        WHERE kind = 'thought' GROUP BY entry_id""",
    "rea": """
        SELECT entry_id, string_agg(value, ' | ' ORDER BY ord) AS reactions FROM cla
        WHERE kind = 'reaction' GROUP BY entry_id""",
    "anc": f"SELECT entry_id, {anchor('text', 'the|with|this|that')} AS time_anchor FROM e",
    "rec": """
        SELECT entry_id, time_anchor, coalesce(situations, 'Não descrita claramente.') AS situations,
               coalesce(thoughts, 'Não verbalizado.') AS thoughts,
               coalesce(emotions, 'Falta léxico.') AS emotions,
               coalesce(reactions, 'Sem reação.') AS reactions, coalesce(triggers, '') AS triggers
        FROM anc LEFT JOIN sit USING (entry_id) LEFT JOIN tho USING (entry_id)
        LEFT JOIN emo USING (entry_id) LEFT JOIN rea USING (entry_id) LEFT JOIN trg USING (entry_id)""",
    "pro": """
        SELECT entry_id, persona, rec.* EXCLUDE (entry_id), polarity, coalesce(keywords, '') AS keywords
        FROM rec JOIN cl USING (entry_id) LEFT JOIN kw USING (entry_id)""",
    "summ": """
        SELECT persona, count(*) AS total, count(*) FILTER (polarity = 'POSITIVE') AS n_positive,
               count(*) FILTER (polarity = 'NEGATIVE') AS n_negative,
               count(*) FILTER (polarity = 'NEUTRAL') AS n_neutral
        FROM cl GROUP BY persona""",
    "ef": """
        SELECT persona, emotion, count(*) AS n FROM (
            SELECT persona, unnest(string_split(emotions, ', ')) AS emotion
            FROM emo JOIN e USING (entry_id)) GROUP BY ALL""",
    "personas": """
        SELECT conv_id AS persona_no, 'conv' || conv_id AS persona, arg_min(text, turn) AS prompt
        FROM conversations GROUP BY conv_id""",
    "gpairs": "SELECT expected, polarity AS predicted FROM cl JOIN gp USING (persona)",
}

# Tables that others read several times.
STORED = {"t", "seeds", "s", "best", "cnt"}


def sql(body: str, **replaced: str) -> str:
    """The body with the tables it needs in front."""
    ctes = {**CTES, **replaced}
    needed: list[str] = []

    def visit(text: str, above: str) -> None:
        for name in ctes:
            if name != above and name not in needed and re.search(rf"\b{name}\b(?!\()", text):
                visit(ctes[name], name)
                needed.append(name)

    visit(body, "")
    needed = list(dict.fromkeys(needed))
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in STORED else ''}({ctes[name]})" for name in needed
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def evaluation(source: str) -> str:
    head = "SELECT '{}' AS scope, 'all' AS label, '{}' AS metric, round({}, 6) AS value FROM {}"
    metrics = ("precision", "recall", "f1")
    hits = "sum(CASE WHEN expected = predicted THEN n ELSE 0 END)"
    parts = [head.format("overall", "accuracy", ratio(hits, "sum(n)"), "cnt")]
    parts += [head.format("macro", m, f"avg({m})", "rep") for m in metrics]
    parts += [
        head.format("weighted", m, ratio(f"sum({m} * support)", "sum(support)"), "rep")
        for m in metrics
    ]
    parts += [
        f"SELECT 'class', label, '{m}', round({m}::DOUBLE, 6) FROM rep" for m in (*metrics, "support")
    ]
    return sql(" UNION ALL ".join(parts), pairs=CTES[source])


SHARES = ", ".join(f"round(n_{x} / total, 6) AS share_{x}" for x in ("positive", "negative", "neutral"))
SHARE_TEXTS = ", ".join(
    f"printf('%.0f%%', n_{x} / total * 100) AS text_{x}" for x in ("positive", "negative", "neutral")
)
REPORT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
PROCESSED_SQL = sql("SELECT * FROM pro")
CLASS_SQL = sql("SELECT entry_id, polarity FROM cl")

LAST_UNLABELLED = (
    "SELECT entry_id, (['NEGATIVE', 'POSITIVE', 'NEUTRAL'])[winner + 1] AS polarity FROM best"
)

ORACLES: dict[str, str] = {
    "read_corpus_csv": sql("SELECT * FROM e"),
    "read_corpus_parquet": sql("SELECT * FROM e"),
    "read_processed_csv": sql(
        "SELECT * REPLACE (nullif(triggers, '') AS triggers, nullif(keywords, '') AS keywords) FROM pro"
    ),
    "read_processed_parquet": PROCESSED_SQL,
    "word_list_hits": sql(
        """SELECT list, word, count(*) AS n_tokens FROM (VALUES ('context_nouns', 'anea'),
           ('context_nouns', 'than'), ('context_nouns', 'then'), ('cognitive_verbs', 'that'),
           ('cognitive_verbs', 'this'), ('action_verbs', 'with'), ('action_verbs', 'from'),
           ('stopwords', 'tion'), ('stopwords', 'ther'), ('stopwords', 'thon')) AS w(list, word)
           JOIN t ON lemma = word GROUP BY ALL"""
    ),
    "gold_coverage": sql(
        "SELECT persona, count(*) AS n_entries, any_value(expected) AS expected "
        "FROM e LEFT JOIN gp USING (persona) GROUP BY persona"
    ),
    "read_tokens": sql("SELECT *, 0::BIGINT AS is_stop FROM t"),
    "tokenize": sql("SELECT entry_id, sent_no, tok_no, text, lemma FROM t"),
    "tokenize_with_lemmas": sql(
        """SELECT entry_id, CASE WHEN lemma LIKE '%s' AND f.form IS NOT NULL
                  THEN left(lemma, length(lemma) - 1) ELSE lemma END AS lemma, count(*) AS n
           FROM t LEFT JOIN (SELECT DISTINCT lemma AS form FROM t) f
             ON f.form = left(lemma, length(lemma) - 1) GROUP BY ALL"""
    ),
    "time_anchor": sql("SELECT * FROM anc"),
    "time_anchor_portuguese": (
        "SELECT conv_id, turn, "
        + anchor("text", "hoje|ontem|amanhã|manhã|tarde|noite|madrugada")
        + " AS time_anchor FROM conversations"
    ),
    "sentences": sql("SELECT * FROM st"),
    "sentence_texts": sql("SELECT * FROM tst"),
    "context_sentences": sql("SELECT * FROM ctx"),
    "person_place_entities": sql(
        "SELECT entry_id, sent_no, ent_id, tok_no AS first_tok, text AS entity FROM t "
        "WHERE ent_label IN ('PER', 'LOC')"
    ),
    "default_when_empty": sql(
        r"""SELECT entry_id, coalesce(nullif(array_to_string(regexp_extract_all(text, '[0-9]+'), ' | '),
            ''), 'Sem reação.') AS field FROM e"""
    ),
    "capitalize": sql(f"SELECT entry_id, sent_no, {cap('sentence')} AS sentence FROM st"),
    "min_words": sql(
        f"SELECT * FROM (SELECT entry_id, sent_no, {words('sentence')} AS n_words FROM st) "
        "WHERE n_words > 2"
    ),
    "strip_text": f"""
        SELECT conv_id, turn, (i - 1) AS pos, {strip('x')} AS piece
        FROM (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS i
              FROM (SELECT conv_id, turn, string_split(text, '.') AS p FROM conversations))""",
    "label_of": sql(
        "SELECT entry_id, (['NEGATIVE', 'NEUTRAL', 'POSITIVE'])[winner + 1] AS label FROM best"
    ),
    "polarity_value": sql("SELECT entry_id, polarity_value AS value FROM num"),
    "calendar": sql("SELECT entry_id, persona, day_no, week_no, day_of_week FROM num"),
    "persona_slice": sql("SELECT * FROM num WHERE persona = 'src3'"),
    "translate_label": sql(f"SELECT entry_id, {NAMES}[polarity] AS name FROM cl"),
    "prediction_column": sql("SELECT polarity AS label, count(*) AS n FROM cl GROUP BY polarity"),
    "valid_pairs": sql("SELECT * FROM pairs"),
    "keyword_filter": sql("SELECT * FROM kwt"),
    "card_text": sql("SELECT entry_id, replace(triggers, ', ', ' **📌** ') AS card FROM trg"),
    "matrix_cells": sql(
        f"""SELECT expected, predicted, n, round(share, 6) AS share, {NAMES}[expected] AS expected_name,
            {NAMES}[predicted] AS predicted_name,
            n || chr(10) || printf('(%.1f%%)', share * 100) AS cell FROM cn"""
    ),
    "match_phrases": sql("SELECT entry_id, phrase_no, category, start_tok, end_tok FROM ph"),
    "thoughts": sql("SELECT * FROM tho"),
    "reactions": sql("SELECT * FROM rea"),
    "subtree_text": sql("SELECT * FROM sub"),
    "subtree_members": sql("SELECT * FROM tree"),
    "attach_gold": sql("SELECT persona, entry_id, expected FROM e LEFT JOIN gp USING (persona)"),
    "attach_entry_gold": sql(
        "SELECT entry_id, persona, expected FROM e LEFT JOIN ge USING (entry_id)"
    ),
    "unknown_personas": sql(
        "SELECT persona, count(*) AS n_entries FROM e "
        "WHERE persona NOT IN (SELECT persona FROM gp) GROUP BY persona"
    ),
    "attach_results_by_entry": sql(
        "SELECT entry_id, persona, emotions, triggers, polarity FROM cl "
        "LEFT JOIN emo USING (entry_id) LEFT JOIN trg USING (entry_id)"
    ),
    "prompt_grid": sql(
        f"""SELECT persona_no * 60 + day - 1 AS grid_no, persona_no, persona, day,
            printf('{PROMPT}', day, 60, prompt) AS request
            FROM personas CROSS JOIN generate_series(1, 60) AS d(day)"""
    ),
    "token_window_rows": sql(
        f"SELECT entry_id, window_no, start_tok, end_tok, {joined('ids')} AS ids FROM win"
    ),
    "token_windows_short": sql(
        "SELECT entry_id, window_no, start_tok, end_tok FROM win", win=windows(20, 8)
    ),
    "window_counts": sql("SELECT entry_id, count(*) AS n_windows FROM win GROUP BY entry_id"),
    "framed_windows": sql(
        "SELECT entry_id, window_no, "
        + joined("list_concat([0], ids, [2])")
        + " AS ids FROM win"
    ),
    "score_windows": sql(f"SELECT entry_id, window_no, {six('l0', 'l1', 'l2')} AS logits FROM sc"),
    "mean_logits": sql(f"SELECT entry_id, {six('l0', 'l1', 'l2')} AS logits, n_windows FROM ml"),
    "argmax": sql("SELECT entry_id, winner::BIGINT AS winner FROM best"),
    "softmax": sql(
        f"""SELECT entry_id, {six('exp(l0 / 100) / z', 'exp(l1 / 100) / z', 'exp(l2 / 100) / z')}
            AS probabilities, round(exp(greatest(l0, l1, l2) / 100) / z, 6) AS confidence
            FROM (SELECT *, exp(l0 / 100) + exp(l1 / 100) + exp(l2 / 100) AS z FROM ml)"""
    ),
    "classify": CLASS_SQL,
    "classify_detailed": sql(
        f"""SELECT entry_id, polarity, {six('l0', 'l1', 'l2')} AS logits,
            {six('exp(l0 - m) / z', 'exp(l1 - m) / z', 'exp(l2 - m) / z')} AS probabilities,
            n_windows, round(1 / z, 6) AS confidence
            FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS z
                  FROM (SELECT *, greatest(l0, l1, l2) AS m FROM ml)) JOIN cl USING (entry_id)"""
    ),
    "emotion_set": sql("SELECT * FROM emo"),
    "situations": sql("SELECT * FROM sit"),
    "triggers": sql("SELECT * FROM trg"),
    "ordered_distinct_join": sql(
        """SELECT entry_id, string_agg(sentence, ' | ' ORDER BY ord) AS sentences
           FROM (SELECT entry_id, sentence, min(sent_no) AS ord FROM st GROUP BY ALL)
           GROUP BY entry_id"""
    ),
    "keywords": sql("SELECT * FROM kw"),
    "term_frequency": sql("SELECT * FROM tf"),
    "emotion_frequency": sql("SELECT * FROM ef"),
    "polarity_summary": sql(f"SELECT *, {SHARES}, {SHARE_TEXTS} FROM summ"),
    "mood_heatmap": sql(
        "SELECT persona, week_no, "
        + ", ".join(
            f"max(CASE WHEN day_of_week = {d} THEN polarity_value END) AS d{d}" for d in range(1, 8)
        )
        + " FROM num GROUP BY ALL"
    ),
    "confusion_matrix": sql("SELECT * FROM cm"),
    "confusion_normalized": sql("SELECT * REPLACE (round(share, 6) AS share) FROM cn"),
    "accuracy": sql(
        "SELECT round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pairs"
    ),
    "per_class_report": sql(f"SELECT label, {REPORT}, support FROM rep"),
    "macro_metrics": sql(
        "SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision", "recall", "f1")) + " FROM rep"
    ),
    "weighted_metrics": sql(
        "SELECT "
        + ", ".join(
            f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in ("precision", "recall", "f1")
        )
        + " FROM rep"
    ),
    "class_metric_bars": sql(
        " UNION ALL ".join(
            f"""SELECT c.label, '{m}' AS metric, round(coalesce({m}, 0), 6) AS value
                FROM (VALUES ('NEGATIVE'), ('NEUTRAL'), ('POSITIVE')) AS c(label)
                LEFT JOIN rep USING (label)"""
            for m in ("precision", "recall", "f1")
        )
    ),
    "flow_links": sql(
        """SELECT list_position(['NEGATIVE', 'NEUTRAL', 'POSITIVE'], expected)::BIGINT - 1 AS source,
           list_position(['NEGATIVE', 'NEUTRAL', 'POSITIVE'], predicted)::BIGINT + 2 AS target,
           n AS value, (expected = predicted)::BIGINT AS hit FROM cnt"""
    ),
    "canonical_matrix": sql(
        """SELECT r.label AS expected, c.label AS predicted, r.place AS row_no, c.place AS col_no,
               (SELECT count(*) FROM mixed m WHERE m.expected = r.label AND m.predicted = c.label) AS n
           FROM seen r, seen c""",
        mixed="""SELECT expected, CASE WHEN entry_id % 7 = 0 THEN 'MIXED' ELSE polarity END AS predicted
                 FROM cl JOIN ge USING (entry_id)""",
        seen="""SELECT * FROM (SELECT unnest(['NEGATIVE', 'NEUTRAL', 'POSITIVE']) AS label,
                    unnest([0, 1, 2])::BIGINT AS place)
                WHERE label IN (SELECT expected FROM mixed UNION SELECT predicted FROM mixed)""",
    ),
    "day_number": sql("SELECT entry_id, persona, day_no FROM num"),
    "day_number_small_chunks": sql("SELECT entry_id, persona, day_no FROM num"),
    "day_number_sparse_keys": """
        SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id * 1000003 END AS entry_id, source AS persona,
            CASE WHEN doc_id % 5 <> 0 THEN row_number() OVER (PARTITION BY source, doc_id % 5 = 0 ORDER BY doc_id) END AS day_no
        FROM documents""",
    "classify_last_unlabelled": sql(LAST_UNLABELLED),
    "classify_python_last_unlabelled": sql(LAST_UNLABELLED),
    "classify_detailed_last_unlabelled": sql(
        f"""SELECT entry_id, polarity, {six('l0', 'l1', 'l2')} AS logits, n_windows
            FROM ml JOIN ({LAST_UNLABELLED}) USING (entry_id)"""
    ),
    "day_number_conversations": (
        "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) "
        "AS day_no FROM conversations"
    ),
    "number_pages_by_url": (
        "SELECT page_id, place, row_number() OVER (ORDER BY place) AS no "
        "FROM (SELECT page_id, concat_ws('#', url, page_id) AS place FROM pages)"
    ),
    "number_events_by_time": (
        "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events"
    ),
    "number_orders_by_day": (
        "SELECT o_orderkey, o_orderpriority, row_number() OVER "
        "(PARTITION BY o_orderpriority ORDER BY o_orderdate, o_totalprice, o_orderkey) AS no FROM orders"
    ),
    "assign_ids": f"""
        SELECT conv_id AS persona_no, turn + 1 AS day, conv_id * 60 + turn AS grid_no,
               'conv' || conv_id AS persona, {strip('text')} AS text,
               row_number() OVER (ORDER BY conv_id, turn) AS entry_id FROM conversations""",
    "polarity_series": sql(
        f"SELECT persona, day_no, polarity, {NAMES}[polarity] AS polarity_name, polarity_value FROM num"
    ),
    "top_terms": sql("SELECT * FROM top"),
    "persona_list": sql("SELECT DISTINCT persona FROM e"),
    "record_for_day": sql(
        "SELECT persona, day_no, polarity, time_anchor, "
        + ", ".join(
            f"replace({f}, ' | ', ' **📌** ') AS {f}"
            for f in ("situations", "emotions", "thoughts", "reactions")
        )
        + ", text FROM rec JOIN num USING (entry_id) JOIN e USING (entry_id, persona) WHERE day_no = 3"
    ),
    "label_union": sql("SELECT * FROM lab"),
    "present_classes": sql(
        "SELECT place::BIGINT AS place, label FROM (VALUES (0, 'MIXED'), (1, 'NEGATIVE'), (2, 'NEUTRAL'), (3, 'POSITIVE')) "
        "AS c(place, label) WHERE label IN (SELECT label FROM lab)"
    ),
    "records": sql("SELECT * FROM rec"),
    "enriched_corpus": PROCESSED_SQL,
    "evaluation_by_entry": evaluation("pairs"),
    "evaluation_by_persona": evaluation("gpairs"),
    "persona_views": sql(
        " UNION ALL ".join(
            [
                f"SELECT persona, 'summary' AS view, '{c}' AS item, {c} AS value FROM summ"
                for c in ("total", "n_positive", "n_negative", "n_neutral")
            ]
            + [
                "SELECT persona, 'emotions', emotion, n FROM ef",
                "SELECT persona, 'heatmap', 'w' || week_no || ' d' || day_of_week, polarity_value FROM num",
                "SELECT persona, 'series', day_no::VARCHAR, polarity_value FROM num",
                "SELECT persona, 'terms', term, n FROM top",
            ]
        )
    ),
    "polarity_shares": sql(f"SELECT persona, total, {SHARES} FROM summ"),
}
ORACLES |= {
    "match_lemmatised_phrases": ORACLES["match_phrases"],
    "evaluation_links": ORACLES["flow_links"],
    "annotate_python": ORACLES["read_tokens"],
    "score_windows_python": ORACLES["score_windows"],
    "mean_logits_in_place": ORACLES["mean_logits"],
    "classify_python": ORACLES["classify"],
    "enriched_corpus_python": ORACLES["enriched_corpus"],
    "persona_views_grown": ORACLES["persona_views"],
    "top_terms_by_bounds": ORACLES["top_terms"],
}
