"""The core queries in plain SQL, as DuckDB runs it on the same tables. Written from the definitions, not from the plans."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the operators shows.
PUNCTUATION = ("", ",", ".", "?", "!", ";", "—", ":")
PUNCTUATION_IDS = {",": 1, ".": 2, "?": 3, "!": 2, ":": 4, "—": 5, ";": 1}
PUNCTUATION_NAMES = {0: "", 1: ",", 2: ".", 3: "?", 4: ":", 5: "—"}
CASE_NAMES = {0: "LOWER", 1: "UPPER", 2: "CAP"}
DROPPED = "".join(chr(int(c, 16)) for c in "22 27 60 a8 b4 2bc 2bd 2c8 2018 201d 201f 2022 2032 2033 a78b a78c".split())
ALPHABETS = {"lt": "a-zA-ZąčęėįšųūžĄČĘĖĮŠŲŪŽ", "any": r"\p{L}"}

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_TAG = r"(?s)^(.*?)\(=([^)]*)\)(.*)$"
_HYPHENS = "-‐‑‒"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def _word(t: str) -> str:
    return rf"regexp_extract({t}, '^[\p{{L}}\p{{Nd}}²³¹]*')"


def _punct(t: str) -> str:
    return f"substr({t}, length({_word(t)}) + 1)"


def _case(w: str) -> str:
    return rf"(CASE WHEN regexp_matches({w}, '^\p{{Lu}}\P{{Lu}}*$') THEN 2 WHEN regexp_matches({w}, '^\p{{Lu}}+$') THEN 1 ELSE 0 END)"


def _punct_id(p: str) -> str:
    return "(CASE " + " ".join(f"WHEN {p} = {_q(s)} THEN {i}" for s, i in PUNCTUATION_IDS.items() if i) + " ELSE 0 END)"


def _name(x: str, names: dict[int, str]) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {i} THEN {_q(n)}" for i, n in names.items()) + " END)"


def _fixed(p: str) -> str:
    return rf"coalesce(nullif(translate(regexp_extract({p}, '[,.?!;—:\-‐‑‒]'), '{_HYPHENS}', '————'), ''), {p})"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def _drop(t: str) -> str:
    return _strip(f"regexp_replace(translate({t}, {_q(DROPPED)}, '{' ' * len(DROPPED)}'), ' +', ' ', 'g')")


def _title(w: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({w}, '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"


def _uppers(w: str) -> str:
    return rf"len(regexp_extract_all({w}, '\p{{Lu}}'))"


def _parsed(t: str) -> tuple[str, str, str]:
    tagged = f"regexp_matches({t}, '{_TAG}')"
    rest = f"(CASE WHEN {tagged} THEN regexp_extract({t}, '{_TAG}', 1) || regexp_extract({t}, '{_TAG}', 3) ELSE {t} END)"
    return _word(rest), _punct(rest), f"(CASE WHEN {tagged} THEN regexp_extract({t}, '{_TAG}', 2) ELSE '' END)"


def _rendered(w: str, p: str, m: str) -> str:
    return f"({w} || {p} || CASE WHEN {m} <> '' THEN '(=' || {m} || ')' ELSE '' END)"


def _reason(w: str, p: str, m: str, alphabet: str) -> str:
    allowed = f"(NOT ({w} = '' AND {p} <> '') AND {p} IN ({', '.join(map(_q, PUNCTUATION))}))"
    return (
        rf"(CASE WHEN regexp_matches({w}, '[\p{{Nd}}²³¹]') THEN 'number' WHEN starts_with({m}, 'M') AND regexp_matches({w}, '[IXV]') THEN 'roman' "
        rf"WHEN starts_with({m}, 'D') THEN 'foreign' WHEN NOT {allowed} THEN 'punctuation' WHEN NOT regexp_matches({w}, '^[{ALPHABETS[alphabet]}]+$') THEN 'symbols' END)"
    )


def _judged(source: str, keys: str, alphabet: str) -> str:
    """CTEs ending in `judged` (keys, clean, ok, short), from a query of (keys, text) without null texts."""
    w, p, m = _parsed("token")
    return f"""
    src AS ({source}),
    tok AS (SELECT {keys}, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT {keys}, {_tok(_drop("text"))} AS l FROM src)),
    par AS (SELECT {keys}, pos, {w} AS word, {p} AS p0, {m} AS mi FROM tok),
    fix AS (SELECT {keys}, pos, word, {_fixed("p0")} AS punct, mi, sum((word <> '')::INT) OVER (PARTITION BY {keys} ORDER BY pos) AS k FROM par),
    grp AS (SELECT {keys}, k, arg_min(word, pos) AS word, arg_min(punct, pos) AS own, arg_min(mi, pos) AS mi, arg_min(punct, pos) FILTER (word = '' AND punct <> '') AS stray FROM fix GROUP BY ALL),
    att AS (SELECT {keys}, k, word, CASE WHEN own <> '' OR k = 0 THEN own ELSE coalesce(stray, '') END AS punct, mi FROM grp),
    agg AS (SELECT {keys}, string_agg(word || punct, ' ' ORDER BY k) AS clean, bool_and({_reason("word", "punct", "mi", alphabet)} IS NULL) AS good, arg_min(word, k) AS first_word, arg_max(punct, k) AS last_punct FROM att GROUP BY ALL),
    judged AS (SELECT src.*, coalesce(clean, '') AS clean, coalesce(good AND NOT regexp_matches(first_word, '^\\p{{Ll}}') AND last_punct <> '', true) AS ok, length(coalesce(clean, '')) < 5 AS short FROM src LEFT JOIN agg USING ({keys}))"""


_S = 't."string"'
_MI = "coalesce(t.mi, '')"
_ANN = rf"""(CASE WHEN t.type = 'WORD' THEN CASE WHEN regexp_matches({_S}, '\p{{Lu}}') OR {_MI} IN ('Dl', 'De') THEN {_S} || '(=' || {_MI} || ')' ELSE {_S} END
    WHEN t.type = 'SEPARATOR' THEN replace({_S}, chr(10), ' ') WHEN t.type = 'SENTENCE_END' THEN '' ELSE coalesce({_S}, '') END)"""
_GROUPED = f"""
    resp AS (SELECT row_number() OVER () AS rid, row_id, chunk_no, tokens, max(chunk_no) OVER (PARTITION BY row_id) AS last_no FROM tagger_response),
    flat AS (SELECT rid, row_id, chunk_no, last_no, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS t, len(tokens) AS n FROM resp WHERE tokens IS NOT NULL),
    used AS (SELECT * FROM flat WHERE chunk_no = last_no OR pos <= floor(n * 0.95) + 2),
    ends AS (SELECT *, count(*) FILTER (t.type = 'SENTENCE_END') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g,
        max(CASE WHEN t.type = 'SENTENCE_END' THEN pos END) OVER (PARTITION BY rid) AS last_end FROM used),
    raw AS (SELECT rid, row_id, chunk_no, g, string_agg({_ANN}, '' ORDER BY pos) AS s FROM ends WHERE pos <= last_end GROUP BY ALL),
    grouped AS (SELECT rid, row_id, chunk_no, (row_number() OVER (PARTITION BY rid ORDER BY g) - 1)::INT AS sent_no, {_strip("s")} AS sentence FROM raw WHERE s <> '')"""


def _repaired() -> str:
    w, p, m = _parsed("token")
    fixed = f"(CASE WHEN {_uppers('word')} < 2 OR starts_with(mi, 'M') OR starts_with(mi, 'X') OR starts_with(mi, 'Ya') THEN word WHEN starts_with(mi, 'Np') OR pos = 0 THEN {_title('word')} ELSE lower(word) END)"
    return f"""{_GROUPED},
    gtok AS (SELECT rid, sent_no, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT rid, sent_no, {_tok("sentence")} AS l FROM grouped)),
    gpar AS (SELECT rid, sent_no, pos, {w} AS word, {p} AS punct, {m} AS mi FROM gtok),
    gfix AS (SELECT rid, sent_no, string_agg({_rendered(fixed, "punct", "mi")}, ' ' ORDER BY pos) AS fixed FROM gpar GROUP BY ALL),
    repaired AS (SELECT rid, row_id, chunk_no, sent_no, coalesce(fixed, '') AS fixed FROM grouped LEFT JOIN gfix USING (rid, sent_no))"""


_TOKENS = f"SELECT DISTINCT unnest({_tok('text')}) AS token FROM documents"
_WORDS = f"SELECT DISTINCT {_word('token')} AS word FROM ({_TOKENS})"
_PUNCTS = f"SELECT DISTINCT {_punct('token')} AS punct FROM ({_TOKENS})"
_TAGGED = """SELECT DISTINCT unnest([t."string" || '(=' || t.mi || '),', t."string" || '.(=' || t.mi || ')', t."string"]) AS token FROM (SELECT unnest(tokens) AS t FROM tagger_response) WHERE t.type = 'WORD' AND t.mi IS NOT NULL"""
_SENTENCES = r"SELECT doc_id, unnest(range(len(l)))::INT AS sent_no, trim(unnest(l)) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]+') AS l FROM documents)"
_DOC_WORDS = f"""SELECT doc_id, pos, {_word('token')} AS word, {_punct('token')} AS punct FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, {_tok('text')} AS l FROM documents)) """
_TRAIN_WORDS = f"""SELECT sent_id, pos::INT AS pos, token, {_word('token')} AS w0, {_punct('token')} AS p0 FROM (SELECT sent_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT sent_id, {_tok('text')} AS l FROM train))"""


def _counts(source: str) -> str:
    return f"""SELECT head, label, sum(p)::BIGINT AS predicted, sum(e)::BIGINT AS expected, sum(c)::BIGINT AS correct FROM (
        SELECT head, predicted AS label, 1 AS p, 0 AS e, CASE WHEN predicted = expected THEN 1 ELSE 0 END AS c FROM {source}
        UNION ALL SELECT head, expected, 0, 1, 0 FROM {source}) WHERE label IS NOT NULL GROUP BY head, label"""


def sql(length: int, size: int, vocabulary: int, cap: int) -> dict[str, str]:
    ids = lambda w: f"list_transform(range(0, ceil(length({w}) / {size}.0)::INT), lambda i: (4 + ('0x' || substr(md5(substr({w}, (i * {size} + 1)::INT, {size})), 1, 6))::BIGINT % {vocabulary})::INT)"
    draw = "(('0x' || substr(md5('42-' || sent_id), 1, 8))::BIGINT / 4294967296.0)"
    lines = lambda a: f"array_to_string({a}, ' ')"
    pad = lambda a: f"list_concat({a}, list_transform(range(0, {length} - len({a})), lambda z: 0))"

    def words(lower: bool, drop: bool) -> str:
        w = "lower(w0)" if lower else "w0"
        return f"""sents AS ({_SENTENCES}),
        stok AS (SELECT doc_id, sent_no AS sent, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, sent_no, {_tok("sentence")} AS l FROM sents)),
        sw AS (SELECT doc_id, sent, pos::INT AS pos, {_word("token")} AS w0, {_punct("token")} AS p0 FROM stok),
        wa AS (SELECT doc_id, sent, pos, {w} AS word, {_case("w0")} AS case_id, {_punct_id("p0")} AS punct_id, ceil(length({w}) / {size}.0)::INT AS c FROM sw),
        wb AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, sent) AS sent_n FROM wa),
        words AS (SELECT * FROM wb {f"WHERE sent_n < {length - 10}" if drop else ""})"""

    def packs(carry: bool, flush: bool, lower: bool, drop: bool) -> str:
        over = f"acc.len + x.c > {length - 1}"
        again = "CASE WHEN x.i > 0 THEN acc.sl ELSE 0 END" if carry else "0"
        return f"""WITH {words(lower, drop)},
        lists AS (SELECT doc_id, list({{'s': sent, 'i': pos, 'c': c, 'len': 0, 'seq': 0, 'sl': 0, 'out': []::INT[]}} ORDER BY sent, pos) AS l FROM words GROUP BY doc_id),
        folded AS (SELECT doc_id, l, list_reduce(list_prepend({{'s': -1, 'i': 0, 'c': 0, 'len': 1, 'seq': 0, 'sl': 0, 'out': []::INT[]}}, l), lambda acc, x: {{
            's': x.s, 'i': x.i, 'c': x.c,
            'len': (CASE WHEN {over} THEN 1 + {again} ELSE acc.len END + x.c)::INT,
            'seq': (acc.seq + CASE WHEN {over} THEN 1 ELSE 0 END)::INT,
            'sl': (CASE WHEN x.i = 0 THEN 0 ELSE acc.sl END + x.c)::INT,
            'out': list_append(acc.out, (acc.seq + CASE WHEN {over} THEN 1 ELSE 0 END)::INT)}}).out AS rows FROM lists),
        placed AS (SELECT doc_id, x.s AS sent, x.i AS pos, r FROM (SELECT doc_id, unnest(l) AS x, unnest(rows) AS r FROM folded)),
        spread AS (SELECT doc_id, sent, pos, {"unnest(range(r, (max(r) OVER (PARTITION BY doc_id, sent)) + 1))" if carry else "r"}::INT AS row FROM placed),
        packed AS (SELECT * FROM (SELECT *, max(row) OVER (PARTITION BY doc_id) AS last_row FROM spread) {"" if flush else "WHERE row < last_row"}),
        full_words AS (SELECT packed.row, words.* FROM packed JOIN words USING (doc_id, sent, pos))"""

    summary = " SELECT doc_id, row, sum(c)::BIGINT AS tokens, count(*) FILTER (c > 0) AS labels, min(sent)::INT AS first_sent, max(sent)::INT AS last_sent FROM full_words GROUP BY doc_id, row"
    carried = packs(True, False, True, True)
    feature_rows = f"""{carried}, fl AS (SELECT doc_id, row, flatten(list({ids("word")} ORDER BY sent, pos)) AS i, flatten(list(list_transform(range(0, c), lambda z: CASE WHEN z = 0 THEN 1 ELSE 0 END) ORDER BY sent, pos)) AS v,
        list(case_id ORDER BY sent, pos) AS cs, list(punct_id ORDER BY sent, pos) AS ps FROM full_words WHERE c > 0 GROUP BY doc_id, row),
        fe AS (SELECT doc_id, row, list_concat([1], i, [2]) AS ti, list_concat([0], cs, [0]) AS cl, list_concat([0], ps, [0]) AS pl, list_concat([1], v, [1]) AS vi FROM fl),
        feats AS (SELECT doc_id, row, {pad("ti")} AS token_ids, {pad("cl")} AS case_labels, {pad("pl")} AS punct_labels, {pad("vi")} AS valid_ids,
            {pad("list_transform(ti, lambda z: 1)")} AS token_masks, {pad("list_transform(cl, lambda z: 1)")} AS label_masks, len(cl)::INT AS label_len FROM fe)"""
    arrays = ("token_ids", "case_labels", "punct_labels", "valid_ids", "token_masks", "label_masks")
    train_arrays = f"""ta AS (SELECT sent_id, pos, lower(w0) AS w, {_case("w0")} AS c, {_punct_id("p0")} AS p FROM ({_TRAIN_WORDS})),
        tb AS (SELECT sent_id, flatten(list({ids("w")} ORDER BY pos)) AS i, flatten(list(list_transform(range(0, ceil(length(w) / {size}.0)::INT), lambda z: CASE WHEN z = 0 THEN 1 ELSE 0 END) ORDER BY pos)) AS v, list(c ORDER BY pos) AS cs, list(p ORDER BY pos) AS ps FROM ta WHERE w <> '' GROUP BY sent_id),
        tr AS (SELECT t.sent_id, coalesce(i, []::INT[]) AS i, coalesce(v, []::INT[]) AS v, coalesce(cs, []::INT[]) AS cs, coalesce(ps, []::INT[]) AS ps FROM train t LEFT JOIN tb USING (sent_id) WHERE t.text IS NOT NULL)"""
    tp, te = "list_concat([1], i, [2])", "list_concat([0], cs, [0])"
    tw, tpunct, tmi = _parsed("token")
    judged_train = _judged("SELECT sent_id, text FROM train WHERE text IS NOT NULL", "sent_id", "any")
    latest = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, word_pos, head ORDER BY scored_at DESC, predicted DESC NULLS LAST, expected DESC NULLS LAST) AS rn FROM prediction_pair) WHERE rn = 1)"
    v = "list_transform(embedding, lambda x: x::DOUBLE)"
    vec = f"(SELECT vec_id, label, {v} AS v FROM embeddings)"
    xent = lambda a, y: f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))) - {a}[{y} + 1])"
    each = lambda a: f"SELECT vec_id, (unnest(range(len(v))))::INT AS idx, round(unnest({a}), 6) AS value FROM {vec}"
    mean = "(list_sum(v) / len(v))"
    label_words = f"SELECT sent_id, pos, lower(w0) AS word, {_case('w0')} AS case_id, {_punct_id('p0')} AS punct_id FROM ({_TRAIN_WORDS})"
    prf = "correct / nullif(predicted, 0)", "correct / nullif(expected, 0)"
    warm = "(CASE WHEN batch >= 500 THEN 1.0 ELSE 0.5 + 0.5 * batch / 500.0 END)"
    return {
        "scan_text": "SELECT text FROM parquet_keeper WHERE text IS NOT NULL",
        "count_rows": "SELECT count(*) AS n FROM parquet_keeper",
        "text_lines": rf"SELECT * FROM (SELECT {_strip('value')} AS text FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS value FROM documents)) WHERE text <> ''",
        "feature_batches": f"""{feature_rows}, sh AS (SELECT doc_id, row, ((row_number() OVER (ORDER BY doc_id, row) - 1) % 4)::INT AS shard FROM feats),
            o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('7-3-' || doc_id || '-' || row), doc_id, row) - 1 AS no FROM sh)
            SELECT doc_id, row, shard, no // 8 AS batch_no, no % 8 AS batch_pos FROM o""",
        "limit_read": "SELECT row_id, text, row_no FROM (SELECT row_id, text, row_number() OVER (ORDER BY row_id) - 1 AS row_no FROM parquet_keeper) WHERE row_no < 100",
        "tag_sentences": rf"""SELECT row_id, {_strip(r"regexp_replace(replace(s, chr(10), ' '), '(\p{L}*\p{Lu}\p{L}*)', '\1(=)', 'g')")} AS sentence
            FROM (SELECT row_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+')) AS s FROM parquet_keeper)""",
        "nonpad_mask": f"{feature_rows} SELECT doc_id, row, {lines('list_transform(token_ids, lambda x: (x <> 0)::INT)')} AS mask FROM feats",
        "embedding_lookup": f"""WITH {train_arrays}, x AS (SELECT sent_id, unnest(range(len(i)))::INT AS pos, unnest(i) AS id FROM tr)
            SELECT sent_id, pos, (id % 600)::INT AS token, round(embedding[1]::DOUBLE, 6) AS first FROM x LEFT JOIN embeddings ON vec_id = id % 600""",
        "punctuate_text": f"""WITH w AS (SELECT doc_id, pos, lower(word) AS w FROM ({_DOC_WORDS}) WHERE word <> ''),
            f AS (SELECT *, 4 + ('0x' || substr(md5(substr(w, 1, {size})), 1, 6))::BIGINT % {vocabulary} AS i FROM w)
            SELECT doc_id, string_agg(CASE i % 3 WHEN 2 THEN {_title('w')} WHEN 1 THEN upper(replace(w, 'ß', 'ss')) ELSE w END || [',', '.', '?', ':', '—', ''][(i % 6 + 5) % 6 + 1], ' ' ORDER BY pos) AS text FROM f GROUP BY doc_id""",
        "parameter_count": "SELECT count(embedding) AS tensors, coalesce(sum(len(embedding)), 0)::BIGINT AS parameters FROM embeddings",
        "masked_loss": f"SELECT label, round(avg({xent('v[1:3]', '(label % 3)')}) FILTER (vec_id % 7 <> 0), 6) AS loss FROM {vec} GROUP BY label",
        "shard_sizes": "SELECT r::INT AS rank, (n // 3 + CASE WHEN r < n % 3 THEN 1 ELSE 0 END)::BIGINT AS rows FROM (SELECT unnest(range(3)) AS r, (SELECT count(*) FROM train) AS n)",
        "inspect_features": f"{feature_rows} SELECT doc_id, row, {', '.join(f'{lines(f'{a}[1:12]')} AS {a}' for a in arrays)}, len(token_ids)::INT AS length, label_len FROM feats ORDER BY doc_id, row LIMIT 20",
        "feature_slice": "SELECT * FROM (SELECT sent_id, text, row_number() OVER (ORDER BY sent_id) - 1 AS row_no FROM train) WHERE row_no BETWEEN 10 AND 29",
        "limit_rows": "SELECT text FROM train WHERE text IS NOT NULL ORDER BY sent_id LIMIT 50",
        "tokenize": f"SELECT doc_id, len(l)::BIGINT AS n, array_to_string(l, ' ') AS words FROM (SELECT doc_id, {_tok('text')} AS l FROM documents WHERE text IS NOT NULL)",
        "split_word_punct": f"SELECT token, {_word('token')} AS word, {_punct('token')} AS punct FROM ({_TOKENS})",
        "parse_word_tag": f"SELECT token, {tw} AS word, {tpunct} AS punct, {tmi} AS mi FROM ({_TAGGED})",
        "render_word_tag": f"SELECT token, {_rendered('w', 'p', 'm')} AS rendered FROM (SELECT token, {tw} AS w, {tpunct} AS p, {tmi} AS m FROM ({_TAGGED}))",
        "case_label": f"SELECT word, {_case('word')}::INT AS case_id FROM ({_WORDS})",
        "mixed_case": rf"SELECT word, regexp_matches(word, '(?s)^.+\p{{Lu}}') AND regexp_matches(word, '\p{{Ll}}') AS mixed FROM ({_WORDS})",
        "punct_label": f"SELECT punct, {_punct_id('punct')}::INT AS punct_id FROM ({_PUNCTS})",
        "label_names": f"SELECT punct, {_name(_punct_id('punct'), PUNCTUATION_NAMES)} AS name FROM ({_PUNCTS})",
        "label_sentence": f"SELECT t.sent_id, coalesce(words, '') AS words, coalesce(cases, '') AS cases, coalesce(puncts, '') AS puncts FROM train t LEFT JOIN (SELECT sent_id, string_agg(word, '|' ORDER BY pos) AS words, string_agg(case_id::VARCHAR, ' ' ORDER BY pos) AS cases, string_agg(punct_id::VARCHAR, ' ' ORDER BY pos) AS puncts FROM ({label_words}) GROUP BY sent_id) USING (sent_id) WHERE t.text IS NOT NULL",
        "lower_corpus": f"SELECT sent_id, string_agg(word, ' ' ORDER BY pos) AS text FROM ({label_words}) WHERE word <> '' GROUP BY sent_id",
        "drop_symbols": f"SELECT doc_id, {_drop('text')} AS text FROM documents WHERE text IS NOT NULL",
        "fix_punct": f"SELECT punct, {_fixed('punct')} AS fixed FROM ({_PUNCTS})",
        "upper_counts": f"SELECT word, {_uppers('word')}::BIGINT AS uppers FROM ({_WORDS})",
        "has_num": rf"SELECT word, regexp_matches(word, '[\p{{Nd}}²³¹]') AS has_num FROM ({_WORDS})",
        "allowed_symbols": f"SELECT word, regexp_matches(word, '^[{ALPHABETS['lt']}]+$') AS lt, regexp_matches(word, '^[{ALPHABETS['any']}]+$') AS any_letters FROM ({_WORDS})",
        "allowed_punct": f"SELECT word, punct, NOT (word = '' AND punct <> '') AND punct IN ({', '.join(map(_q, PUNCTUATION))}) AS allowed FROM (SELECT DISTINCT {_word('token')} AS word, {_punct('token')} AS punct FROM ({_TOKENS}))",
        "annotate_tokens": f"WITH r AS (SELECT row_number() OVER () AS rid, row_id, chunk_no, tokens FROM tagger_response WHERE tokens IS NOT NULL) SELECT r.row_id, r.chunk_no, coalesce(line, '') AS line FROM r LEFT JOIN (SELECT rid, string_agg({_ANN}, '' ORDER BY pos) AS line FROM (SELECT rid, unnest(range(len(tokens))) AS pos, unnest(tokens) AS t FROM r) GROUP BY rid) USING (rid)",
        "group_sentences": f"WITH {_GROUPED} SELECT row_id, chunk_no, sent_no, sentence FROM grouped",
        "fix_case": f"WITH {_repaired()} SELECT row_id, chunk_no, sent_no, fixed FROM repaired",
        "skip_reason": f"WITH {_GROUPED} SELECT *, {_reason('word', 'punct', 'mi', 'lt')} AS reason FROM (SELECT DISTINCT {tw} AS word, {tpunct} AS punct, {tmi} AS mi FROM (SELECT unnest({_tok('sentence')}) AS token FROM grouped))",
        "tagged_corpus": f"WITH {_repaired()}, {_judged('SELECT rid, row_id, chunk_no, sent_no, fixed AS text FROM repaired', 'rid, row_id, chunk_no, sent_no', 'lt')} SELECT row_id, chunk_no, sent_no, clean AS text FROM judged WHERE ok AND NOT short",
        "sentence_split": _SENTENCES,
        "attach_punct": f"WITH {judged_train} SELECT sent_id, clean AS line FROM judged",
        "sentence_ok": f"WITH {judged_train} SELECT sent_id, ok FROM judged",
        "clean_corpus": f"WITH {_judged(f'SELECT doc_id, sent_no, sentence AS text FROM ({_SENTENCES})', 'doc_id, sent_no', 'lt')} SELECT doc_id, sent_no, clean AS text FROM judged WHERE ok AND NOT short",
        "clean_counts": f"WITH {judged_train} SELECT count(*) AS lines, count(*) FILTER (ok AND NOT short) AS kept, count(*) FILTER (ok AND short) AS short, count(*) FILTER (NOT ok) AS skipped FROM judged",
        "stream_clean": f"WITH {judged_train} SELECT sent_id, clean AS text FROM judged WHERE ok AND NOT short",
        "split_hash": f"SELECT sent_id, CASE WHEN {draw} < 0.05 THEN 'dev' WHEN {draw} < 0.1 THEN 'test' ELSE 'train' END AS part FROM train",
        "split_capped": f"""WITH a AS (SELECT sent_id, {draw} AS u, len({_tok('text')}) AS w FROM train WHERE text IS NOT NULL),
            b AS (SELECT *, coalesce(sum(w) FILTER (u < 0.05) OVER (ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
            c AS (SELECT sent_id, u, w, u < 0.05 AND before < {cap} AS dev FROM b),
            d AS (SELECT *, coalesce(sum(w) FILTER (u < 0.1 AND NOT dev) OVER (ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
            SELECT sent_id, CASE WHEN dev THEN 'dev' WHEN u < 0.1 AND before < {cap} THEN 'test' ELSE 'train' END AS part FROM d""",
        "split_counts": f"SELECT split, count(*) AS lines, sum(len({_tok('text')}))::BIGINT AS words FROM (SELECT split, text FROM train UNION ALL SELECT split, text FROM dev UNION ALL SELECT split, text FROM test) WHERE text IS NOT NULL GROUP BY split",
        "shard_modulo": "SELECT sent_id, ((row_number() OVER (ORDER BY sent_id) - 1) % 6)::INT AS shard FROM train",
        "epoch_shuffle": "SELECT sent_id, row_number() OVER (ORDER BY md5('7-1-' || sent_id)) - 1 AS place FROM train",
        "batching": "SELECT sent_id, n // 128 AS batch_no, n % 128 AS batch_pos FROM (SELECT sent_id, row_number() OVER (ORDER BY sent_id) - 1 AS n FROM train)",
        "sort_by_length": f"SELECT sent_id, batch_no, (row_number() OVER (PARTITION BY batch_no ORDER BY l DESC, sent_id) - 1)::INT AS rank FROM (SELECT sent_id, (row_number() OVER (ORDER BY sent_id) - 1) // 128 AS batch_no, coalesce(len({_tok('text')}), 0) AS l FROM train)",
        "piece_counts": f"SELECT word, ceil(length(word) / {size}.0)::INT AS pieces FROM ({_WORDS}) WHERE word <> ''",
        "drop_long_sentences": f"WITH {words(True, True)} SELECT doc_id, sent, sum(c)::BIGINT AS tokens FROM words GROUP BY doc_id, sent",
        "pack_sequences": packs(False, False, True, True) + summary,
        "pack_with_carry": carried + summary,
        "pack_inference": packs(False, True, False, False) + summary,
        "features": f"{feature_rows} SELECT doc_id, row, {', '.join(f'{lines(a)} AS {a}' for a in arrays)}, label_len FROM feats",
        "pad_features": f"""WITH {train_arrays} SELECT sent_id, {lines(pad(tp))} AS token_ids, {lines(pad(te))} AS case_labels, {lines(pad("list_concat([0], ps, [0])"))} AS punct_labels, {lines(pad("list_concat([1], v, [1])"))} AS valid_ids,
            {lines(pad(f"list_transform({tp}, lambda z: 1)"))} AS token_masks, {lines(pad(f"list_transform({te}, lambda z: 1)"))} AS label_masks, (len(cs) + 2)::INT AS label_len FROM tr WHERE len(i) < {length - 10}""",
        "active_mask": f"WITH {train_arrays} SELECT sent_id, {lines('list_transform(list_filter(range(len(v)), lambda k: v[k + 1] = 1), lambda k: k + 1)')} AS active FROM tr",
        "compact_valid": f"WITH {train_arrays}, cv AS (SELECT sent_id, i, list_transform(list_filter(range(len(v)), lambda k: v[k + 1] = 1), lambda k: i[k + 1]) AS kept FROM tr) SELECT sent_id, {lines('list_concat(kept, list_transform(range(len(i) - len(kept)), lambda z: 0))')} AS compacted FROM cv",
        "score_features": f"{carried} SELECT (f % 3)::INT AS case_id, (f % 6)::INT AS punct_id, count(*) AS n FROM (SELECT ({ids('word')})[1] AS f FROM full_words WHERE c > 0) GROUP BY ALL",
        "render_sentence": f"SELECT sent_id, string_agg(CASE case_id WHEN 2 THEN {_title('word')} WHEN 1 THEN upper(word) ELSE word END || coalesce({_name('punct_id', {k: n for k, n in PUNCTUATION_NAMES.items() if k})}, ''), ' ' ORDER BY pos) AS text FROM ({label_words}) GROUP BY sent_id",
        "corpus_totals": f"SELECT (SELECT count(*) FROM documents WHERE len({_tok('text')}) > 0) AS sentences, count(*) FILTER (word <> '') AS words FROM ({_DOC_WORDS})",
        "punct_distribution": f"SELECT {_name('label', PUNCTUATION_NAMES)} AS name, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM (SELECT {_punct_id('punct')} AS label, count(*) AS n FROM ({_DOC_WORDS}) WHERE word <> '' GROUP BY 1)",
        "case_distribution": f"SELECT {_name('label', CASE_NAMES)} AS name, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM (SELECT {_case('word')} AS label, count(*) AS n FROM ({_DOC_WORDS}) WHERE word <> '' GROUP BY 1)",
        "label_counts": _counts("prediction_pair"),
        "label_counts_dedup": _counts(latest),
        "prf_by_label": f"SELECT head, label, round({prf[0]}, 6) AS precision, round({prf[1]}, 6) AS recall, round(CASE WHEN {prf[0]} > 0 THEN CASE WHEN {prf[1]} > 0 THEN 2 * ({prf[0]}) * ({prf[1]}) / ({prf[0]} + {prf[1]}) ELSE 0 END END, 6) AS f1 FROM ({_counts('prediction_pair')})",
        "prf_overall": f"""WITH s AS (SELECT head, coalesce(sum(predicted) FILTER (label > 0 AND expected > 0), 0) AS predicted, coalesce(sum(expected) FILTER (label > 0 AND expected > 0), 0) AS expected, coalesce(sum(correct) FILTER (label > 0 AND expected > 0), 0) AS correct FROM ({_counts("prediction_pair")}) GROUP BY head),
            pr AS (SELECT head, coalesce({prf[0]}, 0) AS p, coalesce({prf[1]}, 0) AS r FROM s) SELECT head, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr""",
        "progress_totals": "SELECT run_id, saved_at, read_rows, sentences_written, words_written, total_rows FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY saved_at DESC NULLS LAST, read_rows DESC NULLS LAST, sentences_written DESC NULLS LAST, words_written DESC NULLS LAST, total_rows DESC NULLS LAST) AS rn FROM run_state) WHERE rn = 1",
        "vector_mean": "SELECT label, idx, round(avg(x), 6) AS value FROM (SELECT label, (unnest(range(len(embedding))))::INT AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, idx",
        "ema": "SELECT user_id, count(value) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda acc, x: acc * 0.95 + x * 0.05), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY user_id",
        "best_so_far": "SELECT event_type, day, loss, min(loss) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2)",
        "argmax": f"SELECT vec_id, (list_position(v, list_max(v)) - 1)::BIGINT AS idx FROM {vec}",
        "softmax": each("list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))"),
        "layer_norm": each(f"list_transform(v, lambda x: (x - {mean}) / sqrt(list_sum(list_transform(v, lambda y: (y - {mean}) * (y - {mean}))) / len(v) + 1e-12))"),
        "cross_entropy": f"SELECT vec_id, round(a, 6) AS case_loss, round(b, 6) AS punct_loss, round(a + 0.7 * b, 6) AS loss FROM (SELECT vec_id, {xent('v[1:3]', '(label % 3)')} AS a, {xent('v[4:9]', '(label % 6)')} AS b FROM {vec})",
        "neighbor_pair": f"SELECT sent_id, pos, coalesce(lag(token) OVER w, token) AS previous, token AS word, coalesce(lead(token) OVER w, token) AS next FROM ({_TRAIN_WORDS}) WINDOW w AS (PARTITION BY sent_id ORDER BY pos)",
        "eden_schedule": f"SELECT batch, epoch, round(0.003 * pow((batch * batch + 25000000.0) / 25000000.0, -0.25) * pow((epoch * epoch + 36.0) / 36.0, -0.25) * {warm}, 9) AS eden, round(0.04 * pow((batch * batch + 25000000.0) / 25000000.0, -0.5) * {warm}, 9) AS eden2 FROM (SELECT range AS batch, range // 2500 AS epoch FROM range(0, 20000, 100))",
    }
