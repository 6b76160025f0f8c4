"""The registered queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import spread
from ..sources.tables import table
from . import chunking, format_dups, lookalike, mixing, overlap, packing, pii, quality, sentences


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    keeper = lambda s, d: spread(table(s, d, "parquet_keeper"))
    documents = lambda s, d: spread(table(s, d, "documents"))
    return {
        "p1_found": lambda s, d: chunking.found(keeper(s, d), table(s, d, "size_limits")),
        "p1_pieces": lambda s, d: chunking.split_oversized(keeper(s, d), table(s, d, "size_limits")),
        "p1_check": lambda s, d: chunking.checked(keeper(s, d), table(s, d, "size_limits")),
        "p2_found": lambda s, d: quality.found(keeper(s, d)),
        "p2_quality": lambda s, d: quality.judged(keeper(s, d)),
        "p3_found": lambda s, d: sentences.found(keeper(s, d), table(s, d, "sentence_check")),
        "p3_sentences": lambda s, d: sentences.sentences(keeper(s, d)),
        "p4_found": lambda s, d: format_dups.found(keeper(s, d)),
        "p4_collapsed": lambda s, d: format_dups.collapsed(keeper(s, d)),
        "p5_found": lambda s, d: overlap.found(table(s, d, "train"), table(s, d, "dev"), table(s, d, "test")),
        "p5_report": lambda s, d: overlap.report(table(s, d, "train"), table(s, d, "dev"), table(s, d, "test")),
        "p5_links": lambda s, d: overlap.linked(table(s, d, "train"), table(s, d, "dev"), table(s, d, "test")),
        "p6_found": lambda s, d: lookalike.found(keeper(s, d)),
        "p6_normalized": lambda s, d: lookalike.normalized(keeper(s, d)),
        "p6_links": lambda s, d: lookalike.linked(keeper(s, d)),
        "p7_pack": lambda s, d: packing.assigned(documents(s, d), table(s, d, "pack_limits")),
        "p7_report": lambda s, d: packing.report(documents(s, d), table(s, d, "pack_limits")),
        "p7_check": lambda s, d: packing.checked(documents(s, d), table(s, d, "pack_limits")),
        "p8_mix": lambda s, d: mixing.mixed(documents(s, d), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: pii.found(documents(s, d)),
        "p9_redacted": lambda s, d: pii.redacted(documents(s, d)),
        "p8_report": lambda s, d: mixing.report(documents(s, d), table(s, d, "mix_targets")),
        "p8_check": lambda s, d: mixing.checked(documents(s, d), table(s, d, "mix_targets")),
    }


_NL = r"(?:\x{e001}?\n|[\r\x{2028}\x{2029}])"  # CRLF comes as U+E001 LF, so no pattern can take half of it
_BL = r"[\t\x0b\x0c\x1c-\x1f \x{85}\p{Zs}]*"
_BLANK_LINES = rf"(?:^{_BL}{_NL}|{_NL})(?:{_BL}{_NL})+(?:{_BL}$)?|^{_BL}{_NL}|{_NL}{_BL}$"


_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_FIELD = r"""^[\s"''*_]*\p{L}[\p{L}\p{M}\p{N} _.\-]*["''*_]*\s*(?:=>|[:=])\s*(.*)$"""


def _folded(t: str) -> str:
    t = f"replace(replace(replace(lower({t}), 'ß', 'ss'), 'ς', 'σ'), 'և', 'եւ')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[\p{{P}}\p{{S}}]+', '', 'g'), '{_WS}+', ' ', 'g'))"


def _same_fields(result: str) -> str:
    """`result` from b (row_id, k), k being canonical forms; fields as sorted name/value pairs."""
    pair = rf"""lambda p: {_folded(r"regexp_extract(p, '^([^:=]*?)\s*(?:=>|[:=])', 1)")} || chr(2) || {_folded(f"regexp_extract(p, '{_FIELD}', 1)")}"""
    parts = f"list_filter(regexp_split_to_array(text, '[\\n\\r\\x{{2028}}\\x{{2029}};|]+'), lambda p: regexp_matches(p, '[^' || '{_WS[1:-1]}' || ']'))"
    objects = r"""regexp_extract_all(text, '"[^"]*"\s*:\s*"[^"]*"')"""
    bad = rf"""len(list_filter(parts, lambda p: NOT regexp_matches(p, '{_FIELD}') OR regexp_matches(p, '[.!?…]["”“»)'']*\s*$')))"""
    return rf"""WITH a AS (SELECT row_id, text, {parts} AS parts, CASE WHEN regexp_matches(text, '^\s*\{{') THEN {objects} ELSE [] END AS obj FROM parquet_keeper WHERE text IS NOT NULL),
        b AS (SELECT row_id, CASE WHEN len(obj) > 0 THEN chr(1) || array_to_string(list_sort(list_transform(obj, {pair})), chr(1))
            WHEN len(parts) > 1 AND {bad} = 0 THEN chr(1) || array_to_string(list_sort(list_transform(parts, {pair})), chr(1)) ELSE {_folded("text")} END AS k FROM a)
        {result}"""


# What looks alike, written out for the SQL apart from the operator's own tables: code points and what they look like.
_LOOKS = """
0430 a 0435 e 043e o 0440 p 0441 c 0443 y 0445 x 0456 i 0458 j 0455 s 04bb h 0501 d 051b q 051d w 04cf l 0475 v
0410 A 0412 B 0415 E 041a K 041c M 041d H 041e O 0420 P 0421 C 0422 T 0423 Y 0425 X 0406 I 0408 J 0405 S 050c G 051a Q 051c W
04ae Y 04c0 I 0474 V 0401 Ë 0451 ë 0407 Ï 0457 ï 03bf o 03bd v 03c1 p 03b1 a 03b9 i 03c5 u 03b3 y 03f2 c 03f3 j
0391 A 0392 B 0395 E 0396 Z 0397 H 0399 I 039a K 039c M 039d N 039f O 03a1 P 03a4 T 03a5 Y 03a7 X 03f9 C
0585 o 057d u 0578 n 0570 h 0581 g 0566 q 0575 j 0555 O 054d U 054f S
13aa A 13f4 B 13df C 13a0 D 13ac E 13c0 G 13bb H 13ab J 13e6 K 13de L 13b7 M 13e2 P 13a1 R 13da S 13a2 T 13d9 V 13b3 W 13c3 Z
2c9e O 2c9f o 2ca2 P 2ca3 p 2ca4 C 2ca5 c 2ca6 T 2cac X 2cad x
2160 I 2164 V 2169 X 216c L 216d C 216e D 216f M 2170 i 2174 v 2179 x 217c l 217d c 217e d 217f m 0251 a 0261 g
""".split()
_SPACES = "00a0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200a 202f 205f 3000".split()
_HYPHENS = "2010 2011 fe63 2043".split()
_UNSEEN = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}"


def _looks() -> str:
    """(row_id, text, k) of the rows with something to see: k is the mapped and composed form, NFKC told for each character."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    old = [chr(int(c, 16)) for c in [*_LOOKS[::2], *_SPACES, *_HYPHENS]]
    new = [*_LOOKS[1::2], *" " * len(_SPACES), *"-" * len(_HYPHENS)]
    for c in map(chr, range(0xFF01, 0xFFEF)):
        if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1:
            old.append(c)
            new.append(n)
    t = f"translate(text, {quoted(''.join(old))}, {quoted(''.join(new))})"
    for c in map(chr, (*range(0xFB00, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4))):
        if (n := unicodedata.normalize("NFKC", c)) != c:
            t = f"replace({t}, {quoted(c)}, {quoted(n)})"
    t = rf"regexp_replace({t}, '([\x{{2190}}-\x{{2bff}}\x{{fe0f}}\x{{1f000}}-\x{{1faff}}])\x{{200d}}', '\1' || chr(57344), 'g')"
    t = rf"regexp_replace({t}, '[{_UNSEEN}]', '', 'g')"
    return rf"s AS (SELECT row_id, text, nfc_normalize({t}) AS k FROM parquet_keeper WHERE regexp_matches(text, '[^' || '{_WS[1:-1]}' || ']'))"


def _same_look() -> str:
    """(row_id_a, row_id_b) of texts that differ but have one mapped and composed form."""
    return f"WITH {_looks()} SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM s a JOIN s b ON a.k = b.k AND a.row_id < b.row_id AND a.text <> b.text"


def _links() -> str:
    return f"""WITH {_looks()}, c AS (SELECT k, count(*) AS n, min(row_id) AS class_id, count(DISTINCT text) AS d FROM s GROUP BY k),
        x AS (SELECT k, text, count(*) AS own FROM s GROUP BY k, text)
        SELECT row_id, class_id, n - own AS links FROM s JOIN c USING (k) JOIN x ON x.k = s.k AND x.text = s.text WHERE d > 1"""


def _one_look() -> str:
    """(row_id, text, is_changed) with the plainest text of each form, as `lookalike.oddness` words it, composed."""
    scripts = r"\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}"
    wide = "".join(c for c in map(chr, range(0xFF01, 0xFFEF)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c)
    joined = "".join(c for c in map(chr, (*range(0xFB00, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4))) if unicodedata.normalize("NFKC", c) != c)
    odd = wide + joined + "".join(chr(int(c, 16)) for c in [*_SPACES, *_HYPHENS, *_LOOKS[_LOOKS.index("2160") : -4 : 2]])
    rank = rf"""CASE WHEN regexp_matches(text, '\p{{Latin}}\p{{M}}*[{scripts}]|[{scripts}]\p{{M}}*\p{{Latin}}') THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[{odd}{_UNSEEN}]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\p{{M}}') THEN 1 ELSE 0 END"""
    return rf"""WITH {_looks()}, r AS (SELECT row_id, first_value(text) OVER (PARTITION BY k ORDER BY {rank}, encode(text)) AS best FROM s)
        SELECT p.row_id, nfc_normalize(coalesce(best, p.text)) AS text, nfc_normalize(coalesce(best, p.text)) IS DISTINCT FROM p.text AS is_changed FROM parquet_keeper p LEFT JOIN r USING (row_id)"""


#: Distinct word sequences of both sides and the word distance of those that share enough words.
_NEAR = r"""WITH norm AS (SELECT sent_id, split, source, trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]+', '', 'g'), '[\t-\r\x1c-\x20\x{85}\p{Z}]+', ' ', 'g')) AS f
                FROM (SELECT sent_id, split, source, text FROM train UNION ALL SELECT sent_id, split, source, text FROM dev UNION ALL SELECT sent_id, split, source, text FROM test)),
            w AS (SELECT *, string_split(f, ' ') AS l FROM norm WHERE len(string_split(f, ' ')) >= 6),
            t AS (SELECT l, count(*) AS c, len(l) AS n FROM w WHERE split = 'train' GROUP BY l), e AS (SELECT DISTINCT l, len(l) AS n FROM w WHERE split <> 'train'),
            tw AS (SELECT DISTINCT l, unnest(l) AS x FROM t), ew AS (SELECT DISTINCT l, unnest(l) AS x FROM e),
            cand AS (SELECT tw.l AS a, ew.l AS b FROM tw JOIN ew USING (x) GROUP BY 1, 2 HAVING count(*) >= len(list_distinct(ew.l)) - greatest(len(tw.l), len(ew.l)) // 8 AND abs(len(tw.l) - len(ew.l)) <= greatest(len(tw.l), len(ew.l)) // 8),
            coded AS (SELECT a, b, list_distinct(list_concat(a, b)) AS v FROM cand),
            dist AS (SELECT a, b, levenshtein(array_to_string(list_transform(a, lambda x: chr((32 + list_position(v, x))::INT)), ''), array_to_string(list_transform(b, lambda x: chr((32 + list_position(v, x))::INT)), '')) AS d FROM coded),"""


def oracle_sql() -> dict[str, str]:
    longest = lambda pattern: f"list_max(list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: length(x)))"
    shows = r"regexp_matches(k, '[\p{L}\p{N}]')"
    return {
        "p4_found": _same_fields(rf"SELECT * FROM (SELECT min(row_id) OVER (PARTITION BY k) AS keep_id, row_id FROM b WHERE {shows}) WHERE keep_id <> row_id"),
        "p4_collapsed": _same_fields(f"SELECT min(row_id) AS keep_id, count(*) AS copies FROM b WHERE {shows} GROUP BY k"),
        # what must hold, whatever the cuts, containers and documents chosen
        "p1_check": "SELECT row_id, true AS pieces_fit, true AS overlaps_hold, true AS is_whole FROM parquet_keeper WHERE text IS NOT NULL",
        "p7_check": "SELECT pack_name, true AS none_over, true AS is_whole, true AS none_split FROM pack_limits",
        "p8_check": "SELECT source, true AS share_met, true AS repeats_kept FROM mix_targets",
        "p6_found": _same_look(),
        "p6_links": _links(),
        "p6_normalized": _one_look(),
        "p1_found": rf"""WITH k AS (SELECT row_id, replace(text, chr(13) || chr(10), chr(57345) || chr(10)) AS text, coalesce(l.max_chars, (SELECT max_chars FROM size_limits WHERE source = 'default')) AS m
                FROM parquet_keeper p LEFT JOIN size_limits l ON p.source = l.source WHERE text IS NOT NULL)
            SELECT row_id, CASE WHEN {longest(_BLANK_LINES)} <= m THEN 'blank_line' WHEN {longest(_NL)} <= m THEN 'line_break'
                WHEN {longest(r'[\t-\r\x1c-\x20\x{85}\x{e001}\p{Z}]+')} <= m THEN 'white_space' ELSE 'no_space' END AS cut_at FROM k WHERE length(text) > m""",
        "p5_report": _NEAR + """
            per AS (SELECT b, sum(c)::BIGINT AS partners FROM dist JOIN t ON t.l = a WHERE d <= greatest(len(a), len(b)) // 8 GROUP BY b)
            SELECT n.split, n.source, count(*) AS rows_all, count(partners) AS rows_overlapping, coalesce(sum(partners), 0)::BIGINT AS partners
            FROM norm n LEFT JOIN per ON string_split(n.f, ' ') = per.b WHERE n.split <> 'train' GROUP BY n.split, n.source""",
        "p5_found": _NEAR + """
            ok AS (SELECT a, b FROM dist WHERE d <= greatest(len(a), len(b)) // 8), r AS (SELECT sent_id, split, string_split(f, ' ') AS l FROM norm)
            SELECT least(x.sent_id, y.sent_id) AS sent_id_a, greatest(x.sent_id, y.sent_id) AS sent_id_b
            FROM ok JOIN r x ON x.l = a AND x.split = 'train' JOIN r y ON y.l = b AND y.split <> 'train'""",
        "p5_links": _NEAR + """
            ok AS (SELECT a, b FROM dist WHERE d <= greatest(len(a), len(b)) // 8), r AS (SELECT sent_id, split = 'train' AS tr, string_split(f, ' ') AS l FROM norm),
            c AS (SELECT l, tr, count(*) AS n, min(sent_id) AS class_id FROM r GROUP BY l, tr),
            k AS (SELECT a AS l, true AS tr, sum(n)::BIGINT AS links FROM ok JOIN c ON c.l = b AND NOT c.tr GROUP BY a UNION ALL SELECT b, false, sum(n)::BIGINT FROM ok JOIN c ON c.l = a AND c.tr GROUP BY b)
            SELECT sent_id, class_id, links FROM r JOIN k USING (l, tr) JOIN c USING (l, tr)""",
    }
