"""Words, their punctuation and their labels, as expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, tokens

# Labels of casing and of punctuation.
LOWER, UPPER, CAPITAL = 0, 1, 2
CASE_NAMES = {0: "LOWER", 1: "UPPER", 2: "CAP"}
PUNCTUATION = ("", ",", ".", "?", "!", ";", "—", ":")
PUNCTUATION_IDS = {"": 0, ",": 1, ".": 2, "?": 3, "!": 2, ":": 4, "—": 5, ";": 1}
PUNCTUATION_NAMES = {0: "", 1: ",", 2: ".", 3: "?", 4: ":", 5: "—"}
# Quotation marks and bullets that cleaning turns into blanks, and hyphens that count as a dash.
DROPPED = "\"'`¨´ʼʽˈ‘”‟•′″Ꞌꞌ"
HYPHENS = "-‐‑‒"
# Letters and digits as Python's `isalpha` and `isdigit` see them; letters of a cleaned sentence, by language.
WORD_CHARS = r"\p{L}\p{Nd}²³¹"
_PLAIN = f"^[{WORD_CHARS}]*$"
ALPHABETS = {"lt": "a-zA-ZąčęėįšųūžĄČĘĖĮŠŲŪŽ", "any": r"\p{L}"}


def split_word(token: Column | str) -> Column:
    """struct<word, punct>: the leading run of letters and digits, and all the rest. Null stays null in both."""
    t = col(token)
    word = F.regexp_extract(t, f"^[{WORD_CHARS}]*", 0)
    parts = F.struct(word.alias("word"), F.substr(t, F.char_length(word) + 1).alias("punct"))
    return F.when(t.rlike(_PLAIN), F.struct(t.alias("word"), F.lit("").alias("punct"))).otherwise(parts)


def parse_word(token: Column | str) -> Column:
    """struct<word, punct, mi> of `w(=MI)p`: the first `(=` up to the first `)` after it; mi is '' without a tag."""
    t, pattern = col(token), r"(?s)^(.*?)\(=([^)]*)\)(.*)$"
    tagged = t.rlike(pattern)
    rest = F.when(tagged, F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 3))).otherwise(t)
    word = F.regexp_extract(rest, f"^[{WORD_CHARS}]*", 0)
    parts = F.struct(word.alias("word"), F.substr(rest, F.char_length(word) + 1).alias("punct"))
    whole = F.struct(parts["word"].alias("word"), parts["punct"].alias("punct"), F.when(tagged, F.regexp_extract(t, pattern, 2)).otherwise("").alias("mi"))
    return F.when(t.rlike(_PLAIN), F.struct(t.alias("word"), F.lit("").alias("punct"), F.lit("").alias("mi"))).otherwise(whole)


def render_word(word: Column, punct: Column, mi: Column) -> Column:
    """The word with its punctuation, then its tag if it has one."""
    return F.concat(word, punct, F.when(mi != "", F.concat(F.lit("(="), mi, F.lit(")"))).otherwise(""))


def case_id(word: Column | str) -> Column:
    """CAPITAL if only the first character is upper case, UPPER if all are, else LOWER (also for mixed and empty words)."""
    w = col(word)
    return F.when(w.rlike(r"^\p{Lu}\P{Lu}*$"), CAPITAL).when(w.rlike(r"^\p{Lu}+$"), UPPER).otherwise(LOWER)


def mixed_case(word: Column | str) -> Column:
    """Whether an upper-case character after the first stands beside a lower-case one anywhere."""
    w = col(word)
    return w.rlike(r"(?s)^.+\p{Lu}") & w.rlike(r"\p{Ll}")


def upper_count(word: Column | str) -> Column:
    return F.regexp_count(col(word), F.lit(r"\p{Lu}"))


def punctuation_id(punct: Column | str) -> Column:
    """The label of a punctuation sign; 0 for whatever is none, null included."""
    p, out = col(punct), F.lit(0)
    for sign, i in PUNCTUATION_IDS.items():
        if i:
            out = F.when(p == sign, i).otherwise(out)
    return out


def named(label: Column | str, names: dict[int, str]) -> Column:
    """The name of a label; null for an unknown one."""
    out = F.lit(None).cast("string")
    for i, n in names.items():
        out = F.when(col(label) == i, n).otherwise(out)
    return out


def title(word: Column | str) -> Column:
    """Each run of letters with a capital first and small others, as Python's `title`."""
    runs = F.regexp_extract_all(col(word), F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def fixed_punctuation(punct: Column | str) -> Column:
    """The first usable sign of a run of signs (hyphens as a dash); the run itself if it has none."""
    p = col(punct)
    sign = F.translate(F.regexp_extract(p, rf"[,.?!;—:\-{HYPHENS[1:]}]", 0), HYPHENS, "—" * len(HYPHENS))
    return F.coalesce(F.nullif(sign, F.lit("")), p)


def drop_symbols(text: Column | str) -> Column:
    """Quotation marks and bullets as blanks, runs of blanks as one, none at the ends."""
    blanked = F.translate(col(text), DROPPED, " " * len(DROPPED))
    return F.regexp_replace(F.regexp_replace(blanked, " +", " "), r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", "")


def fixed_case(word: Column, mi: Column, position: Column) -> Column:
    """A word of two or more capitals as its tag says: numbers and abbreviations stay, names and first words get one capital, others none."""
    keep = (upper_count(word) < 2) | mi.startswith("M") | mi.startswith("X") | mi.startswith("Ya")
    return F.when(keep, word).when(mi.startswith("Np") | (position == 0), title(word)).otherwise(F.lower(word))


def has_number(word: Column | str) -> Column:
    return col(word).rlike(r"[\p{Nd}²³¹]")


def allowed_symbols(word: Column | str, alphabet: str = "lt") -> Column:
    """Whether a word is made of the alphabet's letters only; an empty word isn't. alphabet: a name of ALPHABETS, or letters as
    they stand in a character class (`a-zäöüß`)."""
    return col(word).rlike(f"^[{ALPHABETS.get(alphabet, alphabet)}]+$")


def allowed_punctuation(word: Column | str, punct: Column | str) -> Column:
    w, p = col(word), col(punct)
    return ~((w == "") & (p != "")) & p.isin(*PUNCTUATION)


def skip_reason(word: Column, punct: Column, mi: Column, alphabet: str = "lt") -> Column:
    """Why a word makes its sentence unusable, the first reason that holds; null for a good word."""
    return (
        F.when(has_number(word), "number")
        .when(mi.startswith("M") & word.rlike("[IXV]"), "roman")
        .when(mi.startswith("D"), "foreign")
        .when(~allowed_punctuation(word, punct), "punctuation")
        .when(~allowed_symbols(word, alphabet), "symbols")
    )


def usable(word: Column, punct: Column, mi: Column, alphabet: str = "lt") -> Column:
    """Whether `skip_reason` finds nothing, in fewer steps: a word of the alphabet's letters has no number and isn't empty."""
    tag = ~mi.startswith("D") & ~(mi.startswith("M") & word.rlike("[IXV]"))
    return punct.isin(*PUNCTUATION) & ((mi == "") | tag) & allowed_symbols(word, alphabet)


def labelled(text: Column | str) -> Column:
    """array<struct<word, case_id, punct_id>> of the words of a line, in lower case; words of signs only stay, empty."""

    def one(token: Column) -> Column:
        s = split_word(token)
        return F.struct(F.lower(s["word"]).alias("word"), case_id(s["word"]).alias("case_id"), punctuation_id(s["punct"]).alias("punct_id"))

    return F.transform(tokens(text), one)


def lower_line(text: Column | str) -> Column:
    """The words of a line without signs, in lower case, one blank apart."""
    words = F.transform(tokens(text), lambda t: F.lower(split_word(t)["word"]))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def rendered(word: Column, case: Column, punct: Column, legacy: bool = False) -> Column:
    """A predicted word as text. `legacy` leaves `:` and `—` out, which the first version of the renderer did."""
    w = F.when(case == CAPITAL, title(word)).when(case == UPPER, F.upper(word)).otherwise(word)
    signs = {i: n for i, n in PUNCTUATION_NAMES.items() if i and not (legacy and i > 3)}
    return F.concat(w, F.coalesce(named(punct, signs), F.lit("")))
