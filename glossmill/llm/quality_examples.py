"""Texts of known kind that come from no corpus, for the mixture of `quality`: prose in several languages and forms, lists,
tables, and what nobody reads as sentences (program code, logs, key noise, encoded bytes, boilerplate of signs)."""

from __future__ import annotations

import random

from .pii_examples import sentence

# Letters from which words of other scripts are made.
SCRIPTS = {"cyrillic": "абвгдежзийклмнопрстуфхцчшыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "latin": "abcdefghijklmnoprstuvyz"}
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长"
# Words of program text, log lines and lists.
CODE = """def {a}({b}, {c}=None):\n    return {b} + {c}
for {a} in range({n}):\n    {b}[{a}] = {c}({a})
if ({a} != null && {b}.length > {n}) {{ {c}({a}); }}
const {a} = ({b}) => {b}.map({c} => {c} * {n});
SELECT {a}, count(*) FROM {b} WHERE {c} > {n} GROUP BY {a};
<div class="{a}"><a href="/{b}/{n}">{c}</a></div>
import {a}\nfrom {b} import {c}
public static int {a}(String {b}) {{ return {c}.get({n}); }}
#include <{a}.h>\nint {b}[{n}];
{a}: &{b} {{ margin: {n}px; {c}: {n}% }}
print(f"{{{a}}} {{{b}:.2f}}", file={c})
try:\n    {a}.{b}()\nexcept {c} as e:\n    raise""".split("\n\n")[0].split("\n")
LEVELS, MODULES = "INFO WARN ERROR DEBUG TRACE".split(), "http.server db.pool auth worker-3 kernel nginx cron scheduler".split()
NOUNS = """apples bread milk chairs lamps paper tables books windows doors bolts screws paint rope flour sugar candles batteries duonos
pieno sviesto obuolių knygų kėdžių lentų vinių dažų virvių Milch Brot Käse Stühle Lampen pain lait chaises livres clous""".split()


def _word(rng: random.Random, script: str = "latin", low: int = 2, high: int = 10) -> str:
    return "".join(rng.choice(SCRIPTS[script]) for _ in range(rng.randrange(low, high)))


def _value(rng: random.Random) -> str:
    return rng.choice([lambda: str(rng.randrange(1, 10_000)), lambda: f"{rng.random() * 100:.2f}", lambda: _word(rng).capitalize(), lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}", lambda: rng.choice(NOUNS), lambda: f"{_word(rng)} {_word(rng)}"])()


def _code(rng: random.Random) -> str:
    line = lambda: rng.choice(CODE).format(a=_word(rng), b=_word(rng), c=_word(rng), n=rng.randrange(1, 500))
    return "\n".join("    " * rng.randrange(0, 3) + line() for _ in range(rng.randrange(3, 25)))


def _log(rng: random.Random) -> str:
    at = lambda: f"20{rng.randrange(15, 27)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}{rng.choice(' T')}{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}"
    style = rng.randrange(3)
    one = [
        lambda: f"{at()},{rng.randrange(1000):03} {rng.choice(LEVELS)} {rng.choice(MODULES)}: {rng.choice(['connection', 'request', 'job', 'query'])} {_word(rng)}={rng.randrange(9999)} {rng.choice(['ok', 'failed', 'took'])} {rng.randrange(999)}ms",
        lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} - - [{at()}] \"GET /{_word(rng)}/{_word(rng)}.html HTTP/1.1\" {rng.choice([200, 304, 404, 500])} {rng.randrange(99999)}",
        lambda: f"[{at()}] [{rng.choice(LEVELS)}] {rng.choice(MODULES)}[{rng.randrange(9999)}] 0x{rng.randrange(16**8):08x} {_word(rng)}",
    ][style]
    return "\n".join(one() for _ in range(rng.randrange(3, 20)))


def _noise(rng: random.Random) -> str:
    u = rng.randrange(5)
    if u == 0:  # keys at random
        return " ".join("".join(rng.choice(rng.choice(["asdfghjkl", "qwertyuiop", "zxcvbnm", "bcdfghjklmnpqrstvwxz"])) for _ in range(rng.randrange(3, 14))) for _ in range(rng.randrange(4, 60)))
    if u == 1:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randrange(60, 600))) + "=" * rng.randrange(3)
    if u == 2:
        return rng.choice([" ", "", "\n"]).join("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((2, 8, 32)))) for _ in range(rng.randrange(8, 60)))
    if u == 3:
        return "".join(rng.choice("#@{}[]<>|^&*%$=+-_\\/~!?;: ") for _ in range(rng.randrange(20, 300)))
    w = [_word(rng) for _ in range(rng.randrange(1, 4))]
    return " ".join(rng.choice(w) for _ in range(rng.randrange(12, 90)))


def _table(rng: random.Random) -> str:
    sep = rng.choice([",", ",", ";", "\t", "|", " | ", "  ", "   ", ", "][:8])
    n, makers = rng.randrange(3, 9), None
    head = [_word(rng, rng.choice(["latin", "latin", *SCRIPTS])).capitalize() for _ in range(n)]
    rows = [[_value(rng) for _ in range(n)] for _ in range(rng.randrange(3, 25))]
    lines = [sep.join(r) for r in ([head] if rng.random() < 0.8 else []) + rows]
    if sep == " | " and rng.random() < 0.7:
        lines = [f"| {x} |" for x in lines]
        lines.insert(1, "|" + "---|" * n)
    return "\n".join(lines)


def _list(rng: random.Random) -> str:
    script = rng.choice(["latin", "latin", *SCRIPTS])
    item = lambda: " ".join(rng.choice(NOUNS) if script == "latin" and rng.random() < 0.7 else _word(rng, script) for _ in range(rng.choice((1, 1, 2, 3)))) + rng.choice(["", "", f", {rng.randrange(1, 90)} kg", f" ({rng.randrange(1, 90)})"])
    n = rng.randrange(4, 25)
    u = rng.randrange(4)
    if u == 0:
        return "\n".join(f"{rng.choice(['- ', '- ', '- '])}{item()}" for _ in range(n)) if rng.random() < 0.5 else "\n".join(f"• {item()}" for _ in range(n))
    if u == 1:
        end = rng.choice([".", ")"])
        return "\n".join(f"{k + 1}{end} {item()}" for k in range(n))
    if u == 2:
        sign = rng.choice([": ", ": ", " = ", ":\t"])
        return rng.choice(["\n", "\n", "; ", " | "]).join(f"{_word(rng, script, 3).capitalize()}{sign}{_value(rng) if rng.random() < 0.6 else item()}" for _ in range(rng.randrange(3, 12)))
    return rng.choice([", ", "; ", "\n", ", "]).join(item() for _ in range(n + 4))


def _prose(rng: random.Random) -> str:
    u = rng.random()
    if u < 0.6:
        text = " ".join(sentence(rng)[0].strip() for _ in range(rng.randrange(1, 6)))
        return text.lower().replace(",", "").replace(".", "") if rng.random() < 0.12 else text
    if u < 0.7:  # a script without spaces
        return "".join("".join(rng.choice(HAN) for _ in range(rng.randrange(6, 24))) + rng.choice("。。，！？") for _ in range(rng.randrange(2, 20)))
    script = rng.choice(list(SCRIPTS))
    words = [_word(rng, script, 2, 9) for _ in range(60)]
    small = [_word(rng, script, 1, 4) for _ in range(8)]
    line = lambda: " ".join(rng.choice(small) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(7, 18))).capitalize() + rng.choice([".", ".", ".", "?", "!"])
    return rng.choice([" ", " ", "\n"]).join(line() for _ in range(rng.randrange(2, 12)))


def invented(rng: random.Random) -> tuple[str, str]:
    """(text, kind)."""
    make, kind = rng.choice([(_code, "junk"), (_log, "junk"), (_noise, "junk"), (_table, "table"), (_table, "table"), (_list, "list"), (_list, "list"), (_prose, "prose"), (_prose, "prose"), (_prose, "prose")])
    return make(rng), kind
