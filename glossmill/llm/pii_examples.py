"""Labelled spans of personal data for training the tagger of `pii`.

Two kinds of examples. `annotate` labels documents of a corpus by the conventions of its contact lines, and `varied` puts
other names, streets, numbers and cases in their place. `sentence` makes labelled text that owes nothing to any corpus:
names, streets, phone, identity and mail formats of many countries, built from parts and from random syllables, in
sentences of several languages, beside firms, places and numbers that are no personal data. Nothing here is used by the
operator itself.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")
# Given names and their Lithuanian case forms that the corpus uses.
GIVEN = """
Darius Dariaus Dariui Andrius Andriaus Andriui Marius Mariaus Mariui Jonas Jono Jonui Vytas Vyto Vytui Tomas Tomo Tomui
Kęstas Kęsto Kęstui Petras Petro Petrui Jūratė Jūratės Jūratei Živilė Živilės Živilei Eglė Eglės Eglei Milda Mildos
Mildai Rasa Rasos Rasai Ona Onos Onai Daiva Daivos Daivai Aušra Aušros Aušrai Peter Alice George Helen Anna Karl Jürgen
Ute Ewa Adam Marek Łucja Ольга Пётр Анна Иван
""".split()
# Endings of family names.
FAMILY = "auskas ausko auskui ienė ienės ienei ytė ytės ytei worth well berger wicz енко".split()
_U = "A-ZĄČĘĖĮŠŲŪŽĆŁŃÓŚŹŻÄÖÜА-ЯЁ"
_TOWN = rf"(?:, (?:LT-)?(?:\d\d-\d{{3}} |\d{{5}} )?[{_U}][\w-]+)?"


def _patterns(nocase: bool) -> list[tuple[str, re.Pattern]]:
    flags = re.I if nocase else 0
    u = r"[^\W\d_]" if nocase else f"[{_U}]"
    given = "(?:" + "|".join(sorted((g for g in GIVEN), key=len, reverse=True)) + ")"
    family = rf"(?:{u}[^\W\d_]{{2,}}(?:{'|'.join(FAMILY)}|{'|'.join(f.upper() for f in FAMILY)}))(?!\w)"
    first = rf"(?:(?<!\w){given}|(?<![\w.]){u}\.)"
    middle = r"(?: [^\W\d_]\.)?"
    name = rf"{first}{middle}\s{family}|(?<!\w){family}\s(?:{given}(?!\w)|{u}\.(?!\s?(?:k|y|t)\.))|(?<!\w){family}"
    street = rf"(?<!\w){u}[^\W\d_]+"
    number = r"\d+\s?[A-Za-z]?(?:[-/]\d+)?(?!\w)"
    address = [
        rf"{street} (?:g|pr|al|pl)\. (?:[Nn]r\. )?{number}{_TOWN}",
        rf"{street} gatvė {number}{_TOWN}|{street} gatvėje, \d+ name{_TOWN}",
        rf"(?<![\w-])\d+[A-Za-z]? {street} (?:Street|Lane|Road|Avenue|Square)(?:, Flat \d+)?{_TOWN}",
        rf"{street}(?:straße|str\.|weg|platz|allee|gasse) {number}{_TOWN}|{street} (?:Straße|Weg|Platz|Allee) {number}{_TOWN}",
        rf"(?<=[uUaApP][lL]\. ){street}(?:owa|owska|a) {number}{_TOWN}",
        rf"(?<=[уУ]л\. ){street}, (?:д\. )?\d+(?:, кв\. \d+)?",
    ]
    email = r"[\w.+-]+ ?(?:@|[\[({](?:at|eta|@)[\])}]) ?[\w-]+(?:\.[\w-]+)+"
    phone = [
        r"(?:\+|(?<![\w-])00)370[ .-]?\(?\d{3}\)?[ .-]?\d{2,3}[ .-]?\d{2,3}(?!\d)",
        r"\(8[ ~-]?\d{1,3}\) \d{3}\s?\d{2,4}(?!\d)|\(8[ ~-]\d{3}\) \d{5}(?!\d)",
        r"(?<![\w.,-])[80][ -]600[ -](?:\d{5}|\d\d \d{3})(?!\d)",
        r"(?:\+1[ -]|(?<![\w-]))\(?212\)?[ -]555-\d{4}(?!\d)|(?:\+44 |(?<!\w)0)7700 900\d{3}(?!\d)",
        r"(?:\+48 |(?<![\w-]))500[ -]\d{3}[ -]\d{3}(?!\d)",
        r"(?:(?:\+49 |(?<!\w)0049 ?)30[ /]?|\(030\) ?|(?<!\w)030[/ ])23125 ?\d{3}(?!\d)",
        r"(?:\+7 |(?<![\w-])8 )\(?000\)? \d{3}[ -]\d\d[ -]\d\d(?!\d)",
    ]
    ident = [
        r"(?:(?<=kodas )|(?<=kodas: )|(?<=a\. k\. )|(?<=PESEL )|(?<=pesel )|(?<=личный код ))[3-9]\d{10}(?!\d)|(?<=[Nn]r\. )[3-6]\d{10}(?= priklauso)",
        r"(?<![\w-])[3-6][ -]\d{6}[ -]\d{4}(?!\d)|(?<=;)[3-6]\d{10}(?=;)",
        r"(?<![\w-])000-\d\d-\d{4}(?!\d)|(?<!\w)QQ \d\d \d\d \d\d [A-D](?!\w)",
        r"(?<!\w)[A-Z]\d{8}[A-Z](?!\w)",
    ]
    out = [("email", email), *(("phone", p) for p in phone), *(("id_number", p) for p in ident), *(("address", p) for p in address), ("name", name)]
    return [(k, re.compile(p, flags)) for k, p in out]


_CASED, _NOCASE = _patterns(False), _patterns(True)


def annotate(text: str, ordinary: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans of a text. `ordinary`: words, in lower case, that are no family names."""
    spans: list[tuple[int, int, str]] = []
    for kind, p in _NOCASE if text == text.lower() else _CASED:
        for m in p.finditer(text):
            a, b = m.span()
            if kind == "name" and m[0].lower() in ordinary:
                continue
            if all(b <= x or a >= y for x, y, _ in spans):
                spans.append((a, b, kind))
    return sorted(spans)


# Given names of many countries. Tests use names that aren't here.
GIVEN_WORLD = """
James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas
Sarah Emily Laura Emma Olivia Jack Harry Oliver Hannah Lukas Felix Johanna Stefan Sabine Klaus Heike Matthias Pierre Jean
Camille Antoine Claire Julien Luc Hélène José María Carmen Luis Javier Lucía Pablo Diego Giulia Marco Francesca Luca
Alessandro Paolo João Ana Beatriz Tiago Lars Ingrid Sven Astrid Erik Freja Mikko Aino Jari Katarzyna Piotr Agnieszka
Tomasz Zofia Andrzej Jan Eva Jiří Václav Milan Zoran Jelena Dragan Ivana László Zsófia Gábor Ion Elena Andrei Mihai
Георгий Дмитрий Наталья Сергей Татьяна Олег Людмила Dmitri Natalia Sergei Olga Vladimir Oksana Taras Levon Ani Giorgi
Nino Mehmet Ayşe Emre Fatma Ahmed Fatima Omar Layla Youssef Khalid Aisha Reza Leila Arjun Priya Rahul Ananya Vikram
Sunita Ravi Wei Li Ming Xiu Jing Hao Hiroshi Yuki Kenji Sakura Haruto Ji-woo Min-jun Seo-yeon Nguyen Linh Minh Kofi Kwame
Ama Chinedu Ngozi Amara Tunde Zanele Thabo Wanjiru Tesfaye Selam Kipras Lukas Gintaras Rūta Ieva Agnė Justė Matas Simonas
Jānis Anita Kristaps Mart Liina Dovilė Paulius Ramunė Vytautas Algirdas Birutė
""".split()
# Family names of many countries; most are built from FAMILY_ENDS and FAMILY_PARTS instead.
FAMILY_WORLD = """
Smith Jones Brown Taylor Davies Evans Walker White Hall Clarke Wright Hughes Edwards Murphy Kelly Ryan O'Connor O'Brien
McDonald MacLeod Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Klein Wolf Neumann Dubois Durand Moreau
Laurent Lefèvre Roux Petit García Martínez López Ruiz Romero Torres Navarro Rossi Russo Bianchi Greco Conti Silva Santos
Pereira Costa Almeida Nagy Kovács Szabó Tóth Novák Svoboda Dvořák Horvat Popov Ionescu Yılmaz Demir Kaya Khan Ali Hussain
Haddad Mansour Singh Patel Sharma Gupta Iyer Reddy Wang Li Zhang Chen Liu Wu Zhao Huang Lin Kim Park Lee Choi Jung Tran
Pham Tanaka Suzuki Mensah Osei Boateng Okafor Adeyemi Diallo Traoré Keita Ndlovu Dlamini Kamau Otieno Abebe Bekele Cohen
Levi Kazlauskas Jankauskas Butkus Žukauskaitė Petrauskaitė Bērziņš Ozols Tamm Saar Иванов Смирнова Кузнецов Соколова
""".split()
# Endings of family names by language, and parts that make English, German, Japanese and Nordic ones.
FAMILY_ENDS = "ov ova ev eva in sky ski ska wicz czyk enko chuk yan ian shvili dze ez es ini etti elli ucci eau ault ard escu opoulos idis akis oğlu sen son sson nen lainen auskas aitis aitė ūnas ienė ytė iņš mann inger bauer ová ević ić ов ова ев ева ин ский ская енко чук".split()
FAMILY_PARTS = (
    ("Black White Green Ash Hart Wood Har Brad Whit Win Sher Bark Dal Lang Rad Thorn Hollo".split(), "field ford ton well worth man son ley wood ham by brook way".split()),
    ("Stein Berg Rosen Gold Winter Sommer Reich Lind Kirch Eisen Hohen Bach".split(), "berg stein mann feld hauer thal meyer hofer blum ner baum".split()),
    ("Ya Ta Naka Ko Mori Ishi Mura Saka Matsu Fuji Hara Waka Ueda Kita".split(), "moto shita mura kawa yama da no gawa saki naka".split()),
    ("Lind Berg Söder Nor Hag Sjö Eng Bjørk Dal Hol".split(), "qvist ström gren lund dahl berg strand mark".split()),
)
# Towns, firms' endings, and capitalised words that are no names of persons.
TOWNS = """London Paris Berlin Madrid Rome Vilnius Kaunas Klaipėda Riga Warszawa Kraków Praha Wien München Hamburg Lyon Lisboa
Oslo Stockholm Helsinki Tallinn Budapest Athens Istanbul Cairo Lagos Nairobi Accra Delhi Mumbai Beijing Shanghai Tokyo Osaka
Seoul Sydney Toronto Boston Chicago Denver Austin Москва Киев Šiauliai Panevėžys Dublin Leeds Bristol York""".split()
FIRM_ENDS = ["Ltd", "Inc.", "LLC", "GmbH", "AG", "S.A.", "& Co.", "& Sons", "Group", "Bank", "Motors", "Airlines", "University", "Museum", "Hotel", "Press", "River", "Bridge", "Station", "Park", "Street Market", "Sp. z o.o.", "AB", "UAB"]
PLAIN = """Monday Tuesday Friday January March April July Python Europe Africa America Asia Russian German English French Chinese
Internet Windows Linux Parliament Government President Minister Director Committee Union Article Section Chapter Table Figure
Yesterday Today Tomorrow However Therefore Although Nothing Everyone Somebody Please Thanks Regards Hello Dear Vakar Šiandien
Rytoj Kodėl Taip Tačiau Gerai Labas Miestas Mokykla Lietuva Europa Knyga Namas Heute Gestern Danke Haus Schule Zeit Wczoraj
Dzisiaj Dzień Szkoła Bonjour Maison Merci Demain Hola Gracias Casa Mañana Вчера Сегодня Завтра Спасибо Школа""".split()
# Sentences with slots: N name, P phone, E mail, I identity number, A address; F firm, T town, D number that is no personal
# data, W capitalised word, U web address or file, H user handle. `a|b` stands for either.
CARRIERS = """
Mr|Mrs|Ms|Dr|Dr.|Prof. {N} left early.
See|Visit|Read|Open {U} for more, version {D}.
User {H} wrote to {N}: see {U}
Žr. {U} arba rašykite {E}. Naudotojas {H} atsakė {N}.
Siehe {U}. {W} hat {H} gefragt.
{N} left early|arrived late|smiled|said nothing|went home|called yesterday|won the race|was born in {T}.
{N}, {N} and {N} signed the letter.
Yesterday {N} told {N} about {F}.
The report was written by {N} and printed in {T}.
Please call {N} on|at {P} or write to {E}.
Contact: {N}, {A}, {P}, {E}
Name: {N}\\nAddress: {A}\\nPhone: {P}\\nEmail: {E}
Dear {N},\\nthank you for your letter.\\nRegards,\\n{N}
I met {N} in {T} on {W}. She lives at {A}.
He moved to {A} last year; his SSN|ID number|national ID|identity number is {I}.
SSN {I}, {N}, {A}.
Order no.|Order number {D} was shipped to {N}, {A}.
The parcel for {N} went to {A}.
My number is {P}. Tel. {P}, fax {P}.
Ring {P} after six. Call ({P}) or mail {E}!
According to {N}, {F} bought {F} for {D} euros.
{F} opened a shop in {T}. The train to {T} leaves at {D}.
ISBN {D}, invoice {D}, account {D}, version {D}.
{W} and {W} were in {T} with {N}.
{N} ({T}) beat {N} ({T}) in the final.
Author: {N}. Publisher: {F}, {T}. ISBN {D}
"{N}, come here!" shouted {N}. "{W} is late."
The mayor of {T}, {N}, thanked {F}.
{N}'s book was sold out. {W} came {N}'s answer.
{N} paliko salę anksti. {N} atvyko į {T}.
Kreipkitės į {N} tel. {P} arba el. paštu {E}.
{N} gyvena adresu {A}, asmens kodas {I}.
Ponas|Ponia|Gerb. {N}, jūsų užsakymas nr. {D} išsiųstas.
Pasak {N}, {F} pardavė {D} knygų. {W} lijo.
{F} atidarė parduotuvę mieste {T}. {W} buvo šilta.
Herr|Frau {N} wohnt in der|am {A}. Telefon: {P}
{N} kam gestern aus {T}. {N} lachte. {W} regnet es.
Schreiben Sie an {E}. Ausweisnummer {I}. Bestellnummer {D}.
Pan|Pani {N} mieszka przy ul. {A}, PESEL {I}, tel. {P}.
{N} kupił dom w {T}. {W} pada. Firma {F} zamknięta.
M.|Mme|Monsieur|Madame {N} habite {A}. Téléphone : {P}.
{N} a écrit à {N} le {D}. {W}, il pleut à {T}.
Señor|Señora|Don {N} vive en {A}. Tel.: {P}, DNI {I}.
{N} llegó tarde. {W} llueve en {T}. Pedido {D}.
Signor|Signora {N} abita in {A}. Codice fiscale {I}. Cell. {P}
Господин|Госпожа {N} живёт по адресу: ул. {A}. Тел. {P}.
{N} приехал вчера. Заказ {D} отправлен. {W} было тепло. Паспорт {I}.
""".strip().split("\n")


_VOWELS, _CONSONANTS = "aeiouyąęėįųūó", "bdfgjklmnprstvzžščćłńś"


def _stem(rng: random.Random) -> str:
    return "".join(rng.choice(_CONSONANTS) + (rng.choice("rlv") if rng.random() < 0.3 else "") + rng.choice(_VOWELS) + (rng.choice("nrsk") if rng.random() < 0.3 else "") for _ in range(rng.choice((1, 2, 2, 3))))


def _renamed(span: str, kind: str, rng: random.Random) -> str:
    """The span with another name, street or number, in three of ten cases one of another country."""
    if rng.random() < 0.3:
        return {k: make for k, make in _SLOTS.values()}[kind](rng)
    if kind in ("phone", "id_number"):
        head = 3 if kind == "phone" else 1
        return span[:head] + "".join(rng.choice("0123456789") if c.isdigit() and rng.random() < 0.6 else c for c in span[head:])
    if kind == "name":
        ends = sorted(FAMILY, key=len, reverse=True)

        def word(m: re.Match) -> str:
            w = m[0]
            for e in ends:
                if w.lower().endswith(e) and len(w) > len(e) + 2 and not re.search("[а-яё]", w, re.I):
                    new = _stem(rng) + e
                    return new.upper() if w.isupper() else new.capitalize() if w[0].isupper() else new
            return w

        return re.sub(r"[^\W\d_]+", word, span)
    if kind == "address":
        return re.sub(r"\d", lambda m: rng.choice("123456789"), span)
    return span


def varied(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with half of its spans renamed, in one of ten cases in lower case."""
    out, at, new = "", 0, []
    for a, b, kind in spans:
        out += text[at:a]
        span = _renamed(text[a:b], kind, rng) if rng.random() < 0.5 else text[a:b]
        new.append((len(out), len(out) + len(span), kind))
        out += span
        at = b
    out += text[at:]
    if rng.random() < 0.12 and len(out.lower()) == len(out):
        out = out.lower()
    return out, new


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _shape(pattern: str, rng: random.Random) -> str:
    """d a digit, L a capital; all else as it is."""
    return "".join(rng.choice("0123456789") if c == "d" else rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "L" else c for c in pattern)


def given(rng: random.Random) -> str:
    return rng.choice(GIVEN_WORLD) if rng.random() < 0.85 else _stem(rng).capitalize()


def family(rng: random.Random) -> str:
    u = rng.random()
    if u < 0.35:
        return rng.choice(FAMILY_WORLD)
    if u < 0.6:
        a, b = rng.choice(FAMILY_PARTS)
        return rng.choice(a) + rng.choice(b)
    end = rng.choice(FAMILY_ENDS)
    if re.match("[а-я]", end):
        return "".join(rng.choice("бвгдзклмнпрст") + rng.choice("аеиоу") for _ in range(rng.choice((1, 2)))).capitalize() + rng.choice("бвдлмнрт") + end
    return (_stem(rng) + rng.choice(_CONSONANTS) + (end if u < 0.9 else rng.choice("aoei"))).capitalize()


def name(rng: random.Random) -> str:
    u = rng.random()
    f = family(rng)
    if rng.random() < 0.06:
        f = rng.choice(["van ", "de ", "von ", "van der ", "al-", "El ", "di ", "de la "]) + f
    if rng.random() < 0.06:
        f += rng.choice("- ") + family(rng)
    if rng.random() < 0.06:
        f = f.upper()
    if u < 0.6:
        return given(rng) + (f" {rng.choice('ABCDEFGHIJKLMNOPRSTUVZ')}." if rng.random() < 0.1 else f" {given(rng)}" if rng.random() < 0.06 else "") + " " + f
    if u < 0.72:
        return rng.choice("ABCDEFGHIJKLMNOPRSTUVZ") + "." + rng.choice([" ", " ", ""]) + (rng.choice("ABCDEFGHJKLM") + ". " if rng.random() < 0.2 else "") + f
    if u < 0.78:
        return f"{f} {given(rng)}" if rng.random() < 0.6 else f"{f} {rng.choice('ABDEGJKLMNRSTV')}."
    return (rng.choice(FAMILY_WORLD) if rng.random() < 0.5 else f) if u < 0.88 else rng.choice(GIVEN_WORLD)


def phone(rng: random.Random) -> str:
    sep = rng.choice([" ", " ", "-", ".", "", "/", " - "]) if rng.random() < 0.95 else "\xa0"
    groups = rng.choice([(3, 3, 4), (3, 3, 3), (2, 3, 2, 2), (2, 2, 2, 2, 2), (3, 4), (4, 4), (5, 5), (3, 5), (3, 2, 3), (2, 3, 3), (4, 3, 3), (3, 4, 4), (2, 7), (3, 6)])
    body = [_digits(rng, n) for n in groups]
    u = rng.random()
    if u < 0.45:
        lead = rng.choice(["+", "+", "+", "00"]) + rng.choice("1 7 20 27 30 31 33 34 39 44 45 46 48 49 61 81 86 91 233 234 254 353 358 370 371 372 380 420".split())
        if rng.random() < 0.25:
            body[0] = f"({body[0]})"
        return lead + (rng.choice([sep, " "]) if rng.random() < 0.9 else "") + sep.join(body)
    if u < 0.65:
        return f"({rng.choice(['0', '', '8 ', '8-', '8~'])}{body[0]}){rng.choice([' ', '', '-'])}" + sep.join(body[1:])
    body[0] = rng.choice(["0", "0", "8", "1"]) + body[0][1:]
    return sep.join(body)


_DOMAIN_ENDS = ".com .org .net .lt .de .pl .fr .es .it .ru .co.uk .io .eu .info .example .test .edu .gov.uk".split()


def email(rng: random.Random) -> str:
    plain = lambda: re.sub(r"[^a-z]", "", (given(rng) if rng.random() < 0.5 else _stem(rng)).lower()) or "info"
    local = rng.choice(["{a}.{b}", "{a}_{b}", "{a}", "{a}{n}", "{b}{n}", "{a}-{b}", "info", "{a}+{b}", "{c}.{b}", "{c}{b}"]).format(a=plain(), b=plain() + plain(), c=rng.choice("abcdefgjklmnrst"), n=rng.randrange(1, 2000))
    sign = rng.choice(["@"] * 16 + ["＠", " (at) ", "(at)", " [at] ", "[at]", "{at}", "(eta)", " @ "])
    out = local + sign + (rng.choice(["mail.", "post.", ""]) if rng.random() < 0.2 else "") + rng.choice([plain() + plain(), plain() + "-" + plain(), "gmail", "example", "inbox"]) + rng.choice(_DOMAIN_ENDS)
    return out.upper() if rng.random() < 0.04 else out.title() if rng.random() < 0.04 else out


def identity(rng: random.Random) -> str:
    return _shape(rng.choice(["ddd-dd-dddd", "ddddddddddd", "dddddddddd", "dddddd-dddd", "dddddd dddd", "ddddddddL", "Ldddddddd", "LLddddddL", "LL dd dd dd L", "ddd.ddd.ddd-dd", "dddd dddd dddd", "d dd dd dd ddd ddd dd", "dddddd-dddL", "dddddd/dddd", "LLLLLLddLddLdddL", "ddd ddd ddd", "d-dddddd-dddd", "dd.dd.dd-ddd.dd", "LddddddddL"]), rng)


def address(rng: random.Random) -> str:
    base = rng.choice([_stem(rng).capitalize(), family(rng), rng.choice("High Mill Church Park Station King Queen Oak Elm Maple Baker Long Garden Bridge Victoria".split())])
    n = rng.choice([str(rng.randrange(1, 250)), str(rng.randrange(1, 30)), f"{rng.randrange(1, 99)}{rng.choice('ABCabc')}", f"{rng.randrange(1, 99)}-{rng.randrange(1, 60)}", f"{rng.randrange(1, 99)}/{rng.randrange(1, 60)}"])
    town = rng.choice(TOWNS) if rng.random() < 0.6 else _stem(rng).capitalize() + rng.choice(["ton", "ville", "burg", "ai", "iai", "ów", "", "a"])
    zip_ = _shape(rng.choice(["ddddd", "dd-ddd", "LT-ddddd", "dddd", "LLd dLL", "Ld dLL", "dddd LL"]), rng)
    out = rng.choice([
        f"{n} {base} {rng.choice('Street St. Road Rd Avenue Ave. Lane Drive Square Court Close Way Boulevard Terrace'.split())}",
        f"{n}{rng.choice([',', ''])} {rng.choice(['rue de', 'Rue de', 'rue', 'Rue du', 'avenue', 'Avenue de la', 'boulevard', 'place', 'Quai'])} {base}",
        f"{base}{rng.choice(['straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz', 'gatan', 'vej', 'katu', 'laan', 'straat', 'gade'])} {n}",
        f"{base} {rng.choice(['Straße', 'g.', 'gatvė', 'pr.', 'al.', 'pl.', 'iela', 'tänav', 'utca', 'sokak', 'gatvė'])} {rng.choice(['', '', 'Nr. '])}{n}",
        f"{rng.choice(['Via', 'Calle', 'Avenida', 'Rua', 'Plaza', 'Piazza', 'Corso', 'Viale', 'Strada', 'Paseo'])} {rng.choice(['', '', 'de ', 'della '])}{base}{rng.choice([' ', ', '])}{n}",
        f"{base}{rng.choice(['a', 'owa', 'ska', 'iego'])} {n}",
        "".join(rng.choice("БВГЛМНПС") if i == 0 else rng.choice("аеиорстлн") for i in range(rng.randrange(5, 9))) + rng.choice(["ская", "ная", "а", "ова"]) + f", {rng.choice(['д. ', ''])}{n}" + (f", кв. {rng.randrange(1, 99)}" if rng.random() < 0.4 else ""),
    ])
    if rng.random() < 0.45:
        out += rng.choice([f", {town}", f", {zip_} {town}", f", {town} {zip_}", f", {zip_} {town}"])
    return out


def _figure(rng: random.Random) -> str:
    """A number that is no personal data."""
    return _shape(rng.choice(["dd:dd", "dddd-dd-dd", "dd.dd.dddd", "d ddd", "d ddd ddd", "dd ddd", "ddd", "dd", "dddd", "d,dd", "dd.d", "d.dd.d", "978-d-dd-dddddd-d", "ddddddddddd", "LLdd dddd dddd dddd dddd", "LLL-dddd", "dddd/dd", "dd %", "No. ddddd", "#dddddd", "d.d.d", "dddd–dddd", "ddd ddd", "ddddddd"]), rng)


def _firm(rng: random.Random) -> str:
    base = rng.choice([_stem(rng).capitalize(), family(rng), rng.choice(TOWNS), rng.choice(PLAIN)])
    end = rng.choice(FIRM_ENDS)
    return f"UAB {rng.choice(['„', ''])}{base}" if end == "UAB" else f"{base} {end}"


def _web(rng: random.Random) -> str:
    word = lambda: re.sub(r"[^a-z]", "", _stem(rng).lower()) or "page"
    host = rng.choice(["www.", "", "en.", "docs."]) + word() + word() + rng.choice(_DOMAIN_ENDS)
    path = "/".join(word() for _ in range(rng.randrange(0, 4)))
    return rng.choice(["https://", "http://", "https://", "", "ftp://"]) + host + rng.choice(["", "/", "/" + path, f"/{path}.html", f"/{path}?id={rng.randrange(1, 9999)}", f"/~{word()}/{path}"]) if rng.random() < 0.8 else rng.choice([f"{word()}.{rng.choice(['py', 'txt', 'pdf', 'json'])}", f"/home/{word()}/{path}", f"C:\\\\{word()}\\\\{word()}.exe"])


_SLOTS = {"N": ("name", name), "P": ("phone", phone), "E": ("email", email), "I": ("id_number", identity), "A": ("address", address)}
_OTHER = {"F": _firm, "T": lambda r: r.choice(TOWNS) if r.random() < 0.7 else _stem(r).capitalize(), "D": _figure, "W": lambda r: r.choice(PLAIN), "U": _web, "H": lambda r: "@" + re.sub(r"[^a-z]", "", _stem(r).lower()) + r.choice(["", "_x", "99", ".lt"])}


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A labelled text of one to four sentences that come from no corpus."""
    out, spans = "", []
    for _ in range(rng.choice((1, 1, 2, 3, 4))):
        line = rng.choice(CARRIERS).replace("\\n", "\n")
        for part in re.split(r"(\{\w\}|\w[\w.]*(?: [\w.]+)*(?:\|[\w.]+(?: [\w.]+)*)+)", line):
            if re.fullmatch(r"\{\w\}", part):
                slot = part[1]
                if slot in _OTHER:
                    out += _OTHER[slot](rng)
                else:
                    kind, make = _SLOTS[slot]
                    span = make(rng)
                    spans.append((len(out), len(out) + len(span), kind))
                    out += span
            else:
                out += rng.choice(part.split("|"))
        out += rng.choice([" ", " ", "\n", "\n\n"])
    return out, spans
