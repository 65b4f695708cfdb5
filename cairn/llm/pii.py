"""Personal information in free text, found and replaced by typed placeholders.

Generators with high recall propose spans that may overlap: e-mail addresses,
phone numbers, numbers of documents, street addresses and names of persons. One
boosted classifier for each kind judges a span by its form and its context, and
the spans above the kind's calibrated threshold are taken, the surest first.

The classifiers learn from examples written here (``default_examples``), so that
every kind is known before any document is seen, and from weak labels: usual
words that announce a kind ("call", "my name is") or rule it out ("order",
"version") label the spans beside them, and each labelled span is also shown
with its context hidden, so that form alone suffices where nothing announces a
span. Names, cues and thresholds come from the labels of all documents, reduced
to bounded tables; the trees alone are fitted on a bounded sample, and the
thresholds are chosen on the texts outside it.

Each text is searched once: what is proposed is written with its features, and
cues, thresholds and findings are taken from that table.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.dicts import POST_TYPES, entries
from cairn.llm.boost import Boosted
from cairn.session import materialize, require

KINDS = ("email", "phone", "id", "address", "name")
SAMPLE_DOCUMENTS = 6_000  # documents on which the trees are fitted, at most about
GIVEN_SHARE = 10_000  # a given name goes with one in so many of the announced families at least, an ending with one in ENDING_SHARE
ENDING_SHARE = 100
CUE_SHARE = 1_000  # a cue stands beside one in so many of the labelled spans of its kind at least

# Words that end a street name in running text (full words and
# abbreviations of the usual types; ambiguous ones are left to the classifier).
_LEAVE_OUT = {"acc", "access", "bg", "burg", "ci", "cr", "crest", "cliff", "curve", "curv", "fall", "hw", "ht", "iss", "isle", "ky", "land", "lf", "light", "loaf", "lp", "mews", "oval", "pte", "rad", "radial", "ramp", "rue", "shoal", "spr", "spur", "track", "trailer", "un", "wall", "ways", "wl", "express", "ranches", "tunnels", "al", "bot", "bl", "br", "bv", "cen", "cent", "centre", "center", "cl", "cp", "div", "dl", "dm", "exp", "ext", "field", "fields", "flat", "ford", "fork", "form", "harb", "is", "la", "mill", "is", "la", "pass", "pr", "pt", "rest", "row", "rows", "run", "runs", "sta", "st", "str", "station", "via", "walk", "way", "well", "wells", "view", "spring", "port", "point", "plain", "path", "park", "pine", "island", "lake", "mount", "fort", "mt", "ft", "lk", "common", "club", "corner", "course", "branch", "bridge", "camp", "cape", "bend", "bottom", "bluff", "beach", "arcade", "annex", "dam", "divide", "estate", "extension", "fall", "falls", "ferry", "forest", "forge", "garden", "gateway", "glen", "green", "harbor", "haven", "hill", "hills", "inlet", "key", "knoll", "lakes", "landing", "light", "lock", "lodge", "mall", "meadow", "mission", "mountain", "neck", "orchard", "prairie", "ranch", "rapid", "river", "shore", "stream", "summit", "trace", "track", "tunnel", "union", "valley", "village", "ville", "vista", "woods"}
_PLURALS = {w for w in entries(POST_TYPES) if w.endswith("s") and w[:-1] in entries(POST_TYPES)}  # in running text they are things more often than streets
_TYPES = sorted(set(entries(POST_TYPES)) - _PLURALS - _LEAVE_OUT | {"st", "str", "way", "run", "row", "walk", "path", "pass", "view", "park"}, key=len, reverse=True)
_WAY = r"(?:North(?:east|west)?|South(?:east|west)?|East|West|N\.?E\.?|N\.?W\.?|S\.?E\.?|S\.?W\.?|N\.?|S\.?|E\.?|W\.?)"
_UNIT = r"(?:,?[ \t]+(?:(?:Apt|Apartment|Unit|Suite|Ste|Room|Rm|Floor|Fl|Lot)\b\.?[ \t]*#?|#)[ \t]*[A-Za-z]?-?\d{1,4}-?[A-Za-z]?\b)"
_L = r"[^\W\d_]"
_STREET_WORD = rf"(?:\d{{1,3}}(?:st|nd|rd|th)|{_L}[\w'’-]*)"
_ENGLISH = rf"(?<![\w.,/#+&;-])\d{{1,6}}-?[A-Za-z]?[ \t]+(?:{_WAY}[ \t]+)?(?:{_STREET_WORD}[ \t]+){{1,4}}?(?:{'|'.join(_TYPES)})\b\.?(?:[ \t]+{_WAY}(?![\w'’]))?{_UNIT}?"
_ROUTE = rf"(?<![\w.,/#+&;-])\d{{1,6}}[ \t]+(?:{_WAY}[ \t]+)?(?:State Route|County Road|State Rte|St Rte|Co Rd|County Rd|SR|CR)[ \t]+\d{{1,4}}\b{_UNIT}?"
_GERMAN = rf"(?<![\w.-])(?:{_L}+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee)|{_L}[\w'’-]*[ \t]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm))[ \t]+\d{{1,4}}[ \t]?[a-z]?(?!\w)"
_GERMAN_END = re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee)[ \t]+\d", re.I)
_FRENCH = rf"(?<![\w.,/#-])\d{{1,5}}(?:[ \t]?(?:bis|ter))?,?[ \t]+(?:rue|avenue|av\.|boulevard|bd|chemin|place|allée|impasse|quai|route|cours|square)[ \t]+(?:(?:de la|de l'|du|des|de|d')[ \t]*)?{_L}[\w'’-]+(?:[ \t]+{_L}[\w'’-]+){{0,2}}"
_SPANISH = rf"(?<![\w.-])(?:calle|avenida|avda\.?|av\.|paseo|plaza|camino|carretera|ronda|travesía|c/)[ \t]+(?:(?:de la|de los|de las|del|de)[ \t]+)?{_L}[\w'’-]+(?:[ \t]+{_L}[\w'’-]+){{0,3}},?[ \t]+(?:n\.?º[ \t]*)?\d{{1,5}}(?![\w-])"
_AT = r"(?:[ \t]?(?:@|＠|&#64;|&#x40;|&commat;|%40)[ \t]?|[ \t]*[\[({<][ \t]*at[ \t]*[\])}>][ \t]*)"
_DOT = r"(?:\.|[ \t]*[\[({<][ \t]*(?:dot|punkt|point|punto)[ \t]*[\])}>][ \t]*|[ \t]+dot[ \t]+|&#46;)"
_SPELT = r"[ \t]+(?:at|arroba)[ \t]+"
_SPELT_DOT = r"[ \t]+(?:dot|punkt|point|punto)[ \t]+"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"

#: kind, form and pattern of the generators; names have a generator of their own.
GENERATORS = [
    ("email", "address", re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![\w-])", re.I)),
    ("email", "spelt", re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_SPELT}{_LABEL}(?:\.{_LABEL})*(?:{_SPELT_DOT}{_LABEL})+(?![\w-])", re.I)),
    ("phone", "country", re.compile(r"(?<![\w.+-])(?:\+|00)\d{1,3}[ \t.-]?(?:\(\d{1,4}\)[ \t]?)?\d[\d \t./-]{5,14}\d(?![\w-])")),
    ("phone", "brackets", re.compile(r"(?<![\w+-])(?:(?:\+?1)[ \t.-]?)?\(\d{3}\)[ \t]?\d{3}[ \t.-]?\d{4}(?![\w-])")),
    ("phone", "groups", re.compile(r"(?<![\w.+/-])(?:(?:\+?1)[ \t.-])?\d{3}[ \t./-]\d{3}[ \t.-]\d{4}(?![\w-])")),
    ("phone", "solid", re.compile(r"(?<![\w.+/=-])(?:\+?1)?\d{10}(?![\w.-]*\w)")),
    ("id", "three", re.compile(r"(?<![\w.+/=-])\d{3}([ \t.-])\d{2}\1\d{4}(?![\w-])")),
    ("id", "solid", re.compile(r"(?<![\w.+/=-])\d{9}(?![\w-])")),
    ("id", "letters", re.compile(r"(?<![\w.+/=-])[A-Za-z]{2}\d{7}(?![\w-])")),
    ("id", "letter groups", re.compile(r"(?<![\w.+/=-])[A-Za-z]\d{3}-\d{4}-\d{4}(?![\w-])")),
    ("address", "english", re.compile(_ENGLISH, re.I)),
    ("address", "route", re.compile(_ROUTE, re.I)),
    ("address", "german", re.compile(_GERMAN, re.I)),
    ("address", "french", re.compile(_FRENCH, re.I)),
    ("address", "spanish", re.compile(_SPANISH, re.I)),
]
_FORMS = {form: i for i, form in enumerate(dict.fromkeys([f for _, f, _ in GENERATORS] + ["given family", "initial family", "family, given", "family given", "given and word"]))}

# Usual words that announce a kind to the left, and that rule it out.
ANNOUNCES = {
    "email": r"(?:mailto:|mail(?: me)?(?: at)?:?|write to|contact(?: me| us)?(?: at)?:?|reach me at|addr(?:ess)? is|adresse (?:est|ist)|correo(?: es)?:?|correo electr[oó]nico:?|bitte an|[eé]crivez à|escriban? a|<)\W*$",
    "phone": r"(?:\bcall(?: me)?(?: at| on)?|\bcell(?:phone)?(?: is)?|\bmobile(?: is)?|\bfax|\btel(?:efon|ephone|éfono|éphone)?\.?:?|\btél\.?:?|whatsapp|phone(?: is| number)?:?|\bring|\btext|\bdial|appelez(?: le)?|ll[aá]m[ae](?:me|r)?(?: al)?|ruf\w*(?: \w+)? (?:unter|an)|handy:?|reach me at)\W*$",
    "id": r"(?:\bssn|\bsocial(?: security)?|passport|pasaporte|passeport|reisepass|\bid|\btax(?:payer)?(?: id)?|\btin|licen[cs]e|identity|documento|\bdni|identité|ausweis(?:nummer)?|steuernummer)(?:\W+(?:number|no|nr|card|on|the|my|form|file|is|was|es|est|ist|id))*\W*(?:<[^>]*>|\[\w+\])*$",
    "address": r"(?:(?:deliver|ship|send|sent|mail)(?:ed|ped)?(?: \w+)? to:?|\bliv(?:e|es|ed|ing) (?:at|on)|resid\w+ (?:at|on)|(?:address|place|home|office|house)(?: is|:)|moved (?:from|to)|located at|pin for|wohn\w*(?: in)?|anschrift:?|adresse:?|(?:ging|geschickt) an|j'habite(?: au)?|(?:envoyé|parti) (?:au|à)|viv[eo] en|direcci[oó]n:?|(?:mandaron|enviaron|envi[eé]) a|[^\W\d_]+[.]? [^\W\d_]{3,}, )\s*$",
    "name": r"(?:\b(?:name (?:is|ist)\b|name:|nombre es|attn:?|attention:?|ask for|(?:spoke|talked|met) (?:with|to)|(?:parcel|letter|package|mail) for|forward(?: this| it)? to(?: (?:dr|mr|mrs|ms|prof)\.)?|(?:dr|mr|mrs|ms|prof|herr|frau|señor|señora|madame|monsieur)\b\.?|signed(?: by)?:?|llamo|m'appelle|heiße|bitte|pregunten? por|demandez|per\b|sig\]|regards,|sincerely,|grüße,?|saludos,?|cordialement,?)|\n--[ ]?\n|\n___+\n)\s*(?:<[^>]*>|\[\w+\])*$",
}
RULES_OUT = {
    "email": r"(?:\bsee|\breads|\bfile|\bimage|\(see)\W*$",
    "phone": r"\b(?:track\w*|ticket|order|invoice|checksum|hash|version|build|release|rows?|columns?|page|part|serial|isbn|zip(?:\+4)?|postcode|coordinates?|lat|lon|ip|(?:linear|object|user|uu|gu|tl) ?id)(?:\W+(?:no|number|says|codes?|such|as|is|was|at))*[\W\d]*$",
    "id": r"\b(?:track\w*|ticket|order|invoice|checksum|hash|version|build|release|rows?|columns?|page|part|serial|isbn|zip(?:\+4)?|postcode|key|coordinates?|lat|lon|ip|(?:linear|object|user|uu|gu|tl) ?id)(?:\W+(?:no|number|says|codes?|such|as|is|was|at))*[\W\d]*$",
    "address": r"(?:\b(?:the|this|that|these|between|takes?|took|rows?|columns?|pages?|lines?|about|over|nearly|costs?|cost us|keeps?|kept|dropped|version|ticket|of))\s*$",
    "name": r"(?:\bnear|\baround|\bfrom|\bin|\bat|\bà|\ben|\bcovers|\bon|\balong|\btowards?|block of|\d)\s*$",
}
_ANNOUNCES = {k: re.compile(v, re.I) for k, v in ANNOUNCES.items()}
_RULES_OUT = {k: re.compile(v, re.I) for k, v in RULES_OUT.items()}
#: The words with which a phrase that announces a name begins.
_NAME_CUES = {"name", "nombre", "attn", "attention", "ask", "spoke", "talked", "met", "parcel", "letter", "package", "mail", "forward", "dr", "mr", "mrs", "ms", "prof", "herr", "frau", "señor", "señora", "madame", "monsieur", "signed", "llamo", "m'appelle", "heiße", "bitte", "pregunten", "pregunte", "demandez", "per", "sig", "regards", "sincerely", "grüße", "saludos", "cordialement"}
_FILES = {"png", "jpg", "jpeg", "gif", "csv", "tif", "parquet", "txt", "zip", "pdf", "json", "xml", "html", "log"}
_PLACES = {"mount", "lake", "fort", "saint", "north", "south", "east", "west", "new", "old", "upper", "lower", "city", "county", "the"}
# Words of grammar and measure, which are no part of a street or a name.
_PLAIN = {"the", "a", "an", "of", "to", "in", "on", "and", "or", "is", "was", "were", "be", "been", "for", "from", "with", "as", "at", "by", "that", "this", "their", "every", "my", "our", "your", "his", "her", "each", "these", "those", "into", "past", "it", "its", "has", "have", "had", "not", "but", "because", "whereas", "although", "though", "while", "then", "than", "here", "there", "they", "we", "i", "he", "she", "you", "if", "so", "which", "since", "until", "before", "after", "according", "unless", "when", "where", "still", "near", "along", "around", "between", "behind", "across", "through", "towards", "under", "about", "off", "went", "got", "le", "les", "der", "die", "das", "et", "y", "und", "oder", "para", "por", "mit", "avec", "hours", "minutes", "days", "weeks", "months", "years", "miles", "metres", "meters", "feet", "rows", "row", "lines", "column", "columns", "page", "pages", "entries", "records", "times", "people", "percent", "dollars", "euros", "block", "blocks", "zeilen", "lignes", "registros", "líneas", "stunden", "heures", "horas"}
# Common given names.
GIVEN = frozenset("""james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra paul ashley steven kimberly andrew emily kenneth donna joshua michelle kevin carol brian amanda george melissa edward deborah
hans peter klaus petra sabine jürgen monika stefan anna julia lukas jean marie pierre jacques claire camille luc sophie antoine juan maría josé carmen carlos ana luis lucía pedro elena maria jose wei mei ahmed fatima omar aisha ivan olga yuki hiro priya raj""".split())
_WORD = re.compile(r"[^\W_]+")
_PAIR = re.compile(rf"(?<![\w@.+-])({_L}[\w'’-]+|{_L}\.)((?:[ \t]+{_L}\.)?)(,?)[ \t]+({_L}[\w'’-]+|{_L}\.)((?:[ \t]+{_L}\.)?)(?![\w@])")
#: An e-mail address in angle brackets, which follows the name of its owner.
_ADDRESSEE = re.compile(r"\s*(?:</?\w>)?\s*<(?:<\w>)?[\w.+-]+[ \t]?(?:@|&#64;|[\[(]at|AT )")
_OWNED = re.compile(r"<(?:<\w>)?[\w.+-]+[ \t]?(?:@|&#64;|[\[(]at|AT )")
_OWNER = re.compile(rf"({_L}[\w'’-]+|{_L}\.)((?:[ \t]+{_L}\.)?)(,?)[ \t]+({_L}[\w'’-]+|{_L}\.)((?:[ \t]+{_L}\.)?)\s*(?:</?\w>)?\s*$")


class _Flags(dict):
    """By word as written: 1 a known given name, 2 the ending of a family name, 4 a cue."""

    def __init__(self, given: frozenset[str], endings: tuple[str, ...]):
        self.given, self.endings = given, endings

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        w = word.lower()
        self[word] = v = (w in self.given) + 2 * bool(self.endings and len(w) >= 6 and w.endswith(self.endings)) + 4 * (w in _NAME_CUES)
        return v


@dataclass
class Lexicon:
    """Given names and endings of family names, learnt from announced names;
    common given names are known without that."""

    given: frozenset[str] = GIVEN
    endings: tuple[str, ...] = ()

    def __post_init__(self):
        self.flags = _Flags(self.given, self.endings)

    def __reduce__(self):
        return Lexicon, (self.given, self.endings)

    @classmethod
    def learn(cls, texts: list[str]) -> Lexicon:
        first, last = defaultdict(set), defaultdict(set)
        for a, b in {p for t in texts for p in announced_pairs(t)}:
            first[a].add(b)
            last[b].add(a)
        given = cls.givens({g: len(f) for g, f in first.items()}, len(last))
        families = [f for f, gs in last.items() if gs & given]
        return cls(given, cls.ends(Counter(f[-n:] for f in families for n in (4, 5, 6)), len(families)))

    @staticmethod
    def givens(families: dict[str, int], n: int) -> frozenset[str]:
        """Given names by the number of families announced with them, of ``n`` families."""
        return GIVEN | {g for g, f in families.items() if f >= max(2, n // GIVEN_SHARE) and len(g) >= 3 and g not in _PLAIN and g not in _PLACES}

    @staticmethod
    def ends(families: dict[str, int], n: int) -> tuple[str, ...]:
        """Endings by the number of families that have them, of ``n`` families."""
        common = sorted(e for e, f in families.items() if f >= max(4, n // ENDING_SHARE))
        # a longer ending says no more than a shorter one that ends it
        return tuple(sorted((e for e in common if not any(o != e and e.endswith(o) for o in common)), key=len, reverse=True))


_TOKEN = re.compile(rf"(?<![\w@.+-]){_L}[\w'’-]+(?![\w@+]|\.\w)")
_LETTERS = re.compile(rf"{_L}[\w'’-]*")
_CUE = re.compile(ANNOUNCES["name"].replace(r"\s*(?:<[^>]*>|\[\w+\])*$", r"\s*(?:<[^>]*>|\[\w+\])*(?=\w)"), re.I)
_BREAK = re.compile(r"\n(?:--|___)")
_NO_LEXICON = _Flags(frozenset(), ())


def _flagged(text: str, flags: _Flags) -> int:
    seen = 0
    for w in set(_LETTERS.findall(text)):
        seen |= flags[w]
    return seen


def _cued(text: str, flags: _Flags, seen: int) -> list[int]:
    """Where a name may start because a phrase announces one."""
    at = [m.start() for m in _LETTERS.finditer(text) if flags[m[0]] & 4] if seen & 4 else []
    return [m.end() for s in (*at, *(b.start() for b in _BREAK.finditer(text))) if (m := _CUE.match(text, s))]


def announced_pairs(text: str) -> Iterator[tuple[str, str]]:
    """(given, family) of the announced names of a text, in lower case."""
    pairs = [m for at in _cued(text, _NO_LEXICON, _flagged(text, _NO_LEXICON)) if (m := _PAIR.match(text, at))]
    if "<" in text:
        pairs += [m for o in _OWNED.finditer(text) if (m := _OWNER.search(text, max(0, o.start() - 60), o.start()))]
    for m in pairs:
        a, b = (m[4], m[1]) if m[3] else (m[1], m[4])
        if len(b) >= 6 and len(a) >= 2:
            yield a.lower(), b.lower()


_BEFORE = re.compile(rf"(?<![\w@.+-])((?:({_L}[\w'’-]*)|({_L}\.))(?:[ \t]+({_L})\.?)?[ \t]+)$")
_AFTER = re.compile(rf"(,?)[ \t]+({_L}[\w'’-]+|{_L}\.(?!\w))((?:[ \t]+{_L}\.(?!\w))?)(?![\w@])")


def name_spans(text: str, lex: Lexicon) -> Iterator[tuple[int, int, str]]:
    """(start, end, form) of possible names."""
    flags = lex.flags
    seen = _flagged(text, flags)
    starts = [a for a in _cued(text, flags, seen) if text[a].isupper()]
    for m in _TOKEN.finditer(text) if seen & 3 else ():
        flag = flags[m[0]]
        if not flag & 3:
            continue
        if flag & 1:
            starts.append(m.start())
        if not flag & 2:
            continue
        a = _BEFORE.search(text, max(0, m.start() - 40), m.start())
        b = _AFTER.match(text, m.end())
        if a and a[2] and (flags[a[2]] & 1 or (a[2][0].isupper() and a[2].lower() not in _PLAIN and a[2].lower() not in _PLACES)) and not (a[4] and a[4].islower() and not a[2].islower()):
            yield m.start() - len(a[1]), m.end(), "given family"
        elif a and a[3]:
            yield m.start() - len(a[1]), m.end(), "initial family"
        elif a and a[4] and a[4].isupper() and text[a.end(4)] == ".":
            yield a.start(4), m.end(), "initial family"
        if b and b[1] and (flags[b[2]] & 1 or b[2].endswith(".")):
            end = b.end() if b[3] else b.end(2)
            yield m.start(), end, "family, given"
        elif b and flags[b[2]] & 1 and not (a and a[2] and flags[a[2]] & 1):
            yield m.start(), b.end() if b[3] else b.end(2), "family given"
    for at in sorted(set(starts)):
        m = _PAIR.match(text, at)
        if m and len(m[4]) >= 3 and not m[3] and m[4].lower() not in _PLAIN and (m[4][0].isupper() or m[1][0].islower()):
            yield m.start(), m.end(4), "given and word"


_DIGITS = re.compile(r"\d+")
_MAIL_SIGN = re.compile(r"[@＠]|&#64;|&#x40;|&commat;|%40|[\[({<][ \t]*at[ \t]*[\])}>]", re.I)
_LOCAL = re.compile(r"[\w.+-]+[ \t]*$")
_GERMAN_WORD = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "chaussee")
_SPANISH_WORD = ("calle", "avenida", "avda", "av.", "paseo", "plaza", "camino", "carretera", "ronda", "travesía", "c/")
_DOT_WORD = ("dot", "punkt", "point", "punto")
_NEXT = re.compile(r"-?[A-Za-z]{0,3},?[ \t]+([^\W_]+)")
_ROUTE_FIRST = {"state", "county", "st", "co", "sr", "cr", "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "n", "s", "e", "w", "ne", "nw", "se", "sw"}
_FRENCH_FIRST = {"rue", "avenue", "av", "boulevard", "bd", "chemin", "place", "allée", "impasse", "quai", "route", "cours", "square", "bis", "ter"}
_PATTERN = {(k, f): p for k, f, p in GENERATORS}


def _numbered(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Proposals that hold a number, found from the runs of digits."""
    last: dict[tuple[str, str], int] = {}

    def at(kind: str, form: str, *starts: int) -> Iterator[tuple[str, str, int, int]]:
        for s in starts:
            if s >= last.get((kind, form), 0) and (m := _PATTERN[kind, form].match(text, s)):
                last[kind, form] = m.end()
                yield kind, form, s, m.end()
                return

    size, low = len(text), text.lower()
    spanish = any(w in low for w in _SPANISH_WORD)
    for run in _DIGITS.finditer(text):
        s, e = run.span()
        n, prev, after = e - s, text[s - 1 : s], text[e : e + 1]
        one = n == 1 and text[s] == "1"
        if prev == "+" or text.startswith("00", s):
            yield from at("phone", "country", s - 1 if prev == "+" else s)
        if one or n == 3 and prev == "(" or prev == "+" and text[s] == "1":
            yield from at("phone", "brackets", *([s - 1] if prev == "+" or prev == "(" else []), s)
        if one or n == 3:
            yield from at("phone", "groups", *([s - 1] if prev == "+" else []), s)
        if n in (10, 11):
            yield from at("phone", "solid", *([s - 1] if prev == "+" else []), s)
        if n == 3:
            yield from at("id", "three", s)
            if prev.isalpha():
                yield from at("id", "letter groups", s - 1)
        elif n == 9:
            yield from at("id", "solid", s)
        elif n == 7 and s >= 2 and prev.isalpha():
            yield from at("id", "letters", s - 2)
        if n <= 6 and (after in " \t-," and after or after.isalpha()) and (word := _NEXT.match(text, e)):
            first = word[1].lower()
            yield from at("address", "english", s)
            if first in _ROUTE_FIRST:
                yield from at("address", "route", s)
            if first in _FRENCH_FIRST or after.isalpha() or "," in word[0]:
                yield from at("address", "french", s)
        if n <= 5 and prev and prev in " \tº":
            if text[max(0, s - 20) : s].rstrip(" \t").lower().endswith(_GERMAN_WORD):
                for m in _PATTERN["address", "german"].finditer(text, max(0, s - 60), min(size, e + 4)):
                    if m.end() >= e:
                        yield "address", "german", m.start(), m.end()
            if spanish:
                for m in _PATTERN["address", "spanish"].finditer(text, max(0, s - 90), min(size, e + 2)):
                    if m.end() == e:
                        yield "address", "spanish", m.start(), m.end()


def _mails(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Proposals of e-mail addresses, found from their signs."""
    end = 0
    for sign in _MAIL_SIGN.finditer(text):
        local = _LOCAL.search(text, max(end, sign.start() - 120), sign.start())
        m = local and _PATTERN["email", "address"].match(text, local.start())
        if m and m.end() > end:
            end = m.end()
            yield "email", "address", m.start(), end
    low = text.lower()
    if any(w in low for w in _DOT_WORD) and (" at" in low or "arroba" in low):
        for m in _PATTERN["email", "spelt"].finditer(text):
            yield "email", "spelt", m.start(), m.end()


def spans(text: str, lex: Lexicon) -> list[tuple[str, str, int, int]]:
    """(kind, form, start, end) of everything the generators propose."""
    out = []
    for kind, form, a, b in (*_mails(text), *_numbered(text)):
        while b > a and text[b - 1] in " \t,;":
            b -= 1
        if kind == "address" and form == "english" and text[b - 1] == "." and not re.match(r"[ \t]*[a-z,#]", text[b : b + 40]):
            b -= 1  # the end of the sentence
        if kind == "email" and text[a : a + 7].lower() == "mailto:":
            a += 7
        out.append((kind, form, a, b))
        if kind == "address":
            out += _shorter(text, form, a, b)
    for a, b, form in name_spans(text, lex):
        out.append(("name", form, a, b))
    return list(dict.fromkeys(out))


def _shorter(text: str, form: str, a: int, b: int) -> list[tuple[str, str, int, int]]:
    """Sub-spans of a proposed address that may be the address itself."""
    out = []
    if form == "english":
        # a later number starts it
        for m in re.finditer(r"(?<=[ \t])\d{1,6}-?[A-Za-z]?[ \t]+(?!(?:st|nd|rd|th)\b)", text[a + 1 : b]):
            at = a + 1 + m.start()
            if re.match(_ENGLISH, text[at:b], re.I):
                out.append(("address", form, at, b))
    if form == "french":
        words = list(re.finditer(r"[\w'’-]+", text[a:b]))
        out += [("address", form, a, a + w.end()) for w in words[2:-1]]
    return out


FEATURES = ["form", "length", "digits", "letters", "words", "first digit", "separators", "upper", "capital words", "plain words", "place word", "file", "given", "ending", "same case", "before", "after", "line start", "line end", "announced", "ruled out", "left cue", "right cue"]
_SPEAKING = FEATURES.index("left cue")  # the features before it need no cues
_HIDDEN = [FEATURES.index(f) for f in ("before", "after", "line start", "line end", "announced", "ruled out", "left cue", "right cue")]


_SCALE = re.compile(r"\d+x?")  # as in names of images for screens of several densities


def _char(c: str) -> float:
    return 0.0 if not c else 1.0 if c == "\n" else 2.0 if c.isspace() else 3.0 if c.isdigit() else 4.0 if c.isalpha() else 5.0 if c in "<[" else 6.0 if c in ">]" else 7.0 if c in ".,;:!?" else 8.0


def _words(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    left = [w.lower() for w in _WORD.findall(text[max(0, a - 45) : a])][-3:]
    right = [w.lower() for w in _WORD.findall(text[b : b + 35])][:3]
    return ["<" + re.sub(r"\d", "9", w) for w in left], [">" + re.sub(r"\d", "9", w) for w in right]


def describe(text: str, kind: str, form: str, a: int, b: int, lex: Lexicon) -> list[float]:
    """Features of a span: form and context, without those of the cues."""
    s = text[a:b]
    words = _WORD.findall(s)
    digits = sum(map(str.isdigit, s))
    letters = sum(map(str.isalpha, s))
    alpha = [w for w in words if w[0].isalpha()]
    lower = [w.lower() for w in words]
    first = _DIGITS.search(s)
    line = text.find("\n", b, b + 200)
    return [
        float(_FORMS[form]),
        float(b - a),
        float(digits),
        float(letters),
        float(len(words)),
        float(first[0][0]) if first and first[0][0].isascii() else -1.0,
        float(len(s) - digits - letters),
        sum(map(str.isupper, s)) / max(1, letters),
        sum(w[0].isupper() for w in alpha) / max(1, len(alpha)),
        float(sum(w in _PLAIN for w in lower)),
        float(sum(w in _PLACES for w in lower)),
        float(bool(words) and (lower[-1] in _FILES or (len(lower) > 1 and _SCALE.fullmatch(lower[-2]) is not None))),
        float(sum(w in lex.given for w in lower)),
        float(any(w.endswith(lex.endings) for w in lower)) if lex.endings else 0.0,
        float(len({(w.isupper(), w.islower()) for w in alpha if len(w) > 1}) <= 1),
        _char(text[a - 1 : a]),
        _char(text[b : b + 1]),
        float(not text[max(text.rfind("\n", 0, a) + 1, a - 200) : a].strip(" >\t")),
        float(not text[b : line if line >= 0 else b + 200].strip()),
        float(_ANNOUNCES[kind].search(text, max(0, a - 45), a) is not None),
        float(_RULES_OUT[kind].search(text, max(0, a - 45), a) is not None),
    ]


_ANNOUNCED, _RULED_OUT = FEATURES.index("announced"), FEATURES.index("ruled out")
_BARE_AT = re.compile(r"\s(?:at|AT)\s")
_DOTTED = re.compile(r"(?i)[\[(]at|\sdot\s|[\[(]dot")
_FOLLOWS = re.compile(r"\s*(?:<[^>@\n]{0,4}>)?\s*<?[\w.+-]+\s?(?:@|&#64;|[\[(]at)")


def weak_label(text: str, kind: str, form: str, a: int, b: int, lex: Lexicon, x: list[float]) -> float:
    """1, 0 or NaN (not known) for a span with the features ``x``."""
    yes, no = x[_ANNOUNCED] > 0, x[_RULED_OUT] > 0
    lower = [w.lower() for w in _WORD.findall(text[a:b])]
    if kind == "email":
        if x[FEATURES.index("file")]:
            return 0.0
        if _BARE_AT.search(text, a, b) and not _DOTTED.search(text, a, b):
            return 0.0
        return 1.0
    if kind == "phone" and form in ("country", "brackets"):
        yes = not no  # no other number is written so
    if kind == "address" and any(w in _PLAIN for w in lower[1:]):
        return 0.0
    if kind == "name":
        known = any(w in lex.given for w in lower)
        both = known and any(lex.flags[w] & 2 for w in lower)
        if any(w in _PLACES for w in lower):
            return 0.0
        yes = (yes or _FOLLOWS.match(text, b, b + 60) is not None) and (both or (known and form != "given and word") or form == "initial family")
        no = no and not both
    if yes == no:
        return math.nan
    return 1.0 if yes else 0.0


_KIND = {k: i for i, k in enumerate(KINDS)}


def described(text: str, lex: Lexicon) -> list[tuple[str, str, int, int, float, list[float]]]:
    """(kind, form, start, end, label, features) of all proposed spans."""
    out = []
    for k, f, a, b in spans(text, lex):
        x = describe(text, k, f, a, b, lex)
        out.append((k, f, a, b, weak_label(text, k, f, a, b, lex, x), x))
    return out


def cue_scores(counts: dict[str, tuple[float, float]], n: float, m: float) -> dict[str, float]:
    """Log odds of words beside spans, by how many of ``n`` spans labelled 1 and
    ``m`` labelled 0 they stand beside."""
    least = max(5, (n + m) / CUE_SHARE)
    n, m = max(1.0, n), max(1.0, m)
    return {w: math.log((yes + 0.5) / n) - math.log((no + 0.5) / m) for w, (yes, no) in counts.items() if yes + no >= least}


def beside(text: str, a: int, b: int) -> str:
    """The words beside a span, by spaces."""
    left, right = _words(text, a, b)
    return " ".join(left + right)


def with_cues(x: np.ndarray, words: list[str], cues: dict[str, float]) -> np.ndarray:
    """Features of spans with the scores of the cues to their left and right."""
    out = np.zeros((len(x), len(FEATURES)))
    out[:, :_SPEAKING] = x
    for i, ws in enumerate(words):
        for w in ws.split(" ") if ws else ():
            v = cues.get(w)
            if v:
                out[i, _SPEAKING + (w[0] == ">")] += v
    return out


def muted(x: np.ndarray) -> np.ndarray:
    """Features of spans as if their context were not known to speak either way."""
    mute = x.copy()
    mute[:, _HIDDEN[-4:]] = 0.0
    return mute


# Examples of each kind in running text: what is in braces is planted.
_SHOWN = """Please call {phone} after six and ask for {name}.|You can reach {name} at {email} or {phone}.|Send the keys to {address} by Friday.|The invoice goes to {name}, {address}.|{name} <{email}> replied yesterday.|Her social security number is {id}.|His passport, {id}, was renewed in May.|Driver license number {id} was on the form.|The tax id {id} belongs to our landlord.
Kind regards,\n{name}\n{phone}\n{address}|I have lived at {address} for ten years.|We talked to {name} about the roof.|My name is {name} and my e-mail is {email}.|fax {phone}, mail {email}|Our new office is {address}, second door.|{name} signed for it.|thanks to {name} we found {address} at once|the number is {phone}, the address {email}
The {n} block of {street} is closed.|Order {order} left the depot.|Invoice {order} is paid, the checksum is {hash}.|They moved from {n} Cedar Dr last fall.|Version {n}.{m}.{n} fixes row {n}.|We counted {n} cars and {m} bikes on {street}.|See photo-{m}.png or {given}@{m}x.png for details.|Open {street}@{m}x.{ext} and logo@{m}x.{ext} first.|A voicemail at {phone} got no reply.|The desk answers on {phone} or {phone}.|Tracking {order} {n} has not moved.|The walk takes {m} minutes along {street}.|Lake Placer and Mount Hebb are in the north.|Meet us near {street} at noon.|On 2021-0{k}-1{k} it was {m} degrees at {n}.{n}, -{m}.{n}.|ISBN 978-{m}-{n}-{m} is out of print.|Checksum {hash} for build {order}.|It cost us {n} dollars for the fence on {street}.|meet me at the corner at noon, {n} people came|{given} Street is shut between {given} Park and {given} Hall.|We read {given} Road and Lake {given} Drive on the sign."""
_FAMILIES = "Smith Johnson Miller Weber Fischer Dubois Laurent Moreno Castillo Novak Petrov Tanaka Okafor Lindqvist Harrington Delacroix Montgomery Vandenberg Sandoval Whitaker".split()
_STREETS = "Maple Washington Church Walnut Sunset Highland Jefferson Willow Franklin Spruce".split()
_KINDS_OF_STREET = "Street St Ave Avenue Road Rd Lane Ln Drive Dr Blvd Court Ct Place Way".split()


def default_examples(n: int = 700, seed: int = 5) -> list[tuple[str, set[tuple[str, str]]]]:
    """Texts with what is planted in them, as (kind, surface)."""
    r = random.Random(seed)
    given = sorted(GIVEN)

    def digits(k: int) -> str:
        return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(k - 1))

    def name() -> str:
        a, b = r.choice(given).capitalize(), r.choice(_FAMILIES)
        return r.choice([f"{a} {b}"] * 5 + [f"{a} {r.choice('ABCDEJKLM')}. {b}", f"{a} {b}".upper(), f"{a} {b}".lower()])

    def street() -> str:
        s = f"{r.choice(['', '', '', 'N ', 'South '])}{r.choice([*_STREETS, '21st', '35th', '4th', '102nd'])} {r.choice(_KINDS_OF_STREET)}"
        return r.choice([s, s, s, s.upper(), s.lower()])

    def address() -> str:
        return r.choice([f"{digits(r.randint(1, 5))} {street()}{r.choice(['', '', '', ' Apt ' + digits(2), ' #' + digits(1)])}"] * 6 + [f"{r.choice(['Linden', 'Bahnhof', 'Schiller'])}straße {digits(2)}", f"{digits(2)} rue de la Gare", f"Calle Mayor {digits(2)}", f"{r.choice(['Berg', 'Kirch'])}weg {digits(1)}"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+49 {digits(3)} {digits(7)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{a} {b} {c}", f"+1{a}{b}{c}", f"{a}{b}{c}"])

    def email() -> str:
        local, host, top = r.choice(given) + r.choice(["", ".", "_", digits(2)]).replace(".", ".x"), r.choice(["mail", "post-office", "box.web"]), r.choice(["com", "org", "example", "net", "de"])
        return r.choice([f"{local}@{host}.{top}"] * 5 + [f"{local} [at] {host} [dot] {top}", f"{local}(at){host}.{top}", f"{local}&#64;{host}.{top}", f"{local} at {host} dot {top}"])

    def id_() -> str:
        return r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9), f"{r.choice('ABCX')}{r.choice('KLMN')}{digits(7)}", f"{r.choice('ABDHM')}{digits(3)}-{digits(4)}-{digits(4)}"])

    make = {"name": name, "address": address, "phone": phone, "email": email, "id": id_, "street": street, "given": lambda: r.choice(given).capitalize(), "ext": lambda: r.choice(["png", "jpg", "pdf"]), "n": lambda: digits(r.randint(2, 5)), "m": lambda: digits(r.randint(1, 2)), "k": lambda: digits(1), "order": lambda: r.choice([digits(8), digits(4) + "-" + digits(4), digits(12), digits(10), digits(9)]), "hash": lambda: r.choice(["%010x" % r.getrandbits(40), digits(10), digits(9)])}
    out, shown = [], [t.replace("\\n", "\n") for line in _SHOWN.splitlines() for t in line.split("|")]
    for i in range(n):
        planted: set[tuple[str, str]] = set()

        def fill(m: re.Match) -> str:
            v = make[m[1]]()
            if m[1] in KINDS:
                planted.add((m[1], v))
            return v

        text = re.sub(r"\{(\w+)\}", fill, shown[i % len(shown)])
        out.append((text, planted))
    return out


def example_rows(lex: Lexicon) -> list[tuple[str, str, list[float], float]]:
    """(kind, words beside, features, label) of the spans of ``default_examples``."""
    out = []
    for text, planted in default_examples():
        for k, _, a, b, _, x in described(text, lex):
            out.append((k, beside(text, a, b), x, float((k, text[a:b]) in planted)))
    return out


@dataclass
class Detector:
    """Lexicon, context cues, and a classifier with its threshold for each kind."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    cues: dict[str, dict[str, float]] = field(default_factory=dict)
    models: dict[str, Boosted] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: list[str], seed: int = 3) -> Detector:
        """Fitted on ``texts`` alone: lexicon, cues, trees and, from the fifth of
        the texts that the trees have not seen, thresholds."""
        lexicon = Lexicon.learn(texts)
        rows = [(k, beside(t, a, b), x, v, i) for i, t in enumerate(dict.fromkeys(texts)) for k, _, a, b, v, x in described(t, lexicon) if v == v]
        yes, no = {k: Counter() for k in KINDS}, {k: Counter() for k in KINDS}
        for k, ws, _, v, _ in rows:
            (yes if v else no)[k].update(set(ws.split()))
        size = {k: (sum(r[3] for r in rows if r[0] == k), sum(1 - r[3] for r in rows if r[0] == k)) for k in KINDS}
        cues = {k: cue_scores({w: (yes[k][w], no[k][w]) for w in sorted(yes[k] | no[k])}, *size[k]) for k in KINDS}
        apart = [r[4] % 5 == 4 for r in rows]
        self = cls.train(lexicon, cues, [r for r, out in zip(rows, apart) if not out], seed)
        for k in KINDS:
            held = [r for r, out in zip(rows, apart) if out and r[0] == k]
            if held:
                x = with_cues(np.array([r[2] for r in held]), [r[1] for r in held], {})
                self.thresholds[k] = best_threshold(self.models[k].predict(muted(x)), np.array([r[3] for r in held]))
        return self

    @classmethod
    def train(cls, lexicon: Lexicon, cues: dict[str, dict[str, float]], rows: list[tuple], seed: int = 3) -> Detector:
        """Trees on labelled spans (kind, words beside, features, label, text) and
        on the default examples, so that a kind without labels is known too. All
        spans of a text, and the copies with hidden context, are held out together."""
        self = cls(lexicon, cues)
        shown = example_rows(lexicon)
        for kind in KINDS:
            own = [r for r in rows if r[0] == kind]
            more = [(*r, -1 - i) for i, r in enumerate(r for r in shown if r[0] == kind)]
            every = own + more
            y = np.array([r[3] for r in every])
            group = np.array([r[4] for r in every], dtype=np.int64)
            x = with_cues(np.array([r[2] for r in every]), [r[1] for r in every], cues.get(kind, {}))
            bare = x.copy()
            bare[:, _HIDDEN] = math.nan
            self.models[kind] = Boosted(rounds=40, depth=4).fit(np.concatenate([x, bare, muted(x)]), np.tile(y, 3), seed=seed, groups=np.tile(group, 3))
            self.thresholds[kind] = 0.5
        return self

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what is taken, in order, without overlaps."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """``find`` for many texts; the classifiers judge all their spans at once."""
        rows = [(i, *s) for i, t in enumerate(texts) for s in (described(t, self.lexicon) if t else ())]
        taken = self.judge([r[0] for r in rows], [_KIND[r[1]] for r in rows], [r[3] for r in rows], [r[4] for r in rows], np.array([r[6] for r in rows]), [beside(texts[r[0]], r[3], r[4]) for r in rows])
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for j in taken:
            i, kind, _, a, b, *_ = rows[j]
            out[i].append((a, b, kind))
        return [sorted(f) for f in out]

    def judge(self, text: list[int], kind: list[int], start: list[int], end: list[int], x: np.ndarray, words: list[str]) -> list[int]:
        """Which of the spans are taken; ``text`` tells the spans of a text apart."""
        kinds, kept = np.asarray(kind), defaultdict(list)
        for k, name in enumerate(KINDS):
            at = np.flatnonzero(kinds == k)
            if len(at):
                p = self.models[name].predict(with_cues(x[at], [words[j] for j in at], self.cues.get(name, {})))
                for j, v in zip(at[p >= self.thresholds[name]].tolist(), p[p >= self.thresholds[name]].tolist()):
                    # nearly equal probabilities: the longer span
                    kept[text[j]].append((-round(v, 1), start[j] - end[j], start[j], end[j], name, j))
        out = []
        for found in kept.values():
            taken: list[tuple[int, int]] = []
            for _, _, a, b, _, j in sorted(found):
                if all(b <= u or a >= v for u, v in taken):
                    taken.append((a, b))
                    out.append(j)
        return out


_LEVELS = np.arange(0.2, 0.81, 0.05)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold in [0.2, 0.8] with the best F1 (ties: nearest to one half)."""
    w = np.ones(len(y)) if weight is None else weight
    best = (-1.0, 0.0, 0.5)
    for t in _LEVELS:
        got = p >= t
        hit = float(w[got & (y > 0.5)].sum())
        f = 2 * hit / max(1.0, w[got].sum() + w[y > 0.5].sum())
        best = max(best, (round(f, 3), -abs(t - 0.5), float(t)))
    return best[2]


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """``Lexicon.learn`` over all rows of ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({p for t in b["text"].unique() for p in announced_pairs(t)}), columns=["given", "family"])

    pairs = materialize(texts.select("text").mapInPandas(run, "given string, family string").distinct(), "announced")
    n = pairs.select("family").distinct().count()
    first = pairs.groupBy("given").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, n // GIVEN_SHARE))
    given = Lexicon.givens({r["given"]: r["n"] for r in first.toLocalIterator()}, n)
    known = texts.sparkSession.createDataFrame([(g,) for g in sorted(given)], "given string")
    families = pairs.join(F.broadcast(known), "given", "left_semi").select("family").distinct()
    n = families.count()
    tails = families.select(F.explode(F.array_distinct(F.array(*(F.expr(f"right(family, {k})") for k in (4, 5, 6))))).alias("tail"))
    last = tails.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(4, n // ENDING_SHARE))
    return Lexicon(given, Lexicon.ends({r["tail"]: r["n"] for r in last.toLocalIterator()}, n))


_SPANS = "h long, kind array<byte>, start array<int>, end array<int>, label array<float>, features array<float>, words array<string>, surface array<string>"


def propose(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The texts in which something is proposed: ``doc_id``, hash ``h`` of the
    text, and arrays with an entry for each span (features one after another)."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            memo: dict[str, tuple | None] = {}
            rows = []
            for doc, h, t in zip(b["doc_id"], b["h"], b["text"]):
                if t not in memo:
                    s = described(t, shared.value)
                    memo[t] = ([_KIND[k] for k, *_ in s], [r[2] for r in s], [r[3] for r in s], [r[4] for r in s], [v for r in s for v in r[5]], [beside(t, r[2], r[3]) for r in s], [t[r[2] : r[3]] for r in s]) if s else None
                if memo[t] is not None:
                    rows.append((doc, h, *memo[t]))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "kind", "start", "end", "label", "features", "words", "surface"])

    texts = documents.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return texts.mapInPandas(run, f"doc_id {kind}, {_SPANS}")


def _features(column: pd.Series) -> np.ndarray:
    return np.concatenate(list(column)).astype(float).reshape(-1, _SPEAKING) if len(column) else np.zeros((0, _SPEAKING))


def learn_cues(labels: DataFrame) -> dict[str, dict[str, float]]:
    """The cues of each kind, from all labelled spans (``kind, label, words``)."""
    yes, no = F.sum("label"), F.sum(1 - F.col("label"))
    size = {r["kind"]: (r["yes"], r["no"]) for r in labels.groupBy("kind").agg(yes.alias("yes"), no.alias("no")).collect()}
    words = labels.select("kind", "label", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where("word <> ''").groupBy("kind", "word").agg(yes.alias("yes"), no.alias("no"))
    least = F.lit(0.0)
    for kind, (n, m) in size.items():
        least = F.when(F.col("kind") == kind, max(5.0, (n + m) / CUE_SHARE)).otherwise(least)
    counts: dict[int, dict[str, tuple[float, float]]] = {k: {} for k in size}
    for r in words.where(F.col("yes") + F.col("no") >= least).toLocalIterator():
        counts[r["kind"]][r["word"]] = (r["yes"], r["no"])
    return {KINDS[k]: cue_scores(dict(sorted(c.items())), *size[k]) for k, c in counts.items()}


def choose_thresholds(labels: DataFrame, models: dict[str, Boosted]) -> dict[str, float]:
    """The threshold of each kind, from all labelled spans of the texts given (``kind, label, features``)."""
    shared = labels.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, own in b.groupby("kind"):
                x = muted(with_cues(_features(own["features"]), [""] * len(own), {}))
                level = np.searchsorted(_LEVELS, shared.value[KINDS[kind]].predict(x), side="right")
                yield own[["kind", "label"]].assign(level=level).groupby(["kind", "label", "level"]).size().reset_index(name="n")

    counts: dict[str, list[tuple[float, float, int]]] = defaultdict(list)
    levels = labels.select("kind", "label", "features").mapInPandas(run, "kind byte, label double, level int, n long")
    for r in levels.groupBy("kind", "label", "level").agg(F.sum("n").alias("n")).collect():
        counts[KINDS[r["kind"]]].append((_LEVELS[r["level"] - 1] if r["level"] else 0.0, r["label"], r["n"]))
    return {k: best_threshold(*(np.array(v, dtype=float) for v in zip(*rows))) for k, rows in counts.items()}


def labelled(proposed: DataFrame) -> DataFrame:
    """``h, kind, label, words, features``: a row for each span with a weak label; copies of a text count once."""
    known = proposed.where(F.exists("label", lambda v: v.isNotNull() & ~F.isnan(v))).select("h", "kind", "label", "words", "features").dropDuplicates(["h"])
    each = known.select("h", F.posexplode("kind").alias("i", "kind"), "label", "words", "features")
    one = each.select("h", "kind", F.get("label", "i").cast("double").alias("label"), F.get("words", "i").alias("words"), F.slice("features", F.col("i") * _SPEAKING + 1, _SPEAKING).alias("features"))
    return one.where("label is not null and not isnan(label)")


def fit_detector(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, seed: int = 3, proposed: DataFrame | None = None, lexicon: Lexicon | None = None) -> Detector:
    """A detector whose lexicon, cues and thresholds are learnt from all texts.

    The trees are fitted on the labelled spans of at most about
    ``sample_documents`` texts, and of four fifths at most, picked by a hash of
    the text, so that copies count once; thresholds are chosen on all others.
    """
    texts = documents.where("text is not null and text <> ''")
    if proposed is None:
        lexicon = learn_lexicon(texts)
        proposed = materialize(propose(documents, lexicon), "proposed")
    labels = materialize(labelled(proposed), "labels")
    cues = learn_cues(labels)
    n = labels.select(F.approx_count_distinct("h")).first()[0]
    share = int(min(0.8, sample_documents / max(n, 1)) * 1_000_000)
    place = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(1_000_000))
    rows = labels.where(place < share).orderBy("h", "kind", "words").limit(20 * sample_documents).toLocalIterator()
    number: dict[int, int] = {}
    detector = Detector.train(lexicon, cues, [(KINDS[r["kind"]], r["words"], r["features"], r["label"], number.setdefault(r["h"], len(number))) for r in rows], seed)
    detector.thresholds |= choose_thresholds(labels.where(place >= share), detector.models)
    return detector


def find_personal(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``doc_id, kind, surface``: each distinct piece of personal information.

    Whole texts are searched, quotes and signatures too. NULL and empty texts
    give no row; texts repeated under other numbers give the same rows again,
    repeated rows of one document one row. Overlapping findings: the surer one,
    then the longer. Without a document the result is empty; extra columns are
    ignored. Unless given, the detector is learnt from the documents; a kind that
    nothing in them labels is judged by the default examples.
    """
    require(documents, "doc_id", "text")
    if detector is None:
        lexicon = learn_lexicon(documents.where("text is not null and text <> ''"))
        proposed = materialize(propose(documents, lexicon), "proposed")
        detector = fit_detector(documents, proposed=proposed, lexicon=lexicon)
    else:
        proposed = propose(documents, detector.lexicon)
    shared = documents.sparkSession.sparkContext.broadcast(detector)  # bounded by the sample and by shares of the labels
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["kind"].str.len().to_numpy()
            text = np.repeat(np.arange(len(b)), n)
            kinds, start, end, words, surface = (np.concatenate(list(b[c])) for c in ("kind", "start", "end", "words", "surface"))
            taken = shared.value.judge(text.tolist(), kinds, start.tolist(), end.tolist(), _features(b["features"]), list(words))
            doc = b["doc_id"].to_numpy()
            at = np.array(taken, dtype=np.int64)
            yield pd.DataFrame({"doc_id": doc[text[at]], "kind": np.array(KINDS, dtype=object)[kinds[at]], "surface": surface[at].astype(object)})

    return proposed.select("doc_id", "kind", "start", "end", "features", "words", "surface").mapInPandas(run, f"doc_id {kind}, kind string, surface string").distinct()


def redact(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``doc_id, text`` with each finding replaced by ``[EMAIL]``, ``[PHONE]``,
    ``[ID]``, ``[ADDRESS]`` or ``[NAME]``; all else unchanged. NULL stays NULL."""
    require(documents, "doc_id", "text")
    detector = fit_detector(documents) if detector is None else detector
    shared = documents.sparkSession.sparkContext.broadcast(detector)
    kind = dict(documents.dtypes)["doc_id"]

    def clean(text: str, found: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, k in found:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(dict.fromkeys(t for t in b["text"] if t))
            memo = {t: clean(t, f) for t, f in zip(texts, shared.value.find_all(texts))}
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [memo.get(t, t) for t in b["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string")
