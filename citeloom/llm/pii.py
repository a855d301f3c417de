"""Personal information inside free text (problem 10): anchor expansion.

One pass of an Aho-Corasick automaton over the text in lower case, with every digit read as 0, finds anchors: at-signs
and their written-out forms, schemes of links, shapes of numbers, cues of identity numbers, given names, titles and
contact cues, street words. Around each anchor a deterministic local parser expands and validates the boundaries of
an email address, phone number, identity number, street address or full personal name. Of overlapping finds the more
specific kind stays.

Given names are a parameter (`found_places`, `redacted`): a list of widespread ones by default, to which
`learned_names` adds those of a table. A name whose given name is on no list is found behind a title or a contact cue.

Offsets count code points. Null and empty texts give no finds; texts are processed whole; equal texts give equal
finds. Extra columns are ignored. The rest of a redacted text stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Given names that are widespread in many countries and are no common words, lower case.
GIVEN_NAMES = (
    "abdul abdullah adam aditi agnieszka ahmad ahmed aisha akira alberto alejandro alessandro alexander alexandra alice ali amina ana anders andrea andreas andrew "
    "anita anjali anna anne antoine antonio arjun arthur astrid barbara beatriz benjamin bernard brigitte camila carlos carmen caroline catherine charlotte chiara "
    "christina christopher claire claudia daniel david deepak deborah diego dimitri dmitry dominique edward elena elif elizabeth emily emma enrique erik esther eva "
    "fatima fatma felipe fernando francesca francesco francois friedrich gabriela george giovanni giulia gonzalo guillermo hamid hannah hans hassan heinrich helen "
    "henrik hiroshi hugo hussein ibrahim igor ingrid irina isabel ivan jacques james javier jean jennifer jessica joana joao johanna john jorge jose joseph juan julia "
    "kamal karen karin katarzyna kenji khalid kristina kumar kwame lars laura leila lucia luis magdalena marcin maria mariam marie marta martin matteo mehmet mei "
    "michael miguel mohamed mohammed monika mustafa natalia natasha nguyen nicolas nikolai noor olga olivia omar pablo patricia patrick paul pedro peter philip pierre "
    "priya rachel rahul rania ravi richard roberto samuel sanjay sara sergei sofia stefan susan sven takashi tatiana thomas tomasz vladimir yasmin yuki yusuf zainab"
).split()
#: Words of which an address is known, by the language whose addresses they are of.
STREET_WORDS = {
    "en": "street road avenue lane close court drive place square terrace crescent gardens grove mews".split() + [" ave", " st", " rd", " ln", " ct", " dr"],
    "de": ["straße", "strasse", "str.", "weg ", "gasse ", "allee ", "platz ", "ufer ", "damm ", "am ", "an der ", "auf dem ", "im ", "zum ", "zur "],
    "fr": ["rue ", "avenue ", "av. ", "boulevard ", "bd. ", "bd ", "chemin ", "place ", "allée ", "impasse ", "quai ", "route "],
    "es": ["calle ", "c/ ", "avda", "avenida ", "plaza ", "paseo ", "camino "],
}
#: What follows a name that belongs to an institute, a test or a place and not to a person.
NAMESAKES = "institute|institut|instituto|university|college|hospital|clinic|foundation|centre|center|wing|ward|building|library|laboratory|lab|labs|test|score|scale|index|syndrome|disease|method|reaction|stain|group|consortium|network|award|prize|lecture|street|road|avenue|lane"
#: Chinese two-character family names, and words after which a Chinese name stands.
COMPOUND_NAMES = "欧阳|司徒|尉迟|闻人|慕容|端木|上官|诸葛|东方|皇甫|公孙|司马|夏侯|令狐|宇文|长孙|轩辕|钟离"
NAME_CUES = "联系人|聯絡人|姓名|患者|受试者|负责人"
#: National significant digits by country code, where a numbering plan fixes them.
PLAN = {"1": 10, "33": 9, "34": 9, "44": 10, "61": 9, "81": 10, "86": 11}
#: Titles and contact cues behind which a full name of any given name is taken.
TITLES = ("dr. ", "prof. ", "mr. ", "mrs. ", "ms. ", "mr ", "mrs ", "ms ", "herr ", "frau ", "mme ", "mlle ", "sra. ", "sr. ", "attention ", "attn: ", "participant, ", "contact: ", "kontakt: ", "contacto: ", "signed by ")
#: Cues behind which an identity number of a person stands, in any form.
ID_CUES = (
    "passport no", "passport number", "passport:", "national insurance", "social security", "ssn", "nhs number", "nhs no", "personal id", "identity card", "id card", "driving licence", "driver's license",
    "steuer-id", "steuernummer", "sozialversicherungsnummer", "personalausweis", "reisepass", "numéro de sécurité sociale", "carte d'identité", "registre national", "dni ", "nie ", "nif ", "codice fiscale", "iban",
)
#: What number shapes have in common, every digit read as 0.
SHAPES = ("+0", "(000)", "000-000-0000", "000.000.0000", "000-00-0000", "000 00 0000", "00000 000", "00000000", "000 000", "000/0000", "00.00.00-000", "000-0000", "00 00 00", "000000")
#: Schemes of links that carry an address.
SCHEMES = ("mailto:", "tel:", "sip:")
_ZERO = bytes.maketrans(b"123456789", b"000000000")
_DIGIT = re.compile(r"\d")


def _zeroed(text: str) -> str:
    """``text`` with every ASCII digit as 0."""
    return text.encode("utf-8", "surrogatepass").translate(_ZERO).decode("utf-8", "surrogatepass")



_LETTER = r"[^\W\d_]"
_PARTICLES = r"(?:(?:van der|van den|van de|van|von|zu|de la|de|della|del|di|da|la|le)\s)*"
_PREFIX = r"(?:al-|el-|[dDoO]['’]|[Mm]a?c)?"


def _surname(upper: bool | None) -> str:
    """A family name in title case, in upper case (True) or in lower case (None)."""
    if upper:
        word = r"[A-ZÀ-ÖØ-ÞĀ-Ž]{2,}(?:['’][A-ZÀ-ÖØ-ÞĞŠŽĆČ]+)*"
        return rf"(?:(?:VAN DER|VAN DEN|VAN|VON|DE LA|DE|DELLA|DEL|DI|DA)\s)*(?:AL-|EL-|[DO]['’])?(?:{word})(?:-{word})*"
    if upper is None:
        word = rf"{_LETTER}{{3,}}"
        return rf"{_PARTICLES}(?:al-|el-|[do]['’])?{word}(?:-{word})*"
    word = r"[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]+"
    return rf"{_PARTICLES}{_PREFIX}{word}(?:-(?:{_PREFIX}){word})*"


_STYLES = {"title": False, "upper": True, "lower": None}
_AFTER = {k: re.compile(rf"(?:[ \n][A-ZÀ-Þa-z]\.)?[ \n]({_surname(v)})(?![\w@])") for k, v in _STYLES.items()}
_BEFORE = {k: re.compile(rf"(?<![\w@.\-'’])({_surname(v)}),[ \n]$") for k, v in _STYLES.items()}
_MIDDLE = re.compile(r"[ \n][A-Z]\.(?=[\s,;)/])")
_NAMESAKE = re.compile(rf"[\s\-](?:{NAMESAKES})\b", re.IGNORECASE)
_ENDS_IN_NAMESAKE = re.compile(rf"(?:^|[\s\-])(?:{NAMESAKES})$", re.IGNORECASE)
#: The second part of a given name such as Jean-Luc.
_SECOND_GIVEN = re.compile(r"-[A-ZÀ-Þ][^\W\d_]+(?=[ \n,])")
_PARTICLE_WORDS = frozenset("the van von der de la le du das die el al our this that".split())
#: Lower-case words that never are a family name in running text.
_NO_NAME = frozenset("and with from that this were been have which while when said says asked showed und oder mit nach sind wird wurde habite vive wohnt chez pour avec dans como para only also than then they them their there after before under over into onto".split())

_LOCAL = re.compile(r"[a-z0-9][a-z0-9._%+\-]*$")
_DOMAIN = re.compile(r"[a-z0-9\-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot )[a-z0-9\-]+)+")
_AT_FORMS = ("@", "(at)", "[at]", "{at}", " at ")

_NUMBERS = re.compile(
    r"""(?<![\w/.\-])(?:
      (?P<intl>\+\d{1,3}(?:[ .\-]?\(?\d{1,6}\)?){2,6})
    | (?P<nanp>\(\d{3}\)[ ]?\d{3}[\-. ]\d{4} | \d{3}[.\-]\d{3}[.\-]\d{4})
    | (?P<ssn>\d{3}-\d{2}-\d{4} | \d{3}[ ]\d{2}[ ]\d{4})
    | (?P<uk>07\d{3}[ ]?\d{3}[ ]?\d{3} | 0\d{2,4}[ ]\d{3,4}[ ]\d{3,4})
    | (?P<de>0\d{2,4}/\d{4,6}(?:-\d{1,4})?)
    | (?P<nrn>\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2})
    | (?P<short>\d{3}-\d{4})
    | (?P<nino>[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D])
    | (?P<passport>[A-Z]{2}\d{7})
    | (?P<nie>[XYZ]-?\d{7}-?[A-Z])
    )(?![\w])(?!-\d)(?!\.\d)""",
    re.VERBOSE,
)
_PHONES = {"intl", "nanp", "uk", "de", "short"}
_ID_BEHIND = re.compile(r"\.?\s*(?:number|no\.?|nr\.?|n°|card|licence|license|#|is|ist|:|\s)*[\s:]*([A-Z]{0,4}[ \-]?\d(?:[ .\-]?[A-Z0-9]){5,33})(?!\w)")
_LISTED = re.compile(r"(?:\s*[,;/]\s*|\s+(?:or|and|oder|und|ou|et|o|y)\s+)$")
_SIP = re.compile(r"[\w.+\-]{1,64}@[\w.\-]+\.[A-Za-z]{2,}")
#: Two words of letters in title case, as a name whose given name is on no list.
_UNLISTED = re.compile(rf"({_LETTER}+(?:-{_LETTER}+)*)(?:[ \n][A-Z]\.)?[ \n]{_surname(False)}(?![\w@])|{_surname(False)},[ \n]({_LETTER}+(?:-{_LETTER}+)*)(?![\w@])")
_PHONE_CUE = re.compile(r"(?:phone|tel|tél|mobile|call|ring|fax|电话|電話|тел|[;/]|\bon|\bunter)[.:]?\s*$", re.IGNORECASE)

_TOWN = r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ]?[\w'’]+)*"
_POSTAL = rf"(?:,[ \n]\d{{4,5}}[ \n]{_TOWN})?"
_ADDRESSES = {
    "en": re.compile(
        r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\w+,\s)?(?<![\w.])\d{1,4}[A-Za-z]?\s(?:(?:St|Mt)\.\s)?(?:[A-Z][\w'’\-]+\s){1,3}"
        r"(?:(?:Street|Road|Avenue|Lane|Close|Court|Drive|Place|Square|Terrace|Crescent|Gardens|Grove|Mews)\b|Ave\.|(?:Ave|St|Rd|Ln|Ct|Dr)\b(?:\.(?=[,.]))?)"
        rf"(?:,\s{_TOWN}(?:,?\s[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}})?)?"
    ),
    "de": re.compile(
        r"(?<!\w)(?:(?:Am|An der|Auf dem|Im|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß]+|(?:Obere|Untere|Alte|Neue|Große|Kleine|Lange|Hintere|Vordere)\s(?:Gasse|Straße|Allee)"
        r"|[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm))\s\d{1,4}\s?[a-z]?\b" + _POSTAL
    ),
    "fr": re.compile(
        r"(?<![\w.])\d{1,4}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|chemin|place|allée|impasse|quai|route)\s(?:de la |de l['’]|des |du |de |d['’])?"
        rf"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ]?[\w'’]+)*{_POSTAL}"
    ),
    "es": re.compile(
        r"(?<!\w)(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino)\s(?:de la |de los |de las |del |de )?[A-ZÀ-Þ][\w'’]+(?:\s[A-ZÀ-Þ][\w'’]+)*,\s\d{1,4}"
        rf"(?:,\s\d{{1,2}}\.?[ºª°](?:\s[A-Z])?)?{_POSTAL}"
    ),
}

Span = tuple[int, int, str]


class Finder:
    """Anchors and local parsers. Built once per Python worker."""

    def __init__(self, given: Iterable[str] = tuple(GIVEN_NAMES)):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, list[str]] = {}
        groups = {"given": given, **STREET_WORDS, "at": _AT_FORMS, "cue": NAME_CUES.split("|") + COMPOUND_NAMES.split("|"), "title": TITLES, "id": ID_CUES, "shape": SHAPES, "scheme": SCHEMES}
        for kind, words in groups.items():
            for word in words:
                anchors.setdefault(word, []).append(kind)
        for word, kinds in anchors.items():
            self.automaton.add_word(word, (kinds, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[Span]:
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters have a lower case of two
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        by_kind: dict[str, list[tuple[int, int]]] = {k: [] for k in (*STREET_WORDS, "at", "given", "cue", "title", "id", "shape", "scheme")}
        for end, (kinds, n) in self.automaton.iter(_zeroed(low)):
            for kind in kinds:
                by_kind[kind].append((end + 1 - n, end + 1))
        emails = [s for a in by_kind["at"] if (s := self._email(text, low, *a))] + [s for a in by_kind["scheme"] if (s := self._scheme(text, *a))]
        addresses = [s for language in STREET_WORDS for s in self._addresses(text, by_kind[language], _ADDRESSES[language])]
        numbers = self._numbers(text, sorted(by_kind["shape"])) + [s for a in by_kind["id"] if (s := self._cued_id(text, low, *a))]
        found = _disjoint([emails, addresses, numbers])
        taken = _Taken(found)
        names = [s for a in by_kind["given"] if (s := self._person(text, low, *a, taken))]
        names += [s for a in by_kind["cue"] if (s := self._han_name(text, *a))]
        titled = [s for a in by_kind["title"] if (s := self._titled(text, low, *a, taken))]
        return _disjoint([found, names, titled])

    def _email(self, text: str, low: str, start: int, end: int) -> Span | None:
        form = low[start:end]
        left, right = start, end
        if form != " at ":
            if left and low[left - 1] == " " and right < len(low) and low[right] == " ":
                left, right = left - 1, right + 1
            elif left and low[left - 1] == " ":
                return None
        # 64 and 253 characters are the most that mail standards allow
        if not (local := _LOCAL.search(low, max(0, left - 64), left)) or not (domain := _DOMAIN.match(low, right, right + 253)):
            return None
        if local.start() and (low[local.start() - 1].isalnum() and low[local.start() - 1].isascii()):
            return None
        stop = domain.end()
        if form == " at " and "dot" not in domain[0]:
            return None
        # a sentence may follow without a space: its first letter is upper case after a lower-case host
        dot = text.rfind(".", right, stop)
        if dot > 0 and text[dot + 1 : dot + 2].isupper() and text[dot - 1].islower() and text.find(".", right, dot) > 0:
            stop = dot
        while stop > right and text[stop - 1] == "-":
            stop -= 1
        if not re.search(r"[a-z]{2,}$", low[right:stop]):
            return None
        return local.start(), stop, "email"

    def _addresses(self, text: str, anchors: list[tuple[int, int]], pattern: re.Pattern) -> list[Span]:
        out: list[Span] = []
        done = -1
        for start, end in anchors:
            # an address has a house number
            lo, hi = max(0, start - 200), min(len(text), end + 200)
            if start < done or not _DIGIT.search(text, lo, hi):
                continue
            for m in pattern.finditer(text, lo, hi):
                if m.start() <= start + 1 and end - 1 <= m.end() + 1:
                    out.append((m.start(), m.end(), "address"))
                    done = m.end()
                if m.start() > end:
                    break
        return out

    def _scheme(self, text: str, start: int, end: int) -> Span | None:
        """The address of a link, where its own shape does not give it away already."""
        if text[start:end].lower() != "sip:":
            return None
        m = _SIP.match(text, end)
        return (m.start(), m.end(), "email") if m else None

    def _numbers(self, text: str, anchors: list[tuple[int, int]]) -> list[Span]:
        """Numbers around shape anchors. A number begins at most eight characters before its first anchor."""
        out: list[Span] = []
        done = 0
        for start, end in anchors:
            if end <= done:
                continue
            # bare digits are a number of interest only behind letters, or as a mobile number
            if text[start:end].isdigit() and not text.startswith("07", start):
                before = text[start - 1] if start else ""
                if not ("A" <= before <= "Z" or (before in " -" and start > 1 and "A" <= text[start - 2] <= "Z")):
                    continue
            m = _NUMBERS.search(text, max(done, start - 8), end + 64)
            if not m or m.start() > start or m.end() < end:
                continue
            done = m.end()
            kind, b, e = m.lastgroup, m.start(), m.end()
            if kind == "intl":
                e = _by_plan(text, b, e)
                if e is None:
                    continue
            if kind == "short" and not _PHONE_CUE.search(text, max(0, b - 12), b):
                before = _LISTED.search(text, max(0, b - 12), b)
                if not (before and out and out[-1][1] == before.start() and out[-1][2] == "phone"):
                    continue
            out.append((b, e, "phone" if kind in _PHONES else "id_number"))
        return out

    def _cued_id(self, text: str, low: str, start: int, end: int) -> Span | None:
        """The number behind a cue of identity numbers, with at least six digits."""
        if start and low[start - 1].isalnum() or not (m := _ID_BEHIND.match(text, end)) or sum(c.isdigit() for c in m[1]) < 6:
            return None
        return m.start(1), m.end(1), "id_number"

    def _titled(self, text: str, low: str, start: int, end: int, taken: _Taken) -> Span | None:
        """A full name in title case behind a title or a contact cue, whatever the given name."""
        if start and low[start - 1].isalnum() or not (m := _UNLISTED.match(text, end)):
            return None
        given = m[1] or m[2]
        if not all(len(w) > 1 and w[0].isupper() and w[1:].islower() for w in given.split("-")) or given.lower() in _PARTICLE_WORDS:
            return None
        stop = m.end() - 2 if m[0].endswith(("'s", "’s")) else m.end()
        if _NAMESAKE.match(text, stop) or _ENDS_IN_NAMESAKE.search(text[m.start() : stop]) or taken.meets(m.start(), stop):
            return None
        return m.start(), stop, "person"

    def _person(self, text: str, low: str, start: int, end: int, taken: _Taken) -> Span | None:
        if end < len(text) and text[end] == "-" and (second := _SECOND_GIVEN.match(text, end)):
            end = second.end()
        if start and (text[start - 1].isalnum() or text[start - 1] in "-_.@+'’") or end < len(text) and (text[end].isalnum() or text[end] in "-_@+"):
            return None
        if taken.meets(start, end):
            return None
        given = text[start:end]
        if end > start + 1 and "-" in given and not given[0].isupper():
            return None
        style = "upper" if given.isupper() else "lower" if given.islower() else "title"
        if (m := _AFTER[style].match(text, end, end + 200)) and not (style == "lower" and m[1].split()[-1] in _NO_NAME):
            stop = m.end()
            if text[stop - 2 : stop] in ("'s", "’s"):
                stop -= 2
            if _NAMESAKE.match(text, stop) or _ENDS_IN_NAMESAKE.search(m[1]) or taken.meets(start, stop):
                return None
            return start, stop, "person"
        if m := _BEFORE[style].search(text, max(0, start - 200), start):
            if taken.meets(m.start(1), start) or (style == "lower" and m[1].split()[-1] in _NO_NAME):
                return None
            mid = _MIDDLE.match(text, end)
            return m.start(1), mid.end() if mid else end, "person"
        return None

    def _han_name(self, text: str, start: int, end: int) -> Span | None:
        if text[start:end] in NAME_CUES.split("|"):
            m = re.compile(r"\s*[:：]?\s*([一-鿿]{2,4})(?![一-鿿])").match(text, end)
            return (m.start(1), m.end(1), "person") if m else None
        if start and "一" <= text[start - 1] <= "鿿":
            return None
        m = re.compile(r"[一-鿿]{1,2}(?![一-鿿])").match(text, end)
        return (start, m.end(), "person") if m else None


def _by_plan(text: str, start: int, end: int) -> int | None:
    """Where an international number ends by its country's numbering plan; groups that go beyond it are left out."""
    cc = re.match(r"\+(\d{1,3})", text[start:end])[1]
    code = next((c for c in (cc, cc[:2], cc[:1]) if c in PLAN), None)
    most = 1 + len(code) + PLAN[code] if code else 16
    stop, digits = start, 0
    for g in re.finditer(r"\d+", text[start:end]):
        digits += len(g[0])
        if digits > most - 1:
            break
        stop = start + g.end()
    n = sum(c.isdigit() for c in text[start:stop])
    return stop if (n == most - 1 if code else n >= 8) else None


class _Taken:
    """Disjoint spans in order; whether another one meets them is found by bisection."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.spans = sorted(spans)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (end,))
        return k > 0 and self.spans[k - 1][1] > start


def _disjoint(layers: list[list[Span]]) -> list[Span]:
    """Spans of earlier layers win over later ones, within a layer longer over shorter; in order of the text."""
    out = _Taken()
    for layer in layers:
        for s in sorted(set(layer), key=lambda x: (x[0] - x[1], x)):
            if not out.meets(s[0], s[1]):
                insort(out.spans, s)
    return out.spans


_FINDERS: dict[tuple[str, ...], Finder] = {}


def find(text: str | None, given: tuple[str, ...] = tuple(GIVEN_NAMES)) -> list[Span]:
    """The finds in ``text``; the automaton of a list of given names is built once per process."""
    if given not in _FINDERS:
        _FINDERS[given] = Finder(given)
    return _FINDERS[given].spans(text)


def learned_names(first_names: DataFrame, most_bytes: int = 32 << 20) -> tuple[str, ...]:
    """The widespread given names and those of a one-column table, in lower case, for `found_places` and `redacted`.

    Names of one word of at least three letters are taken, from all rows. Given names are a closed class that fits
    into memory; a table with more than ``most_bytes`` of distinct ones holds something else and is refused."""
    name = F.lower(F.btrim(F.col(first_names.columns[0])))
    distinct = first_names.select(name.alias("v")).where(r"v rlike '^\\p{L}{3,}$'").distinct()
    size = distinct.agg(F.sum(F.octet_length("v"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of distinct given names are more than {most_bytes}")
    return tuple(sorted({*GIVEN_NAMES, *(r.v for r in distinct.collect())}))


def pii_spans(text: Column, given: tuple[str, ...] = tuple(GIVEN_NAMES)) -> Column:
    """The finds of each text, in order, as an array of (begin_off, end_off, pii_type)."""

    @F.pandas_udf("array<struct<begin_off: int, end_off: int, pii_type: string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("begin_off", "end_off", "pii_type"), s)) for s in find(t, given)])

    return spans(text)


def redact_text(text: str | None, given: tuple[str, ...] = tuple(GIVEN_NAMES)) -> str | None:
    """``text`` with typed placeholders such as ``[EMAIL]`` in place of its finds; null stays null."""
    if text is None:
        return None
    parts, at = [], 0
    for b, e, kind in find(text, given):
        parts += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def redacted(text: Column, given: tuple[str, ...] = tuple(GIVEN_NAMES)) -> Column:
    """Each text redacted by `redact_text`."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, given))

    return redact(text)


def found_places(df: DataFrame, id_col: str, text: Column, given: tuple[str, ...] = tuple(GIVEN_NAMES)) -> DataFrame:
    """(id, begin_off, end_off, pii_type), one row per find."""
    return df.select(id_col, F.inline(pii_spans(text, given)))
