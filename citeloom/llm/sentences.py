"""Sentence boundaries across languages and scripts (problem 7): a pushdown automaton.

The automaton reads a text once. Its stack holds open quotation marks, brackets and list levels; terminators of
many scripts end a sentence only at the bottom of the stack. Before a full stop a trie of abbreviations is read
backwards; what follows decides in doubtful cases. It emits the offset just after each sentence's last non-blank character.

Null, empty and blank texts have no sentences. A text without a terminator is one sentence. Texts of any length are
processed whole in linear time. An opening mark without its closing mark is an ordinary character. Extra columns are
ignored; repeated rows give equal results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, lower case, without their last full stop.
NEVER = (
    "dr prof mr mrs ms mx st sr sra srta dra mme mlle mgr fr rev hon gen col sgt capt lt pres gov sen rep "
    "fig figs tab tabs tabl table abb abs eq eqs ref refs sec sect ch chap vol vols no nos nr pp p v vs vers ver ed eds cf ca approx aprox env esp resp suppl "
    "dept univ inst bzw ggf evtl sog vgl usf u z d s i "
    "z.b u.a d.h i.d.r s.o s.u u.u i.e e.g p.ej p.ex c.-à-d n.b viz al et.al "
    "ej ex núm nº art arts pág págs cap av avda "
    "ee рис табл см ср ок проф доц акад им напр гг стр т с св "
    "д डॉ प्रो श्री क "
    "د أ ص م"
).split()
#: Abbreviations that end a sentence where what follows can begin one.
MAYBE = "etc usw inc ltd co corp jr sr a.m p.m u.s u.k u.s.a e.u u.n d.c ee.uu uu n.s s.d ph.d m.d b.c a.d bd blvd и.т.д и.др т.д др г".split()
#: German words before which a number with a full stop is an ordinal.
ORDINAL_BEFORE = "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jh jahrestag jahrgang tag tages woche monat quartal kapitel auflage klasse stock mal platz rang".split()
#: Marks that end a sentence in any script but the full stop, which needs more thought.
HARD = "。！？｡।॥؟۔።፧?!‼⁇⁈⁉…"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "“": "”", "„": "“”", "‹": "›"}
_CLOSERS = set("".join(PAIRS.values()))
_WIDE = re.compile(r"[぀-ヿ一-鿿฀-๿]")
_THAI = re.compile(r"[฀-๿]")
_BRACKETED = re.compile(r"\s*(?:\(([^()\n]*)\)|\[\d[\d,;\s–-]*\])")
_CITES = re.compile(r"^REFS?$|PMID|pmid|PMC\d|doi|10\.\d{4}|(?:19|20)\d\d[a-z]?")
#: The label of a list item at the beginning of a line: a number, letter or Roman numeral with its mark, or a bullet.
_ITEM = re.compile(r"[ \t]*(?:(?P<label>\d{1,3}|[a-zA-Z]|[ivxIVX]{2,6})(?P<mark>[.)])|\((?P<inner>\d{1,3}|[a-z]|[ivx]{2,6})\)|(?P<bullet>[-–—•‣◦*]))[ \t]+(?=\S)")
_LIST_LABEL = re.compile(r"\d{1,3}(?:\.\d{1,2})*|[a-zA-Z]|[ivxIVX]{1,4}")
#: A single capital, or letters with full stops or hyphens between them.
_INITIALS = re.compile(r"[A-ZÀ-ÞА-ЯĀ-Ž]|(?:[^\W\d_][.\-]){1,4}[^\W\d_]")


class Trie:
    """Abbreviations, read backwards from a full stop."""

    def __init__(self, words: list[tuple[str, str]]):
        self.root: dict = {}
        for word, kind in words:
            node = self.root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = kind

    def before(self, low: str, end: int, start: int) -> tuple[str, int] | None:
        """The kind and the start of the longest abbreviation that ends at ``end`` and begins a word."""
        node, at, found = self.root, end, None
        while True:
            if "" in node and (at == start or not (low[at - 1].isalnum() or low[at - 1] in "'’-" and at - 1 > start and low[at - 2].isalnum() and node[""] != "never")):
                found = (node[""], at)
            if at == start:
                return found
            c = low[at - 1]
            if c in "  \n":
                # "z. B." and "z.B." are the same abbreviation
                back = at
                while back > start and low[back - 1] in "  \n":
                    back -= 1
                if back > start and low[back - 1] == "." and "." in node:
                    at = back
                    continue
                return found
            if c not in node:
                return found
            node, at = node[c], at - 1


_ABBREVIATIONS = Trie([(w, "never") for w in NEVER] + [(w, "maybe") for w in MAYBE])


def closing_marks(text: str) -> dict[int, int]:
    """For each opening quotation mark or bracket with a partner, the partner's offset."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    straight: int | None = None
    for i, c in enumerate(text):
        if c == '"':
            if straight is None:
                straight = i
            else:
                out[straight] = i
                straight = None
        elif c in PAIRS and not (c == "“" and stack and stack[-1][0] == "„"):
            stack.append((c, i))
        elif c in _CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if c in PAIRS[stack[k][0]]:
                    out[stack[k][1]] = i
                    del stack[k:]
                    break
    return out


def _marker_end(text: str, at: int) -> int | None:
    """Where the citation marker ends that stands at ``at``, behind blanks; None where there is none."""
    m = _BRACKETED.match(text, at)
    return m.end() if m and (m[1] is None or _CITES.search(m[1])) else None


_ROMAN = {"i": 1, "v": 5, "x": 10}


def _label_values(label: str) -> list[tuple[str, int]]:
    """What a list label can mean: its kind of numbering and its place in it."""
    if label.isdigit():
        return [("number", int(label))]
    case, low = ("upper" if label.isupper() else "lower"), label.lower()
    out = [(f"letter {case}", ord(low) - 96)] if len(low) == 1 and low.isascii() else []
    if set(low) <= set(_ROMAN):
        v = [_ROMAN[c] for c in low]
        out.append((f"roman {case}", sum(-x if x < max(v[k:]) else x for k, x in enumerate(v))))
    return out


def list_item(m: re.Match, levels: list[tuple[str, int]]) -> bool:
    """Whether a label begins an item; ``levels`` is the stack of open lists, innermost last, and follows.

    A label goes on with an open list if it is the next of it, which closes the lists within, or opens a list if it
    is the first of a numbering or a bullet. Any other number at the beginning of a line is ordinary text."""
    if m["bullet"]:
        meanings, mark = [("bullet " + m["bullet"], 0)], ""
    else:
        meanings, mark = _label_values(m["label"] or m["inner"]), m["mark"] or "()"
    for depth in range(len(levels) - 1, -1, -1):
        for kind, value in meanings:
            if levels[depth][0] == kind + mark and (value == levels[depth][1] + 1 or m["bullet"]):
                del levels[depth + 1 :]
                levels[depth] = (kind + mark, value)
                return True
    for kind, value in meanings:
        if value == 1 or m["bullet"]:
            levels.append((kind + mark, value))
            return True
    return False


def _starts_sentence(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can begin a sentence: an upper-case letter, a digit, an opening mark or a letter without case."""
    n = len(text)
    while at < n and text[at] in " \t\r\n\f\v 　":
        at += 1
    while at < n and text[at] in "\"'“„«‘([「『（¿¡—–-• ":
        at += 1
    if at >= n:
        return True
    c = text[at]
    return not c.islower()


def boundaries(text: str | None) -> list[int]:
    """The end offsets of the sentences of ``text``."""
    if not text or not text.strip():
        return []
    partner = closing_marks(text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    thai = len(_THAI.findall(text)) * 2 > sum(c.isalpha() for c in text)
    ends: list[int] = []
    n, i, start = len(text), 0, 0
    stack: list[int] = []  # offsets of the closing marks to come, innermost last
    levels: list[tuple[str, int]] = []  # kind and place of the open lists

    def emit(end: int) -> int:
        """End the sentence at ``end``, or behind the citation markers that follow it."""
        nonlocal start
        while (stop := _marker_end(text, end)) and not _continues(text, stop):
            end = stop
            while end < n and text[end] in ".。":
                end += 1
        if text[start:end].strip():
            ends.append(start + len(text[start:end].rstrip()))
            start = end
        return end

    while i < n:
        if not stack and (not i or text[i - 1] in "\r\n") and (item := _ITEM.match(text, i)) and list_item(item, levels):
            # an item is a unit of its own, and the full stop of its label ends nothing
            if text[start:i].strip():
                ends.append(start + len(text[start:i].rstrip()))
            start, i = i, item.end()
            continue
        if stack and i == stack[-1]:
            stack.pop()
            i += 1
            if not stack and _quoted_whole(text, start, i):
                i = emit(i)
            continue
        if i in partner:
            stack.append(partner[i])
            i += 1
            continue
        if stack:
            i += 1
            continue
        c = text[i]
        if thai and c in " \n\t " and i > start and text[start:i].strip():
            nxt = i
            while nxt < n and text[nxt].isspace():
                nxt += 1
            if nxt < n and not _marker_end(text, nxt) and _THAI.match(text[nxt]) and _thai_before(text, i):
                i = emit(i)
                i = max(i, nxt)
                continue
            i += 1
            continue
        if c == "." or c in HARD:
            stop = i
            while stop < n and (text[stop] == "." or text[stop] in HARD):
                stop += 1
            run = text[i:stop]
            close = stop
            while close < n and text[close] in "\"'”’»」』)" and close not in partner:
                close += 1
            if _ends(text, low, start, i, stop, close, run):
                i = emit(close)
                continue
            i = stop
            continue
        i += 1
    if text[start:].strip():
        ends.append(start + len(text[start:].rstrip()))
    return ends


def _thai_before(text: str, at: int) -> bool:
    """Whether the stretch before a space is Thai, or a marker after Thai."""
    return bool(_THAI.match(text[at - 1])) or text[at - 1] in ")]\"”»ๆฯ.?!" or text[at - 1].isdigit()


def _continues(text: str, at: int) -> bool:
    """Whether the text at ``at`` goes on in lower case, so that a marker before it is part of the next sentence."""
    while at < len(text) and text[at] in "  ":
        at += 1
    return at < len(text) and text[at].islower()


def _quoted_whole(text: str, start: int, end: int) -> bool:
    """Whether a quotation that was just closed is a sentence of its own: it opens the sentence, ends like one, and an upper-case letter follows."""
    body = text[start:end].strip()
    if len(body) < 3 or body[0] not in "\"“„«「『" or body[-2] not in ".!?。！？।؟":
        return False
    rest = text[end:]
    if body[0] in "「『" or not rest.strip():
        return False
    return rest[0].isspace() and rest.lstrip()[0].isupper() and not _marker_end(text, end)


def _ends(text: str, low: str, start: int, i: int, stop: int, close: int, run: str) -> bool:
    """Whether the run of terminators at ``i`` ends the sentence that begins at ``start``."""
    n = len(text)
    if stop >= n:
        return True
    nxt = close
    while nxt < n and text[nxt].isspace():
        nxt += 1
    after = text[nxt] if nxt < n else ""
    spaced = nxt > close
    if run[0] in "。！？｡।॥۔።፧" and "…" not in run:
        return True
    if "…" in run or run.startswith(".."):
        # an ellipsis ends a sentence only where the next one visibly begins
        return spaced and bool(after) and _starts_sentence(text, nxt) and not _WIDE.match(text[close])
    if run[0] in "?!؟" or run[0] in HARD:
        return not after.islower()
    # a full stop
    if not spaced:
        return _glued(text, low, start, i, close)
    found = _ABBREVIATIONS.before(low, i, start)
    if found:
        return found[0] == "maybe" and _starts_sentence(text, nxt)
    word = _last_word(text, start, i)
    if _INITIALS.fullmatch(word) or (_LIST_LABEL.fullmatch(word) and not text[start : i - len(word)].strip()):
        return False
    if word.isdigit() and len(word) <= 2:
        following = re.match(r"[^\W\d_]+", low[nxt : nxt + 24])
        if following and following[0] in ORDINAL_BEFORE:
            return False
    return _starts_sentence(text, nxt)


def _last_word(text: str, start: int, end: int) -> str:
    return re.search(r"[^\s(\[\"“„«]*$", text[max(start, end - 40) : end])[0]


def _glued(text: str, low: str, start: int, i: int, close: int) -> bool:
    """A full stop without a space behind it: a boundary where a word ends and a capitalised one begins."""
    n = len(text)
    if close >= n or close > i + 1:
        after = text[close] if close < n else ""
        return not after or (after.isupper() and close + 1 < n and not text[close + 1].isupper())
    a = text[close]
    if a in "\"“„«¿¡" and close + 1 < n:
        a = text[close + 1]
    if not (a.isalpha() and (a.isupper() or _WIDE.match(a))):
        return False
    before = text[i - 1] if i else ""
    if not (before.islower() or before in ")]»”\"%" or before.isdigit() or _WIDE.match(before)):
        return False
    found = _ABBREVIATIONS.before(low, i, start)
    if found and found[0] == "never":
        return False
    word = _last_word(text, start, i)
    if len(word) < 2 and before not in ")]":
        return False
    if "." in word and not word.replace(".", "").isdigit():
        return False
    tail = text[close : close + 2]
    return len(tail) < 2 or not tail[1].isupper()


def sentence_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, sent_no, end_off): one row per sentence, sent_no from 1."""

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        return texts.map(boundaries)

    cut = df.select(id_col, F.posexplode(ends(text)).alias("_p", "end_off"))
    return cut.select(id_col, (F.col("_p") + 1).cast("int").alias("sent_no"), "end_off")
