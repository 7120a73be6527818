"""Sentence spans of a text by semi-Markov dynamic programming.

A text is cut into blocks first: paragraphs, list items and headings; fenced code and lines without letters or digits
hold none. Every place of a block where marks stand that can end a sentence in its script is a candidate, inside quotations
too. The program chooses the whole spans between candidates whose scores sum highest. A span is scored by

- its closing word and mark (abbreviations, numbers, initials, the mark's own weight),
- the word that opens the span after it,
- its length,
- its quotations and brackets: what it holds only in part costs more than any other term can win, and a quotation at its
  end counts differently if it is the whole span (what follows may tell who spoke) or follows words of the span itself.

The last term depends on both ends of a span, so a cut changes what later cuts are worth, and spans are chosen jointly.
Abbreviations and opening words are learned from the corpus (learn()); the lists below only add weight.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.plans.staging import stage

# Words that add weight, in lower case.
#: Titles, written with a capital: stand before a name.
TITLES = frozenset("Mr Mrs Ms Mx Dr Prof St".split())
#: Before a name or in the middle of a sentence.
NEVER = frozenset(
    "mr mrs dr prof st hr fr frl sra srta dra sr dña mme mlle mm messrs gen col capt lt rev hon "
    "vs cf e.g i.e eg ie viz approx esp incl z.b d.h u.a bzw ca evtl ggf vgl sog inkl bspw zzgl "
    "p.ej ej p.ex ex ud uds av vda c.-à-d env apr av см т.е т.к напр им ул проф акад π.χ δηλ βλ κ.κ डॉ मि.से श्री np tj tzn m.in".split()
)
#: Before a number.
NUMBERED = frozenset("no nos nr num núm núms fig figs sec secs sect abb abschn kap bd pág págs pag p pp s art arts vol ch chap eq tab ver стр рис гл табл п пп σελ αρ εικ n nº § ziff tel".split())
#: In the middle of a sentence or at its end.
MAYBE = frozenset("etc usw u.s.w inc ltd co corp bros jr p.m a.m pm am u.s u.k e.u u.n ph.d b.a т.д т.п др пр г гг руб тыс млн κ.λπ κ.ά κλπ ee.uu ff usf o.ä".split())
#: After a time of day these go on with the sentence.
GO_ON = frozenset("and or but to until till on in at by for from with every each daily as if when while so then local sharp is was the a".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
#: Words that open sentences, of English and German.
OPENERS = frozenset(
    "the a an it he she we they you i this that these those then there here his her its our your my who what when where why how if in on at for but and or so as no yes not to with after before from is are was do does did more next see use read each every all some "
    "der die das ein eine es er sie wir ich ihr man am im auf bei mit nach von vor zu zum zur für nr siehe bitte läuft warum wie wer wo wenn als aber und oder dann hier dort jeder jede jedes dieser diese dieses kein keine dr".split()
)
OPEN_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", '"': '"', "＂": "＂"}
COMMAS = ",;:，、：；،؛፣፤·၊՝"
DASHES = "—–―‒-"

_BLANKS = " \xa0\u202f\n"
#: Marks that end sentences: the Unicode property without the Burmese comma, the ellipsis, Tibetan shads, and the Greek
#: question mark, which may be written as a semicolon.
_END = regex.compile(r"(?:(?![၊])\p{Sentence_Terminal}|[…།༎༏༑;;．])+")
_MARK = regex.compile(r"(?![၊])\p{Sentence_Terminal}|[…།༎༏༑．]")
_PAIRS = regex.compile(r"[()\[\]{}（）［］【】「」『』《》〈〉«»‹›“”„‘’‚\"＂]")
_OPENERS = regex.compile(r"[\s(\[{（［【「『《〈«‹»›“”„‘‚\"＂'¿¡*_]*")
_SPACED = regex.compile(r"(?<=[\p{Thai}\p{Lao}])\s+(?=[\p{Thai}\p{Lao}])")
_TICKS = re.compile(r"`[^`]+`")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r"^[ \t]*(=+|-+|~+)[ \t]*$")
_HEAD = re.compile(r"^[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"^[ \t]*(?:([-*+•])|(\d{1,9})[.)])(?:[ \t]+|$)")
_LEAD = regex.compile(r"(?:[\s\ufeff\u200b]|#+(?=[\s#]|$)|[-*+•](?=\s)|\d{1,9}[.)](?=\s))*")
_GAP = regex.compile(r"\s*")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.'’º§_-]*")
_WORD_AT = regex.compile(r"[\p{L}\p{M}\p{N}'’-]*")
_ROMAN = regex.compile(r"[IVXLC]+\b")
_DOTTED = regex.compile(r"(?:\p{L}{1,3}\.)+\p{L}{1,3}")
_GERMAN = re.compile(r"\b(?:der|die|das|und|nicht|ein|eine|einen|den|dem|wurde|ist|am)\b", re.I)
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
#: Scripts with a full stop of their own, and marks that are one. In a text that has such a mark a dot is none there.
_OWN_SCRIPT = regex.compile(r"[\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Ethiopic}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Armenian}\p{Mongolian}]")
_OWN_STOP = regex.compile(r"[।॥።。｡។៕။།༎։᠃᠉]")
_GREEK = regex.compile(r"\p{Greek}")
_CASELESS = regex.compile(r"[\p{Lo}\p{Lm}]")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_QUOTES = "”»\"“」"
_PARTICLES = "とっ、。がのをにはでもや"


class Statistics(NamedTuple):
    """What is learned of a corpus: types that are abbreviations, and words that open sentences, each with a weight."""

    abbreviations: dict[str, float]
    openers: dict[str, float]


NOTHING = Statistics({}, {})


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end and kind (text, head) of each block, in order."""
    pos, lines = 0, []
    for line in re.split("(?<=\n)|(?<=\r)(?!\n)", text):
        if line:
            lines.append((pos, line.rstrip("\r\n  ")))
            pos += len(line)
    if lines and lines[0][1].startswith("\ufeff"):
        lines[0] = (1, lines[0][1][1:])
    start = end = None
    listed: int | None = None  # number of the list item that is open, 0 for a bullet
    fence = None
    underlined = -1  # the line that underlines a heading
    for k, (at, line) in enumerate(lines):
        bare = line.strip(" \t﻿​\xa0　\f\v")
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        m = _FENCE.match(line)
        rule = _RULE.match(line)
        # a line of ~ under a heading that was just taken is its underline and opens no fence
        if m and not (m[1][0] == "~" and rule and (start is not None or underlined == k)) and not ("`" in m[2] and m[1][0] == "`"):
            if start is not None:
                yield start, end, "text"
                start = None
            listed, fence = None, m[1]
            continue
        if not bare:
            if start is not None:
                yield start, end, "text"
                start = None
            # a blank line does not end the numbering of a list
            continue
        item = _ITEM.match(line)
        if rule and not (item and bare not in ("-",) and len(bare) == 1):
            if start is not None:
                yield start, end, "text"
                start = None
            continue
        under = k + 1 < len(lines) and (r := _RULE.match(lines[k + 1][1])) is not None and len(r[1]) > 1
        if _HEAD.match(line) or (under and not item):
            if start is not None:
                yield start, end, "text"
                start = None
            yield at, at + len(line), "head"
            listed, underlined = None, k + 1 if under else -1
            continue
        if item:
            number = int(item[2]) if item[2] else 0
            # inside a paragraph a number with a dot is a wrapped word unless it begins or goes on a list
            begins = start is None or item[1] is not None or (listed is not None and number == listed + 1) or (number == 1 and listed is None and not _open_ended(text, start, end))
            if begins:
                if start is not None:
                    yield start, end, "text"
                start, end, listed = at, at + len(line), number
                continue
        elif start is None:
            listed = None
        if start is None:
            start = at
        end = at + len(line)
    if start is not None and not fence:
        yield start, end, "text"


def _open_ended(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] lacks an end mark or a colon, closing quotations and brackets aside."""
    while end > start and (text[end - 1].isspace() or text[end - 1] in "\"'”»)"):
        end -= 1
    return end == start or text[end - 1] not in ".!?:…。！？"


def _pairs(block: str) -> list[tuple[int, int]]:
    """Quotations and brackets that are closed, outermost only, with code between back ticks."""
    ticks = [(m.start(), m.end() - 1) for m in _TICKS.finditer(block)] if "`" in block else []
    starts = [a for a, _ in ticks]
    out: list[tuple[int, int]] = list(ticks)
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()  # closing marks that would close something on the stack
    quotes = block.count('"')
    for m in _PAIRS.finditer(block):
        c, i = m[0], m.start()
        quotes -= c == '"'
        if starts and (k := bisect_right(starts, i) - 1) >= 0 and i <= ticks[k][1]:
            continue
        before, after = block[i - 1 : i], block[i + 1 : i + 2]
        closes = awaited[c] > 0
        if c == "’" and (after.isalnum() or not closes):
            continue
        if c == '"' and closes and before.isspace() and after and not after.isspace():
            closes = quotes % 2 == 0  # looks like an opening one; the rest must come out even
        if closes:
            while True:
                o, at = stack.pop()
                for x in OPEN_CLOSE[o]:
                    awaited[x] -= 1
                if c in OPEN_CLOSE[o]:
                    break
            out.append((at, i))
        elif c in OPEN_CLOSE and not (c == '"' and (after == "" or after.isspace() or before.isalnum())):
            stack.append((c, i))
            for x in OPEN_CLOSE[c]:
                awaited[x] += 1
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


def _closing(block: str, at: int) -> tuple[str, str]:
    """The word before a dot, in lower case without outer dots, and as it is written; with the one before if both make a
    listed abbreviation written with a blank (z. B., т. д., p. ej.)."""
    word = _WORD_BEFORE.match(block, 0, at)[0]
    if len(word) <= 3:
        start = at - len(word)
        gap = start
        while gap and block[gap - 1].isspace():
            gap -= 1
        if 0 < gap < start and block[gap - 1] == ".":
            both = f"{_WORD_BEFORE.match(block, 0, gap - 1)[0]}.{word}".lower()
            if both in NEVER or both in MAYBE:
                return both, word
    word = word[max(word.rfind("'"), word.rfind("’")) + 1 :]  # l'art.
    return word.lower().strip("."), word


class _Next(NamedTuple):
    """What stands after a cut: whether blanks come first, the first character, the first word past opening marks, and
    the class of its first letter: upper, lower, digit, caseless or other."""

    spaced: bool
    char: str
    head: str
    kind: str
    at: int


def _next(block: str, cut: int) -> _Next | None:
    at = _GAP.match(block, cut).end()
    if at == len(block):
        return None
    p = _OPENERS.match(block, at).end()
    head = _WORD_AT.match(block, p)[0]
    x = block[p : p + 1]
    if x.isupper() or x.istitle() or (x.islower() and any(y.isupper() for y in head[1:])):  # names such as iOS open too
        kind = "upper"
    else:
        kind = "lower" if x.islower() else "digit" if x.isdigit() else "caseless" if _CASELESS.match(x) else "other"
    return _Next(at > cut, block[at], head, kind, p)


# Weights of the terms. HARD: whatever else is said, no end.
HARD = -100.0
#: A quotation or bracket held in part costs more than all other terms together can win.
BALANCE = -60.0
#: A span costs more the longer it is, from LONG code points on, at most LONGEST; beyond FAR all spans cost the same.
LONG, SLOPE, LONGEST = 300, 1 / 500, 1.5
FAR = LONG + int(LONGEST / SLOPE)
#: No cut scored lower can pay: most that length and the change of a later quotation's term can win.
LEAST = -20.0


def _dot(block: str, first: int, nxt: _Next, opens: float, own: bool, own_stop: bool, german: bool, known: Statistics) -> float:
    """Score of a single dot: the word it closes, and the one that opens after it."""
    lower, upper, digit = nxt.kind == "lower", nxt.kind == "upper", nxt.kind == "digit"
    word, written = _closing(block, first)
    if own:
        if own_stop:
            return HARD  # the text has a full stop of the script
        score = 4.0
    else:
        score = 3.0 if lower else 6.0
    learned = known.abbreviations.get(word, 0.0)
    if word in NEVER or written in TITLES or digit and word in NUMBERED:
        return score - 15.0
    if learned:
        score -= learned * (3.0 if upper else 9.0)
    if word in ("a.m", "p.m"):
        return score - (9.0 if lower and nxt.head in GO_ON else 0.0 if lower else 3.0)
    if word in MAYBE:
        return min(score, 3.0 if upper else score) - (9.0 if lower or digit and len(word) < 3 else 3.0 if not upper else 0.0) + (opens if upper else 0.0)
    if word in NUMBERED and len(word) > 1 and _ROMAN.match(block, nxt.at):
        return score - 10.0
    if written.isdigit():
        if nxt.head.lower() in MONTHS and len(written) <= 2:
            return score - 15.0
        if german and len(written) <= 2 and (lower or upper):  # ordinals; a noun belongs to one, a word seldom capital doesn't
            return -2.0 + (6.0 * opens if upper else 0.0)
        return score - 2.0 if not lower else 4.0
    if len(written) == 1 and written.isalpha():
        if len(nxt.head) <= 2 and nxt.head.isalpha() and block[nxt.at + len(nxt.head) : nxt.at + len(nxt.head) + 1] == ".":
            return -6.0  # z. B.
        # initials stand before names, labels (plan B, item a) before any word
        return -6.0 + (9.0 * opens if upper else 0.0) if (upper and written.isupper()) or lower else 2.0 if upper else -1.0
    if _DOTTED.fullmatch(written):
        return -6.0 if lower or digit else 2.0 + opens
    return score


def _score(block: str, first: int, last: int, nxt: _Next, own_stop: bool, german: bool, known: Statistics) -> float:
    """Score of a cut after the marks block[first:last], quotations aside."""
    marks = block[first:last]
    before = block[first - 1 : first]
    own = bool(_OWN_SCRIPT.match(before)) if before else False
    full = any(x > "\x7f" and x not in "…;．․" for x in marks)
    if nxt.char in COMMAS:
        return HARD
    if ";" in marks or ";" in marks:
        if not (before and _GREEK.match(before) and nxt.spaced) or set(marks) - set(";;"):
            return HARD
    if not full and not nxt.spaced and not (own and _OWN_SCRIPT.match(nxt.char) and "." not in marks and "…" not in marks):
        return HARD
    lower, upper = nxt.kind == "lower", nxt.kind == "upper"
    opens = known.openers.get(nxt.head.lower(), 1.0 if nxt.head.lower() in OPENERS else 0.0)
    score = 0.0
    if nxt.char in DASHES:  # speech goes on after a dash in lower case
        rest = _GAP.match(block, nxt.at + 1).end() if nxt.at < len(block) else nxt.at
        after = _next(block, rest)
        if after is None or after.kind not in ("upper", "digit") and not (after.kind == "caseless" and full):
            return HARD
        nxt, lower, upper, score = after._replace(spaced=True), False, after.kind == "upper", -2.0
        opens = known.openers.get(nxt.head.lower(), 1.0 if nxt.head.lower() in OPENERS else 0.0)
    if set(marks) <= {"…"} or marks.startswith(".."):
        if upper and nxt.spaced and not own:
            return score + 4.0
        return score + (2.0 if nxt.char in "¿¡" else -6.0)
    if full and not own and not set(marks) - set("…。！？｡．"):
        return score + 9.0
    if "." not in marks and "．" not in marks and "․" not in marks:
        return score + 9.0 - (1.0 if lower else 0.0)  # ! ? and the marks of scripts that have their own
    if len(marks) > 1:
        return score + (HARD if own and own_stop else 6.0)
    return score + _dot(block, first, nxt, opens, own, own_stop, german, known)


def _length(block: str, a: int, b: int) -> float:
    """A short span of one word seldom is a sentence, a very long one neither."""
    size = b - a
    if size <= 60:
        part = block[a:b]
        return -0.5 if part.isascii() and len(part.split(None, 2)) < 2 else 0.0
    return 0.0 if size <= LONG else -min(LONGEST, (size - LONG) * SLOPE)


class _Place(NamedTuple):
    """A candidate: where it cuts, its score, and, after a quotation, where that opens, where another one ended before,
    and the scores if the quotation is the whole span, follows words, or follows words after a colon or another quotation."""

    cut: int
    score: float
    quote: int = -1
    prior: int = -1
    alone: float = 0.0
    led: float = 0.0
    led_in: float = 0.0


def _places(block: str, pairs: list[tuple[int, int]], own_stop: bool, known: Statistics) -> list[_Place]:
    opens = [a for a, _ in pairs]
    close_at = {b: (a, b) for a, b in pairs}
    lead = _LEAD.match(block).end()
    kana, german = bool(_KANA.search(block)), bool(_GERMAN.search(block))

    def depth(i: int) -> bool:
        k = bisect_right(opens, i) - 1
        return k >= 0 and opens[k] < i <= pairs[k][1]

    found: dict[int, _Place] = {}
    for m in _SPACED.finditer(block):
        found[m.start()] = _Place(m.start(), 9.0 + (BALANCE if depth(m.start()) else 0.0))
    done = 0
    for m in _END.finditer(block):
        first, last = m.span()
        if first < done:
            continue
        cut, quote = last, None
        while cut < len(block):
            c = block[cut]
            if cut in close_at:
                quote = close_at[cut]
                cut += 1
            elif c in _BLANKS and cut + 1 in close_at and block[cut + 1] in "»›":  # « ainsi. »
                quote = close_at[cut + 1]
                cut += 2
            elif quote is not None and _MARK.match(c):
                quote, first, last = None, cut, cut + 1
                cut += 1
            elif c in "*_" and (cut + 1 == len(block) or block[cut + 1] in "*_ \n\t\r"):
                cut += 1
            else:
                break
        done = cut
        if cut <= lead or cut >= len(block):
            continue
        nxt = _next(block, cut)
        if nxt is None:
            continue
        inside = BALANCE if depth(cut) else 0.0
        if quote is None or block[quote[1]] == "`":
            s = _score(block, first, last, nxt, own_stop, german, known) + inside
            if s > LEAST:
                found[cut] = _Place(cut, s)
            continue
        if inside or _score(block, first, last, nxt, False, False, NOTHING) == HARD and not nxt.spaced and not _OWN_SCRIPT.match(nxt.char) and block[last - 1] not in "。！？｡":
            continue
        if nxt.char in COMMAS or nxt.char in DASHES and nxt.kind != "upper" and not (_dashed(block, nxt)):
            continue
        a = quote[0]
        if kana:
            s = HARD if nxt.char in _PARTICLES else 4.0
            if s > LEAST:
                found[cut] = _Place(cut, s)
            continue
        lower, caseless, upper = nxt.char.islower() and nxt.kind == "lower", bool(_CASELESS.match(nxt.char)), nxt.char.isupper() or nxt.kind == "upper"
        alone = 3.0 if block[a] in "([（［【" else HARD if lower or caseless else 5.0
        led = -5.0 if lower else 6.0 if upper else 3.0
        at = a
        while at and block[at - 1].isspace():
            at -= 1
        tail = block[at - 1 : at]
        led_in = 5.0 if lower else 6.0
        prior = -1
        if tail and tail in ":：":
            led = led_in
        elif tail and tail in ",，":
            prior = max(block.rfind(q, 0, a) for q in _QUOTES)
        found[cut] = _Place(cut, 0.0, a, prior, alone, led, led_in)
    return [found[k] for k in sorted(found) if found[k].cut < len(block)]


def _dashed(block: str, nxt: _Next) -> bool:
    """Whether a capital follows the dash that stands here."""
    after = _next(block, nxt.at + 1) if nxt.at < len(block) else None
    return after is not None and after.kind == "upper"


def spans(block: str, own_stop: bool | None = None, known: Statistics = NOTHING) -> list[tuple[int, int]]:
    """Sentences of one block as (start, end) within it. own_stop: whether the text has a full stop other than the dot."""
    own_stop = bool(_OWN_STOP.search(block)) if own_stop is None else own_stop
    places = _places(block, _pairs(block), own_stop, known)
    if not places:
        return [(0, len(block))]
    run = [0, *(p.cut for p in places), len(block)]
    places = [_Place(0, 0.0), *places, _Place(len(block), 0.0)]
    n = len(run)
    words = [0]  # pieces with letters or digits up to a place
    for a, b in zip(run, run[1:], strict=False):
        words.append(words[-1] + (_ALNUM.search(block, a, b) is not None))
    best, back = [0.0] + [float("-inf")] * (n - 1), [0] * n
    top = [0] * n  # where best is highest up to a place, as all spans from beyond FAR cost the same
    for j in range(1, n):
        p, here = places[j], run[j]
        alone_from = -1  # the start from which the quotation is the whole span
        if p.quote >= 0:
            k = bisect_right(run, p.quote, 0, j) - 1
            if not block[run[k] : p.quote].strip() or k == 0 and _LEAD.match(block).end() >= p.quote:
                alone_from = k
        i = j - 1
        while i >= 0 and here - run[i] <= FAR:
            v = best[i] + _length(block, run[i], here) + p.score + (-20.0 if words[j] == words[i] else 0.0)
            if p.quote >= 0:
                v += p.alone if i == alone_from else p.led_in if p.prior >= run[i] else p.led
            if v > best[j]:
                best[j], back[j] = v, i
            i -= 1
        if i >= 0:
            far = top[i] if alone_from > i or alone_from < 0 else top[alone_from - 1] if alone_from else -1
            v = best[far] - LONGEST + p.score + (p.led_in if p.prior >= here - FAR else p.led if p.quote >= 0 else 0.0) if far >= 0 else float("-inf")
            if v > best[j]:
                best[j], back[j] = v, far
            if 0 <= alone_from <= i and (v := best[alone_from] - LONGEST + p.alone) > best[j]:
                best[j], back[j] = v, alone_from
        top[j] = j if best[j] > best[top[j - 1]] else top[j - 1]
    out, j = [], n - 1
    while j:
        out.append((run[back[j]], run[j]))
        j = back[j]
    return out[::-1]


def sentences(text: str | None, known: Statistics = NOTHING) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points; start is past white space and heading or list marks."""
    out = []
    text = text or ""
    own_stop = _OWN_STOP.search(text) is not None
    for a, b, kind in blocks(text):
        block = text[a:b]
        if not _ALNUM.search(block):
            continue
        begins = _LEAD.match(block).end()
        for s, e in [(0, len(block))] if kind == "head" else spans(block, own_stop, known):
            part = block[s:e]
            if not _ALNUM.search(part):
                continue
            skip = begins if s == 0 else len(part) - len(part.lstrip())
            out.append((a + s + min(skip, len(part)), a + s + len(part.rstrip())))
    return out


# Learning from the corpus

#: A type is learned if it makes up this share of all dots at least, so 1 / SHARE types at most are kept and sent to tasks.
SHARE = 1 / 50_000
_STOP = regex.compile(r"(?P<w>[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)\.(?:[ \t]+\n?[ \t]*|\n[ \t]*|(?=[,;:]))(?P<n>[\p{L}\p{N},;:][\p{L}\p{M}]*)")
_TYPES = regex.compile(r"[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*")
_INNER = regex.compile(r"(?<=[\p{Ll},] )\p{Lu}[\p{L}\p{M}]*")
#: Counters are handed on when they hold so many types, so a task's memory doesn't grow with its input.
_HELD = 200_000


def _counted(documents: DataFrame, count, schema: str = "kind string, term string, n bigint") -> DataFrame:
    """Sums over all documents of what count(text) adds to a Counter of (kind, term)."""

    def rows(c: Counter) -> pa.RecordBatch:
        keys = list(c)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(c.values()), pa.int64())], ["kind", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                count(t.as_py(), held)
                if len(held) > _HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    return documents.select("text").where(F.col("text").isNotNull()).mapInArrow(run, schema).groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _stops(text: str, held: Counter) -> None:
    """Dots after words: of each type all, those the sentence goes on after, those before a digit; capitals that follow."""
    n = 0
    for m in _STOP.finditer(text):
        n += 1
        w, x = m["w"].lower(), m["n"]
        held["dot", w] += 1
        if x[0].islower() and x.islower() or x[0] in ",;:":
            held["on", w] += 1
        elif x[0].isdigit():
            held["digit", w] += 1
        elif x[0].isupper():
            held["opens", x.lower()] += 1
    held["all", ""] += n


def learn(documents: DataFrame, share: float = SHARE) -> Statistics:
    """Abbreviations and opening words of the texts, by counts over all of them.

    A type is an abbreviation if it hardly ever stands without a dot and the sentence mostly goes on after it (a small
    letter, a comma or a digit follows); a word opens sentences if it is capital after dots but small inside sentences.
    Only types with `share` of all dots count, at most 1 / share of each, which bounds what reaches driver and tasks.
    """
    counts = stage(_counted(documents, _stops), "stops")
    total = F.sum(F.when(F.col("kind") == "all", F.col("n")))
    wide = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("dot", "on", "digit", "opens")], total.alias("all_"))
    n_dots = counts.where("kind = 'all'").agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    least = max(2, n_dots * share)
    rows = wide.where((F.col("term") != "") & ((F.col("dot") >= least) & ((F.col("on") + F.col("digit")) * 2 >= F.col("dot")) | (F.col("opens") >= least))).collect()
    dotted = {r["term"]: r["dot"] for r in rows if r["dot"] >= least and (r["on"] + r["digit"]) * 2 >= r["dot"]}
    opening = {r["term"] for r in rows if r["opens"] >= least}
    if not dotted and not opening:
        return NOTHING
    sent = documents.sparkSession.sparkContext.broadcast((frozenset(dotted), frozenset(opening)))

    def uses(text: str, held: Counter) -> None:
        dots, opens = sent.value
        for w, n in Counter(_TYPES.findall(text)).items():
            low = w.lower()
            if low in dots:
                held["uses", low] += n
            if w == low and low in opens:
                held["small", low] += n
        for w, n in Counter(_INNER.findall(text)).items():
            if w.lower() in opens:
                held["capital", w.lower()] += n

    seen: dict[tuple[str, str], int] = {(r["kind"], r["term"]): r["n"] for r in _counted(documents, uses).collect()}
    found = {w: 1.0 for w, n in dotted.items() if n * 10 >= seen.get(("uses", w), n) * 9}
    openers = {}
    for w in opening:
        small, capital = seen.get(("small", w), 0), seen.get(("capital", w), 0)
        if small + capital:
            openers[w] = small / (small + capital)
    return Statistics(found, openers)


def split_sentences(documents: DataFrame, with_text: bool = False, known: Statistics | None = None) -> DataFrame:
    """doc_id, start_char, end_char (and sentence) of every sentence of text, whole texts, any language.

    known: what learn() found; by default it is learned from these documents. A null or empty text has no sentence;
    repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id bigint, start_char bigint, end_char bigint" + (", sentence string" if with_text else "")
    sent = documents.sparkSession.sparkContext.broadcast(learn(documents) if known is None else known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        for b in batches:
            ids, starts, ends, said = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sentences(t, learned)
                ids += [i] * len(got)
                starts += [x[0] for x in got]
                ends += [x[1] for x in got]
                if with_text:
                    said += [t[x[0] : x[1]] for x in got]
            cols = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(said, pa.string())] if with_text else cols, ["doc_id", "start_char", "end_char", "sentence"][: 4 if with_text else 3])

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(split, schema)
