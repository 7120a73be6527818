"""Passages of test items inside documents, by pigeonhole edit matching on words.

A test item is cut into pieces of PIECE words: k + 1 pieces for an error budget of k word edits. A text within that budget
leaves at least one piece intact, and so does any run of 2 * PIECE - 1 consecutive words; an automaton finds all intact
pieces in one pass over a document. Around each hit Myers' bit-parallel edit distance on words decides: that of the whole
item against its budget, and that of the stretch around the piece, where a run of RUN words leaves at most so many edits
as the stretch has more words. Only what passes is looked at word by word.

What items share is told apart before: windows of RUN words that stand in one item only are its own. A piece that several
items share is searched for once, in the name of the least of them, so an instruction that opens millions of items makes
one row a document and not millions; passages() gives the items behind it. Each own window still holds a piece that is
searched for in its item's name.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.plans.staging import stage

PIECE, RUN = 7, 13
#: Words (in bytes) of items searched for by one automaton; more are taken in blocks, each with a pass over the documents.
BLOCK_BYTES = 16_000_000

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0]+")
_ESCAPED_CODE = re.compile(r"\\+(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_ESCAPED_SPACE = re.compile(r"\\+[nrtfvb0]")
_JOINED_LINE = re.compile(r"\\\r?\n")
_BLOCK_TAG = re.compile(r"</?(?:p|br|hr|li|ul|ol|dl|dt|dd|div|td|th|tr|table|tbody|thead|section|article|pre|blockquote|h[1-6]|para)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--|-->")
_LINK = re.compile(r"\]\([^()\s]*\)")
_GUTTER = re.compile(r"(?m)^[^\w\n]*\d+\s*[|\u2502]")
_WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case, digits as they are, all else a blank.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Stands between a text and what its tags hold, and is no word.
_APART = "\0"


def _code(m: re.Match) -> str:
    n = int(next(g for g in m.groups() if g), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "


def _plain(text: str) -> str:
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    text = _INVISIBLE.sub("", text)
    # upper case with marks may decompose on folding, so normal form comes before and after
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())))


def normal(text: str | None) -> str:
    """Runs of letters and digits, one blank between them, after undoing string escapes, markup, invisible characters,
    compatibility forms and case. A tag goes, however long; if it holds a passage's worth of words itself, as an attribute
    may, these follow at the end, and if it has no attribute it is taken for text and stays."""
    if not text:
        return ""
    if "\\" in text:
        text = _ESCAPED_SPACE.sub(" ", _ESCAPED_CODE.sub(_code, _JOINED_LINE.sub("", text)))
    if "&" in text:
        text = html.unescape(text)
    if "\0" in text:
        text = text.replace("\0", " ")
    held: list[str] = []
    if "<" in text:

        def tag(m: re.Match, instead: str = "") -> str:
            if len(m[0]) > 2 * RUN and len(_WORD.findall(m[0])) >= RUN:
                if "=" not in m[0]:
                    return f" {m[0][1:-1]} "
                held.append(_plain(m[0][1:-1]))
            return instead

        text = _TAG.sub(tag, _BLOCK_TAG.sub(lambda m: tag(m, " "), text))
    if "](" in text:
        text = _LINK.sub("]", text)
    if "|" in text or "\u2502" in text:
        text = _GUTTER.sub(" ", text)
    return f" {_APART} ".join([_plain(text), *held]) if held else _plain(text)


def words(text: str | None) -> list[str]:
    """The words of normal(), parts of a text set apart left out of the count."""
    return [w for w in normal(text).split(" ") if w and w != _APART]


def myers(pattern: list[str], text: list[str]) -> int:
    """The least number of word edits that turn pattern into some stretch of text."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a stretch may begin anywhere, so nothing is carried in
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        best = min(best, score)
    return best


def window_hash(ws: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(ws)) - (1 << 63)


class Item(NamedTuple):
    """One item with what it shares: of each position, the set of items that hold the window of RUN words there (0 if it is
    the item's own), whether others hold the piece there, and whether this item is the least of those."""

    words: list[str]
    sets: dict[int, int]
    shared: frozenset[int]
    least: frozenset[int]


def pieces_of(item: Item) -> dict[int, bool]:
    """Places of the pieces that are searched for in an item's name, and whether each counts for the whole item's budget.

    The item's pieces are those at every PIECE-th word that no other item holds, or that it is the least to hold. Each own
    window gets one more if none of these lies in it, and so does each place where the items that share windows change.
    """
    ws, last = item.words, len(item.words) - PIECE
    if not ws:
        return {}
    starts = [*range(0, max(last, 0) + 1, PIECE)]
    if last > 0 and starts[-1] != last:
        starts.append(last)
    out = {p: p not in item.shared for p in starts if p not in item.shared or p in item.least}
    mine = sorted(p for p in out if p not in item.shared)
    held = -1  # the last own piece taken
    k = 0
    for w in range(len(ws) - RUN + 1):
        changes = item.sets.get(w, 0) and w and item.sets.get(w - 1, 0) not in (0, item.sets[w])
        if item.sets.get(w, 0) and not changes:
            continue
        while k < len(mine) and mine[k] <= w + RUN - PIECE:
            held = max(held, mine[k])
            k += 1
        if changes or held < w:
            inside = range(w + RUN - PIECE, w - 1, -1)
            p = next((p for p in inside if p not in item.shared), w + RUN - PIECE)
            out.setdefault(p, False)
            if not changes:
                held = max(held, p)
    return out


class Found(NamedTuple):
    """A document's match with an item. own is None if only a look at the whole run can tell."""

    item: int
    distance: int | None
    run: int
    start: int
    own: bool | None


class Matcher:
    """Search for the items of one block."""

    def __init__(self, items: dict[int, Item]):
        self.items = items
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        self.budgets: dict[int, int] = {}
        for i, item in items.items():
            own = pieces_of(item)
            self.budgets[i] = max(0, sum(own.values()) - 1)
            for p in own:
                self.pieces.setdefault(f" {' '.join(item.words[p : p + PIECE])} ", []).append((i, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        if self.pieces:
            self.automaton.make_automaton()

    def _own(self, item: Item, a: int, b: int) -> bool | None:
        """Whether words a to b of the item stand in this order in no other item."""
        sets = [item.sets.get(k, 0) for k in range(a, b - RUN + 1)]
        return True if 0 in sets else False if len(sets) == 1 else None

    def search(self, text: str | None) -> list[Found]:
        joined = normal(text)
        if not joined or not self.pieces:
            return []
        joined = f" {joined} "
        hits: list[tuple[int, str]] = list(self.automaton.iter(joined))
        if not hits:
            return []
        ws = joined[1:-1].split(" ")
        found: dict[int, list] = {}
        runs: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int]] = set()
        at = here = 0
        for end, piece in hits:
            start = end - len(piece) + 1
            if start >= here:
                at += joined.count(" ", here, start)
            else:  # a piece that ends later may begin earlier
                at -= joined.count(" ", start, here)
            here = start
            for i, p in self.pieces[piece]:
                item, diagonal = self.items[i], at - p
                own, k = item.words, self.budgets[i]
                state = found.setdefault(i, [None, 0, 0, False])
                if (state[0] is None or state[0] > 0) and (i, diagonal) not in tried:
                    tried.add((i, diagonal))
                    near = ws[max(0, diagonal - k) : diagonal + len(own) + k]
                    there = set(near)
                    # words that are nowhere near are edits for sure
                    if sum(w not in there for w in own) <= k and (d := myers(own, near)) <= k:
                        state[0] = d if state[0] is None else min(state[0], d)
                if runs.get((i, diagonal), -1) >= p:
                    continue  # inside a run already measured
                # the stretch in which any run of RUN words through the piece lies
                lo, hi = max(0, p - (RUN - PIECE)), min(len(own), p + RUN)
                budget = hi - lo - RUN
                if budget < 0 or myers(own[lo:hi], ws[max(0, diagonal + lo - budget) : diagonal + hi + budget]) > budget:
                    continue
                a, b = p, min(p + PIECE, len(own))
                while a > 0 and diagonal + a > 0 and own[a - 1] == ws[diagonal + a - 1]:
                    a -= 1
                while b < len(own) and diagonal + b < len(ws) and own[b] == ws[diagonal + b]:
                    b += 1
                runs[i, diagonal] = b - 1
                if b - a < RUN:
                    continue
                mine = self._own(item, a, b)
                better = (mine is True, mine is None, b - a) > (state[3] is True, state[3] is None and state[1] > 0, state[1] if state[3] is not True else 0)
                if state[1] == 0 or better:
                    state[1:] = [b - a, a, mine]
        return [Found(i, d, n, a, u) for i, (d, n, a, u) in found.items() if d is not None or n]


_ITEM = "item_id bigint, words array<string>, sets array<struct<pos: int, of: bigint>>, shared array<struct<pos: int, least: boolean>>"


def _grams(items: DataFrame) -> DataFrame:
    """item_id, size, h, pos of every window of RUN words and every piece of PIECE words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for size in (PIECE, RUN):
                    n = max(0, len(ws) - size + 1)
                    hs = [window_hash(ws[k : k + size]) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(hs, pa.int64()), pa.array(range(n), pa.int32())], ["item_id", "size", "h", "pos"])

    return items.mapInArrow(each, "item_id bigint, size int, h bigint, pos int")


def _worded(items: DataFrame) -> DataFrame:
    """item_id, words of the items; those without an id, a text or words are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ws, pa.list_(pa.string()))], ["item_id", "words"])

    kept = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    return kept.mapInArrow(each, "item_id bigint, words array<string>").where(F.size("words") > 0)


def passages(items: DataFrame) -> DataFrame:
    """of BIGINT, item_id, pos: the windows of RUN words that several items share. of tells the sets of items apart."""
    grams = _grams(_worded(items)).where(F.col("size") == RUN)
    return grams.join(_sharers(grams).select("size", "h", "of"), ["size", "h"]).select("of", "item_id", "pos")


def _sharers(grams: DataFrame) -> DataFrame:
    """size, h, of, first of what several items hold: a fingerprint of the set of items, and the least of them.

    Constant in size, however many items share it: the set is never collected.
    """
    g = grams.select("size", "h", "item_id").distinct().groupBy("size", "h")
    return g.agg(F.min("item_id").alias("first"), F.max("item_id").alias("__last"), F.bit_xor(F.xxhash64("item_id")).alias("of")).where(F.col("first") < F.col("__last")).drop("__last")


def _prepared(worded: DataFrame) -> DataFrame:
    """Items with what they share, in the schema of _ITEM; a row grows with its own item only."""
    grams = _grams(worded)
    met = grams.join(_sharers(grams), ["size", "h"])
    sets = F.collect_list(F.when(F.col("size") == RUN, F.struct("pos", F.when(F.col("of") == 0, 1).otherwise(F.col("of")).alias("of"))))
    shared = F.collect_list(F.when(F.col("size") == PIECE, F.struct("pos", (F.col("item_id") == F.col("first")).alias("least"))))
    return worded.join(met.groupBy("item_id").agg(sets.alias("sets"), shared.alias("shared")), "item_id", "left")


def _blocks(items: DataFrame, most: int) -> Iterator[dict[int, Item]]:
    block: dict[int, Item] = {}
    size = 0
    for r in items.toLocalIterator():
        shared = r["shared"] or []
        block[r["item_id"]] = Item(r["words"], {x["pos"]: x["of"] for x in r["sets"] or []}, frozenset(x["pos"] for x in shared), frozenset(x["pos"] for x in shared if x["least"]))
        size += sum(map(len, r["words"])) + len(r["words"])
        if size >= most:
            yield block
            block, size = {}, 0
    if block:
        yield block


#: The matcher a Python worker made last; its tasks share it.
_MADE: dict[str, Matcher] = {}


def _matcher(token: str, block: dict[int, Item]) -> Matcher:
    if token not in _MADE:
        _MADE.clear()
        _MADE[token] = Matcher(block)
    return _MADE[token]


def leaks(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, run, own for every document that holds an item wholly or partly.

    distance: word edits between the item and the closest stretch of the document, null if beyond the item's budget (one
    less than the number of its pieces that no other item holds). run: the words of a run of at least RUN equal words, 0 if
    there is none. own: whether that run stands in no other item; such a run is preferred to a longer one that doesn't. A
    document that holds only what several items share has a row for the least of these items: see passages(). Null texts
    and ids find nothing, an item without words neither; of items with the same id one counts; repeated document rows give
    repeated results; other columns are ignored; empty tables give no rows. Items go to the executors in blocks of
    block_bytes, so their number is not bounded.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").isNotNull())
    schema = "doc_id bigint, item_id bigint, distance int, run int, start int, own boolean"
    worded = stage(_worded(items.select("item_id", "text")).dropDuplicates(["item_id"]), "items")
    prepared = stage(_prepared(worded), "shared")
    out, unsure = None, False
    for block in _blocks(prepared, block_bytes):
        unsure = unsure or any(len(x.sets) > 1 for x in block.values())
        sent, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(token, sent.value)
            for b in batches:
                rows = []
                ids = b.column(0).to_pylist()
                for i, t in enumerate(b.column(1)):
                    rows += [(ids[i], *x) for x in matcher.search(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "distance", "run", "start", "own"])

        part = docs.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema).drop("start")
    if unsure:
        out = _decided(stage(out, "leaks"), prepared)
    return out.select("doc_id", "item_id", "distance", "run", F.coalesce("own", F.lit(False)).alias("own"))


def _decided(found: DataFrame, prepared: DataFrame) -> DataFrame:
    """found with own filled in where only windows that others share make up a run: whether another item holds it whole.

    An item can hold such a run only where it shares windows itself, so no other places are looked at.
    """
    asked = found.where("own is null and run > 0").select("item_id", "start", "run").distinct()
    # lengths of runs, at most as many as the longest item has words
    lengths = sorted(r["run"] for r in asked.select("run").distinct().toLocalIterator())
    if not lengths:
        return found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, ws, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                shared = set(at)
                for start in at:
                    for size in lengths:
                        if start + size > len(ws) or start + size - RUN not in shared:
                            continue
                        rows.append((i, size, start, window_hash(ws[start : start + size])))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["item_id", "run", "start", "h"])

    all_ = prepared.where(F.size("sets") > 0).select("item_id", "words", F.col("sets.pos").alias("at")).mapInArrow(whole, "item_id bigint, run int, start int, h bigint")
    hashed = asked.join(all_, ["item_id", "run", "start"])
    holders = all_.join(hashed.select("run", "h").distinct(), ["run", "h"]).groupBy("run", "h").agg(F.min("item_id").alias("__a"), F.max("item_id").alias("__b"))
    sole = hashed.join(holders, ["run", "h"]).select("item_id", "run", "start", (F.col("__a") == F.col("__b")).alias("sole"))
    return found.join(sole, ["item_id", "run", "start"], "left").withColumn("own", F.coalesce("own", "sole")).drop("sole")
