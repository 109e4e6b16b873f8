"""Test passages inside training documents: q-gram lemma filter and banded alignment.

Texts are reduced to their words: case, punctuation, markup, comment signs and
accents go, own macros are replaced by their meaning, notes and comments at
the end of a line move behind the text, each Han or Kana character is a word.
An item leaks into a document if a stretch of at least ``SHARE`` of the item's
words aligns with the document with at most one edit in ``EDIT`` words.

A stretch of L words with e edits keeps at least
``grams of the stretch - e * (longest word + q - 1)`` of its character
q-grams, whatever words are put in.  An edit moves what follows it by one
word at most, so all of these lie on e + 1 diagonals, a diagonal being the
place in the document minus the place in the item, counted in words.  A task
looks its documents' q-grams up in the item index, counts the hits per item
and overlapping band of so many diagonals, and keeps only bands that reach the
item's bound; these regions are spread over the cluster again and verified by
a banded word alignment.  Grams that many items share (stock phrases) are left
out of index and bound alike where an item's other grams suffice.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.markup import closing, definitions
from driftmesh.scratch import Scratch

#: Least share of an item's words that makes a leak, and words per allowed edit.
SHARE, EDIT = 0.4, 8
#: Characters of the items of one block; its index is broadcast and takes about 25 bytes a character.
BLOCK_CHARS = 1_000_000
#: Characters a task hashes at once, and hits it counts at once (8 bytes each).
CHARS, HITS = 600_000, 4_000_000
#: Lengths of q-grams, the longest first; an item takes the first whose bound is at least LEAST.  A single character
#: has a bound of at least 1 for every item.
GRAMS = (16, 8, 4, 2, 1)
LEAST = 24
#: A gram of more items than this is a stock one; an item takes the least number with which its bound is at least LEAST.
STOCK = (20,)

_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"\d+(?:[.,]\d+)+|[{_CJK}]|[^\W_{_CJK}]+")
_ASCII = re.compile(r"[a-z][a-z0-9]*|\d+(?:[.,]\d+)+|[a-z0-9]+")
_MARKS = re.compile("[\u0300-\u036f\u3099\u309a\u00ad\u200b-\u200f\u2060\ufeff]+")
_JOIN = re.compile(r"(?<=[^\s%])%[ \t]*\n[ \t]*")
_LEAD = re.compile(r"^[ \t]*%[% \t]*", re.M)
_TRAIL = re.compile(r"%(.*)")
_DROP = re.compile(r"\\(?:[cC]ite[a-z]*|ref|eqref|autoref|pageref|label|includegraphics|input|include|usepackage|documentclass|bibitem|begin|end|color|vspace|hspace)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}")
_ACCENT = re.compile(r"\\(?:[\'`^\"~=.]\s*|[cvHukrbdt](?=\s*\{)\s*)(?:\{\s*\\?([A-Za-z]{1,2})\s*\}|\\?([A-Za-z]))")
_LETTER = re.compile(r"\\(ss|oe|OE|ae|AE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]+)?")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?|\\(.)", re.S)
_FOLD = (("\u0153", "oe"), ("\u00e6", "ae"), ("\u00f8", "o"), ("\u0142", "l"), ("\u0131", "i"), ("\u0111", "d"))


def words_of(text: str) -> list[str]:
    """The words of a text, its notes and line-end comments last."""
    notes: list[str] = []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "%" in text:
        text = text.replace("\\%", " ")
        if "%" in text:
            text = _LEAD.sub("", _JOIN.sub("", text))
            text = _TRAIL.sub(lambda m: notes.append(m.group(1)) or " ", text)
    if "\\" in text:
        macros, spans = definitions(text) if "\\newcommand" in text or "\\def" in text or "\\renewcommand" in text or "\\DeclareMath" in text else ({}, [])
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        while (at := text.rfind("\\footnote{")) >= 0:
            end = closing(text, at + 10)
            notes.append(text[at + 10 : end])
            text = text[:at] + text[end + 1 :]
        text = _unmarked(text, macros)
        notes = [_unmarked(n, macros) if "\\" in n else n for n in notes]
    if notes:
        text = "\n".join([text, *notes])
    text = text.replace("{", "").replace("}", "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.replace("\u00df", "ss")))
        for a, b in _FOLD:
            if a in text:
                text = text.replace(a, b)
    return _ASCII.findall(text) if text.isascii() else _WORD.findall(text)


def _unmarked(text: str, macros: dict[str, tuple[int, str]]) -> str:
    """A text without commands; own macros give their meaning, other commands only their text."""
    text = _LETTER.sub(lambda m: m.group(1), _ACCENT.sub(lambda m: m.group(1) or m.group(2), _DROP.sub(" ", _filled_in(text, macros))))

    def command(m: re.Match) -> str:
        name = m.group(1)
        if name is None:
            return "" if m.group(2) == "-" else " "
        own = macros.get("\\" + name)
        if own and not own[0]:
            return f" {_unmarked(own[1], {k: v for k, v in macros.items() if k != m.group().rstrip('*')})} "  # no macro means itself
        return ""

    return _COMMAND.sub(command, text)


def _filled_in(text: str, macros: dict[str, tuple[int, str]]) -> str:
    """A text whose own macros with arguments are replaced by their meaning, the arguments put in."""
    names = [n for n, (arity, _) in macros.items() if arity]
    if not any(n in text for n in names):
        return text
    use = re.compile("(?:" + "|".join(map(re.escape, names)) + r")(?![A-Za-z])\s*(?:\[[^\]]*\]\s*)?")
    out, at = [], 0
    while m := use.search(text, at):
        name = m.group().split("[")[0].rstrip()
        arity, body = macros[name]
        args, k = [], m.end()
        for _ in range(arity):
            while text[k : k + 1].isspace():
                k += 1
            end = closing(text, k + 1) if text[k : k + 1] == "{" else k
            args.append(_filled_in(text[k + 1 : end] if end > k else text[k : k + 1], macros))
            k = end + 1
        body = _filled_in(body, {n: v for n, v in macros.items() if n != name})
        out += [text[at : m.start()], " ", re.sub(r"#(\d)", lambda d: args[int(d.group(1)) - 1] if 0 < int(d.group(1)) <= len(args) else "", body), " "]
        at = min(k, len(text))
    return "".join([*out, text[at:]])


def most_edits(n: int) -> int:
    """Edits of the longest leak of an item of n words that has no half which is a leak by itself."""
    return min(n, 2 * max(1, math.ceil(SHARE * n)) - 1) // EDIT


def kept_grams(sizes: np.ndarray, q: int, rare: np.ndarray) -> int:
    """The fewest rare character q-grams that any stretch that makes a leak shares with its edited copy.

    ``sizes``: the words' lengths with the blank behind each; ``rare``: which
    of the item's q-grams count.  With the same number of edits a longer
    stretch keeps no fewer, so the least length and the multiples of ``EDIT``
    above it are tried.  A leak of twice the least length or more has a half
    that is a leak by itself.
    """
    n = len(sizes)
    span = max(1, math.ceil(SHARE * n))
    start = np.r_[0, np.cumsum(sizes)]
    before = np.r_[0, np.cumsum(rare)]
    least = np.iinfo(np.int64).max
    for length in [span, *range(span + EDIT - span % EDIT, min(n + 1, 2 * span), EDIT)]:
        edits = length // EDIT
        lo, hi = start[: n + 1 - length], start[length:] - q
        grams = np.where(hi > lo, before[np.clip(hi, 0, len(rare))] - before[np.clip(lo, 0, len(rare))], 0)
        part = np.partition(np.lib.stride_tricks.sliding_window_view(sizes, length), length - edits - 1, axis=1)
        lost = part[:, length - edits :].sum(1) + edits * (q - 1)
        least = min(least, int((grams - lost).min()))
    return least


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram at every place, built by doubling."""
    power, size, out, rest = 0x9E3779B97F4A7C15, 1, None, q
    step, shift = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 0
    while True:
        if rest & 1:
            m = len(codes) - shift - size + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = step[shift : shift + m] if out is None else out[:m] * np.uint64(power) + step[shift : shift + m]
            shift += size
        rest >>= 1
        if not rest:
            return out ^ (out >> np.uint64(29))
        step = step[:-size] * np.uint64(power) + step[size:] if len(step) > size else np.zeros(0, np.uint64)
        power, size = power * power % 2**64, size * 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Index:
    """The q-grams of the items that use one q: sorted hashes, and (item, word) of each.

    ``items``: number of the item, the hashes of its words, their sizes, its
    grams, which of them count, and its bound.  A band of an item is ``width``
    diagonals.
    """

    BITS = 20

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]):
        self.q = q
        self.number = np.array([k for k, *_ in items])
        self.named = [names for _, names, *_ in items]
        self.words = np.array([len(names) for names in self.named], np.int64)
        self.bound = np.array([bound for *_, bound in items], np.int64)
        self.width = np.array([most_edits(n) + 1 for n in self.words.tolist()], np.int32)
        grams, item, word = [], [], []
        for k, (_, _, sizes, h, rare, _) in enumerate(items):
            grams.append(h[rare])
            item.append(np.full(len(grams[-1]), k, np.int32))
            word.append(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(h)][rare])
        grams, item, word = (np.concatenate(x) for x in (grams, item, word))
        order = np.argsort(grams, kind="stable")
        self.grams, first, many = np.unique(grams[order], return_index=True, return_counts=True)
        self.first, self.many = first.astype(np.int32), many.astype(np.int32)
        self.item, self.word = item[order], word[order]
        # the first gram of every value of the top bits: few values have more than one gram
        top = self.grams >> np.uint64(64 - self.BITS)
        self.start = np.searchsorted(top, np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` whose gram is in the index, and the number of that gram."""
        h = _hashes(codes, self.q)
        top = (h >> np.uint64(64 - self.BITS)).astype(np.int32)
        k, stop = self.start[top], self.start[top + 1]
        at = np.flatnonzero(k < stop).astype(np.int32)
        h, k, stop = h[at], k[at], stop[at]
        found_at, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        while len(at):
            same = self.grams[k] == h
            found_at.append(at[same])
            found.append(k[same])
            k = k + 1
            more = ~same & (k < stop)
            at, h, k, stop = at[more], h[more], k[more], stop[more]
        return np.concatenate(found_at), np.concatenate(found)

    def cells(self, word: np.ndarray, k: np.ndarray, bands: int, margin: np.ndarray) -> np.ndarray:
        """Accumulator cell (item times band) of every hit: a gram of the text, beginning in ``word``, with one of an item."""
        n = self.many[k]
        post = np.repeat(self.first[k] - (np.cumsum(n, dtype=np.int32) - n), n)
        post += np.arange(len(post), dtype=np.int32)  # a stretch has not much more than HITS of them
        item = self.item[post]
        band = (np.repeat(word, n) - self.word[post]) // self.width[item] + margin[item]
        wide = np.int32 if len(self.number) * bands < 2**31 else np.int64
        return item.astype(wide) * wide(bands) + band.astype(wide)


def _named(codes: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of every word of ``codes``; ``parts`` is the word each character belongs to."""
    place = np.arange(len(codes)) - starts[parts]
    value = codes.astype(np.uint64) * _FACTORS[place % len(_FACTORS)] + (place // len(_FACTORS)).astype(np.uint64)
    value[(codes == 32) | (codes == 10)] = 0
    return np.add.reduceat(value, starts)


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) | 1 for k in range(64)], np.uint64)


def _words_in(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of every character (a blank belongs to the word before it), and the first character of every word."""
    breaks = (codes[:-1] == 32) | (codes[:-1] == 10)
    word = np.zeros(len(codes), np.int32)
    np.cumsum(breaks, out=word[1:])
    return word, np.r_[0, np.flatnonzero(breaks) + 1]


def _candidates_in(part: _Index, codes: np.ndarray, word: np.ndarray, total: int) -> Iterator[tuple[int, int, int]]:
    """Item, first diagonal and number of diagonals of all bands in which an item reaches its bound, adjacent ones as one."""
    margin = (part.words // part.width + 2).astype(np.int32)
    bands = int((total // part.width + 2 * margin).max()) + 2
    at, k = part.known(codes)
    if not len(at):
        return
    found = []
    for a, b in _stretches(np.cumsum(part.many[k], dtype=np.int64), HITS):
        found.append(np.unique(part.cells(word[at[a:b]], k[a:b], bands, margin), return_counts=True))
    hit, count = found[0]
    if len(found) > 1:
        hit, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        count = np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)
    # two adjacent bands hold all diagonals of an alignment; the last bands of an item are empty, so no pair spans two items
    pair = count.copy()
    pair[:-1] += np.where(hit[1:] == hit[:-1] + 1, count[1:], 0)
    bound = part.bound[hit // bands]
    good = np.union1d(hit[pair >= bound], hit[count >= bound] - 1)
    for a, b in _runs(good):
        i = int(good[b] // bands)
        yield i, int(good[a] - i * bands - margin[i]) * int(part.width[i]), int(good[b] - good[a] + 2) * int(part.width[i])


def _runs(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of every run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(cells) != 1)
    return zip(np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(cells) - 1].tolist()) if len(cells) else iter(())


def _regions(index: list[_Index], streams: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Text, item, its first word and the end of words and the number of diagonals of all regions in which an item may align."""
    codes = _codes("\n".join(streams))
    word, first = _words_in(codes)
    names = _named(codes, word, first)
    starts = [0, *accumulate(t.count(" ") + 1 for t in streams)]
    found = []
    for part in index:
        for i, begin, many in _candidates_in(part, codes, word, len(first)):
            # a diagonal is the word at which the item would begin; hits of two texts can share a band only near their
            # border, then the region is looked at in both
            end = begin + many + int(part.words[i])
            t = max(0, bisect_right(starts, begin) - 1)
            while t < len(streams) and starts[t] < end:
                own = np.zeros(end - begin, np.uint64)
                lo, hi = max(begin, starts[t]), min(end, starts[t + 1])
                own[lo - begin : hi - begin] = names[lo:hi]
                if lo < hi and _may_align(_other(part.named[i], own, many).all(1)):
                    found.append((t, int(part.number[i]), begin - starts[t], end - starts[t], many))
                t += 1
    return found


def _other(item: np.ndarray, region: np.ndarray, many: int) -> np.ndarray:
    """Where the item's words and the region's differ, for every word of the item along each of ``many`` diagonals."""
    size = region.itemsize
    return np.ndarray((len(item), many), region.dtype, np.ascontiguousarray(region), 0, (size, size)) != item[:, None]


def _may_align(missing: np.ndarray, share: float = SHARE, edit: int = EDIT) -> bool:
    """False if no stretch of the item has few enough words that no diagonal has."""
    least = math.ceil(share * len(missing))
    total = np.zeros(len(missing) + 1, np.int64)
    np.cumsum(1 - edit * missing, out=total[1:])
    return bool((total[least:] >= np.minimum.accumulate(total)[: len(total) - least]).any())


def _stretches(total: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive stretches whose running sum ``total`` grows by about ``most``."""
    cuts = np.flatnonzero(np.diff(total // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(total)]))


def numbered(item: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """The words of an item as numbers, and the number of each word."""
    numbers: dict[str, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in item], np.int32), numbers


def leaks_at(item: tuple[np.ndarray, dict[str, int]], region: list[str], share: float = SHARE, edit: int = EDIT) -> bool:
    """True if a stretch of at least ``share`` of the item's words aligns anywhere in the region, one edit in ``edit`` words."""
    n = len(item[0])
    return bool(n) and aligns(item, [None] * n + region + [None] * n, n + len(region) + 1, share, edit)


def aligns(item: tuple[np.ndarray, dict[str, int]], region: list[str | None], many: int, share: float = SHARE, edit: int = EDIT) -> bool:
    """As :func:`leaks_at`, along ``many`` diagonals only: word 0 of the item may stand at the first ``many`` places of the region.

    Edit distances from all starts in the item at once, each free to begin on
    any of the diagonals.
    """
    a, numbers = item
    n = len(a)
    least = math.ceil(share * n)
    b = np.array([numbers.get(w, -1) for w in region], np.int32)
    other = _other(a, b, many)
    if not _may_align(other.all(1), share, edit):
        return False
    starts = n - least + 1
    along = np.arange(many, dtype=np.int32)
    cost = np.zeros((starts, many), np.int32)
    for k in range(n):  # k + 1 words of the item from each start that still has so many
        live = min(starts, n - k)
        step = cost[:live] + other[k : k + live]
        np.minimum(step[:, :-1], cost[:live, 1:] + 1, out=step[:, :-1])  # a word of the item left out
        cost = np.minimum.accumulate(step - along, axis=1) + along  # words added
        if k + 1 >= least:
            best = cost.min(1)
            if (best * edit <= k + 1).any():
                return True
            if (best > n // edit).all():
                return False
    return False


def _index_of(rows: list[tuple[int, list[str]]]) -> list[_Index]:
    """The index of a block of items (number, words)."""
    by_q: dict[int, list] = {}
    left = []
    for k, words in rows:
        codes = _codes(" ".join(words))
        left.append((k, _named(codes, *_words_in(codes)), np.array([len(w) + 1 for w in words], np.int64), codes))
    for q in GRAMS:
        hashed = [_hashes(codes, q) for *_, codes in left]
        grams, items = np.unique(np.concatenate([np.unique(h) for h in hashed]), return_counts=True) if left else (None, None)
        later = []
        for (k, names, sizes, codes), h in zip(left, hashed):
            every = np.ones(len(h), bool)
            shared = items[np.searchsorted(grams, h)]
            for counted in (*(shared <= most for most in STOCK), every):
                bound = kept_grams(sizes, q, counted)
                if bound >= LEAST or (q == GRAMS[-1] and counted is every):
                    by_q.setdefault(q, []).append((k, names, sizes, h, counted, bound))
                    break
            else:
                later.append((k, names, sizes, codes))
        left = later
    return [_Index(q, part) for q, part in by_q.items()]


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and a text with the text's words in its place."""
    for batch in batches:
        words = [" ".join(words_of(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["id", "words"])


def _filter(shared, stripped: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, _ = shared.value
        reach = max(int((part.words + 2 * part.width).max()) for part in index)
        for batch in batches:
            docs, streams, held = [], [], 0
            rows: list[tuple] = []

            def flush():
                cut: dict[int, list[str]] = {}
                for t, i, a, b, many in _regions(index, streams):
                    words = cut.get(t) or cut.setdefault(t, streams[t].split(" "))
                    rows.append((docs[t], i, max(0, -a), many, b - a, " ".join(words[max(0, a) : max(0, b)])))

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split() if stripped else words_of(text)
                if not words:
                    continue
                size = max(4 * reach, CHARS // 8)
                for k in range(0, max(1, len(words) - reach), size - reach):  # long texts in overlapping pieces
                    docs.append(doc)
                    streams.append(" ".join(words[k : k + size]))
                    held += len(streams[-1]) + 1
                    if held >= CHARS:
                        flush()
                        docs, streams, held = [], [], 0
            if streams:
                flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.int32()] * 4, pa.string()])], names=["doc_id", "item", "lead", "many", "size", "region"])

    return run


def _verify(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, ids = shared.value
        items: dict[int, tuple] = {}
        for batch in batches:
            doc, item, lead, many, size, region = (c.to_pylist() for c in batch.columns)
            good = []
            for k, i in enumerate(item):
                if i not in items:
                    items[i] = numbered(words[i].split(" "))
                inner = region[k].split(" ")
                if aligns(items[i], [None] * lead[k] + inner + [None] * (size[k] - lead[k] - len(inner)), many[k]):
                    good.append(k)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([doc[k] for k in good]), pa.array([ids[item[k]] for k in good])], names=["doc_id", "item_id"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id``: every document with each item that leaks into it.

    Rows with a null id or text take part in nothing, an empty item is in no
    document, repeated rows give one result row, an empty table an empty
    result; other columns are ignored.  Texts are used whole.  Items are
    reduced to their words by Spark and taken in blocks of about
    ``block_chars`` characters, whose index is built by one task and is small
    enough to be broadcast; where there are several blocks, the documents are
    reduced to their words once, too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = items.select(items[item_id].cast("long").alias("id"), items[text].alias("text")).dropna()
    docs = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).dropna()
    items = scratch.save(items.mapInArrow(_streams, "id long, words string").where("words <> ''").distinct(), "items")
    chars = items.agg(F.sum(F.length("words"))).first()[0] or 0
    if not chars:
        return spark.createDataFrame([], "doc_id long, item_id long")
    blocks = 1 if chars <= block_chars else 2 * -(-chars // block_chars)
    cut = items.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(blocks)).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "words"])
        words, ids = rows["words"].tolist(), rows["id"].tolist()
        index = _index_of([(k, w.split(" ")) for k, w in enumerate(words)])
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "index": [pickle.dumps((index, words, ids))]})

    built = scratch.save(cut.groupBy("block").applyInPandas(build, "block int, index binary"), "index")
    if blocks > 1:
        docs = scratch.save(docs.mapInArrow(_streams, "id long, words string"), "documents")
    out = None
    for b in range(blocks):
        for row in built.where(F.col("block") == b).collect():
            shared = spark.sparkContext.broadcast(pickle.loads(row["index"]))
            regions = scratch.save(docs.mapInArrow(_filter(shared, blocks > 1), "doc_id long, item int, lead int, many int, size int, region string"), f"regions{b}")
            found = regions.repartition("doc_id", "item").mapInArrow(_verify(shared), "doc_id long, item_id long").distinct()
            out = found if out is None else out.unionByName(found)
    return out.distinct() if blocks > 1 else out
