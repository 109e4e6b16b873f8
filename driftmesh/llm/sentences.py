"""Sentence ends in marked-up articles of many languages.

One pass over the texts masks what is no running text, without moving any
character, cuts the rest into paragraphs, items and captions, and gives a row
for every place at which a sentence may end, besides counts of words.  What
is an abbreviation and what begins sentences is learned from these rows over
the whole corpus, per language and without labels: by the log-likelihood
ratio of a word being bound to its period, by what follows its periods, and
by how much a word is bound to sure beginnings.  Each open place is then
classified by joining it with these statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.markup import closing
from driftmesh.llm.mixing import one_language
from driftmesh.scratch import Scratch

#: Least score of an abbreviation and least share of its periods that visibly end nothing.
ABBREVIATION, GOES_ON = 0.3, 0.1
#: Uses to which the score of a word is scaled where nothing visibly goes on behind its periods.
USES = 20
#: Uses without a period, per use with one, that an abbreviation may have.
WITHOUT = 0.2
#: Least log-likelihood ratios of a sentence starter, of one with at least the share MOSTLY of its capitalised uses at
#: sure beginnings, and of a collocation across a period.
STARTER, LIKELY, MOSTLY, COLLOCATION = 30, 7.88, 0.6, 7.88
#: Share of capitalised followers that are no starters from which a period ends nothing.
NO_STARTERS = 0.7
#: Share of beginnings among all places of a caseless word, or of a Thai chunk, from which it begins sentences.
BEGINS = 0.1

# Stand-ins of equal length: markup inside a word, something like a word, end of a block, nothing, citation or
# reference.  A tie becomes \x07, a blank that binds.
_MARK, _THING, _BREAK, _GONE, _KEY = "\x01", "\x02", "\x03", "\x05", "\x06"
_SUBS = [
    (re.compile(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)", re.S), _GONE),
    (re.compile(r"\\%"), _THING),
    (re.compile(r"%[^\n]*(?:\n[ \t]*(?=[^\s%]))?"), _GONE),
    (re.compile(r"\\\[.*?(?:\\\]|\Z)|\$\$.*?(?:\$\$|\Z)|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|flalign|alignat)\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S), _THING),
    (re.compile(r"\$[^$]*(?:\$|\Z)|\\\(.*?(?:\\\)|\Z)", re.S), _THING),
    (re.compile(r"\\begin\{(tabular[*x]?|array|longtable|verbatim)\}.*?(?:\\end\{\1\}|\Z)", re.S), _BREAK),
    (re.compile(r"\\(?:title|author|date|thanks|part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*(?:\}|\Z)"), _BREAK),
    (re.compile(r"\\(?:begin|end)(?:\{[^}]*(?:\}|\Z)(?:\[[^\]]*\])?|\Z)|\\item\b(?:\s*\[[^\]]*\])?|\\(?:maketitle|centering|newpage|clearpage|par|bigskip|tableofcontents|appendix)\b|\\(?:input|include|includegraphics|bibliographystyle)\b(?:\[[^\]]*\])?(?:\{[^}]*(?:\}|\Z))?"), _BREAK),
    (re.compile(r"\\(?:label|vspace|hspace|color|usepackage|documentclass)\*?(?:\[[^\]]*\])?\{[^}]*(?:\}|\Z)"), _GONE),
    (re.compile(r"\\(?:[cC]ite[a-z]*\*?|ref|eqref|autoref|pageref)(?:\[[^\]]*\])*\{[^}]*(?:\}|\Z)"), _KEY),
    (re.compile(r"\\(?:emph|text[a-z]+|bf|it|sc|em|rm|sf|tt|[a-z]{2}series|[a-z]{2}shape)\b\s?|[{}]|\\['`^\"~=.](?=[{\\A-Za-z])"), _MARK),
    (re.compile(r"\\-"), _GONE),
    (re.compile(r"\\[A-Za-z]+\*?(?:\x01\x01)?"), _THING),
    (re.compile(r"\\[ ,;:!/\\]"), " "),
]
_FLOAT = re.compile(r"\\begin\{((?:figure|table)\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}|\\bibliography\b|\\end\{document\}")
_BLOCKS = re.compile("\x03[\x03\\s\x05]*|\n[ \t\r\x05]*\n[\\s\x05]*")
_CLOSERS = "(?:[\u202f\u00a0]?\u00bb|[\u201d\u2019\")\\]\uff09\u300d\u300f\u300b\u3011]|''|\x01|\u201c(?=[\\s,.;:!?\x05\x07]|$)|'(?![\\w']))*"
# A semicolon is a Greek question mark.  The pattern begins with a set of characters, which re looks for much faster.
_MARK_1 = "[.!?\u2026\u3002\uff01\uff1f\uff0e\u0964\u0965\u061f\u06d4\u037e;](?:(?<!;)|(?=\\s)(?<=[\u0370-\u03ff];))"
_MARKS = re.compile(f"{_MARK_1}(?:{_MARK_1})*({_CLOSERS})")
_OPENERS = re.compile("[\\s\x01\x05\x07`\u201c\u201e\u00ab\u300c\u300e\u2018\u00bf\u00a1\"'\u2014\u2013-]*")
_WORD = re.compile(r"[^\W\d_][\w\u0900-\u0963\u0e31-\u0e4e]*(?:[\x01\x05](?=\w)[\w\u0900-\u0963\u0e31-\u0e4e]*)*(?:\.(?=\w)\w+)*|\d[\d.,]*\d|\d")
_BEFORE = re.compile(r"[\w\u0900-\u0963\u0e31-\u0e4e\x01\x05]+(?:[.,][\w\x01\x05]+)*$")
_THAI, _CJK = re.compile("[\u0e00-\u0e7f]"), re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]")
_SCRIPTS = [("th", _THAI), ("zh", _CJK), ("ar", re.compile("[\u0600-\u06ff]")), ("hi", re.compile("[\u0900-\u097f]")), ("ru", re.compile("[\u0400-\u04ff]")), ("el", re.compile("[\u0370-\u03ff]"))]
_OTHER = re.compile("[\u0370-\u04ff\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]")
_SAYS = re.compile(r"[^\W_]")
_KANA = re.compile("[\u3040-\u30ff]")
_BLANKS = re.compile("[ \t\r\n\u00a0\x05\x07]+")
_BLANK = re.compile(r"[\s\x07]")
#: Characters of final marks and of what closes behind them.
_ENDINGS = ".!?\u2026\u3002\uff01\uff1f\uff0e\u0964\u0965\u061f\u06d4\u037e;\u202f\u00a0\u00bb\u201d\u2019\"')]\uff09\u300d\u300f\u300b\u3011\u201c\x01"
_LATIN = re.compile("[A-Za-z]")
#: The language of blocks in Latin letters whose document has none, or one of another script: all languages together.
_ANY = "any"


def _filled(stand_in: str):
    return lambda m: stand_in * (m.end() - m.start())


_FILLS = [(p, _filled(s)) for p, s in _SUBS]


def _captions(m: re.Match) -> str:
    """A float without anything but its captions, each a block."""
    text, out, at = m.group(), [], 0
    while (k := text.find("\\caption", at)) >= 0:
        start = text.find("{", k)
        if start < 0:
            break
        end = closing(text, start + 1)
        out += [_BREAK * (start + 1 - at), text[start + 1 : end]]
        at = end
    out.append(_BREAK * (len(text) - at))
    return "".join(out)


def masked(text: str) -> tuple[str, int]:
    """The running text, with stand-ins for everything else, and its place in the text."""
    start = text.find("\\begin{document}")
    start = 0 if start < 0 else start + 16
    end = _BIBLIOGRAPHY.search(text, start)
    text = text[start : end.start() if end else len(text)]
    if "\\" in text or "%" in text or "$" in text:
        for k, (pattern, fill) in enumerate(_FILLS):
            text = pattern.sub(fill, text)
            if k == 2:
                while (at := text.find("\\footnote")) >= 0:
                    brace = text.find("{", at)
                    stop = closing(text, brace + 1) + 1 if brace >= 0 else len(text)
                    text = text[:at] + _MARK * (min(stop, len(text)) - at) + text[stop:]
                text = _FLOAT.sub(_captions, text)
    return text, start


def _language(block: str, lang: str) -> str:
    """The document's language, or another one if the block's script rules it out."""
    for name, script in _SCRIPTS if not block.isascii() and _OTHER.search(block) else ():
        found = len(script.findall(block))
        if found and found * (2 if name in ("zh",) else 1) >= len(_LATIN.findall(block)) * 0.5:
            return ("ja" if _KANA.search(block) else "zh") if name == "zh" else name
    return _ANY if lang in ("th", "zh", "ja", "ar", "hi", "ru", "el", "") or lang is None else lang


def _kind(c: str) -> str:
    """Class of a following character: lower, Upper, Number, Thing, Key, caseless, other."""
    if c.islower():
        return "L"
    if c.isupper():
        return "U"
    if c.isdigit():
        return "D"
    if c == _THING:
        return "P"
    if c == _KEY:
        return "K"
    return "N" if c.isalpha() else "O"


def _first(block: str, at: int, lang: str) -> str:
    """The word, or in scripts without blanks the first two characters, at a place."""
    c = block[at : at + 1]
    if lang in ("zh", "ja"):
        return "A" if c.isascii() and c.isalnum() else block[at : at + 2]
    if lang == "th":
        return "A" if c.isascii() and c.isalnum() else block[at : at + 5]
    m = _WORD.match(block, at)
    return m.group().replace(_MARK, "").replace(_GONE, "") if m else c


def _before(block: str, at: int) -> str:
    """The word that ends just before a place, or nothing."""
    size = 60
    part = block[max(0, at - size) : at]
    while size < at and not _BLANK.search(part):  # a longer word is taken whole
        size *= 2
        part = block[max(0, at - size) : at]
    if part.isascii():  # most words need no pattern
        words = part.replace("\x07", " ").split()
        if not words or not part[-1:].isalnum():
            return "" if part[-1:] not in (_MARK, _GONE) else _cleaned(part)
        word = words[-1].rsplit("-", 1)[-1].lstrip("([`'\"")
        if word.isalnum():
            return word
    return _cleaned(part)


def _cleaned(part: str) -> str:
    m = _BEFORE.search(part)
    return m.group().replace(_MARK, "").replace(_GONE, "") if m else ""


def _thai(block: str, lang: str, seen: Counter) -> Iterator[tuple]:
    """Blanks of a Thai block that may part sentences."""
    for m in _BLANKS.finditer(block):
        a, b = m.start(), m.end()
        if not a or b >= len(block):
            continue
        after, x = block[b], _first(block, b, lang)
        seen["place", lang, "", x] += 1
        before = block[:a].rstrip(_MARK)[-1:]
        if before in ".,:;(\u2014-" or after in ",.;:)\u0e46\x06" or _kind(after) in "LUDP" or _kind(before) in "LUDPK" or before == ")":
            continue
        yield a, "blank", "", x


def _marks(block: str, lang: str, seen: Counter) -> Iterator[tuple]:
    """Final marks of a block: place behind them, kind, word before, word after."""
    for m in _MARKS.finditer(block):
        (at, stop), end, closers = m.span(), m.start(1), m.group(1)
        mark, behind = block[at:end], block[stop : stop + 1]
        if mark == "." and not closers and (behind.isalpha() or behind.isdigit()):
            continue  # inside a number, a name or an abbreviation
        closers = closers.rstrip(_MARK)
        end += len(closers)
        if behind and behind in ",;:\u060c\uff0c\u3001\uff1b" and mark[-1] != ".":
            continue
        nxt = _OPENERS.match(block, stop).end()
        if nxt >= len(block):  # the end of the block ends it
            if mark == "." and not closers and (w := _before(block, at)):
                seen["dot", lang, "##" if w.isdigit() else w.lower() if len(w) > 1 else w, "end"] += 1
            continue
        c = block[nxt]
        if mark == "." and lang in ("th", "zh", "ja"):
            continue  # an abbreviation or an initial: these scripts end sentences otherwise
        kind, dense = _kind(c), nxt == stop
        if mark == ".":
            if dense and kind not in "O" and not closers:
                continue
            w = _before(block, at)
            if w.isdigit():
                w = "##"
            tie = behind == "\x07"
            if closers:
                w = ""
            if w:
                goes = kind in "LKO" or tie
                seen["dot", lang, w.lower() if len(w) > 1 else w, "on" if goes or (kind == "D" and w != "##") else kind] += 1
            if kind in "LK" or c in ",;:(" or tie:
                continue
            x = _first(block, nxt, lang)
            if closers and kind == "N":
                yield end, "close", "", x
            elif w:
                yield end, "dot", w.lower() if len(w) > 1 else w, x
            else:
                yield end, "sure", "", x
            continue
        if "\u2026" in mark or mark.startswith(".."):
            if kind in "UDP" and not dense:
                yield end, "sure", "", _first(block, nxt, lang)
            elif kind == "N":
                yield end, "close", "", _first(block, nxt, lang)
            continue
        if kind in "LK" or c in ",;:":
            continue
        x = _first(block, nxt, lang)
        if closers and kind == "N" or closers and lang in ("zh", "ja"):
            seen["closed", lang, "", x] += 1
            yield end, "close", "", x
        else:
            seen["start", lang, "", x] += 1
            yield end, "sure", "", x


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of places (kind sure, dot, close, blank) and of counts (kind word, start, dot count, closed, place)."""
    names = ["row", "doc_id", "end", "lang", "w", "x", "n"]
    for batch in batches:
        rows, seen = [], Counter()
        words: dict[str, Counter] = {}
        for doc, text, doc_lang in zip(*(c.to_pylist() for c in batch.columns)):
            run, start = masked(text.replace("~", "\x07") if "~" in text else text)
            last = 0
            spans = [(m.start(), m.end()) for m in _BLOCKS.finditer(run)]
            for a, b in [*spans, (len(run), len(run))]:
                block, offset = run[last:a], start + last
                last = b
                lead = _OPENERS.match(block).end()
                body = block.rstrip(" \t\r\n\u00a0\u202f\x05\x07")
                if lead >= len(body) or not _SAYS.search(body):
                    continue
                lang = _language(body, doc_lang)
                seen["start", lang, "", _first(body, lead, lang)] += 1
                if lang in ("zh", "ja"):
                    pass
                elif lang == "th":
                    seen["place", lang, "", _first(body, lead, lang)] += 1
                else:
                    words.setdefault(lang, Counter()).update(_WORD.findall(body))
                ends = [*_marks(body, lang, seen)]
                if lang == "th":
                    ends += _thai(body, lang, seen)
                done = set()
                for end, kind, w, x in ends:
                    if end not in done:
                        done.add(end)
                        rows.append((kind, doc, offset + end, lang, w, x, 0))
                tail = _tail(body)
                rows.append(("sure", doc, offset + tail, lang, "", "", 0))
        for lang, counts in words.items():
            rows += [("word", None, None, lang, w, "", n) for w, n in counts.items()]
        rows += [(f"n_{kind}", None, None, lang, w, x, n) for (kind, lang, w, x), n in seen.items()]
        if rows:
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _tail(body: str) -> int:
    """End of a block's last sentence: its final mark with what closes after it, else its last character."""
    last = None
    for last in _MARKS.finditer(body, len(body.rstrip(_ENDINGS))):
        pass
    if last and last.end() == len(body):
        return last.start(1) + len(last.group(1).rstrip(_MARK))
    return len(body)


def _dunning(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two things met together more often than by chance, 0 where they are met less often."""
    log = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)
    rest, others = second - both, total - first
    p, p1, p2 = second / total, both / first, F.when(others > 0, rest / others)
    ratio = 2 * (log(both, first, p1) + log(rest, others, p2) - log(both, first, p) - log(rest, others, p))
    return F.when(p1 > p, ratio).otherwise(0.0)


def sentence_ends(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, sent_end``: how many characters each sentence ends after.

    Rows with a null id or text have no sentences, nor has a text without any
    letter or digit in its running text; a null or misspelt language is put
    right by the script, and where that leaves it open the statistics of all
    languages together count; repeated rows give one result row each
    place, an empty table an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sentences")
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.coalesce(one_language(docs[lang]), F.lit("")).alias("lang")).where("doc_id is not null and text is not null")
    found = texts.mapInArrow(_candidates, "row string, doc_id long, end int, lang string, w string, x string, n long")
    found.write.partitionBy("row").parquet(scratch.path("rows"))
    rows = docs.sparkSession.read.schema(found.schema).parquet(scratch.path("rows"))
    # what is counted in any language counts for blocks without a known one, too
    def pooled(counts: DataFrame, *keys: str) -> DataFrame:
        every = counts.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit(_ANY)))))
        return every.groupBy("lang", *keys).agg(F.sum("n").alias("n"))

    count = lambda kind, *keys: pooled(rows.where(F.col("row") == kind).groupBy("lang", *keys).agg(F.sum("n").alias("n")), *keys)
    after = scratch.save(pooled(rows.where("row = 'dot'").groupBy("lang", "w", "x").agg(F.count("*").alias("n")), "w", "x"), "after")

    # Bound words: the log-likelihood ratio of "the period belongs to the word" over chance, weighed down by the word's
    # length, and few uses without a period.  They may be abbreviations, or merely end sentences.
    words = scratch.save(count("word", "w"), "words")
    dots = count("n_dot", "w", "x").groupBy("lang", "w").agg(F.sum("n").alias("n_dot"), F.sum(F.when(F.col("x") == "on", F.col("n")).otherwise(0)).alias("n_on"))
    lower = words.groupBy("lang", F.when(F.length("w") > 1, F.lower("w")).otherwise(F.col("w")).alias("w")).agg(F.sum("n").alias("n_all"))
    per_lang = lower.groupBy("lang").agg(F.sum("n_all").alias("n_words")).join(dots.groupBy("lang").agg(F.sum("n_dot").alias("n_dots")), "lang")
    p = F.least(F.lit(0.99), F.greatest(F.lit(1e-6), F.col("n_dots") / F.col("n_words")))
    without = F.greatest(F.lit(0), F.coalesce("n_all", "n_dot") - F.col("n_dot"))
    ratio = 2 * (F.col("n_dot") * (F.log(F.lit(0.99)) - F.log(p)) + without * (F.log(F.lit(0.01)) - F.log(1 - p)))
    size = F.length(F.regexp_replace("w", r"\.", ""))
    score = F.when(without <= WITHOUT * F.col("n_dot"), ratio * F.exp(-size) * (F.length("w") - size + 1)).otherwise(0.0)
    # a word behind which nothing visibly goes on has to be short, however often it occurs
    seen = (F.col("n_on") >= GOES_ON * F.col("n_dot")) & (score >= ABBREVIATION)
    short = score * USES / F.col("n_dot") >= ABBREVIATION
    special = (F.col("w") == "##") | F.col("w").rlike(r"^\p{Lu}$")
    bound = dots.join(lower, ["lang", "w"], "left").join(per_lang, "lang").where(seen | short | special).select("lang", "w", "n_dot", "n_on")
    bound = scratch.save(bound, "bound")

    # Sentence starters: words bound by their log-likelihood ratio to sure beginnings, which are those of blocks, behind
    # other final marks, and behind the periods of words that are not bound to them.
    plain = after.join(bound, ["lang", "w"], "left_anti").groupBy("lang", "x").agg(F.sum("n").alias("n"))
    starts = count("n_start", "x").unionByName(plain).groupBy("lang", "x").agg(F.sum("n").alias("n_start"))
    starts = scratch.save(starts, "starts")
    breaks = starts.groupBy("lang").agg(F.sum("n_start").alias("n_breaks"))
    begun = starts.join(words.select("lang", F.col("w").alias("x"), F.col("n").alias("n_all")), ["lang", "x"])
    begun = begun.join(breaks, "lang").join(lower.groupBy("lang").agg(F.sum("n_all").alias("n_words")), "lang")
    uses = F.greatest("n_all", "n_start")
    ratio = _dunning(F.col("n_start"), uses, F.col("n_breaks"), F.greatest("n_words", F.col("n_breaks") + uses - F.col("n_start")))
    mostly = F.col("n_start") >= MOSTLY * F.col("n_all")
    starter = begun.where((ratio >= STARTER) | (ratio >= LIKELY) & mostly).select("lang", "x", F.lit(True).alias("starter"), mostly.alias("mostly"))
    starter = scratch.save(starter, "starters")

    # Abbreviations: bound words behind whose periods the text visibly goes on, or goes on with words that mostly begin
    # nothing.
    follow = after.join(starter.where("mostly"), ["lang", "x"], "left").groupBy("lang", "w").agg(F.sum("n").alias("n_open"), F.sum(F.when(F.col("starter").isNull(), F.col("n")).otherwise(0)).alias("n_other"))
    others = F.coalesce(F.col("n_other") / F.col("n_open"), F.lit(0.0))
    goes_on = F.when(F.col("w") == "##", others >= 0.5).when(special, F.lit(True)).otherwise((F.col("n_on") / F.col("n_dot") >= GOES_ON) | ((others >= NO_STARTERS) & (F.col("n_open") >= 3)))
    abbreviation = bound.join(follow, ["lang", "w"], "left").where(goes_on).select("lang", "w", F.lit(True).alias("abbreviation"))
    abbreviation = scratch.save(abbreviation, "abbreviations")

    # Collocations: followers, other than those that mostly begin sentences, that the periods of an abbreviation or a
    # number have more often than sure beginnings have them, by the log-likelihood ratio; such a period ends nothing.
    pair = after.join(abbreviation.select("lang", "w").unionByName(bound.where("w = '##'").select("lang", "w")).distinct(), ["lang", "w"], "left_semi")
    pair = scratch.save(pair.withColumnRenamed("n", "n_pair"), "pairs")
    pair = pair.join(pair.groupBy("lang", "w").agg(F.sum("n_pair").alias("n_open")), ["lang", "w"])
    pair = pair.join(starter.where("mostly"), ["lang", "x"], "left_anti").join(starts, ["lang", "x"], "left").join(breaks, "lang", "left").fillna(0, ["n_start", "n_breaks"])
    ratio = _dunning(F.col("n_pair"), F.col("n_open"), F.col("n_pair") + F.col("n_start"), F.col("n_open") + F.col("n_breaks"))
    collocation = pair.where((F.col("n_pair") > 1) & (ratio >= COLLOCATION)).select("lang", "w", "x", F.lit(True).alias("collocation"))

    # Caseless words, first characters and Thai chunks that begin sentences.
    closed = count("n_closed", "x").withColumnRenamed("n", "n_closed")
    begins = starts.join(closed, ["lang", "x"], "left").where((F.col("n_start") >= 2) & (F.col("n_start") >= BEGINS * F.coalesce("n_closed", F.lit(0)))).select("lang", "x", F.lit(True).alias("begins"))
    chunks = starts.join(count("n_place", "x"), ["lang", "x"]).where((F.col("n_start") >= 2) & (F.col("n_start") >= BEGINS * F.col("n"))).select("lang", "x", F.lit(True).alias("begins"))

    sure = rows.where("row = 'sure'").select("doc_id", "end")
    dot = rows.where("row = 'dot'").select("doc_id", "end", "lang", "w", "x").join(abbreviation, ["lang", "w"], "left").join(starter, ["lang", "x"], "left").join(collocation, ["lang", "w", "x"], "left")
    initials = F.col("w").rlike(r"^\p{Lu}$") & (F.length("x") == 1)
    dot = dot.where((F.col("abbreviation").isNull() | F.col("starter")) & F.col("collocation").isNull() & ~initials).select("doc_id", "end")
    close = rows.where("row = 'close'").select("doc_id", "end", "lang", "x").join(begins, ["lang", "x"], "left_semi").select("doc_id", "end")
    blank = rows.where("row = 'blank'").select("doc_id", "end", "lang", "x").join(chunks, ["lang", "x"], "left_semi").select("doc_id", "end")
    return sure.unionByName(dot).unionByName(close).unionByName(blank).distinct().select("doc_id", F.col("end").alias("sent_end"))
