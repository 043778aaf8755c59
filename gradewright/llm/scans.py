"""Problem 7: text from scanned pages made continuous and readable."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradewright.scratch import Scratch
from gradewright.skew import HOT_SHARE

#: Lines at each edge of a page that may be running lines, and pages on which one must recur.
EDGE, RECUR = 3, 3
#: Share of a source's pages on which a line must recur that isn't set like a title.
OFTEN = 0.1
#: A word is a misreading of another if that one is so many times as frequent; less is asked of words with foreign characters.
RATIO, ODD_RATIO = 10, 2
#: What a line with nothing but its page number may say beside it, as _fold() writes it.
BARE = ("", "p", "pl", "page", "pg")
_PAGES_PER_WINDOW = 256

# What character recognition makes of printed characters, misread to printed.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"),
    ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"), ("ii", "ll"), ("nn", "m"), ("in", "m"), ("m", "in"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"), ("|", "l"), ("!", "l"), ("!", "i"), ("$", "s"), ("@", "a"),
)
# Letters read for digits.
DIGITS = {"O": "0", "o": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "G": "6", "b": "6", "B": "8", "g": "9", "q": "9"}

_BREAK = "-­‐‑¬"
_ENDS = re.compile(rf"([^\W\d_](?:[\w'{_BREAK}]*[^\W_])?|[^\W\d_])[{_BREAK}]\s*$")
_STARTS = re.compile(r"\s*([^\W_][\w'-]*)")
_HEAD = re.compile(r"\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][\w'-]*(?:\s+[\w'-]+)*\s*$")
_LONE = re.compile(r"\W*\d+\W*")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’–—…•·°§"
_ROMAN = re.compile(r"[ivx]{1,7}")
_STROKES = str.maketrans("1|!l", "iiii")
_ODD = re.compile(r"[^a-z'-]")


# Strokes stand for all that is mistaken for them, so that one character and the two it is read as come out alike.
_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "t": "f", "5": "s", "$": "s", "9": "g", "q": "g", "c": "e", "m": "rrl", "n": "rl", "d": "el", "u": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "w": "vv"})


def _fold(text: str) -> str:
    """One form for all misreadings of a line: classes of characters that are mistaken for each other."""
    s = unicodedata.normalize("NFKD", text.lower())
    s = "".join(ch for ch in s if not unicodedata.combining(ch) and not ch.isspace())
    return s.translate(_FOLD)


def _number(token: str) -> str | None:
    """The digits of a token that is a number with or without misread digits."""
    plain = "".join(DIGITS.get(ch, ch) for ch in token)
    return plain if plain.isdigit() else None


def edge_form(line: str) -> tuple[str, int | None, bool]:
    """(skeleton, number, roman) of a line: letters folded, its first page-number-like token made #."""
    value, roman, out = None, False, []
    for token in re.findall(r"[\w|!$]+|[^\w\s]", line):
        has_digit = any(ch.isdigit() for ch in token)
        number = _number(token) if has_digit or (len(line.split()) <= 3 and len(token) <= 3 and _number(token) and not _ROMAN.fullmatch(token.translate(_STROKES))) else None
        if number is not None and len(number) <= 6:
            if value is None:
                value = int(number)
            out.append("#")
        elif value is None and token == token.lower() and _ROMAN.fullmatch(token.translate(_STROKES)):
            # Small numerals of front matter: a stroke is an i, as pages from l on are not numbered so.
            value, roman = _roman(token.translate(_STROKES)), True
            out.append("#")
        else:
            out.append(_fold(token))
    return "".join(out), value, roman


def _roman(token: str) -> int:
    size = {"i": 1, "v": 5, "x": 10}
    total = 0
    for a, b in zip(token, token[1:] + " "):
        total += size[a] if size[a] >= size.get(b, 0) else -size[a]
    return total


def _titled(line: str) -> bool:
    """Whether the line looks like a title: no sentence end, its longer words capitalised or all letters set apart."""
    words = [w for w in re.findall(r"[^\W\d_][\w'-]*", line) if len(w) > 3 or w[0].isupper()]
    return not line.rstrip().endswith((".", ",", ";")) and (not words or all(w[0].isupper() for w in words))


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "source_id", "page_number", "side", "depth", "line_no", "skeleton", "value", "titled"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows = []
        for page, source, number, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "source_id", "page_number", "text"))):
            lines = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
            for side, some in (("top", lines[:EDGE]), ("bottom", lines[: -EDGE - 1: -1])):
                for depth, (no, line) in enumerate(some):
                    skeleton, value, _ = edge_form(line)
                    rows.append((page, source, number, side, depth, no, skeleton, value, _titled(line)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def chrome_lines(pages: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no) of running headers, footers and page numbers.

    A line among the outer EDGE lines of a page is one if its folded form recurs at that edge on RECUR pages of the source (on
    two, or as a header or footer that parse_results names, if it is set like a title; with any number in it, if it is set like one), or if its number keeps a constant
    distance to the page numbers of RECUR pages; a line with such a form and a number that misses it by misread digits counts too.
    Only lines up to the first other line of the edge are taken.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "chrome")
    edges = scratch.write(pages.select("page_id", "source_id", "page_number", "text").mapInArrow(
        _edge_batches, "page_id long, source_id long, page_number int, side string, depth int, line_no int, skeleton string, value long, titled boolean"
    ))
    plain = edges.filter(~F.col("skeleton").contains("#"))
    forms = plain.groupBy("source_id", "side", "skeleton").agg(F.count_distinct("page_id").alias("n"), F.avg(F.col("titled").cast("int")).alias("t"))
    running = forms.filter((F.col("t") > 0.5) & (F.col("n") >= 2)).select("source_id", "side", "skeleton")
    if results is not None:
        fold = F.pandas_udf(lambda lines: lines.map(lambda x: edge_form(x)[0]), StringType())
        hints = results.select("source_id", F.explode(F.array_distinct(F.concat(F.coalesce("headers", F.array()), F.coalesce("footers", F.array())))).alias("h"))
        hints = hints.filter("h is not null").select("source_id", fold("h").alias("skeleton")).distinct()
        named = forms.join(hints, ["source_id", "skeleton"], "left_semi").filter("t > 0.5").select("source_id", "side", "skeleton")
        running = running.union(named).distinct()
    # A title with a number, of whatever value ("edition 2029", "Institute 12"); rows of figures have more numbers.
    # What is not set like a title must recur on OFTEN of the source's pages.
    often = F.col("n") >= F.col("pages") * OFTEN
    sizes = edges.groupBy("source_id").agg(F.count_distinct("page_id").alias("pages"))
    worded = edges.filter((F.regexp_count("skeleton", F.lit("#")) <= 2) & (F.length(F.regexp_replace("skeleton", "[^a-z]", "")) >= 4))
    recurring = worded.groupBy("source_id", "side", "skeleton").agg(F.count_distinct("page_id").alias("n"), F.avg(F.col("titled").cast("int")).alias("t"))
    recurring = recurring.join(sizes, "source_id").filter((F.col("n") >= RECUR) & ((F.col("t") > 0.5) | often))
    running = running.union(recurring.select("source_id", "side", "skeleton")).distinct()
    numbered = edges.filter(F.col("skeleton").contains("#") & F.col("value").isNotNull()).withColumn("off", F.col("value") - F.col("page_number"))
    offs = numbered.groupBy("source_id", "side", "skeleton", "off").agg(F.count_distinct("page_id").alias("n"))
    # Small sources have no three pages of a form: page numbers themselves, alone on their line, need two.
    bare = F.regexp_replace("skeleton", "[^a-z0-9]", "").isin(*BARE)
    kept = offs.filter((F.col("n") >= RECUR) | bare & (F.col("n") >= 2) & (F.abs("off") <= 60))
    same = numbered.join(kept.select("source_id", "side", "skeleton", "off"), ["source_id", "side", "skeleton", "off"], "left_semi").select("page_id", "side", "depth", "line_no")
    # A number that misses the usual distance by one misread digit.
    usual = kept.groupBy("source_id", "side", "skeleton").agg(F.max_by("off", F.struct("n", -F.abs("off"))).alias("usual"))
    digits = lambda c: F.length(c.cast("string"))
    meant = F.col("page_number") + F.col("usual")
    close = (digits(F.col("value")) == digits(meant)) & (F.levenshtein(F.col("value").cast("string"), meant.cast("string")) <= 1)
    by_number = same.union(numbered.join(usual, ["source_id", "side", "skeleton"]).filter(close).select("page_id", "side", "depth", "line_no"))
    by_form = edges.join(running, ["source_id", "side", "skeleton"], "left_semi").select("page_id", "side", "depth", "line_no")
    hits = by_number.union(by_form).distinct()
    rank = F.row_number().over(Window.partitionBy("page_id", "side").orderBy("depth"))  # at most EDGE rows
    return hits.withColumn("r", rank).filter(F.col("r") == F.col("depth") + 1).select("page_id", "line_no").distinct()


def _clean(token: str) -> str:
    return token.strip(_STRIP)


def repaired_number(token: str, before: str) -> str | None:
    """The number that a token with misread digits stands for; None if it is none or has no misread digit.

    A capital and digits after a capitalised word is a code (a form's number), not a number.
    """
    core = _clean(token)
    letters = [ch for ch in core if not ch.isdigit() and ch not in ".,/:-"]
    digits = sum(ch.isdigit() for ch in core)
    if not letters or not digits or any(ch not in DIGITS for ch in letters) or len(letters) > max(1, digits):
        return None
    if core[0].isalpha() and core[1:].isdigit() and len(core) <= 3 and core[0].isupper() and before[:1].isupper():
        return None
    if len(letters) == 1 and core[-1] in "sgbi" and core[:-1].isdigit() and digits < 2:
        return None
    return "".join(DIGITS.get(ch, ch) for ch in core)


class _Tokens(dict):
    """What a token is, remembered by token and whether a capital stands before it: a number's text and repair, or a word, or nothing."""

    def __missing__(self, key: tuple[str, bool]) -> tuple[str | None, str | None]:
        if len(self) >= 500_000:
            self.clear()
        token, capital = key
        word = _clean(token).lower()
        fixed = repaired_number(token, "X" if capital else "")
        if fixed is None and sum(ch.isalpha() for ch in word) < 2:
            word = None
        self[key] = out = (word, fixed)
        return out


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emits the words, the breaks and the misread numbers of each page's running text, and its first and last words.

    kind w: all words of the page, in ``words``, with their lines in ``lines``. b: left and right part of a word broken within the page. n: a number and its repair. h: the page's first word.
    t: the left part that the page ends in. Right parts are not words of their line.
    """
    names = ["page_id", "source_id", "page_number", "kind", "line_no", "word", "other", "lines", "words"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
    known = _Tokens()
    for batch in batches:
        rows: list[tuple] = []
        for page, source, number, text, chrome in zip(*(batch.column(c).to_pylist() for c in ("page_id", "source_id", "page_number", "text", "chrome"))):
            out = set(chrome or ())
            put = lambda kind, no, word, other=None: rows.append((page, source, number, kind, no, word, other, None, None))  # noqa: B023,E731
            in_lines: list[int] = []
            words: list[str] = []
            lines = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip() and i not in out]
            open_part: tuple[int, str] | None = None
            before = ""
            headed = False
            for no, line in lines:
                tokens = line.split()
                start = _STARTS.match(line)
                if not headed and not _LONE.fullmatch(line):
                    put("h", no, start.group(1) if start else "")
                    headed = True
                skip = False
                if open_part is not None and _LONE.fullmatch(line):
                    continue  # a number by itself does not go on with a word
                if open_part is not None:
                    if start:
                        put("b", open_part[0], open_part[1], start.group(1))
                        skip = True
                    else:
                        in_lines.append(open_part[0])
                        words.append(open_part[1].lower())
                    open_part = None
                end = _ENDS.search(line)
                if end and (len(tokens) > 1 or not skip):
                    open_part = (no, end.group(1))
                    tokens = tokens[:-1]
                for j, token in enumerate(tokens):
                    if skip and j == 0:
                        before = token
                        continue
                    word, fixed = known[token, before[:1].isupper()]
                    before = token
                    if fixed is not None:
                        put("n", no, word, fixed)
                    elif word is not None:
                        in_lines.append(no)
                        words.append(word)
            if open_part is not None:
                put("t", *open_part)
            if words:
                rows.append((page, source, number, "w", None, None, None, in_lines, words))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


#: Letters of a word up to which a second confusion is looked for; what is longer is no word.
LONGEST = 200


def readings(word: str) -> set[str]:
    """What may have been printed where ``word`` was read: one or two confusions undone, accents and ligatures resolved."""
    flat = "".join(ch for ch in unicodedata.normalize("NFKD", word) if not unicodedata.combining(ch)).replace("‐", "-")
    out = {flat}

    def undo(w: str) -> set[str]:
        got = set()
        for read, printed in CONFUSIONS:
            at = w.find(read)
            while at >= 0:
                got.add(w[:at] + printed + w[at + len(read):])
                at = w.find(read, at + 1)
        return got

    once = undo(flat)
    out |= once
    odd = [x for x in once if len(x) <= LONGEST] if _ODD.search(flat) or len(flat) >= 6 else []
    for x in odd:
        # A second one only where it takes a foreign character away, or in long words.
        out |= {y for y in undo(x) if not _ODD.search(y)}
    out.discard(word)
    return out


def _reading_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c)], ["word", "n", "printed"])

    rows: list[tuple[str, int, str]] = []
    for batch in batches:
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            rows += [(w, n, x) for x in readings(w)]
            if len(rows) > 20_000:  # a word has up to some hundreds
                yield emit(rows)
                rows = []
    if rows:
        yield emit(rows)


class ScannedPages:
    """The defects of scanned page texts and their repair.

    pages: (page_id, source_id, page_number, text); a repeated page_id counts once, by the longest text. Null and empty texts are skipped,
    so a word broken at the end of a page goes on on the next page that has running text. results: parse_results, whose headers and
    footers serve as hints only.

    The vocabulary is counted over the running text of all pages, fragments of broken words left out. A broken
    word is joined without its hyphen if the vocabulary has that, with it if it has that, and otherwise with it only
    if both parts are words. A word is misread if undoing one or two confusions of character recognition gives a word that is RATIO times
    as frequent; misread digits are recognised by their number's form.
    """

    def __init__(self, pages: DataFrame, results: DataFrame | None = None):
        self.scratch = scratch = Scratch(pages.sparkSession, "scans")
        once = pages.filter("page_id is not null and text is not null and trim(text) <> ''").groupBy("page_id").agg(
            F.max_by(F.struct("source_id", F.col("page_number").cast("int").alias("page_number"), "text"), F.struct(F.length("text"), "text")).alias("r")
        )
        self.pages = scratch.write(once.select("page_id", "r.*"))
        self.chrome = scratch.write(chrome_lines(self.pages, results))
        per_page = self.chrome.groupBy("page_id").agg(F.collect_list("line_no").alias("chrome"))
        self.parts = scratch.write(self.pages.join(per_page, "page_id", "left").mapInArrow(
            _line_batches, "page_id long, source_id long, page_number int, kind string, line_no int, word string, other string, lines array<int>, words array<string>"
        ))
        self.words = self.parts.filter("kind = 'w'").select("page_id", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("page_id", F.col("x.lines").alias("line_no"), F.col("x.words").alias("word"))
        self.vocabulary = scratch.write(self.words.groupBy("word").agg(F.count("*").alias("n")))
        self.breaks = scratch.write(self._breaks())
        self.readings = scratch.write(self._readings())

    def _breaks(self) -> DataFrame:
        """(page_id, line_no, left, right, next_page): all broken words; next_page is null within a page."""
        inner = self.parts.filter("kind = 'b'").select("page_id", "line_no", F.col("word").alias("left"), F.col("other").alias("right"), F.lit(None).cast("long").alias("next_page"))
        heads = self.parts.filter("kind = 'h'").select("source_id", "page_number", "page_id", F.col("word").alias("head"))
        tails = self.parts.filter("kind = 't'").select("page_id", "line_no", F.col("word").alias("left"))
        # The next page with running text: within windows of pages, then between windows, so no task holds a whole source.
        win = heads.withColumn("win", F.floor(F.col("page_number") / _PAGES_PER_WINDOW))
        order = Window.partitionBy("source_id", "win").orderBy("page_number", "page_id")
        here = win.withColumn("nxt", F.lead(F.struct("page_id", "head")).over(order))
        firsts = win.groupBy("source_id", "win").agg(F.min_by(F.struct("page_id", "head"), F.struct("page_number", "page_id")).alias("f"))
        firsts = firsts.withColumn("after", F.lead("f").over(Window.partitionBy("source_id").orderBy("win"))).select("source_id", "win", "after")
        nxt = here.join(firsts, ["source_id", "win"]).select("page_id", F.coalesce("nxt", "after").alias("nxt"))
        across = tails.join(nxt, "page_id").filter("nxt.head <> ''").select("page_id", "line_no", "left", F.col("nxt.head").alias("right"), F.col("nxt.page_id").alias("next_page"))
        return inner.unionByName(across)

    def _joined(self) -> DataFrame:
        pairs = self.breaks.select(F.lower("left").alias("l"), F.lower("right").alias("r")).distinct()
        soft = F.regexp_replace("l", "[­‐‑¬]", "-")
        right = F.regexp_replace("r", "[-']+$", "")
        return pairs.select("l", "r", F.concat(soft, right).alias("plain"), F.concat(soft, F.lit("-"), right).alias("hyphened"), soft.alias("a"), right.alias("b"))

    def _readings(self) -> DataFrame:
        """(word, repaired): the likeliest printed word of every misread word, whole or broken."""
        forms = self._joined()
        unseen = forms.select(F.explode(F.array("plain", "hyphened")).alias("word")).distinct().join(self.vocabulary, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
        asked = self.vocabulary.unionByName(unseen).repartition("word")
        cands = asked.mapInArrow(_reading_batches, "word string, n long, printed string")
        known = self.vocabulary.select(F.col("word").alias("printed"), F.col("n").alias("m"))
        odd = F.col("word").rlike("[^a-z'-]")
        good = cands.join(known, "printed").filter(
            ~F.col("printed").rlike("[^a-z'-]") & (odd & (F.col("m") >= F.greatest(F.lit(2), F.col("n") * ODD_RATIO)) | ~odd & (F.col("m") >= F.greatest(F.lit(5), F.col("n") * RATIO)))
        )
        return good.groupBy("word").agg(F.max_by("printed", F.struct("m", "printed")).alias("repaired"))

    def broken(self) -> DataFrame:
        """(page_id, line_no, repaired) of words broken over lines or pages."""
        voc = lambda c, n: self.vocabulary.select(F.col("word").alias(c), F.col("n").alias(n))
        fix = lambda c, n: self.readings.select(F.col("word").alias(c), F.col("repaired").alias(n))
        f = self._joined()
        for c in ("plain", "hyphened", "a", "b"):
            f = f.join(voc(c, f"n_{c}"), c, "left")
        f = f.join(fix("plain", "f_plain"), "plain", "left").join(fix("hyphened", "f_hyphened"), "hyphened", "left")
        n = lambda c: F.coalesce(f"n_{c}", F.lit(0))
        word = (
            F.when((n("plain") >= n("hyphened")) & (n("plain") > 0), F.coalesce("f_plain", "plain"))
            .when(n("hyphened") > 0, F.coalesce("f_hyphened", "hyphened"))
            .when(F.col("f_plain").isNotNull(), F.col("f_plain"))
            .when(F.col("f_hyphened").isNotNull(), F.col("f_hyphened"))
            .when((n("a") >= 3) & (n("b") >= 3), F.col("hyphened")).otherwise(F.col("plain"))
        )
        repaired = f.select("l", "r", word.alias("repaired"))
        return self.breaks.withColumn("l", F.lower("left")).withColumn("r", F.lower("right")).join(repaired, ["l", "r"]).select("page_id", "line_no", "repaired", "left", "right", "next_page")

    def misread(self) -> DataFrame:
        """(page_id, line_no, word, repaired) of misread words and numbers."""
        total = self.vocabulary.agg(F.sum("n")).first()[0] or 0
        # The most frequent words (at most 1 / HOT_SHARE of them) are left out before the join: they are no misreadings, and would crowd it.
        hot = F.broadcast(self.vocabulary.filter(F.col("n") > total * HOT_SHARE).join(self.readings, "word", "left_anti").select("word"))
        # The first word of a page that ends a word of the page before is no word.
        ends = self.breaks.filter("next_page is not null").select(F.col("next_page").alias("page_id"), F.lower("right").alias("word"))
        heads = self.parts.filter("kind = 'h'").select("page_id", "line_no").join(ends, "page_id").distinct()
        words = self.words.join(hot, "word", "left_anti").join(self.readings, "word").join(heads, ["page_id", "line_no", "word"], "left_anti")
        numbers = self.parts.filter("kind = 'n'").select("page_id", "line_no", "word", F.col("other").alias("repaired"))
        return words.select("page_id", "line_no", "word", "repaired").unionByName(numbers).distinct()

    def defects(self) -> DataFrame:
        """(page_id, line_no, defect, repaired): every chrome line, broken word and misread word or number."""
        line = F.col("line_no").cast("long").alias("line_no")
        rows = self.chrome.select("page_id", line, F.lit("chrome").alias("defect"), F.lit("").alias("repaired"))
        rows = rows.unionByName(self.broken().select("page_id", line, F.lit("broken").alias("defect"), "repaired"))
        return rows.unionByName(self.misread().select("page_id", line, F.lit("glyph").alias("defect"), "repaired")).distinct()

    def paragraphs(self) -> DataFrame:
        """(source_id, page_id, page_number, paragraph_no, text, goes_on): the readable paragraphs of each page.

        A word broken over two pages is given whole where it begins. goes_on: the paragraph runs on onto the next page.
        """
        some = lambda df, name, *cols: df.groupBy("page_id").agg(F.collect_list(F.struct(*cols)).alias(name))
        broken = self.scratch.write(self.broken())
        begun = broken.filter("next_page is not null").select(F.col("next_page").alias("page_id"), F.lit(True).alias("begun")).distinct()
        all_parts = (
            self.pages.join(some(self.chrome, "chrome", "line_no"), "page_id", "left").join(some(broken, "broken", "line_no", "left", "repaired"), "page_id", "left")
            .join(some(self.misread(), "misread", "line_no", "word", "repaired"), "page_id", "left").join(begun, "page_id", "left")
        )
        return all_parts.mapInArrow(_paragraph_batches, "source_id long, page_id long, page_number int, paragraph_no int, text string, goes_on boolean")


def _like(old: str, new: str) -> str:
    """new with the punctuation around old's word and its capitals."""
    core = _clean(old)
    at = old.find(core)
    if core.isupper() and len(core) > 1:
        new = new.upper()
    elif core[:1].isupper():
        new = new[:1].upper() + new[1:]
    return old[:at] + new + old[at + len(core):]


def _paragraph_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source_id", "page_id", "page_number", "paragraph_no", "text", "goes_on"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            chrome = {x["line_no"] for x in r["chrome"] or ()}
            broken = {x["line_no"]: x for x in r["broken"] or ()}
            misread: dict[int, dict[str, str]] = {}
            for x in r["misread"] or ():
                misread.setdefault(x["line_no"], {})[x["word"]] = x["repaired"]
            paragraphs: list[list[str]] = [[]]
            drop_first, headed, tabled = bool(r["begun"]), False, False
            for no, line in enumerate(r["text"].split("\n"), 1):
                if no in chrome:
                    continue
                if not line.strip():
                    if paragraphs[-1]:
                        paragraphs.append([])
                    headed = tabled = False
                    continue
                tokens = line.split()
                tail = ""
                if drop_first and tokens:
                    m = _STARTS.match(tokens[0])
                    tail = tokens[0][m.end():] if m else ""
                    tokens = tokens[1:]
                    if tail and paragraphs[-1]:
                        paragraphs[-1][-1] += tail
                    drop_first = False
                fixes = misread.get(no, {})
                tokens = [_like(t, fixes[_clean(t).lower()]) if _clean(t).lower() in fixes else t for t in tokens]
                if no in broken and tokens:
                    tokens[-1] = _like(tokens[-1].rstrip(_BREAK + " "), broken[no]["repaired"])
                    drop_first = True
                before = paragraphs[-1][-1] if paragraphs[-1] else ""
                is_row = " | " in line
                ended = not before or before.endswith((".", "!", "?", ":"))
                is_head = ended and not is_row and len(tokens) <= 12 and bool(_HEAD.match(line)) and _titled(line)
                if paragraphs[-1] and (is_head or headed or is_row != tabled):
                    paragraphs.append([])
                if is_row and paragraphs[-1] and tokens:
                    tokens[0] = "\n" + tokens[0]  # rows of a table keep their lines
                headed, tabled = is_head, is_row
                paragraphs[-1] += tokens
            done = [" ".join(p).replace(" \n", "\n") for p in paragraphs if p]
            for k, text in enumerate(done):
                rows.append((r["source_id"], r["page_id"], r["page_number"], k, text, k == len(done) - 1 and not text.endswith((".", "!", "?", ":"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
