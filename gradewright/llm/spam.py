"""Problem 10: keyword-stuffed and link-list pages, by mean pointwise mutual information of neighbouring words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright.scratch import Scratch

#: Words that are told apart in the counts of neighbours: the most widespread of all, and so many a group of texts of one kind (a language, as a rule).
WIDESPREAD, GROUPS, PER_GROUP = 1024, 64, 16
#: Classes of all other words by their last two letters, and one of numbers. So there are at most (2048 + 65)^2 kinds of neighbours, whatever the corpus.
ENDINGS = 64
#: Words of a window; the mutual information of a pair counts within these bounds, that of a pair standing three times within NEAR words with REPEATED.
WINDOW, NEAR, LOW, HIGH, REPEATED = 30, 60, -2.0, 2.0, -1.0
#: Share of all pairs above which a pair may stand as often as it likes.
USUAL = 1 / 1000
#: Windows with a lower mean are incoherent: in the first reading (texts with more than SUSPECT of them don't count in the second), in the second.
FIRST, SUSPECT, COHERENT = 1.0, 0.3, 0.7
#: A page is spam if more than this share of its letters is.
SHARE = 0.5
#: Words read at a time.
CHUNK = 400_000

_WORD = re.compile(r"\w+")
_MARKUP = re.compile(r"<[^<>]{1,300}>|&[a-z]{2,8};")
_LINK = re.compile(r"(?:[a-z]{2,8}:)?//\S+|\bwww\.\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|(?<![\w/])/[\w+%.-]+/[\w+%./?=&-]+")
_FIGURE = re.compile(r"\s*[\d.,]+\s*(?:%|\w{1,8})?\s*$")
_HREF = re.compile(r"<a\s[^<>]*>[^<>]*</a>", re.I)


def _lower_words(text: str) -> list[str]:
    return _WORD.findall(_MARKUP.sub(" ", text.lower()) if "<" in text or "&" in text else text.lower())


def _spread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emits in how many texts of each group every word stands; a text's group hangs on its most frequent word."""
    spread: dict[int, Counter] = {}

    def rows() -> pa.RecordBatch:
        flat = [(g, w, n) for g, c in spread.items() for w, n in c.items()]
        spread.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["g", "word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            count = Counter(_lower_words(text.as_py()))
            if count:
                mode = max(count.items(), key=lambda x: (x[1], x[0]))[0]
                spread.setdefault(xxhash.xxh32_intdigest(mode) % GROUPS, Counter()).update(count.keys())
        if sum(map(len, spread.values())) > 1_000_000:
            yield rows()
    if spread:
        yield rows()


def vocabulary(texts: DataFrame, widespread: int = WIDESPREAD, per_group: int = PER_GROUP) -> list[str]:
    """The words told apart: those in the most texts, and those most at home in each group of texts, so that a language of few texts has its function words too."""
    spread = texts.select("text").mapInArrow(_spread_batches, "g int, word string, n long").groupBy("g", "word").agg(F.sum("n").alias("n"))
    total = spread.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("g", "n")).alias("by"))  # at most GROUPS entries a word
    best = total.orderBy(F.desc("all"), "word").limit(widespread).select("word")
    home = total.select("word", "all", F.explode("by").alias("b")).select("word", F.col("b.g").alias("g"), (F.col("b.n") * F.col("b.n") / F.col("all")).alias("home"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("home"), "word"))
    own = home.withColumn("place", place).filter(F.col("place") <= per_group).select("word")
    return sorted(r["word"] for r in best.union(own).distinct().collect())  # bounded by the parameters


def _marked(low: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a lower-cased stretch, which of them belong to links, and which to rows of figures."""
    found = [(m.start(), m.group()) for m in _WORD.finditer(low)]
    at = np.array([x for x, _ in found], dtype=np.int64)
    link, table = np.zeros(len(found), bool), np.zeros(len(found), bool)
    for pattern in (_HREF, _LINK):
        for m in pattern.finditer(low):
            a, b = np.searchsorted(at, m.span())
            link[a:b] = True
    pos = 0
    for line in low.split("\n") if " | " in low or "\t" in low else ():
        cells = re.split(r" \| |\t", line)
        if 2 <= len(cells) <= 8 and sum(1 for c in cells[1:] if _FIGURE.match(c)) * 2 >= len(cells) - 1:
            a, b = np.searchsorted(at, (pos, pos + len(line)))
            table[a:b] = True
        pos += len(line) + 1
    return [w for _, w in found], link, table


def _kinds(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of the lower-cased text, which of them belong to links, and which to rows of figures.

    Only lines with a sign of either are looked at closely; markup may go over lines, so a text with markup is all one stretch.
    """
    low = text.lower()
    if "<a" in low:
        return _marked(low)
    if "/" not in low and "www." not in low and " | " not in low and "\t" not in low:
        words = _lower_words(low)
        none = np.zeros(len(words), bool)
        return words, none, none
    low = _MARKUP.sub(" ", low) if "<" in low or "&" in low else low
    words: list[str] = []
    links, tables = [], []
    for line in low.split("\n"):
        if "/" in line or "www." in line or " | " in line or "\t" in line:
            own, link, table = _marked(line)
        else:
            own = _WORD.findall(line)
            link = table = np.zeros(len(own), bool)
        words += own
        links.append(link)
        tables.append(table)
    return words, np.concatenate(links), np.concatenate(tables)


class _Words(dict):
    """Word to number, in order of appearance; keeps each one's class and length. Forgotten as a whole when it grows too large."""

    def __init__(self, told: list[str], limit: int = 600_000):
        super().__init__()
        self.told, self.limit = {w: i for i, w in enumerate(told)}, limit
        self.kind: list[int] = []
        self.length: list[int] = []

    def __missing__(self, word: str) -> int:
        own = self.told.get(word)
        if own is None:
            own = len(self.told) + (ENDINGS if word[0].isdigit() else xxhash.xxh32_intdigest(word[-2:]) % ENDINGS)
        self.kind.append(own)
        self.length.append(min(len(word), 2047))
        self[word] = value = len(self)
        return value

    def forget_if_large(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.kind.clear()
            self.length.clear()


def _repeated(keys: np.ndarray, place: np.ndarray, k: int, times: int = 3) -> np.ndarray:
    """Which keys stand at least ``times`` times within k places; keys differ from text to text, and places rise."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    p, at = keys[order], place[order]
    if len(p) >= times:
        near = (p[times - 1:] == p[: 1 - times]) & (at[times - 1:] - at[: 1 - times] < k)
        for j in range(times):
            out[order[j: len(order) - times + 1 + j][near]] = True
    return out


def _read_batches(told: list[str]):
    """Emits every text as the classes of its words, and of each word its length and flags, and how often its pair with the next stands in the text.

    Flags: 1 in a link, 2 in a row of figures, 4 the pair with the next word is repeated nearby, 8 the word itself is, and is one of those not told apart.
    """
    n_kinds = len(told) + ENDINGS + 1

    def emit(ids: list[int], texts: list[tuple[list[int], np.ndarray, np.ndarray]], words: _Words) -> pa.RecordBatch:
        sizes = np.array([len(t[0]) for t in texts], np.int64)
        flat = np.concatenate([t[0] for t in texts])
        doc = np.repeat(np.arange(len(texts)), sizes)
        kind, length = np.array(words.kind, np.int64)[flat], np.array(words.length, np.int64)[flat]
        flags = np.zeros(len(flat), np.int64)
        own = np.zeros(len(flat), np.int32)
        if len(flat):
            flags = np.concatenate([t[1] for t in texts]) + 2 * np.concatenate([t[2] for t in texts])
            at = np.flatnonzero(doc[1:] == doc[:-1])
            # Numbers of words and of the chunk's texts have 20 bits at most.
            flags[at] += 4 * _repeated(doc[at] << 40 | flat[at] << 20 | flat[at + 1], at, NEAR)
            rare = np.flatnonzero(kind >= n_kinds - ENDINGS - 1)
            flags[rare] += 8 * _repeated(doc[rare] << 20 | flat[rare], rare, NEAR)
            _, which, n = np.unique((doc[at] * n_kinds + kind[at]) * n_kinds + kind[at + 1], return_inverse=True, return_counts=True)
            own[at] = n[which]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (kind.astype(np.int16), (length * 16 + flags).astype(np.int16), own)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "kind", "mark", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(told)
        ids: list[int] = []
        texts: list = []
        size = 0  # of words, and one a text
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own, link, table = _kinds(text.as_py())
                ids.append(key)
                texts.append((np.fromiter(map(words.__getitem__, own), np.int64, len(own)), link.astype(np.int64), table.astype(np.int64)))
                size += len(own) + 1
                if size >= CHUNK:
                    yield emit(ids, texts, words)
                    ids, texts, size = [], [], 0
                    words.forget_if_large()
        if ids:
            yield emit(ids, texts, words)

    return run


class _Table:
    """Counts of neighbouring classes, at most (classes)^2 whatever the corpus."""

    def __init__(self, n_kinds: int, cells: pa.Table):
        pairs = np.zeros(n_kinds * n_kinds, np.int64)
        pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        pairs = pairs.reshape(n_kinds, n_kinds)
        self.left, self.right, self.total = pairs.sum(1).astype(np.float64), pairs.sum(0).astype(np.float64), max(1.0, float(pairs.sum()))
        self.pairs = np.minimum(pairs, 2**31 - 1).astype(np.int32)


class _Texts:
    """A batch of texts as arrays over all their words."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("kind")
        self.n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.kind = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        mark = batch.column("mark").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.own = batch.column("own").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.link, self.table, self.size = mark & 1 == 1, mark & 2 == 2, mark >> 4
        self.pair_again, self.word_again = mark & 4 == 4, mark & 8 == 8
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.flatnonzero(self.doc[1:] == self.doc[:-1])  # pairs, by their first word

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.n))

    def information(self, table: _Table, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every pair, and which are repeated in excess; ``counted`` texts are in the table and have their own pairs taken out.

        A pair that makes up over USUAL of all pairs elsewhere is no excess.
        """
        a, b = self.kind[self.at], self.kind[self.at + 1]
        both = np.maximum(0, table.pairs[a, b] - self.own[self.at] * counted[self.doc[self.at]])
        chance = table.left[a] * table.right[b] / table.total
        again = (self.pair_again[self.at] & (both < USUAL * table.total)) | self.word_again[self.at]
        return np.clip(np.log((both + 0.5) / (chance + 0.5)), LOW, HIGH), again

    def spam_share(self, information: np.ndarray, again: np.ndarray, least: float) -> np.ndarray:
        """Share of each text's letters that is in links or in windows of a lower mean information than ``least``; rows of figures are exempt."""
        value = np.zeros(len(self.kind))
        value[self.at] = np.where(again, REPEATED, information)
        total = np.concatenate([[0], np.cumsum(value)])
        # Windows of pairs: a text of n words has n - 1; those at its ends are moved inwards.
        pairs = np.maximum(self.n - 1, 1)[self.doc]
        place = np.minimum(np.arange(len(self.kind)) - self.first[self.doc], pairs - 1)
        a = np.clip(place - WINDOW // 2, 0, np.maximum(0, pairs - WINDOW))
        b = np.minimum(a + WINDOW, pairs)
        mean = (total[self.first[self.doc] + b] - total[self.first[self.doc] + a]) / (b - a)
        bad = self.link | (~self.table & (mean < least) & (self.n[self.doc] > 1))
        return self.sums(bad * self.size) / np.maximum(1, self.sums(self.size))


def _cells(texts: _Texts, counted: np.ndarray, n_kinds: int) -> pa.RecordBatch:
    at = texts.at[counted[texts.doc[texts.at]]]
    cell, n = np.unique(texts.kind[at] * n_kinds + texts.kind[at + 1], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["cell", "n"])


def _suspects(texts: _Texts, first: _Table) -> np.ndarray:
    return texts.spam_share(*texts.information(first, np.ones(len(texts.n), bool)), FIRST) > SUSPECT


def _count_batches(n_kinds: int, shared=None):
    """Emits the counts of neighbouring classes; with the first reading's table, those of texts that it finds coherent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _Texts(batch)
            yield _cells(texts, ~_suspects(texts, shared.value) if shared else np.ones(len(texts.n), bool), n_kinds)

    return run


def _score_batches(first, second):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _Texts(batch)
            information, repeated = texts.information(second.value, ~_suspects(texts, first.value))
            mean = np.bincount(texts.doc[texts.at], weights=information, minlength=len(texts.n)) / np.maximum(1, texts.n - 1)
            again = np.bincount(texts.doc[texts.at], weights=repeated, minlength=len(texts.n)) / np.maximum(1, texts.n - 1)
            link = texts.sums(texts.link * texts.size) / np.maximum(1, texts.sums(texts.size))
            columns = [texts.n, texts.spam_share(information, repeated, COHERENT), mean, again, link]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "spam_share", "mean_pmi", "repeated_share", "link_share"])

    return run


def spam_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, spam_share, mean_pmi, repeated_share, link_share, spam) of every document.

    A window of words is spam if the mean pointwise mutual information of its neighbouring words is low: word salad and lists have neighbours that
    chance could have put together, and a collocation (or an uncommon word) that stands three times within some lines tells nothing and counts with a penalty. Information
    is bounded on both sides, so that one strong collocation can't make up for the loose ends of a list. Links with their labels are spam too, rows of
    figures never. The corpus is read twice, with the text's own pairs taken out both times: texts of which much is incoherent in the first reading don't
    count in the second, so spam doesn't make its own collocations look usual.

    All counts are exact sums over all documents. They are of word classes: some thousands of words are told apart, the most widespread of all and the ones
    most at home in each group of texts with like most frequent words, and all others go by their last letters. So the table that
    every task gets has at most (2048 + 65)^2 cells (18 MB) at every size of the corpus. No list of words of any language is given.
    Texts are read three times (which words are told apart; their classes, which are written; then only these are read) and never shuffled.

    Null and empty texts have no words and are not spam; a text of one word is only if that is a link. Repeated doc_ids: the
    highest share counts. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "spam")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    told = vocabulary(texts)
    n_kinds = len(told) + ENDINGS + 1
    read = scratch.write(texts.mapInArrow(_read_batches(told), "doc_id long, kind array<short>, mark array<short>, own array<int>"))

    def table(shared=None):
        cells = read.select("kind", "mark", "own").mapInArrow(_count_batches(n_kinds, shared), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        return spark.sparkContext.broadcast(_Table(n_kinds, cells.toArrow()))  # at most a row a cell, however large the corpus

    first = table()
    second = table(first)
    scored = read.mapInArrow(_score_batches(first, second), "doc_id long, n_words long, spam_share double, mean_pmi double, repeated_share double, link_share double")
    best = scored.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("n_words", "spam_share", "mean_pmi", "repeated_share", "link_share")])
    return best.withColumn("spam", F.col("spam_share") > SHARE)
