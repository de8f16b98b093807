"""RAKE: phrases between stop words and delimiters, scored by degree and frequency of their chunks.

All of it happens inside one document, so a document is read once, for all settings together, and
nothing is shuffled. Work and memory follow the document's length; offsets come from one automaton
pass over it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # a search term by term stands in
    ahocorasick = None

#: Rows of a batch that leaves a task.
ROWS = 50_000


@dataclass(frozen=True)
class Settings:
    """A stop list, delimiters and a threshold; null and empty entries are ignored, ValueError without a delimiter."""

    settings_id: int
    stops: frozenset[str]
    marks: frozenset[str]
    threshold: float | None = None

    @classmethod
    def of(cls, settings_id: int, stoplist: Iterable[str | None] | None, delimiters: Iterable[str | None] | None, threshold: float | None = None) -> Settings:
        marks = frozenset(d for d in delimiters or () if d)
        if not marks:
            raise ValueError("RAKE needs at least one delimiter that is not empty")
        return cls(settings_id, frozenset(w for w in stoplist or () if w), marks, threshold)

    def pattern(self) -> re.Pattern[str]:
        """The delimiters, the longest first."""
        return re.compile("(" + "|".join(re.escape(d) for d in sorted(self.marks, key=lambda d: (-len(d), d))) + ")")


class Analysis:
    """What RAKE says of one lower-cased text."""

    def __init__(self, text: str, settings: Settings, pattern: re.Pattern[str]) -> None:
        self.settings, self.text = settings, text
        self.chunks = [c for part in pattern.split(text) if (c := part.strip())]

    def phrases(self) -> list[list[str]]:
        """Runs of chunks; a chunk that is a stop word or delimiter ends one, a blank one neither ends nor joins."""
        found: list[list[str]] = []
        now: list[str] = []
        for chunk in self.chunks:
            if chunk in self.settings.stops or chunk in self.settings.marks:
                if now:
                    found.append(now)
                now = []
            else:
                now.append(chunk)
        return [*found, now] if now else found

    def word_scores(self, phrases: list[list[str]]) -> dict[str, tuple[int, int]]:
        """Frequency of each chunk, and its degree: the other chunks of its phrases."""
        freq: Counter = Counter()
        degree: Counter = Counter()
        for words in phrases:
            freq.update(words)
            for w in words:
                degree[w] += len(words) - 1
        return {w: (n, degree[w]) for w, n in freq.items()}

    def candidates(self) -> dict[str, float]:
        """Each distinct phrase with the sum of its chunks' degree / frequency; of phrases that read the same the last one counts."""
        phrases = self.phrases()
        scores = self.word_scores(phrases)
        ratio = {w: d / n for w, (n, d) in scores.items()}
        return {" ".join(words): sum(ratio[w] for w in words) for words in phrases}

    def linked(self, candidates: dict[str, float]) -> dict[str, float]:
        """Pairs of one-word candidates with only stop words between them; both scores are added for every occurrence.

        The term is both words with the stop words between, two spaces if there are none.
        """
        words = self.text.split()
        open_ = [(i, w) for i, w in enumerate(words) if w not in self.settings.stops]
        found: defaultdict[str, float] = defaultdict(float)
        for (i, a), (j, b) in zip(open_, open_[1:]):
            if a in candidates and b in candidates:
                found[f"{a} {' '.join(words[i + 1 : j])} {b}"] += candidates[a] + candidates[b]
        return dict(found)

    def terms(self) -> dict[str, float]:
        """Candidates and linked pairs from the threshold up; a linked term overrides a candidate."""
        candidates = self.candidates()
        every = candidates | self.linked(candidates)
        least = self.settings.threshold
        return every if least is None else {t: s for t, s in every.items() if s >= least}


def places(text: str, terms: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """``term, start, end`` of the places of each term in a text, those of one term not overlapping."""
    terms = [t for t in terms if t]
    if ahocorasick is None or not terms:
        for t in terms:
            at = text.find(t)
            while at >= 0:
                yield t, at, at + len(t)
                at = text.find(t, at + len(t))
        return
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    automaton.make_automaton()
    free: dict[str, int] = {}
    for last, t in automaton.iter(text):
        start = last + 1 - len(t)
        if start >= free.get(t, 0):
            free[t] = last + 1
            yield t, start, last + 1


Rows = Callable[[Analysis], Iterable[tuple]]
#: The tables RAKE can give of a document: columns, and their rows.
TABLES: dict[str, tuple[str, Rows]] = {
    "chunks": ("pos int, chunk string", lambda a: enumerate(a.chunks)),
    "phrases": ("phrase string, n long", lambda a: Counter("|".join(words) for words in a.phrases()).items()),
    "word_scores": ("word string, freq long, degree long, ratio double", lambda a: ((w, n, d, d / n) for w, (n, d) in a.word_scores(a.phrases()).items())),
    "scores": ("term string, score double", lambda a: a.candidates().items()),
    "linked": ("term string, score double", lambda a: a.linked(a.candidates()).items()),
    "terms": ("term string, score double", lambda a: a.terms().items()),
    "offsets": ("term string, start int, end int", lambda a: places(a.text, a.terms())),
}
TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def rake_table(corpus: DataFrame, settings: list[Settings], table: str = "terms") -> DataFrame:
    """``settings_id, doc_id`` and the columns of one of TABLES, for every row of ``corpus(doc_id, text)`` and all settings.

    Each row is a document for itself. Null and empty texts give no rows; works on raw text in both modes.
    """
    columns, rows_of = TABLES[table]
    names, types = zip(*((n, TYPES[t]) for n, t in (c.split() for c in columns.split(", "))))
    kind = corpus.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(s, s.pattern()) for s in settings]
        for batch in batches:
            ids: list[int] = []
            owner: list[int] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                data = zip(*rows) if rows else ((),) * len(names)
                made = pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(data, types))], names=["settings_id", "doc_id", *names])
                for held in (ids, owner, rows):
                    held.clear()
                return made

            for row, text in enumerate(batch.column(1).to_pylist()):
                for s, pattern in known:
                    for found in rows_of(Analysis(text, s, pattern)):
                        rows.append(found)
                        ids.append(s.settings_id)
                        owner.append(row)
                        if len(rows) >= ROWS:
                            yield out()
            yield out()

    texts = corpus.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))
    return texts.mapInArrow(run, f"settings_id int, doc_id {kind}, {columns}")


def rake(corpus: DataFrame, stoplist: list[str], delimiters: list[str], threshold: float | None = None) -> DataFrame:
    """``doc_id, term, score`` of candidates and linked pairs; a linked term overrides a candidate."""
    return rake_table(corpus, [Settings.of(0, stoplist, delimiters, threshold)]).drop("settings_id")


def rake_offsets(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, term, start, end``: the places of ``terms(doc_id, term)`` in their documents' lower-cased texts, not overlapping."""
    kind = corpus.schema["doc_id"].dataType.simpleString()
    lists = terms.where(F.col("term").isNotNull()).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = list(places(text, wanted))
                for a in range(0, len(found), ROWS):
                    term, start, end = zip(*found[a : a + ROWS])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(term), pa.int64())), pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "term", "start", "end"])

    texts = corpus.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text")).join(lists, "doc_id")
    return texts.mapInArrow(run, f"doc_id {kind}, term string, start int, end int")
