"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

One pass over each document counts what its unambiguous occurrences say (``Document``): words that
stand before a full stop with a small letter, comma or number behind them, the same words without
a full stop, capitalised words inside a sentence, in small letters, or at a beginning beyond
doubt. A full stop that these settle is settled by them. Where the document says nothing, the cut
is kept with a *doubt*; the doubts of all documents are answered by the book of the corpus, the
sums of the documents' counts, which is joined to them by word: it has no size limit and travels
to no task. Terminators, quotes and spaces follow rules of the script: see ``units``.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

# Abbreviations usual in some languages, and words that lead in a German ordinal ("am 0"), for single texts
# without a corpus. ``sentence_units`` does not use them.
USUAL = frozenset("No Nr Vol pp Fig fig Abb e.g i.e approx Approx ca Ca env Env aprox Aprox vs cf Cf vgl ex ej p.ej z.B d.h al рис см т.е т.д ул Dr Prof St Mr Mrs Ms Mme Mlle Sr Sra Dra Hr проф डॉ श्री د".split()) | frozenset(f"{lead} 0" for lead in "am Am vom Vom zum Zum im Im beim der Der die Die das Das den Den dem Dem des Des bis Bis seit Seit ab Ab".split())

STOPS = ".!?…。！？｡؟۔।॥‼⁇⁈⁉"
FULL_WIDTH = frozenset("。！？｡")
OPENERS = dict(zip("([{（［【「『«‹", ")]}）］】」』»›"))
CLOSERS = frozenset(OPENERS.values()) | frozenset("”’“\"")
LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
RUN = re.compile(rf"[{STOPS}]+")
QUOTES = re.compile(r"[(\[{（［【「『«‹)\]}）］】」』»›“”„‘’\"]")
LIST_MARK = re.compile(r"\s*(?:[-*•·‣▪◦・–]\s*(?=\S)|[(（]\w{1,3}[)）]\s*|\d{1,3}[.)、．]\s*(?!\d)|\d{1,3}[.)]\s+)")
#: What stands around a word, as a set of characters.
AROUND = r"\s()\[\]{}（）«»„“”‘’\"「」『』…!?"
BREAKS = re.compile(f"[{AROUND}]")
NEXT_WORD = re.compile(r"[\w\u0300-\u036f]+")
THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f])[ \t\u00a0]+(?=[\u0e00-\u0e7f])")
ALNUM = re.compile(r"[^\W_]")
#: Least and greatest length of a line of wrapped text.
WRAP = (50, 110)
#: A run of characters longer than this is no abbreviation.
LONGEST = 100
#: What may stand between a terminator and the closer behind it.
ONLY_BETWEEN = re.compile("[ \u00a0\u202f\n\r" + re.escape("".join(sorted(CLOSERS))) + "]*")
NOT_SPACE = re.compile(r"\S")
THAI = re.compile(r"[\u0e00-\u0e7f]")
DASHES = frozenset("—–-―")


def _letters(kind: str) -> str:
    """All characters for which the str method ``kind`` holds, as ranges of a set."""
    has = getattr(str, kind)
    out, start = [], -1
    for code in range(sys.maxunicode + 2):
        if code <= sys.maxunicode and has(chr(code)):
            start = code if start < 0 else start
        elif start >= 0:
            out.append(f"{chr(start)}-{chr(code - 1)}")
            start = -1
    return "".join(out)


UPPER, LOWER = _letters("isupper"), _letters("islower")
WORDS = re.compile(r"\w+")
INSIDE = re.compile(rf"(?<=[{LOWER},;] )([{UPPER}]\w*+)(\.?)")
BEGINNING = re.compile(rf"(?:\A|\n\s*\n|[!?…] )\s*+[«“„‘\"¿¡(\[]*([{UPPER}]\w*)")
BEFORE_STOP = re.compile(rf"(?<![^{AROUND},;])([^{AROUND},;.]++(?:\.[^{AROUND},;.]++)*+)\.(?:(?=([,;:)]))|(?=(\s+)[«“„‘\"¿¡(\[]*+(\w*))|\Z)")

# Letters without which a word cannot be spoken.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеёиоуыэюяіїєαεηιουω"

#: What is known of a word: COMMON begins sentences, NAME stands capitalised inside them.
COMMON, NAME = 1, 2
#: Counters of the corpus for each word, as ``Document.counts`` gives them.
COUNTERS = ("inner", "number", "final", "plain", "named", "usual", "open", "start", "inside", "ordinal")


class Document:
    """What the unambiguous occurrences of a document's words say, from one pass over it."""

    def __init__(self, text: str) -> None:
        self.words = Counter(WORDS.findall(text))
        inside = Counter(INSIDE.findall(text))
        self.inside: Counter = Counter()
        for (word, _), n in inside.items():
            self.inside[word] += n
        self.starts = Counter(BEGINNING.findall(text))
        self.ordinals: Counter = Counter()
        self.before: dict[str, list[int]] = defaultdict(lambda: [0] * 3)  # inner, number, final
        self.followed: list[tuple[str, str]] = []
        stops: Counter = Counter()
        for m in BEFORE_STOP.finditer(text):
            word, comma, gap, following = m.groups("")
            if len(word) > LONGEST:
                continue
            if word.isdigit():
                if len(word) <= 2 and following[:1].isupper() and text[m.start() - 1 : m.start()] == " ":
                    self.ordinals[following] += 1
                continue
            stops[word] += 1
            if not comma and (not gap or gap.count("\n") > 1):
                self.before[word][2] += 1
            elif following[:1].isupper():
                self.followed.append((word, following))
            elif "\n" in gap:
                continue  # the line may end a heading or be wrapped
            elif comma or following.islower():
                self.before[word][0] += 1
            elif following[:1].isdigit():
                self.before[word][1] += 1
        # a capitalised word that may begin a sentence is no other use of an abbreviation
        self.plain = {word: n for word, k in stops.items() if (n := inside.get((word, ""), 0) if word[0].isupper() else self.words.get(word, 0) - k) > 0}
        for word, following in self.followed:
            if self.abbreviation(word) is False:
                self.starts[following] += 1

    def abbreviation(self, word: str) -> bool | None:
        """Whether the document shows ``word.`` to go on, or shows ``word`` to be a word; None if neither."""
        inner, number, final = self.before.get(word, (0, 0, 0))
        plain = self.plain.get(word, 0)
        if inner > plain and inner >= final or inner + number >= 2 and not plain and not final:
            return True
        return False if plain or final else None

    def kind(self, name: str) -> int:
        """COMMON if the document has the capitalised word in small letters, NAME if only inside sentences, else 0."""
        if self.words.get(name[0].lower() + name[1:]):
            return COMMON
        return NAME if self.inside.get(name) else 0

    def add_counts(self, total: dict[str, list[int]]) -> None:
        """Add the document's counts to those of the corpus, by word in the order of COUNTERS."""
        for word, (inner, number, final) in self.before.items():
            row = total[word]
            row[0] += inner
            row[1] += number
            row[2] += final
        for word, n in self.plain.items():
            total[word][3] += n
        for word, following in self.followed:
            kind = self.kind(following)
            total[word][4 if kind == NAME else 5 if kind == COMMON else 6] += 1
        for place, words in ((7, self.starts), (8, self.inside), (9, self.ordinals)):
            for word, n in words.items():
                total[word][place] += n


#: A question to the corpus about a cut: what kind, the word before, the word after, whether the document
#: shows the first to be an abbreviation, and what it shows of the second.
Doubt = tuple[str, str, str, int, int]


def pairs_of_quotes(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotes and brackets of a stretch, as (place of opener, place of closer)."""
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()  # of the stack, by closer
    found: list[tuple[int, int]] = []

    def open_(closer: str) -> None:
        stack.append((closer, at))
        depth[closer] += 1

    def close(closer: str) -> None:
        if not depth[closer]:
            return
        while True:
            top, begin = stack.pop()
            depth[top] -= 1
            if top == closer:
                found.append((begin, at))
                return

    for m in QUOTES.finditer(text, start, end):
        c, at = m.group(), m.start()
        if c in OPENERS:
            open_(OPENERS[c])
        elif c == "„":
            open_("“")
        elif c == "“":
            if depth["“"]:
                close("“")
            else:
                open_("”")
        elif c == "‘":
            open_("’")
        elif c == '"':
            if depth['"']:
                close('"')
            else:
                open_('"')
        else:
            if c == "’" and at and at + 1 < end and text[at - 1].isalnum() and text[at + 1].isalnum():
                continue
            close(c)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _cased(c: str) -> bool:
    return c.islower() or c.isupper()


def _spaceless(c: str) -> bool:
    """Whether a character is of a script that runs without spaces between words."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "฀" <= c <= "໿" or c in "。！？、，；：」』）"


def stretches(text: str, doc: Document) -> list[tuple[int, int, Doubt | None]]:
    """Parts of the text between breaks of line that end a unit, with the doubt about the break before.

    A blank line ends a part. A single break does so unless the text there was wrapped to a width:
    the line has WRAP characters and about as many as the longest such line of its paragraph, is no
    list item, and is not followed by a list mark. In scripts without spaces, lines count as wrapped
    if three or more of the paragraph's have the same, greatest, length.
    """
    lines: list[tuple[int, int]] = []
    at = 0
    for m in LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    if len(lines) == 1:
        return [(0, len(text), None)]
    out: list[tuple[int, int, Doubt | None]] = []
    paragraph: list[tuple[int, int]] = []
    for s, e in [*lines, (0, 0)]:
        if text[s:e].strip():
            paragraph.append((s, e))
        elif paragraph:
            _join(text, paragraph, out, doc)
            paragraph = []
    return out


def _join(text: str, lines: list[tuple[int, int]], out: list[tuple[int, int, Doubt | None]], doc: Document) -> None:
    """Add the parts of one paragraph, given as its lines."""
    sizes = [len(text[s:e].rstrip()) for s, e in lines]
    longest = max((x for x in sizes if x <= WRAP[1]), default=0)
    even = longest >= 20 and sizes.count(longest) >= 3
    joins = False  # whether the line before goes on in this one
    doubt: Doubt | None = None
    for i, (s, e) in enumerate(lines):
        if joins:
            out[-1] = (out[-1][0], e, out[-1][2])
        else:
            out.append((s, e, doubt))
        item = not joins and doubt is None and LIST_MARK.match(text, s, e) is not None
        joins, doubt = False, None
        if i + 1 == len(lines):
            return
        last, following = text[s + sizes[i] - 1], text[lines[i + 1][0] : lines[i + 1][1]].lstrip()
        if _spaceless(last) or _spaceless(following[0]):
            joins = even and sizes[i] == longest and last not in STOPS and last not in CLOSERS and not item and LIST_MARK.match(following) is None
        elif not item and WRAP[0] <= sizes[i] <= WRAP[1] and sizes[i + 1] <= WRAP[1] and sizes[i] >= 0.55 * longest:
            joins = True
            if LIST_MARK.match(following):  # a mark, or a number that an abbreviation leads in
                joins = last not in STOPS and last not in CLOSERS and following[0].isdigit()
                word = _word_before(text, s, s + sizes[i] - 1) if last == "." else ""
                if word:
                    known = doc.abbreviation(word)
                    joins = known is True
                    doubt = ("word", word, "", 0, 0) if known is None else None


def units(text: str, usual: frozenset[str] = frozenset()) -> list[tuple[int, int, Doubt | None]]:
    """The units of a text as half-open ranges: sentences, headings and list items, in order.

    The third member is the doubt about the cut before the unit, None where the document settles
    it; ``usual`` are abbreviations that go on where the document does not know better.

    Inside matched quotes and brackets nothing ends. After a terminator and what closes behind it,
    a unit ends unless a small letter, comma or dash with a small letter follows; a full stop also
    needs that its word is no abbreviation, initial or ordinal there. A quotation that opens a unit
    goes on into the words that report it; in caseless scripts a later quotation ends its unit only
    if a colon led it in. Full-width stops need no space. Thai ends units at spaces between Thai
    letters. Units are without white space around and hold a letter or digit.
    """
    out: list[tuple[int, int, Doubt | None]] = []
    doc = Document(text)
    _cut(text, doc, usual, out)
    return out


def settled(text: str, usual: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """The units of one text without a corpus: what the document leaves in doubt ends, but for initials and its own abbreviations."""
    out: list[tuple[int, int]] = []
    for start, end, doubt in units(text, usual):
        if doubt and (doubt[0] == "initial" or doubt[0] == "word" and doubt[3] and doubt[4] != COMMON):
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _cut(text: str, doc: Document, usual: frozenset[str], out: list[tuple[int, int, Doubt | None]]) -> None:
    sure = 0
    for s, e, doubt in stretches(text, doc):
        mark = LIST_MARK.match(text, s, e) if doubt is None else None
        begin = s  # the unit's first character; ``sure`` is the same if cuts in doubt are none
        sure = s if doubt is None else sure
        cuts: list[tuple[int, Doubt | None]] = []
        pairs: list[tuple[int, int]] | None = None
        opens: list[int] = []
        at = mark.end() if mark else s
        while m := RUN.search(text, at, e):
            at = m.end()
            if at >= e:
                break
            if pairs is None:
                pairs = pairs_of_quotes(text, s, e)
                opens = [a for a, _ in pairs]
            end, quote = at, -1
            k = bisect_right(opens, m.start()) - 1
            if k >= 0 and pairs[k][1] > m.start():
                closer = pairs[k][1]
                if ONLY_BETWEEN.match(text, at, closer).end() < closer:
                    continue
                end, quote = closer + 1, pairs[k][0]
                while end < e and text[end] in STOPS:
                    end += 1
            at = end
            verdict = _ends(text, m.start(), m.end(), end, begin, sure, e, quote, doc, usual)
            if verdict is not False:
                cuts.append((end, None if verdict is True else verdict))
                begin = end
                while begin < e and text[begin].isspace():
                    begin += 1
                sure = begin if verdict is True else sure
        begin = s
        for cut, following in [*cuts, (e, None)]:
            if THAI.search(text, begin, cut):
                inner = pairs if pairs is not None else pairs_of_quotes(text, begin, cut)
                starts = [a for a, _ in inner]
                for gap in THAI_GAP.finditer(text, begin, cut):
                    k = bisect_right(starts, gap.start()) - 1
                    if k < 0 or inner[k][1] <= gap.start():
                        _add(out, text, begin, gap.start(), doubt)
                        begin, doubt = gap.end(), None
            _add(out, text, begin, cut, doubt)
            begin, doubt = cut, following


def _first_letter(text: str, start: int, end: int) -> str:
    m = ALNUM.search(text, start, end)
    return m.group() if m else ""


def _add(out: list[tuple[int, int, Doubt | None]], text: str, start: int, end: int, doubt: Doubt | None) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if ALNUM.search(text, start, end):
        out.append((start, end, doubt if out else None))


def _word_before(text: str, begin: int, stop: int) -> str | None:
    """The characters before ``stop`` up to what stands around words; None if there are more than LONGEST."""
    least = max(begin, stop - LONGEST - 1)
    word = BREAKS.split(text[least:stop])[-1]
    return None if len(word) > LONGEST else word


def _ends(text: str, stop: int, after: int, end: int, begin: int, sure: int, limit: int, quote: int, doc: Document, usual: frozenset[str]) -> bool | Doubt:
    """Whether a unit that began at ``begin`` ends at ``end``, or the doubt about it; its terminators are ``stop:after``."""
    following = end
    while following < limit and text[following].isspace():
        following += 1
    if following >= limit:
        return True
    run = text[stop:after]
    c = text[following]
    gap = following > end
    if c in ",;:،؛，；：、)]}":
        return False
    wide = run[-1] in FULL_WIDTH or run == "……" or run[-1] in "।॥؟۔"
    if not gap and not wide:
        if not (c.isupper() or c in "¿¡«“„‘\"[("):
            return _caseless_letter(c) and run[-1] in "!?…"
        if c == '"' and quote < 0 and text[end - 1] != '"' and run != "." and not text[end : end + 2].strip('"'):
            return False
        if run == ".":
            word = _word_before(text, begin, stop)
            if word is None or len(word) < 2 or not word[-1].islower() or not word[0].isalpha() or "/" in word or "." in word:
                return quote >= 0 or (c == "[" and (word is None or len(word) > 1))
    # what follows, past openers
    look = following
    while look < limit and (text[look] in "«“„‘\"'([（「『¿¡‹" or text[look].isspace()):
        look += 1
    letter = text[look] if look < limit else ""
    if c in DASHES and gap:
        ahead = following + 1
        while ahead < limit and (text[ahead].isspace() or text[ahead] in DASHES):
            ahead += 1
        if ahead < limit and (text[ahead].islower() or quote >= 0):
            return False
    word_after = NEXT_WORD.match(text, look, limit)
    name = word_after.group() if word_after else ""
    if letter.islower() and name and not any(x.isupper() for x in name[1:]):
        return False
    if quote >= 0 and text[quote] not in "([{（［【":
        inside = _first_letter(text, quote, end)
        opening = not ALNUM.search(text, begin, quote)
        if inside and not _cased(inside) and not inside.isdigit() or (letter and _caseless_letter(letter)):
            if opening:
                return False
            lead = quote - 1
            while lead > begin and text[lead].isspace():
                lead -= 1
            return text[lead] in ":：,"
        if opening and name and doc.kind(name) == NAME:
            rest = text[word_after.end() : word_after.end() + 2]
            return not (rest[:1] == " " and rest[1:2].islower())
        return True
    if run != ".":
        return True
    if end > after:  # closed by a bracket
        return True
    return _after_word(text, stop, begin, sure, c, letter, name, doc, usual)


def _caseless_letter(c: str) -> bool:
    return c.isalpha() and not _cased(c)


def _after_word(text: str, stop: int, begin: int, sure: int, c: str, letter: str, name: str, doc: Document, usual: frozenset[str]) -> bool | Doubt:
    """Whether the single full stop at ``stop`` ends a unit rather than belonging to an abbreviation, initial or ordinal."""
    word = _word_before(text, begin, stop)
    if not word:
        return True
    if word.isdigit():
        if not NOT_SPACE.search(text, sure, stop - len(word)):
            return False  # a list mark
        if len(word) > 2 or not letter.isupper() or doc.starts.get(name):
            return True
        if usual and f"{BREAKS.split(text[max(sure, stop - LONGEST) : stop - len(word)].rstrip())[-1]} 0" in usual:
            return False
        return "number", "", name, 0, 0
    capital = name[:1].isupper()
    if len(word) == 1 and word.isalpha():
        if not _cased(word):
            return False
        if letter.isdigit() and word.islower():
            return _doubted(word, "", 0, doc, usual)
        if len(name) < 2 or not capital:
            return False if word.isupper() or capital else bool(name)
        kind = doc.kind(name)
        if kind == COMMON:
            return ("initial", "", name, 0, 0) if word.isupper() else True
        return False if kind == NAME or word.isupper() else ("initial", "", name, 0, 0)
    if c in "([" or letter.isdigit() or not name:
        return _doubted(word, "", 0, doc, usual)
    return _doubted(word, name, doc.kind(name), doc, usual)


def _doubted(word: str, name: str, kind: int, doc: Document, usual: frozenset[str]) -> bool | Doubt:
    """The same for a word of two or more letters before ``name`` ("" for a number or bracket)."""
    known = doc.abbreviation(word)
    if known is None and word in usual:
        return kind == COMMON
    if known is False:
        return True
    if known and (not name or kind):
        return kind == COMMON
    return ("word", word, name, int(bool(known)), kind)


# --- the book of the corpus -------------------------------------------------------------------

COLUMNS = ("rec", "doc_id", "chain", "size", "k", "start_pos", "end_pos", "doubt", "word", "name", "known", "kind", *COUNTERS)
#: Distinct words whose counts a task holds before it hands them on.
HELD = 200_000


def cut_and_count(texts: DataFrame) -> DataFrame:
    """The candidate units of all texts, and their counts for the book, from one pass.

    Rows with a ``rec`` are units: units linked by doubts make a chain of ``size``, ``k`` is the
    place in it, and ``doubt, word, name, known, kind`` is the doubt about the cut before. Rows
    without are counts of ``word``.
    """
    key = texts.schema["doc_id"].dataType.simpleString()
    schema = f"rec long, doc_id {key}, chain int, size int, k int, start_pos int, end_pos int, doubt string, word string, name string, known int, kind int, " + ", ".join(f"{c} long" for c in COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0] * len(COUNTERS))
        number = TaskContext.get().partitionId() << 36
        doc_type = None

        def out(owner: pa.Array, columns: list[list]) -> pa.RecordBatch:
            n = len(columns[0])
            rec, chain, size, k, start, end, doubts = columns
            asked = list(zip(*(d or (None,) * 5 for d in doubts))) if n else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            fields = [pa.array(rec, pa.int64()), owner, *(pa.array(x, pa.int32()) for x in (chain, size, k, start, end)), *(pa.array(x, t) for x, t in zip(asked, kinds))]
            return pa.RecordBatch.from_arrays([*fields, *(pa.nulls(n, pa.int64()) for _ in COUNTERS)], names=list(COLUMNS))

        def out_counts() -> pa.RecordBatch:
            words, n = list(counts), len(counts)
            rows = list(zip(*counts.values())) if n else [()] * len(COUNTERS)
            empty = [pa.nulls(n, pa.int64()), pa.nulls(n, doc_type), *(pa.nulls(n, pa.int32()) for _ in range(5)), pa.nulls(n, pa.string()), pa.array(words, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
            counts.clear()
            return pa.RecordBatch.from_arrays([*empty, *(pa.array(x, pa.int64()) for x in rows)], names=list(COLUMNS))

        for batch in batches:
            doc_type = batch.column(0).type
            owner: list[int] = []
            columns: list[list] = [[] for _ in range(7)]
            for row, text in enumerate(batch.column(1).to_pylist()):
                found: list[tuple[int, int, Doubt | None]] = []
                doc = Document(text)
                doc.add_counts(counts)
                _cut(text, doc, frozenset(), found)
                heads = [i for i, (_, _, d) in enumerate(found) if d is None]
                for chain, (i, j) in enumerate(zip(heads, [*heads[1:], len(found)])):
                    for k in range(i, j):
                        for column, value in zip(columns, (number, chain, j - i, k - i, *found[k])):
                            column.append(value)
                owner += [row] * len(found)
                number += 1
            yield out(batch.column(0).take(pa.array(owner, pa.int64())), columns)
            if len(counts) > HELD:
                yield out_counts()
        if counts:
            yield out_counts()

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def book_of(found: DataFrame, least: int = 8) -> DataFrame:
    """``word, role, starter, ordinal`` from the counts in ``found``.

    ``role``: 'word' if it stands without a full stop more often than with one; 'going_on' if a
    small letter, comma or number mostly follows; 'title' if a capitalised word follows that is
    seldom a common one, and the word hardly ever ends a paragraph or stands without a full stop
    and has names behind it or no vowel; null for what is seen less than ``least`` times or settled by none of these. ``starter``: usual at beginnings beyond doubt, seldom inside. ``ordinal``: follows a
    number with a full stop more often than it begins.
    """
    unspoken = ~F.lower("word").rlike(f"[{VOWELS}]")
    sums = found.where("rec is null").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    capital = F.col("named") + F.col("usual") + F.col("open")
    total = F.col("inner") + F.col("number") + F.col("final") + capital
    role = (
        F.when((total > 0) & (F.col("plain") > total), "word")
        .when((total >= least) & (F.col("inner") + F.col("number") >= 0.5 * total), "going_on")
        .when((total >= least) & (capital >= 0.8 * total) & (F.col("usual") <= 0.05 * capital) & (F.col("final") + F.col("plain") <= 0.05 * total) & ((F.col("named") >= 0.02 * capital) | unspoken), "title")
    )
    starter = (F.col("start") >= 3) & (F.col("inside") <= 0.05 * (F.col("start") + F.col("inside")))
    ordinal = (F.col("ordinal") >= least) & (F.col("start") <= 0.05 * F.col("ordinal"))
    return sums.select("word", role.alias("role"), starter.alias("starter"), ordinal.alias("ordinal"))


def goes_on(doubt: Column, known: Column, kind: Column, name: Column, role: Column, starter: Column, ordinal: Column) -> Column:
    """The corpus' answer to a doubt: whether the unit goes on past the cut."""
    common = (kind == COMMON) | ((kind == 0) & starter)
    by_word = F.when((known == 1) | (role == "going_on"), ~common).when(role == "title", (name != "") & ~(starter & (kind != NAME))).otherwise(False)
    return F.when(doubt == "number", ordinal).when(doubt == "initial", ~starter).otherwise(by_word)


def sentence_units(records: DataFrame, salts: int = 16) -> DataFrame:
    """``doc_id, unit_no, start_pos, end_pos`` for every unit of ``records(doc_id, text)``, in order.

    Offsets are half-open, in code points. A null, empty or blank text, or one without a letter or
    digit, has no units. Repeated rows are cut each for itself. Whole texts of any length are cut;
    other columns are ignored. Doubts are answered from all texts given: by distinct question, so
    a frequent one is asked once, and its answer goes back in ``salts`` copies.
    """
    found = written(cut_and_count(records.where(F.col("text").isNotNull()).select("doc_id", "text")), "units")
    book = book_of(found)
    rows = found.where("rec is not null").select("rec", "doc_id", "chain", "size", "k", "start_pos", "end_pos", "doubt", "word", "name", "known", "kind")
    question = ["doubt", "word", "name", "known", "kind"]
    asked = rows.where("doubt is not null").select(*question).distinct()
    by_word = book.select("word", "role")
    by_name = book.select(F.col("word").alias("name"), "starter", "ordinal")
    answers = asked.join(by_word, "word", "left").join(by_name, "name", "left")
    no = F.lit(False)
    on = goes_on(F.col("doubt"), F.col("known"), F.col("kind"), F.col("name"), F.coalesce("role", F.lit("")), F.coalesce("starter", no), F.coalesce("ordinal", no))
    yes = answers.where(on).select(*question, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("on"))
    linked = rows.where("size > 1").withColumn("salt", F.pmod(F.col("rec"), F.lit(salts)).cast("int")).join(yes, [*question, "salt"], "left")
    order = Window.partitionBy("rec", "chain").orderBy("k")
    islands = linked.withColumn("island", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order))
    whole = islands.groupBy("rec", "doc_id", "chain", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    columns = ["rec", "doc_id", "start_pos", "end_pos"]
    every = rows.where("size = 1").select(*columns).unionByName(whole.select(*columns))
    numbered = every.withColumn("unit_no", (F.row_number().over(Window.partitionBy("rec").orderBy("start_pos")) - 1).cast("int"))
    return numbered.select("doc_id", "unit_no", "start_pos", "end_pos")
