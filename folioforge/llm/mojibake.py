"""Text decoded with the wrong character encoding: find the runs and restore them.

1. Adjacent character pairs are counted over all distinct values of the corpus.
2. A pair scores its smoothed pointwise mutual information ``log2((n + 1) / (E + 1))``, ``E``
   the count expected of independent characters, at the level of characters and of
   character classes; the lower of the two holds.  Words of capitals are read in small ones.
3. Maximum-scoring segments of ``-score - THETA`` whose sum reaches ``LEAST`` isolate
   improbable runs, widened over adjoining characters outside ASCII.
4. Inverse mappings are tested inside those runs only.  One is accepted if the run becomes
   UTF-8, or more likely under the pair counts.  A run of letters only, whose classes may
   stand together, is accepted after an exact check: its restored words occur elsewhere in
   the corpus.  A run that nothing restores is reported only if it holds U+FFFD or a control
   character, which no text has.

Characters outside the Latin script and the code pages at hand count as one for each class,
so the counts have at most the square of about 1,100 characters, whatever the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.skew import salted_join
from folioforge.session import cut_lineage, spread

#: Bits of improbability that a pair must exceed to add to a run, and bits of a whole run.
THETA, LEAST = 0.5, 1.4
#: Bits of a pair of classes from which a run is no spelling of any kind.
STRUCTURE = 2.0
#: Pseudo-counts of symbols beside blanks, digits and punctuation, as a share of all pairs.
SYMBOLS_APART = 0.05
#: Log likelihood that a one-byte mapping of a run of letters must gain, in nats.
MARGIN = 0.5
#: Nats that a mapping other than from the code pages 437 and 850 must gain besides.
RARE = 6.0
MEMO = 200_000
EDGE = "\x02"
#: What stands for a letter of another script, and for another symbol.
LETTER, SYMBOL = "\ue000", "\ue001"

# Combining marks that precede their letter in the ANSEL character set, by byte.
ANSEL_MARKS = {
    0xE0: "̉", 0xE1: "̀", 0xE2: "́", 0xE3: "̂", 0xE4: "̃", 0xE5: "̄", 0xE6: "̆",
    0xE7: "̇", 0xE8: "̈", 0xE9: "̌", 0xEA: "̊", 0xF0: "̧", 0xF1: "̨",
}
# Letters of the ANSEL character set, by byte.
ANSEL_LETTERS = {0xA1: "Ł", 0xA2: "Ø", 0xA5: "Æ", 0xA6: "Œ", 0xB1: "ł", 0xB2: "ø", 0xB5: "æ", 0xB6: "œ", 0xB8: "ı"}

VOWELS = frozenset("aeiouy")
# Typographic forms of ASCII punctuation.
TYPOGRAPHIC = frozenset("‘’‚“”„–—…‐‑′″")
# Base letters of letters that Unicode does not decompose.
BASES = {"ø": "o", "æ": "a", "œ": "o", "Ø": "O", "Æ": "A", "Œ": "O", "ı": "i"}


def char_class(c: str) -> str:
    """The class of one character, a single letter.

    ``_`` blank or edge, ``v c U`` small vowels, other small letters and capitals, ``V C``
    small letters outside ASCII, ``9`` digits, ``p`` punctuation, ``s`` symbols, ``z``
    ignorable and wide blanks, ``x`` letters of other scripts and compatibility forms.
    """
    if c == EDGE or c == " ":
        return "_"
    if c.isascii():
        if c.isalpha():
            return "U" if c.isupper() else "v" if c in VOWELS else "c"
        return "9" if c.isdigit() else "p"
    if c == LETTER:
        return "x"
    if c in TYPOGRAPHIC:
        return "p"
    kind = unicodedata.category(c)
    if kind in ("Zs", "Cf"):
        return "z"
    code = ord(c)
    if kind[0] == "L" and kind != "Lo" and (code < 0x250 or 0x1E00 <= code < 0x1F00):
        base = unicodedata.normalize("NFD", c)[0]
        return "U" if c.isupper() else "V" if BASES.get(base, base) in VOWELS else "C"
    if kind != "Lo" and kind[0] in "LM" or code >= 0x250 and kind[0] == "L" or 0x1D400 <= code < 0x1D800 or 0xFF00 <= code < 0xFFF0 or 0x2150 <= code < 0x2190:
        return "x"
    return "s"


def _repertoire() -> frozenset[str]:
    """Characters that keep their own counts: ASCII, Latin letters and the code pages."""
    pages = {bytes([b]).decode(p, "ignore") for b in range(256) for p in ("cp437", "cp850", "mac_roman", "cp1252", "latin-1")}
    latin = {chr(c) for c in (*range(0x250), *range(0x1E00, 0x1F00))}
    return frozenset(pages | latin | TYPOGRAPHIC | {"\ufffd"})


REPERTOIRE = _repertoire()
WORD = re.compile(r"\S+")


def _small(m: re.Match) -> str:
    word = m.group()
    if sum("A" <= c <= "Z" for c in word) < 2 or any("a" <= c <= "z" for c in word):
        return word
    return "".join(x if len(x := c.lower()) == 1 else c for c in word)


def view(text: str) -> str:
    """The text as it is counted and scored, edges marked: one character for each of its own."""
    text = WORD.sub(_small, text)
    if not text.isascii():
        text = "".join(c if c in REPERTOIRE else LETTER if char_class(c) in "xz" else SYMBOL for c in text)
    return EDGE + text + EDGE


def to_bytes(text: str, encoding: str) -> bytes:
    """Encode; windows-1252 also passes the control characters of Latin-1 through."""
    if encoding != "cp1252":
        return text.encode(encoding)
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            out += c.encode("latin-1")
    return bytes(out)


WIDE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
NARROW = (
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp850", "mac_roman"), ("latin-1", "mac_roman"), ("latin-1", "cp850"),
)


def one_byte_inverses(text: str) -> list[str]:
    """The readings of a whole text under every mapping between one-byte encodings and from ANSEL."""
    out = []
    for source, target in NARROW:
        try:
            out.append(to_bytes(text, source).decode(target))
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return [x for x in (*out, ansel(text)) if x and x != text]


#: Mappings of old terminals and catalogue systems; others always need the check of words.
USUAL = frozenset({"cp1252 as cp850", "cp1252 as cp437", "ansel as latin-1"})


def as_utf8(text: str) -> str | None:
    """The text that was UTF-8 read as a one-byte encoding, up to three times over; or none."""
    best = None
    for _ in range(3):
        for encoding in WIDE:
            try:
                again = to_bytes(text, encoding).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if again != text:
                best = text = again
                break
        else:
            break
        if text.isascii():
            break
    return best


def utf8_inside(text: str) -> str | None:
    """The text with every part that is UTF-8 read as a one-byte encoding decoded, or none."""
    for encoding in WIDE:
        out, at, changed = [], 0, False
        while at < len(text):
            try:
                lead = to_bytes(text[at], encoding)[0]
                size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                if size and at + size <= len(text):
                    out.append(to_bytes(text[at : at + size], encoding).decode("utf-8"))
                    at, changed = at + size, True
                    continue
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
            out.append(text[at])
            at += 1
        if changed:
            found = "".join(out)
            return utf8_inside(found) or found
    return None


def ansel(text: str) -> str | None:
    """The text whose ANSEL bytes were read as Latin-1, or none."""
    out, mark, changed = [], "", False
    for c in text:
        code = ord(c)
        if code in ANSEL_MARKS:
            mark, changed = ANSEL_MARKS[code], True
            continue
        if code in ANSEL_LETTERS:
            c, changed = ANSEL_LETTERS[code], True
        if mark:
            c = unicodedata.normalize("NFC", c + mark)
            if len(c) > 1:
                return None
            mark = ""
        out.append(c)
    return "".join(out) if changed and not mark else None


def pieces(text: str) -> list[str]:
    """A value cut at its blanks, each piece with what stands on either side: together they have its pairs, each once."""
    first, *rest = view(text).split(" ")
    if not rest:
        return [first]
    *middle, last = rest
    return [first + " ", *(f" {p} " for p in middle), " " + last]


def piece_pairs(counts: Counter) -> Counter:
    """Adjacent pairs of pieces by their number; each distinct piece is read once."""
    total: Counter = Counter()
    for piece, n in counts.items():
        for pair in zip(piece, piece[1:]):
            total[pair] += n
    return total


def count_pairs(text: str) -> Counter:
    """Adjacent pairs of one value, edges included."""
    marked = view(text)
    return Counter(zip(marked, marked[1:]))


def pair_counts(values: DataFrame, column: str = "value") -> DataFrame:
    """``a, b, n``: adjacent character pairs over all distinct non-null values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        counts: Counter = Counter()
        for batch in batches:
            for text in batch[column]:
                counts.update(pieces(text))
            if len(counts) >= MEMO:
                total.update(piece_pairs(counts))
                counts.clear()
        total.update(piece_pairs(counts))
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])

    distinct = values.where(F.col(column).isNotNull()).select(column).distinct()
    return distinct.mapInPandas(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


class PairModel:
    """Pair scores and likelihoods from the counts of :func:`pair_counts`."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.pair = {a + b: n for a, b, n in counts}
        self.total = max(1, sum(self.pair.values()))
        self.first: Counter = Counter()
        self.second: Counter = Counter()
        self.class_pair: Counter = Counter()
        self.class_first: Counter = Counter()
        self.class_second: Counter = Counter()
        self.class_char: Counter = Counter()
        self.classes: dict[str, str] = {}
        for a, b, n in counts:
            x, y = self.kind(a), self.kind(b)
            self.first[a] += n
            self.second[b] += n
            self.class_pair[x + y] += n
            self.class_first[x] += n
            self.class_second[y] += n
            self.class_char[x + b] += n
        # what is known of symbols before any corpus: they stand apart from letters
        prior = self.total * SYMBOLS_APART / 3
        self.class_total = self.total + 6 * prior
        for other in "_9p":
            for x, y in (("s", other), (other, "s")):
                self.class_pair[x + y] += prior
                self.class_first[x] += prior
                self.class_second[y] += prior
        self.scores: dict[str, float] = {}
        self.logs: dict[str, float] = {}

    def kind(self, c: str) -> str:
        found = self.classes.get(c)
        if found is None:
            found = self.classes[c] = char_class(c)
        return found

    def by_class(self, pair: str) -> float:
        """Smoothed mutual information of the classes of a pair, in bits."""
        x, y = self.kind(pair[0]), self.kind(pair[1])
        if x in "xz" or y in "xz":
            return 0.0
        return math.log2((self.class_pair[x + y] + 1) / (self.class_first[x] * self.class_second[y] / self.class_total + 1))

    def score(self, pair: str) -> float:
        """Smoothed mutual information of a pair in bits, the lower of both levels."""
        found = self.scores.get(pair)
        if found is None:
            a, b = pair
            if self.kind(a) in "xz" or self.kind(b) in "xz":
                found = 0.0
            else:
                by_char = math.log2((self.pair.get(pair, 0) + 1) / (self.first[a] * self.second[b] / self.total + 1))
                found = min(by_char, self.by_class(pair))
            if pair.isascii():  # no mapping changes these
                found = max(0.0, found)
            self.scores[pair] = found
        return found

    def log(self, pair: str) -> float:
        """Log likelihood of the second character after the first, backed off to classes."""
        found = self.logs.get(pair)
        if found is None:
            a, b = pair
            x = self.kind(a)
            alone = (self.second[b] + 0.05) / (self.total + 500)
            by_class = (self.class_char[x + b] + 5 * alone) / (self.class_first[x] + 5)
            found = self.logs[pair] = math.log((self.pair.get(pair, 0) + 5 * by_class) / (self.first[a] + 5))
        return found

    def likelihood(self, text: str) -> float:
        return sum(self.log(text[i : i + 2]) for i in range(len(text) - 1))


def segments(weights: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments, as half-open ranges of indexes, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before start, sum at end
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(s, e) for s, e, _, _ in found]


class Repair:
    """What is garbled in a value: ``restored`` is null where a run is lost.

    ``sure`` is the value with the runs that need no check restored, ``sure_undone`` null if
    there are none; ``words`` is what must occur in the corpus for the others.
    """

    __slots__ = ("restored", "undone", "sure", "sure_undone", "words")

    def __init__(self, restored, undone, sure, sure_undone, words):
        self.restored, self.undone, self.sure, self.sure_undone, self.words = restored, undone, sure, sure_undone, words


LETTERS = re.compile(r"[^\W\d_]+")


class Restorer:
    """Finds and restores garbled runs; remembers the values it has seen."""

    def __init__(self, model: PairModel):
        self.model, self.memo = model, {}

    def __call__(self, text: str | None) -> Repair | None:
        """What is garbled in a value, or none."""
        if text is None or text.isascii():
            return None
        if text not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = self._repair(text)
        return self.memo[text]

    def _repair(self, text: str) -> Repair | None:
        lost = any(c == "\ufffd" for c in text)
        whole, sure = text, text
        undone: list[str] = []
        sure_undone: list[str] = []
        words: set[str] = set()
        for _ in range(3):  # a restored run may be garbled again, and show what hid behind it
            fixes = self._fixes(whole)
            if not fixes:
                break
            parts, at = [], 0
            for a, b, fixed, kind, certain in fixes:
                parts += [whole[at:a], fixed]
                at = b
                undone.append(kind)
                if certain:
                    sure_undone.append(kind)
            after = "".join(parts) + whole[at:]
            if all(f[4] for f in fixes) and sure == whole:
                sure = after
            else:
                words |= self._changed(whole, fixes)
                if sure == whole:  # the certain runs alone
                    parts, at = [], 0
                    for a, b, fixed, _, certain in fixes:
                        if certain:
                            parts += [whole[at:a], fixed]
                            at = b
                    sure = "".join(parts) + whole[at:]
            whole = after
        broken = lambda t: lost or any(0x80 <= ord(c) < 0xA0 for c in t)
        name = lambda kinds, t: ", ".join(dict.fromkeys(kinds + ["lost"] * broken(t))) or None
        if not undone and not broken(text):
            return None
        outcome = lambda kinds, t: (None if broken(t) else t, name(kinds, t))
        return Repair(*outcome(undone, whole), *outcome(sure_undone, sure), frozenset(words))

    @staticmethod
    def _changed(text: str, fixes) -> set[str]:
        """The words that uncertain fixes would make, in small letters."""
        parts, at, spans, size = [], 0, [], 0
        for a, b, fixed, _, certain in fixes:
            parts += [text[at:a], fixed]
            size += a - at
            if not certain:
                spans.append((size, size + len(fixed)))
            size += len(fixed)
            at = b
        whole = "".join(parts) + text[at:]
        return {m.group().lower() for m in LETTERS.finditer(whole) for a, b in spans if m.start() < b and a < m.end()}

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Half-open ranges of the improbable runs of a value."""
        marked = view(text)
        weights = [-self.model.score(marked[i : i + 2]) - THETA for i in range(len(marked) - 1)]
        out: list[tuple[int, int]] = []
        for start, end in segments(weights):
            if sum(weights[start:end]) < LEAST:
                continue
            # pairs start..end-1 cover marked[start:end + 1], so text[start - 1:end]
            a, b = max(0, start - 1), min(len(text), end)
            while a > 0 and not text[a - 1].isascii():
                a -= 1
            while b < len(text) and not text[b].isascii():
                b += 1
            if text[a:b].isascii():
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _fixes(self, text: str) -> list[tuple[int, int, str, str, bool]]:
        """(start, end, restored, mapping, certain) of every run that a mapping restores."""
        out, at = [], 0
        for a, b in self.runs(text):
            if a < at:
                continue
            fixed, kind, end = self._invert(text, a, b)
            if fixed is not None:
                after = text[max(0, a - 1) : a] + fixed + text[end : end + 1]
                certain = kind in USUAL and self._structural(text, a, b) and not self._structural(after, 0, len(after))
                out.append((a, end, fixed, kind, kind == "utf-8" or certain))
                at = end
        return out

    def _structural(self, text: str, a: int, b: int) -> bool:
        """Whether a run has a pair whose classes do not stand together.

        A symbol after a word may be one, as in "N°"; one before a letter is not.
        """
        marked = view(text)[a : b + 2]
        pairs = (marked[i : i + 2] for i in range(len(marked) - 1))
        return any(not p.isascii() and self.model.kind(p[1]) not in "sp" and self.model.by_class(p) <= -STRUCTURE for p in pairs)

    def _spelt(self, text: str) -> bool:
        return all(c.isascii() or self.model.kind(c) not in "sz" for c in text)

    def _invert(self, text: str, a: int, b: int):
        run = text[a:b]
        for found in (as_utf8(run), utf8_inside(run)):
            if found is not None and all(c.isascii() or self.model.kind(c) != "s" for c in found):
                return found, "utf-8", b
        before = text[a - 1] if a else EDGE
        best, least = None, 0.0 if self._structural(text, a, b) else MARGIN
        for rank, (source, target) in enumerate(NARROW):
            try:
                other = to_bytes(run, source).decode(target)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            best = self._better(best, text, before, run, other, b, f"{target} as {source}", least + RARE * (rank > 1))
        wide_end = min(len(text), b + 1)
        other = ansel(text[a:wide_end])
        if other is not None:
            best = self._better(best, text, before, text[a:wide_end], other, wide_end, "ansel as latin-1", least)
        if best is None:
            return None, None, b
        return best[1], best[2], best[3]

    def _better(self, best, text, before, run, other, end, kind, least):
        after = text[end] if end < len(text) else EDGE
        if other == run or not self._spelt(other):
            return best
        gain = self.model.likelihood(view(before + other + after)[1:-1]) - self.model.likelihood(view(before + run + after)[1:-1])
        if gain > least and (best is None or gain - least > best[0]):
            return gain - least, other, kind, end
        return best


def fit(values: DataFrame, column: str = "value") -> PairModel:
    """The pair model of all distinct values of a column."""
    return PairModel([(r.a, r.b, r.n) for r in pair_counts(values, column).collect()])


def odd(column: str = "value"):
    """Whether a text has characters outside ASCII; others are never garbled."""
    return F.col(column).rlike(r"[^\x00-\x7F]")


REPAIR_SCHEMA = "value string, restored string, undone string, sure string, sure_undone string, words array<string>"


def repairs(values: DataFrame, model: PairModel | None = None) -> DataFrame:
    """``value, restored, undone`` for each distinct garbled value of ``values(value)``.

    The exact check of uncertain runs joins their restored words, which are few, with the
    distinct words of the corpus; neither side is collected.
    """
    shared = values.sparkSession.sparkContext.broadcast(model or fit(values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(shared.value)
        for batch in batches:
            found = [(v, r.restored, r.undone, r.sure, r.sure_undone, sorted(r.words)) for v in batch["value"] if (r := restore(v))]
            yield pd.DataFrame(found, columns=["value", "restored", "undone", "sure", "sure_undone", "words"])

    distinct = values.where(odd()).select("value").distinct()
    found = cut_lineage(spread(distinct).mapInPandas(run, REPAIR_SCHEMA))
    asked = found.select("value", F.explode("words").alias("word"))
    known = distinct.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"([\p{L}\p{M}]+)"), 1))).alias("word"))
    known = known.where(odd("word")).join(asked.select("word").distinct(), "word", "left_semi").distinct()
    missing = asked.join(known, "word", "left_anti").select("value").distinct().withColumn("unknown", F.lit(True))
    judged = found.join(missing, "value", "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))
    pick = lambda sure, whole: F.when(F.col("unknown"), F.col(sure)).otherwise(F.col(whole))
    kept = judged.where("not unknown or sure_undone is not null")
    return kept.select("value", pick("sure", "restored").alias("restored"), pick("sure_undone", "undone").alias("undone"))


def garbled_values(elements: DataFrame) -> DataFrame:
    """The garbled values of ``elements(field_name, row_id, elem, value)``.

    Result: those rows with ``restored`` (null where a run cannot be restored) and
    ``undone``, the mappings.  All fields share one model.  Null, empty and ASCII values are
    never garbled; repeated rows are each reported; texts of any length are read whole.
    Distinct values are judged once; rows of a hot value are salted.
    """
    narrow = elements.select("field_name", F.col("row_id").cast("bigint"), F.col("elem").cast("int"), "value")
    found = cut_lineage(repairs(elements.select("value")))
    return salted_join(narrow.where(odd()), found, ["value"]).select("field_name", "row_id", "elem", "value", "restored", "undone")
