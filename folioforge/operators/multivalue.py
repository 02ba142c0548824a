"""Several values packed in one field, one row per value with its position.

A parsing expression grammar, ordered choice first match wins::

    Packed     <- Trail* ( Enumerated / Sequence ) Trail* End
    Enumerated <- Mark Item ( Mark Item )+              Mark <- "(" digit+ ")"
    Sequence   <- Item ( Delim Item )*
    Item       <- Quoted / Bracketed / Bare
    Quoted     <- '"' ( '""' / !'"' . )* '"' &( Delim / Trail / End )
    Bracketed  <- "[" Sequence "]" &( Delim / Trail / End )
    Bare       <- ( Group / !Delim . )+                 Group <- "(" ... ")" / "{" ... "}"
    Delim      <- ";" / "|" / "--" / tab / newline / " / " / SeriesComma / Conjunction

``Quoted`` and ``Bracketed`` fail on a missing or misplaced closing mark; the parser then
backtracks, takes ``Bare`` with the mark as an ordinary character and sets an error flag.
A comma separates only between quoted items or in a series ``A, B, and C``.  A conjunction
(``and``, ``&``) separates only where the caller says fields hold places, and never inside
a name of the lexicon of compound names, misspelt or not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.skew import salted_join
from folioforge.session import cut_lineage

#: Names of a lexicon that are collected and broadcast at once; a larger one is read in blocks of so many.
MOST_NAMES = 5_000
MARK = re.compile(r"\(\d{1,3}\)\s*")
HARD = re.compile(r"\s*(?:;|\||--+|\t|\n|\s/(?=\s))\s*")
CONJUNCTION = re.compile(r"\s*&\s*|,?\s+and\s+", re.IGNORECASE)
COMMA = re.compile(r"\s*,\s*")
SERIES_END = re.compile(r",\s+(?:and|&)\s+", re.IGNORECASE)
TRAIL = " \t\r\n:;,.?"
SPLITTABLE = re.compile(r";|\||--|\t|\n| / |\(\d|&|,|\band\b|\"", re.IGNORECASE)
#: What can begin a second item where conjunctions do not separate.
NO_CONJUNCTION = re.compile(r";|\||--|\t|\n|\s/\s|\(\d|\"|\[")
#: A worker forgets its results beyond so many distinct strings.
MEMO = 200_000


def plain(text: str) -> tuple[str, list[int] | None]:
    """Compatibility form without ignorable characters, so that delimiters are recognised.

    Also the offset in the text of each character, none where they are the same.
    """
    if text.isascii():
        return text, None
    out: list[str] = []
    offsets: list[int] = []
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
            offsets.append(i)
        elif unicodedata.category(c) != "Cf":
            for x in unicodedata.normalize("NFKC", c):
                out.append(x)
                offsets.append(i)
    return "".join(out), offsets


def key(text: str) -> str:
    """Lower-case letters and single spaces, accents dropped."""
    folded = unicodedata.normalize("NFKD", text)
    letters = "".join(c if c.isalpha() else " " for c in folded if not unicodedata.combining(c))
    return " ".join(letters.lower().split())


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions, changes or swaps turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space at its ends."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def ascii_letters(text: str) -> str:
    """Lower-case ASCII letters alone: what wrong encodings leave of a name."""
    return re.sub("[^a-z]", "", text.lower())


def fewest_edits(name: str, candidates: list[str], most: int) -> int | None:
    """Fewest edits from any candidate to a name, or none within ``most``."""
    for edits in range(most + 1):
        if any(within_edits(c, name, edits) for c in candidates):
            return edits
    return None


@dataclass
class Parse:
    """The values of one string, as typed, and what went wrong."""

    values: list[str]
    errors: list[str] = field(default_factory=list)


class Grammar:
    """The parser of one kind of field.

    ``conjunctions``: whether ``and`` and ``&`` can separate values.  ``compounds``: names
    that hold a conjunction themselves; ``regions``: names that follow a place's.  What a
    larger lexicon says of a text is handed to :meth:`parse`.
    """

    def __init__(self, conjunctions: bool, compounds: list[str] = (), regions: list[str] = ()):
        self.conjunctions = conjunctions
        self.regions = {key(r) for r in regions} | {key(r.split("(")[0]) for r in regions}
        self.compounds, self.bare_compounds = [], []
        for name in compounds:
            sides = re.split(r"\s+and\s+|\s*&\s*", name, flags=re.IGNORECASE)
            for fold, pairs in ((key, self.compounds), (ascii_letters, self.bare_compounds)):
                pair = tuple(fold(x).replace(" ", "") for x in sides)
                if len(pair) == 2 and min(map(len, pair)) > 3 and pair not in pairs:
                    pairs.append(pair)

    def parse(self, text: str | None, guards=None, known=None) -> Parse:
        """Values in order, as typed; none for null or blank text.

        ``guards`` and ``known`` add to what the grammar's own names say: see :meth:`guards` and :meth:`known`.
        """
        if text is None:
            return Parse([])
        body, offsets = plain(text)
        self.guarded = self.guards(body) | set(() if guards is None else guards)
        self.local = self.regions | set(() if known is None else known)
        self.base = 0
        errors: list[str] = []
        at, end = trimmed(body, 0, len(body))
        if not self.conjunctions and not NO_CONJUNCTION.search(body):
            spans = [(at, end)] if at < end else []
        else:
            spans = self._enumerated(body, at, end) or self._sequence(body[at:end], at, errors)
        values = []
        for a, b in spans:
            if body[a:b].strip(TRAIL + '[]"'):
                values.append(body[a:b] if offsets is None else text[offsets[a] : offsets[b - 1] + 1])
        return Parse(values, errors)

    def guards(self, body: str) -> set[int]:
        """Offsets behind the conjunctions of a plain text that are inside a compound name."""
        if not self.conjunctions or not self.compounds:
            return set()
        return {m.end() for m in CONJUNCTION.finditer(body) if self._compound(body[: m.start()], body[m.end() :])}

    @staticmethod
    def parts(body: str) -> set[str]:
        """The parts of a series that could be regions, folded."""
        return {key(p) for p in body.split(",")} if SERIES_END.search(body) else set()

    def _enumerated(self, text: str, at: int, end: int) -> list[tuple[int, int]] | None:
        marks = list(MARK.finditer(text, at, end))
        if len(marks) < 2 or marks[0].start() > at:
            return None
        ends = [m.start() for m in marks[1:]] + [end]
        return [trimmed(text, m.end(), e) for m, e in zip(marks, ends)]

    def _sequence(self, text: str, base: int, errors: list[str]) -> list[tuple[int, int]]:
        """Spans of the items of a part of the text that begins at ``base``."""
        values: list[tuple[int, int]] = []
        at, n = 0, len(text)
        after_quote = False
        outer, self.base = self.base, base
        series = self._series(text)
        while at < n:
            delim = self._delim(text, at, 0, series, after_quote)
            if delim and values:
                at = delim
                continue
            item = self._quoted(text, at, series, errors)
            after_quote = item is not None
            if item is None:
                item = self._bracketed(text, at, series, errors)
            if item is None:
                item = self._bare(text, at, series)
            found, at = item
            values.extend(found)
        self.base = outer
        return [(a + base, b + base) for a, b in values]

    def _series(self, text: str) -> bool:
        """Whether the text is a series ``A, B, and C``."""
        if not self.conjunctions or not (m := SERIES_END.search(text)):
            return False
        return "," in text[: m.start()] and "(" not in text[: m.start()]

    def _closed(self, text: str, at: int, series: bool) -> bool:
        rest = text[at:]
        return not rest.strip(TRAIL) or self._delim(text, at, 0, series, True) is not None or rest.lstrip(TRAIL)[:1] == "]"

    def _quoted(self, text: str, at: int, series: bool, errors: list[str]):
        if text[at] != '"':
            return None
        end = at + 1
        while (end := text.find('"', end)) >= 0 and text[end : end + 2] == '""':
            end += 2
        if end < 0 or not self._closed(text, end + 1, series):
            errors.append("unclosed quote" if end < 0 else "text after quote")
            return None
        end += 1
        return [(at, end)], end

    def _bracketed(self, text: str, at: int, series: bool, errors: list[str]):
        if text[at] != "[":
            return None
        end = text.find("]", at)
        if end < 0 or not self._closed(text, end + 1, series):
            errors.append("unclosed bracket" if end < 0 else "text after bracket")
            return None
        base = self.base
        inside = self._sequence(text[at + 1 : end], base + at + 1, errors)
        inside = [(a - base, b - base) for a, b in inside]
        return [(a, b) for a, b in inside if text[a:b].strip(TRAIL)], end + 1

    def _bare(self, text: str, at: int, series: bool):
        start, n = at, len(text)
        at += 1
        depth = int(text[start] in "({")
        while at < n:
            c = text[at]
            if c in "({":
                depth += 1
            elif c in ")}":
                depth = max(0, depth - 1)
            elif not depth and self._delim(text, at, start, series, False):
                break
            at += 1
        return [trimmed(text, start, at)], at

    def _delim(self, text: str, at: int, start: int, series: bool, after_quote: bool) -> int | None:
        """The end of a delimiter at ``at``, or none."""
        if m := HARD.match(text, at):
            return m.end()
        if (after_quote and (m := COMMA.match(text, at)) and text[m.end() : m.end() + 1] == '"'):
            return m.end()
        if not self.conjunctions:
            return None
        if m := CONJUNCTION.match(text, at):
            left, right = text[start:at], text[m.end() :]
            return None if self.base + m.end() in self.guarded or not right.strip(TRAIL) or not left.strip(TRAIL) and start else m.end()
        if series and (m := COMMA.match(text, at)) and text[m.end() :].strip(TRAIL + '[]"'):
            following = text[m.end() :].split(",")[0].strip()
            # an abbreviation, or a region, belongs to the place before it
            return None if following.endswith(".") or key(following) in self.local else m.end()
        return None

    def _compound(self, left: str, right: str) -> bool:
        """Whether the texts around a conjunction end and begin a compound name, misspelt or damaged."""
        for fold, pairs in ((key, self.compounds), (ascii_letters, self.bare_compounds)):
            x, y = fold(left).replace(" ", ""), fold(right).replace(" ", "")
            for a, b in pairs:
                most = (len(a) + len(b)) // 4
                one = fewest_edits(a, [x[-len(a) - k :] for k in range(-2, 3) if len(a) + k > 0], len(a) // 3)
                if one is None or one > most:
                    continue
                two = fewest_edits(b, [y[: len(b) + k] for k in range(-2, 3)], len(b) // 3)
                if two is not None and one + two <= most:
                    return True
        return False


class Splitter:
    """A grammar with a memory of the strings it has parsed; one per Python worker task."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.memo = grammar, {}

    def __call__(self, text: str | None, guards=None, known=None) -> Parse:
        if text is None:
            return Parse([])
        found = self.memo.get(text)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if text.isascii() and not SPLITTABLE.search(text):
                found = Parse([text.strip()] if text.strip(TRAIL + '[]"') else [])
            else:
                found = self.grammar.parse(text, guards, known)
            self.memo[text] = found
        return found


@dataclass
class Lexicon:
    """Names that hold a conjunction and names of regions: lists to broadcast, or tables where they are too many."""

    listed: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    names_table: DataFrame | None = None
    regions_table: DataFrame | None = None


def _few(df: DataFrame, most: int) -> list[str] | None:
    rows = df.limit(most + 1).collect()
    return None if len(rows) > most else sorted(r[0] for r in rows)


def make_lexicon(names: list[DataFrame], regions: DataFrame | None = None, most: int = MOST_NAMES) -> Lexicon:
    """The lexicon of one-column tables; only names that hold a conjunction are compounds."""
    found = Lexicon()
    given = None
    for df in names:
        (column,) = df.columns
        here = df.where(F.col(column).rlike(r"(?i)\s(and|&)\s")).select(F.col(column).alias("name"))
        given = here if given is None else given.unionByName(here)
    if given is not None:
        given = given.distinct()
        listed = _few(given, most)
        found.listed, found.names_table = ([], cut_lineage(given)) if listed is None else (listed, None)
    if regions is not None:
        (column,) = regions.columns
        given = regions.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
        listed = _few(given, most)
        found.regions, found.regions_table = ([], cut_lineage(given)) if listed is None else (listed, None)
    return found


def with_hints(df: DataFrame, column: str, lexicon: Lexicon, most: int = MOST_NAMES) -> DataFrame:
    """Adds ``guards`` and ``known``: what a lexicon too large to broadcast says of each text, else nulls.

    Its names are read in blocks of about ``most``, each against the distinct texts that
    hold a conjunction; its regions are joined with the parts of series.
    """
    out = df
    values = df.where(F.col(column).rlike(r"(?i)&|\band\b")).select(F.col(column).alias(column)).distinct()
    if lexicon.names_table is None:
        out = out.withColumn("guards", F.lit(None).cast("array<int>"))
    else:
        blocks = -(-lexicon.names_table.count() // most)
        found = None
        for k in range(blocks):
            block = [r.name for r in lexicon.names_table.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]
            shared = df.sparkSession.sparkContext.broadcast(block)

            def guarded(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                grammar = Grammar(True, shared.value)
                for batch in batches:
                    rows = [(v, g) for v in batch[column] for g in grammar.guards(plain(v)[0])]
                    yield pd.DataFrame(rows, columns=[column, "guard"])

            here = values.mapInPandas(guarded, f"{column} string, guard int")
            found = here if found is None else found.unionByName(here)
        marks = found.groupBy(column).agg(F.collect_set("guard").alias("guards"))
        out = salted_join(out, marks, [column], "left")
    if lexicon.regions_table is None:
        return out.withColumn("known", F.lit(None).cast("array<string>"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(v, p) for v in batch[column] for p in Grammar.parts(plain(v)[0])], columns=[column, "region"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"region": sorted({k for n in batch["name"] for k in (key(n), key(n.split("(")[0]))})})

    parts = values.mapInPandas(cut, f"{column} string, region string")
    names = lexicon.regions_table.mapInPandas(folded, "region string").distinct()
    known = parts.join(names, "region", "left_semi").groupBy(column).agg(F.collect_set("region").alias("known"))
    return salted_join(out, known, [column], "left")


PACKED_SCHEMA = "field_name string, row_id bigint, elem int, pos int, n_values int, value string, error string"


def split_values(elements: DataFrame, lexicons: dict[str, Lexicon], packed_only: bool = False) -> DataFrame:
    """One row for each value of ``elements(field_name, row_id, elem, value)``.

    Result: ``field_name, row_id, elem, pos, n_values, value, error``; ``pos`` counts from 0
    and ``error`` names what the parser backtracked on, else null.  ``lexicons`` has the
    names of each field in which conjunctions separate; other fields split on delimiters
    only.  Null and blank texts have no rows; repeated rows are each split; texts of any
    length are parsed whole.  With ``packed_only`` strings of a single value are left out.
    Narrow while the lexicons can be broadcast: rows stay in their partitions, each worker
    parses a distinct string once.
    """
    lists = {name: (x.listed, x.regions) for name, x in lexicons.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitters: dict[str, Splitter] = {}
        for batch in batches:
            rows = []
            for name, row, elem, value, guards, known in zip(*(batch[c] for c in ("field_name", "row_id", "elem", "value", "guards", "known"))):
                if name not in splitters:
                    splitters[name] = Splitter(Grammar(name in lists, *lists.get(name, ([], []))))
                found = splitters[name](value, guards, known)
                n = len(found.values)
                if packed_only and n < 2:
                    continue
                error = "; ".join(found.errors) or None
                rows.extend((name, row, elem, pos, n, v, error) for pos, v in enumerate(found.values))
            yield pd.DataFrame(rows, columns=["field_name", "row_id", "elem", "pos", "n_values", "value", "error"])

    narrow = elements.select("field_name", F.col("row_id").cast("bigint"), F.col("elem").cast("int"), "value").where("value is not null")
    large = {n: x for n, x in lexicons.items() if x.names_table is not None or x.regions_table is not None}
    parts = [with_hints(narrow.where(F.col("field_name") == n), "value", x) for n, x in large.items()]
    parts.append(with_hints(narrow.where(~F.col("field_name").isin(list(large))) if large else narrow, "value", Lexicon()))
    columns = ["field_name", "row_id", "elem", "value", "guards", "known"]
    hinted = parts[0].select(*columns)
    for part in parts[1:]:
        hinted = hinted.unionByName(part.select(*columns))
    return hinted.mapInPandas(run, PACKED_SCHEMA)
