"""Text that looks the same in different characters, brought to one consistent form.

1. Compatibility normalisation and deletion of ignorable characters.
2. Each letter of a word opens its readings: itself and every letter that looks like it, in
   any script.  The word is a lattice of readings; a path stays in one script.
3. Viterbi search for the likeliest path: the script by what the value's other letters show,
   or the corpus where they show nothing; each reading by the script's character trigrams,
   backed off to bigrams and single letters; a letter of another script costs ``CHANGE``.  The form is
   read off the back-trace.

The trigram counts come from all distinct values whose words are of one script.  Letters
count without case and marks, at most ``SIGNS`` a script, so the model is bounded.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import mojibake
from folioforge.operators.skew import salted_join
from folioforge.session import cut_lineage, spread

MEMO = mojibake.MEMO
#: Nats that a letter read as another costs, and weight of the script that a value shows.
CHANGE, SHOWN = 1.0, 3.0
#: Scripts whose words are counted, and signs of each; all other letters of one share a sign.
COUNTED = ("LATIN", "GREEK", "CYRILLIC")
SIGNS = 64

# Letters of other scripts and the Latin letters they look like.
CYRILLIC_UPPER = {"А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I"}
CYRILLIC_LOWER = {"а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "ԁ": "d", "һ": "h", "ӏ": "l", "ү": "y", "ѵ": "v", "к": "k", "г": "r", "п": "n"}
GREEK_UPPER = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
GREEK_LOWER = {"α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "χ": "x", "σ": "o", "ω": "w", "η": "n", "τ": "t", "ϲ": "c", "ϳ": "j"}
# Letters of other blocks and scripts that pass for plain Latin ones.
OTHER = {
    "ɑ": "a", "ɩ": "i", "ӧ": "ö", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Ս": "U", "Օ": "O",
    "ꓐ": "B", "ꓓ": "D", "ꓚ": "C", "ꓔ": "T", "ꓑ": "P", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓮ": "A", "ꓰ": "E", "ꓳ": "O",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲭ": "X",
}
# Further readings of letters that look like several.
ALSO = {"υ": "v", "ν": "u", "ӏ": "i", "ı": "l", "Ӏ": "l", "І": "l", "Ι": "l", "ɩ": "l", "г": "s", "ω": "o"}

LETTERS = re.compile(r"[^\W\d_]+")
# Latin letters whose Unicode name says which plain letter they draw in another style.
STYLED = re.compile(r"LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER (?:DOTLESS|SCRIPT|OPEN|LONG)) ([A-Z])$")


@lru_cache(maxsize=None)
def script_of(c: str) -> str:
    """The script named first in the character's Unicode name."""
    return unicodedata.name(c, "").partition(" ")[0]


def _table() -> dict[str, set[tuple[str, str]]]:
    """For each letter its other readings as (script, letter)."""
    found: dict[str, set[tuple[str, str]]] = defaultdict(set)
    pairs = [*(CYRILLIC_UPPER | CYRILLIC_LOWER).items(), *(GREEK_UPPER | GREEK_LOWER).items(), *OTHER.items(), *ALSO.items()]
    for code in (*range(0x131, 0x300), *range(0x1D00, 0x1D80), *range(0xA730, 0xA800)):
        if m := STYLED.match(unicodedata.name(chr(code), "")):
            pairs.append((chr(code), m[1].lower()))
    for other, latin in pairs:
        found[other].add(("LATIN", latin))
        if script_of(other) in ("GREEK", "CYRILLIC"):
            found[latin].add((script_of(other), other))
    return found


ALIKE = _table()


def compatible(text: str) -> str:
    """Compatibility form, composed, without ignorable characters."""
    if text.isascii():
        return text
    folded = unicodedata.normalize("NFKC", text)
    kept = "".join(c for c in folded if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F and c != "͏")
    return unicodedata.normalize("NFC", kept)


@lru_cache(maxsize=50_000)
def readings(c: str) -> tuple[tuple[str, str], ...]:
    """The letters that one letter may stand for, with their scripts; itself first."""
    own = (script_of(c), c)
    out = set(ALIKE.get(c, ()))
    parts = unicodedata.normalize("NFD", c)
    if len(parts) > 1:
        for script, other in ALIKE.get(parts[0], ()):
            whole = unicodedata.normalize("NFC", other + parts[1:])
            if len(whole) == 1:
                out.add((script, whole))
    return (own, *sorted(out - {own}))


@lru_cache(maxsize=50_000)
def sign(c: str) -> str:
    """A letter as it is counted: small, without marks, ``*`` beyond the common ones of its script."""
    small = unicodedata.normalize("NFD", c.lower())[0]
    if small.isascii() or small in "øæœßþðđłıħŋ":
        return small
    code = ord(small)
    return small if 0x3B1 <= code < 0x3CA or 0x430 <= code < 0x460 else "*"


def count_trigrams(text: str) -> Counter:
    """(script, first, second, third) of the words of one counted script in a value; edges are blanks."""
    return word_trigrams(Counter(words(text)))


def words(text: str) -> list[str]:
    return LETTERS.findall(compatible(text))


def word_trigrams(counts: Counter) -> Counter:
    """The same of words by their number; each distinct word is read once."""
    total: Counter = Counter()
    for word, n in counts.items():
        scripts = {script_of(c) for c in word}
        if len(scripts) == 1 and (script := scripts.pop()) in COUNTED:
            signs = "  " + "".join(map(sign, word)) + " "
            for a, b, c in zip(signs, signs[1:], signs[2:]):
                total[script, a, b, c] += n
    return total


def trigram_counts(values: DataFrame, column: str = "value") -> DataFrame:
    """``script, a, b, c, n`` over all distinct non-null values of a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        counts: Counter = Counter()
        for batch in batches:
            for text in batch[column]:
                counts.update(words(text))
            if len(counts) >= MEMO:
                total.update(word_trigrams(counts))
                counts.clear()
        total.update(word_trigrams(counts))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["script", "a", "b", "c", "n"])

    distinct = values.where(F.col(column).isNotNull()).select(column).distinct()
    counted = distinct.mapInPandas(run, "script string, a string, b string, c string, n bigint")
    return counted.groupBy("script", "a", "b", "c").agg(F.sum("n").alias("n"))


class ScriptModel:
    """Log likelihood of a letter after two others within a script."""

    def __init__(self, counts: list[tuple[str, str, str, str, int]]):
        self.three: Counter = Counter()
        self.two: Counter = Counter()
        self.pair: Counter = Counter()
        self.first: Counter = Counter()
        self.one: Counter = Counter()
        self.total: Counter = Counter()
        for script, a, b, c, n in counts:
            self.three[script, a, b, c] += n
            self.two[script, a, b] += n
            self.pair[script, b, c] += n
            self.first[script, b] += n
            self.one[script, c] += n
            self.total[script] += n
        self.all = max(1, sum(self.total.values()))
        self.logs: dict[tuple[str, str, str, str], float] = {}

    def log(self, script: str, a: str, b: str, c: str) -> float:
        key = (script, a, b, c)
        found = self.logs.get(key)
        if found is None:
            one = (self.one[script, c] + 0.5) / (self.total[script] + 0.5 * SIGNS)
            two = (self.pair[script, b, c] + 4 * one) / (self.first[script, b] + 4)
            found = self.logs[key] = math.log((self.three[key] + 4 * two) / (self.two[script, a, b] + 4))
        return found

    def script(self, script: str) -> float:
        return math.log((self.total[script] + 1) / (self.all + 10))


class Unifier:
    """Brings values to one form; remembers those it has seen."""

    def __init__(self, model: ScriptModel):
        self.model, self.memo = model, {}

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        found = self.memo.get(text)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[text] = self._unify(text)
        return found

    def _unify(self, text: str) -> str:
        folded = compatible(text)
        if folded.isascii():
            return folded
        shown = Counter(script_of(c) for c in folded if c.isalpha() and len(readings(c)) == 1)
        return LETTERS.sub(lambda m: self.word(m.group(), shown), folded)

    def prior(self, script: str, shown: Counter) -> float:
        """Log probability of a word's script: smoothed share of the letters that can be no other."""
        if not shown:
            return self.model.script(script)
        return SHOWN * math.log((shown[script] + 0.1) / (sum(shown.values()) + 0.1 * len(COUNTED)))

    def word(self, word: str, shown: Counter) -> str:
        """The likeliest reading of a word, by Viterbi over its lattice; a path has one script."""
        lattice = [readings(c) for c in word]
        scripts = {s for s, _ in lattice[0]}.intersection(*({s for s, _ in r} for r in lattice[1:]))
        if not scripts:
            return word
        # state: script and the last two signs; value: score, state before, letter
        columns: list[dict[tuple[str, str, str], tuple[float, tuple | None, str]]]
        columns = [{(s, " ", " "): (self.prior(s, shown), None, "") for s in sorted(scripts)}]
        for c, options in zip(word, lattice):
            own = script_of(c)  # a letter of the same script costs nothing: the trigrams alone decide
            column: dict[tuple[str, str, str], tuple[float, tuple | None, str]] = {}
            for state, (score, _, _) in columns[-1].items():
                script, a, b = state
                for other, letter in options:
                    if other != script:
                        continue
                    read = sign(letter)
                    total = score + self.model.log(script, a, b, read) - CHANGE * (script != own)
                    key = (script, b, read)
                    if key not in column or total > column[key][0]:
                        column[key] = (total, state, letter)
            columns.append(column)
        last = max(columns[-1], key=lambda k: (columns[-1][k][0] + self.model.log(*k, " "), k))
        letters, state = [], last
        for column in reversed(columns[1:]):
            _, before, letter = column[state]
            letters.append(letter)
            state = before
        return "".join(reversed(letters))


def fit(values: DataFrame, column: str = "value") -> ScriptModel:
    """The trigram model of all distinct values of a column."""
    return ScriptModel([(r.script, r.a, r.b, r.c, r.n) for r in trigram_counts(values, column).collect()])


def changed_forms(values: DataFrame) -> DataFrame:
    """``value, form`` for each distinct value of ``values(value)`` whose form differs."""
    shared = values.sparkSession.sparkContext.broadcast(fit(values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unify = Unifier(shared.value)
        for batch in batches:
            found = [(v, f) for v in batch["value"] if (f := unify(v)) != v]
            yield pd.DataFrame(found, columns=["value", "form"])

    distinct = values.where(mojibake.odd()).select("value").distinct()
    return spread(distinct).mapInPandas(run, "value string, form string")


def consistent_forms(elements: DataFrame, changed_only: bool = False) -> DataFrame:
    """The consistent form of each value of ``elements(field_name, row_id, value)``.

    Result: those columns, ``form`` and ``is_garbled``; a garbled value (see
    :mod:`mojibake`) keeps its characters.  Null stays null, empty and ASCII values stay as
    they are, repeated rows are each returned, texts are read whole.  ``changed_only`` keeps
    the values whose form differs.  Distinct values are judged once; rows of a hot value
    are salted, ASCII rows stay where they are.
    """
    rows = elements.select("field_name", F.col("row_id").cast("bigint"), "value")
    values = elements.select("value")
    forms, damaged = changed_forms(values), mojibake.repairs(values).select("value")
    if changed_only:
        forms = cut_lineage(forms.join(damaged, "value", "left_anti"))
        return salted_join(rows.where(mojibake.odd()), forms, ["value"]).select("field_name", "row_id", "value", "form", F.lit(False).alias("is_garbled"))
    marked = cut_lineage(forms.join(damaged.withColumn("is_garbled", F.lit(True)), "value", "full_outer"))
    found = salted_join(rows.where(mojibake.odd()), marked, ["value"], "left")
    garbled = F.coalesce("is_garbled", F.lit(False))
    found = found.select("field_name", "row_id", "value", F.when(garbled, F.col("value")).otherwise(F.coalesce("form", "value")).alias("form"), garbled.alias("is_garbled"))
    same = rows.where(~F.coalesce(mojibake.odd(), F.lit(False))).select("*", F.col("value").alias("form"), F.lit(False).alias("is_garbled"))
    return found.unionByName(same)
