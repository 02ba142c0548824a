"""Evaluation passages inside a corpus.

1. Items become folded words, and words numbers; every run of ``SEED`` numbers is a pattern
   of one Aho-Corasick automaton, which a Python worker builds once for all its tasks.
2. Each text is scanned once, its words folded and numbered the same way; where a seed is
   found the offset of every word in the original is taken.
3. Seeds of one item on neighbouring diagonals that cover at least ``COVERED`` of its words
   are aligned word by word with the text around them.  Any passage of ``WORDS`` words with
   at most one edit in ``PER_EDIT`` covers as many, so nothing is lost.
4. A passage is a stretch of the alignment that begins and ends on equal or changed words,
   spans at least ``WORDS`` words of the item and has at most one edit for ``PER_EDIT``.

Case, accents, punctuation and spacing do not matter.  Null and empty texts hold nothing; an
item shorter than ``WORDS`` words cannot be found; repeated rows are each reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 5
WORDS = 24
PER_EDIT = 8
#: Fewest words in seeds of a passage: three edits cut 24 words into runs of which three may be under ``SEED`` words.
COVERED = 9
#: Words of items in one automaton (about 300 MB); more are scanned in several passes.
MOST_WORDS = 500_000
#: Words of text on either side of the seeds that are aligned.
AROUND = 12
IGNORED = "­​-‍⁠﻿"
# possessive, so that no word is read twice
WORD = re.compile(f"[^\\W_]++(?:[̀-ͯ{IGNORED}]++[^\\W_]*+)*+")
DROPPED = re.compile(f"[{IGNORED}]")


def fold_word(word: str, known: dict[str, str]) -> str:
    """A word without case, accents and ignorable characters; ``known`` remembers."""
    found = known.get(word)
    if found is None:
        if len(known) > 500_000:
            known.clear()
        found = word.casefold()
        if not found.isascii():
            found = unicodedata.normalize("NFKD", DROPPED.sub("", found))
            found = "".join(c for c in found if not unicodedata.combining(c))
        known[word] = found
    return found


def words_of(text: str, known: dict[str, str]) -> tuple[list[str], list[tuple[int, int]]]:
    """Folded words and their offsets in the original."""
    found = [(fold_word(m.group(), known), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def folded(text: str, known: dict[str, str]) -> list[str]:
    """Folded words without their offsets."""
    get = known.get
    return [get(w) or fold_word(w, known) for w in WORD.findall(text)]


class Scanner:
    """Finds the items of one automaton in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.known: dict[str, str] = {}
        self.items = {i: folded(t, self.known) for i, t in items}
        self.number: dict[str, int] = {}
        for words in self.items.values():
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.items.items():
            numbers = [self.number[w] for w in words]
            for at in range(len(numbers) - SEED + 1):
                seeds[tuple(numbers[at : at + SEED])].append((i, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, places in seeds.items():
            self.automaton.add_word(pattern, places)
        if seeds:
            self.automaton.make_automaton()
        self.empty = not seeds

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int, int]]:
        """(item, start, end, item_from, item_to, edits) of each item found; offsets are the original's."""
        if not text or self.empty:
            return []
        words = folded(text, self.known)
        if len(words) < SEED:
            return []
        number = self.number.get
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, places in self.automaton.iter(tuple([number(w, 0) for w in words])):
            for item, place in places:
                seeds[item].append((end - SEED + 1, place))
        if not seeds:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        out = []
        for item, found in seeds.items():
            best = None
            for group in self._groups(found):
                passage = self._align(words, self.items[item], group)
                if passage and (best is None or passage[3] - passage[2] > best[3] - best[2]):
                    best = passage
            if best:
                a, b, p, q, edits = best
                out.append((item, spans[a][0], spans[b - 1][1], p, q, edits))
        return out

    def _groups(self, seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Seeds close in the text and on near diagonals, if they cover enough words."""
        groups: list[list[tuple[int, int]]] = []
        for at, place in sorted(seeds):
            for g in reversed(groups):
                if at - g[-1][0] <= 2 * WORDS and abs((at - place) - (g[-1][0] - g[-1][1])) <= WORDS // 2:
                    g.append((at, place))
                    break
            else:
                groups.append([(at, place)])
        return [g for g in groups if len({p + k for _, p in g for k in range(SEED)}) >= COVERED]

    def _align(self, words: list[str], item: list[str], group: list[tuple[int, int]]):
        """The longest passage of the alignment around a group: text from, to, item from, to, edits."""
        first = min(p for _, p in group)
        last = max(p for _, p in group) + SEED
        # item words that the seeds and as many edits on either side can reach
        low, high = max(0, first - 3 * AROUND), min(len(item), last + 3 * AROUND)
        a = max(0, min(t for t, _ in group) - (first - low) - AROUND)
        b = min(len(words), max(t for t, _ in group) + SEED + (high - last) + AROUND)
        ops = alignment(item[low:high], words[a:b])
        return longest_passage(ops, a, low)


def alignment(item: list[str], text: list[str]) -> list[tuple[int, int, bool]]:
    """Edit alignment of an item with part of a text: (text words, item words, equal) of each step."""
    n, m = len(item), len(text)
    rows = [[0] * (m + 1)]  # the text around the item is free
    for i in range(1, n + 1):
        above, row, word = rows[-1], [i], item[i - 1]
        left = i
        for j in range(1, m + 1):
            best = above[j - 1] + (word != text[j - 1])
            if above[j] + 1 < best:
                best = above[j] + 1
            if left + 1 < best:
                best = left + 1
            row.append(best)
            left = best
        rows.append(row)
    i, j = n, min(range(m + 1), key=lambda x: (rows[n][x], x))
    steps: list[tuple[int, int, bool]] = []
    while i > 0:
        here = rows[i][j]
        equal = j > 0 and item[i - 1] == text[j - 1]
        if j > 0 and here == rows[i - 1][j - 1] + (not equal):
            i, j = i - 1, j - 1
            steps.append((1, 1, equal))
        elif here == rows[i - 1][j] + 1:
            i -= 1
            steps.append((0, 1, False))
        else:
            j -= 1
            steps.append((1, 0, False))
    steps.append((j, 0, False))  # the text before
    return steps[::-1]


def longest_passage(steps: list[tuple[int, int, bool]], text_at: int, item_at: int):
    """The stretch with most item words that is long and clean enough, or none."""
    at = [(text_at + steps[0][0], item_at, 0)]
    for t, p, equal in steps[1:]:
        x, y, e = at[-1]
        at.append((x + t, y + p, e + (not equal)))
    equal = [s[2] for s in steps[1:]]
    # only where no stretch between equal words is long enough may it end on changed ones
    return _stretch(at, equal) or _stretch(at, [t == p == 1 for t, p, _ in steps[1:]])


def _stretch(at: list[tuple[int, int, int]], ends: list[bool]):
    """The longest clean stretch whose first and last steps are among ``ends``."""
    best = None
    for i in range(len(ends)):
        if not ends[i]:
            continue
        for j in range(len(ends), i, -1):
            if not ends[j - 1]:
                continue
            length, edits = at[j][1] - at[i][1], at[j][2] - at[i][2]
            if length < WORDS or best and length <= best[3] - best[2]:
                break
            if edits * PER_EDIT <= length:
                best = (at[i][0], at[j][0], at[i][1], at[j][1], edits)
                break
    return best


_SCANNERS: dict[str, Scanner] = {}


def scanner(mark: str, shared) -> Scanner:
    """The scanner of a broadcast list of items, kept for later tasks of the worker; only the last one is."""
    if mark not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[mark] = Scanner(shared.value)
    return _SCANNERS[mark]


FOUND_SCHEMA = "doc_id bigint, item_id bigint, start int, end int, item_from int, item_to int, edits int"


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The items that leaked into each document: one row a document and item.

    ``documents(doc_id, text)``, ``items(item_id, text)``.  Result: ``doc_id, item_id``, the
    longest passage as ``start, end`` in the original text and ``item_from, item_to`` in
    words of the item, and its ``edits``.  Narrow: texts are scanned where they are, once
    for each ``MOST_WORDS`` words of items.
    """
    given = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = given.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    passes = max(1, math.ceil(size / MOST_WORDS))
    found = None
    for k in range(passes):
        block = given.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        shared = documents.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block])

        def run(batches: Iterator[pd.DataFrame], shared=shared, mark=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            find = scanner(mark, shared).find
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"]) for hit in find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "item_from", "item_to", "edits"])

        here = documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, FOUND_SCHEMA)
        found = here if found is None else found.unionByName(here)
    return found
