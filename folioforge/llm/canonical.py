"""Free-entered values mapped to the closest entry of a reference list.

1. Values are deduplicated; all work is on distinct values.
2. Normalised: look-alikes and garbled runs undone where possible, case, accents and
   punctuation dropped, abbreviations of the caller's table spelt out.
3. Every window of words of a value is a probe, since a place may carry a street, a region
   or a phrase; parts around a comma are probed in reverse order too.  Candidates come from
   an inverted index of padded character n-grams: all ordered pairs of letters at most
   ``REACH`` apart, so that a swap, a slip or a missing letter leaves most of them.
4. Score: cosine of n-gram weights, a gram weighing the root of its inverse frequency in the
   list.  The best entry at or above ``threshold`` is accepted if it leads the best other
   entry by ``margin``; else the value is unmatched.
5. An exact check may then refuse it: a fifth of the form's letters, one at least, may be
   inserted, dropped, changed or swapped, none in forms of three letters or fewer.
6. With ``cut_words`` a value is first read as a cut form: each word begins the form's word
   in its place.  It is accepted if one entry alone begins so.

Two ways to the same result.  The index of a list of at most ``MOST_FORMS`` forms is
broadcast, after counting them; a larger list is joined on its n-grams (:func:`by_join`).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.multivalue import within_edits

#: Forms of a reference list that may be broadcast as an index (about 40 MB).
MOST_FORMS = 100_000
MEMO = 200_000
#: Letters of a gram are at most so far apart.
REACH = 3
#: A probe has at most so many words more than the longest form of the list.
SPARE_WORDS = 3
#: Letters that the longest word of a cut form must have.
CUT_LEAST = 3
#: Places after the point to which scores are compared, so that both ways agree.
PLACES = 9
# Letters that Unicode does not decompose.
UNDECOMPOSED = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ł": "l", "ı": "i"})


#: What folds each ASCII character.
ASCII_FOLD = "".join(chr(c).lower() if chr(c).isalpha() else " " for c in range(128))


def fold(text: str) -> str:
    """Lower-case ASCII-like letters and single spaces."""
    if text.isascii():
        return " ".join(text.translate(ASCII_FOLD).split())
    folded = unicodedata.normalize("NFKD", text)
    letters = "".join(c if c.isalpha() else " " for c in folded if not unicodedata.combining(c))
    return " ".join(letters.lower().translate(UNDECOMPOSED).split())


def grams(text: str) -> Counter:
    """Ordered pairs of near letters of a padded text, whatever lies between them, blanks dropped."""
    padded = "\x02" + text.replace(" ", "") + "\x03"
    return Counter(padded[i] + padded[i + d] for d in range(1, REACH + 1) for i in range(len(padded) - d))


def weight(forms: int, holding: int) -> float:
    """Weight of a gram in a list of so many forms."""
    return math.sqrt(1 + math.log(forms / holding))


def folded_forms(forms: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Distinct (key, folded form) pairs that have letters, sorted."""
    pairs = {(k, fold(f)) for k, f in forms if k is not None and f is not None}
    return sorted(p for p in pairs if p[1])


class Index:
    """Inverted n-gram index of (key, form) pairs; several forms may lead to one key."""

    def __init__(self, forms: list[tuple[str, str]]):
        forms = folded_forms(forms)
        self.keys = sorted({k for k, _ in forms})
        number = {k: i for i, k in enumerate(self.keys)}
        self.of = [number[k] for k, _ in forms]
        self.forms = [f for _, f in forms]
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.cut: dict[str, list[int]] = defaultdict(list)
        for i, (k, f) in enumerate(forms):
            self.exact[f.replace(" ", "")].add(number[k])
            for start in {w[:n] for w in f.split() for n in range(CUT_LEAST, len(w) + 1)}:
                self.cut[start].append(i)
        counted = [grams(f) for f in self.forms]
        seen = Counter(g for c in counted for g in c)
        n = max(1, len(forms))
        self.weight = {g: weight(n, s) for g, s in seen.items()}
        self.rare = weight(n, 1)
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(counted):
            norm = math.sqrt(sum((t * self.weight[g]) ** 2 for g, t in c.items()))
            for g, t in c.items():
                lists[g].append((i, t * self.weight[g] / norm))
        self.lists = {g: (np.array([i for i, _ in l], dtype=np.int64), np.array([w for _, w in l])) for g, l in lists.items()}
        self.words = max([len(f.split()) for f in self.forms], default=1)
        self.shortest = min([len(f.replace(" ", "")) for f in self.forms], default=1)

    def near(self, probe: str, threshold: float) -> list[tuple[int, float]]:
        """Forms whose cosine with the probe reaches the threshold, with it."""
        at, parts, square = [], [], 0.0
        for g, t in grams(probe).items():
            w = t * self.weight.get(g, self.rare)
            square += w * w
            if (entry := self.lists.get(g)) is not None:
                at.append(entry[0])
                parts.append(w * entry[1])
        if not at:
            return []
        sums = np.bincount(np.concatenate(at), np.concatenate(parts))
        scores = np.round(sums / math.sqrt(square), PLACES)
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]


def windows(value: str, words: int, abbreviations: dict[str, str]) -> list[str]:
    """The probes of a value: windows of up to ``words`` and some words, all of it, and its parts reversed."""
    spell = lambda text: [abbreviations.get(w, w) for w in fold(text).split()]
    every = spell(value)
    if not every:
        return []
    spans = [every[i:j] for i in range(len(every)) for j in range(i + 1, min(len(every), i + words + SPARE_WORDS) + 1)]
    spans.append(every)
    parts = value.split(",")
    if len(parts) == 2 and all(map(fold, parts)):
        spans.append(spell(parts[1]) + spell(parts[0]))
    return list(dict.fromkeys(" ".join(s) for s in spans))


def begins(cut: list[str], form: list[str]) -> bool:
    """Whether each word of one begins the word of the other in its place, and some are cut."""
    return len(cut) == len(form) and cut != form and all(f.startswith(c) for c, f in zip(cut, form))


class Matcher:
    """Best entry of one value."""

    def __init__(self, index: Index, threshold: float, margin: float, abbreviations: dict[str, str], cut_words: bool):
        self.index, self.threshold, self.margin = index, threshold, margin
        self.abbreviations, self.cut_words = abbreviations, cut_words
        self.memo: dict[str, tuple[str | None, float]] = {}
        self.seen: dict[str, list[tuple[int, float]]] = {}

    def __call__(self, value: str) -> tuple[str | None, float]:
        """Key of the accepted entry or null, and its score."""
        found = self.memo.get(value)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[value] = self._match(value)
        return found

    def _match(self, value: str) -> tuple[str | None, float]:
        index = self.index
        probes = windows(value, index.words, self.abbreviations)
        exact = [(len(p.replace(" ", "")), k) for p in probes for k in index.exact.get(p.replace(" ", ""), ())]
        if exact:
            return longest([(n, index.keys[k]) for n, k in exact])
        if self.cut_words:
            words = fold(value).split()
            anchor = max(words, key=len, default="")
            keys = {index.keys[index.of[i]] for i in index.cut.get(anchor, ()) if begins(words, index.forms[i].split())}
            if len(keys) == 1:
                return keys.pop(), 1.0
        found = [(index.keys[index.of[i]], s, p, index.forms[i]) for p in probes if self._long(p) for i, s in self._near(p)]
        return decide(found, self.margin)

    def _long(self, probe: str) -> bool:
        return len(probe.replace(" ", "")) >= self.index.shortest - 2

    def _near(self, probe: str) -> list[tuple[int, float]]:
        found = self.seen.get(probe)
        if found is None:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            found = self.seen[probe] = self.index.near(probe, self.threshold)
        return found


def longest(exact: list[tuple[int, str]]) -> tuple[str | None, float]:
    """The key of the longest equal window, or none where two keys have one as long."""
    most = max(n for n, _ in exact)
    keys = {k for n, k in exact if n == most}
    return (keys.pop() if len(keys) == 1 else None), 1.0


def few_edits(probe: str, form: str) -> bool:
    """The exact check of an accepted pair."""
    a, b = probe.replace(" ", ""), form.replace(" ", "")
    most = 0 if len(b) <= 3 else max(1, round(len(b) / 5))
    # print and scans confuse "rn" and "m"
    return within_edits(a, b, most) or ("rn" in a or "rn" in b) and within_edits(a.replace("rn", "m"), b.replace("rn", "m"), most)


def decide(candidates: list[tuple[str, float, str, str]], margin: float) -> tuple[str | None, float]:
    """The accepted key of (key, score, probe, form) candidates or none, and the best score."""
    if not candidates:
        return None, 0.0
    best: dict[str, tuple[float, str, str]] = {}
    for key, score, probe, form in candidates:
        best[key] = max(best.get(key, (0.0, "", "")), (score, probe, form))
    ranked = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))
    key, (score, _, _) = ranked[0]
    clear = len(ranked) == 1 or score - ranked[1][1][0] >= margin
    sure = clear and any(few_edits(p, f) for k, s, p, f in candidates if k == key and s >= score - margin)
    return (key if sure else None), score


def collect_forms(forms: DataFrame) -> list[tuple[str, str]] | None:
    """The (ref_key, form) rows of a reference list, or none if it is too large to broadcast."""
    rows = forms.select("ref_key", "form").distinct().limit(MOST_FORMS + 1).collect()
    return None if len(rows) > MOST_FORMS else [(r.ref_key, r.form) for r in rows]


MAPPED = "value string, ref_key string, score double"


def map_values(
    distinct: DataFrame, forms: DataFrame, threshold: float, margin: float, abbreviations: dict[str, str] | None = None, cut_words: bool = False
) -> DataFrame:
    """``value, ref_key, score`` for each row of ``distinct(value)``.

    ``forms(ref_key, form)`` is the reference list with all forms of each entry.  ``ref_key``
    is null for unmatched values, among them null, blank and letterless ones.  An empty list
    matches nothing.
    """
    listed = collect_forms(forms)
    if listed is None:
        return by_join(distinct, forms, threshold, margin, abbreviations, cut_words)
    shared = distinct.sparkSession.sparkContext.broadcast(Index(listed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(shared.value, threshold, margin, abbreviations or {}, cut_words)
        for batch in batches:
            found = [match(v) if v is not None else (None, 0.0) for v in batch["value"]]
            yield pd.DataFrame({"value": batch["value"], "ref_key": [k for k, _ in found], "score": [s for _, s in found]})

    return distinct.select("value").mapInPandas(run, MAPPED)


def by_join(
    distinct: DataFrame, forms: DataFrame, threshold: float, margin: float, abbreviations: dict[str, str] | None = None, cut_words: bool = False
) -> DataFrame:
    """:func:`map_values` for reference lists of any size, by joins on n-grams and on cut words."""

    def fold_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(folded_forms(list(zip(batch["ref_key"], batch["form"]))), columns=["ref_key", "form"])

    forms = forms.select("ref_key", "form").mapInPandas(fold_all, "ref_key string, form string").distinct()
    letters = F.length(F.replace("form", F.lit(" ")))
    stats = forms.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("form", " "))).alias("words"), F.min(letters).alias("shortest")).first()
    number, words, shortest = max(1, stats.n), stats.words or 1, stats.shortest or 1

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, f, g, float(t)) for k, f in zip(batch["ref_key"], batch["form"]) for g, t in grams(f).items()]
            yield pd.DataFrame(rows, columns=["ref_key", "form", "gram", "t"])

    index = forms.mapInPandas(listed, "ref_key string, form string, gram string, t double")
    weights = index.groupBy("gram").agg(F.sqrt(1 + F.log(number / F.count(F.lit(1)))).alias("w"))
    index = index.join(weights, "gram")
    norms = index.groupBy("ref_key", "form").agg(F.sqrt(F.sum((F.col("t") * F.col("w")) ** 2)).alias("norm"))
    index = index.join(norms, ["ref_key", "form"]).select("ref_key", "form", "gram", (F.col("t") * F.col("w") / F.col("norm")).alias("u"))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, p) for v in batch["value"] if v is not None for p in windows(v, words, abbreviations or {})]
            yield pd.DataFrame(rows, columns=["value", "probe"])

    def spelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, g, float(t)) for p in batch["probe"] if len(p.replace(" ", "")) >= shortest - 2 for g, t in grams(p).items()]
            yield pd.DataFrame(rows, columns=["probe", "gram", "t"])

    values = distinct.select("value").distinct()
    asked = values.mapInPandas(probed, "value string, probe string")
    squeeze = lambda c: F.replace(c, F.lit(" "))
    equal = asked.withColumn("k", squeeze("probe")).join(forms.select("ref_key", squeeze("form").alias("k")), "k")
    equal = equal.select("value", "ref_key", F.lit(1.0).alias("score"), "probe", F.col("k").alias("form"), F.lit("equal").alias("kind"))
    # a window that many values have is compared once
    probes = asked.join(equal.select("value").distinct(), "value", "left_anti")
    rows = probes.select("probe").distinct().mapInPandas(spelt, "probe string, gram string, t double")
    rows = rows.join(weights, "gram", "left").withColumn("w", F.coalesce("w", F.lit(weight(number, 1))) * F.col("t"))
    squares = rows.groupBy("probe").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = rows.join(index, "gram").groupBy("probe", "ref_key", "form").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    near = dots.join(squares, "probe").withColumn("score", F.round(F.col("dot") / F.col("norm"), PLACES)).where(F.col("score") >= threshold)
    near = probes.join(near, "probe").select("value", "ref_key", "score", "probe", "form", F.lit("near").alias("kind"))
    found = equal.unionByName(near)
    if cut_words:
        starts = forms.withColumn("word", F.explode(F.array_distinct(F.split("form", " "))))
        starts = starts.where(F.length("word") >= CUT_LEAST).withColumn("start", F.explode(F.sequence(F.lit(CUT_LEAST), F.length("word"))))
        starts = starts.select("ref_key", "form", F.substring("word", F.lit(1), F.col("start")).alias("anchor")).distinct()

        def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(v, w, max(w.split(), key=len)) for v in batch["value"] if v is not None and (w := fold(v))]
                yield pd.DataFrame(rows, columns=["value", "probe", "anchor"])

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[[begins(p.split(), f.split()) for p, f in zip(batch["probe"], batch["form"])]]

        left = values.join(equal.select("value").distinct(), "value", "left_anti").mapInPandas(anchored, "value string, probe string, anchor string")
        pairs = left.join(starts, "anchor").select("value", "ref_key", F.lit(1.0).alias("score"), "probe", "form", F.lit("cut").alias("kind"))
        found = found.unionByName(pairs.mapInPandas(cut, pairs.schema))

    def decided(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        of = {k: list(zip(f["ref_key"], f["score"], f["probe"], f["form"])) for k, f in frame.groupby("kind")}
        cuts = {k for k, _, _, _ in of.get("cut", ())}
        if "equal" in of:
            chosen = longest([(len(f), k) for k, _, _, f in of["equal"]])
        elif len(cuts) == 1:
            chosen = cuts.pop(), 1.0
        else:
            chosen = decide(of.get("near", []), margin)
        return pd.DataFrame({"value": [key[0]], "ref_key": [chosen[0]], "score": [chosen[1]]})

    # A value has at most its windows times the forms near one of them: a bounded group.
    chosen = found.groupBy("value").applyInPandas(decided, MAPPED)
    return distinct.select("value").join(chosen, "value", "left").select("value", "ref_key", F.coalesce("score", F.lit(0.0)).alias("score"))


def name_forms(name: str | None) -> set[str]:
    """The forms of a region's name: whole, without a qualifier in brackets, the first of two joined names."""
    if name is None:
        return set()
    plain = re.sub(r"\s*\(.*?\)", "", name).strip()
    return {name, plain or name, re.split(r"\s+and\s+|\s*&\s*", plain)[0] or name}
