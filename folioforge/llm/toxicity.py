"""Abusive, hateful or sexual passages: scores for every document and rates per source.

1. Texts become folded tokens; disguised words (digits for letters, stars, letters spaced
   out) are undone or stand as a mask.  Features are tokens and adjacent pairs.
2. Weights: log-odds of a feature in documents labelled 1 against the whole corpus, with a
   Dirichlet prior in proportion to the corpus and further mass on the words of a lexicon.
   The corpus side is matched in language to the labelled documents.  Features that are not
   significant weigh nothing.
3. Every maximal segment of the token scores is found in linear time (:func:`segments`).
4. Calibration by extreme values over all documents: ``lam`` solves ``mean(exp(lam * score))
   = 1`` over their tokens, and a segment of score ``S`` in ``n`` tokens is expected
   ``K * n * exp(-lam * S)`` times by chance; ``K`` is counted, and both are fitted to the
   documents that the calibration itself does not mark.  A document's score is minus the
   logarithm of the chance of its best segment.
5. A document is flagged where that chance is at or below a cut.  With ``LEAST_LABELLED``
   positive labels or more the cut has the fewest errors on labelled documents that the
   weights did not see (each fold is scored by the weights of the others), an unjust
   accusation counting ``FALSE_ALARM`` times; with fewer, it is the false discovery rate of
   ``FALSE_DISCOVERIES`` over the whole corpus.

The texts are read twice in Python: to count the features of the positive sample, and for
the segments; everything after that works on a few numbers a document.  The labelled
documents are a sample of at most ``MOST_LABELLED``; the corpus counts, the calibration and
the scores cover every document.

Defined results: null and empty texts score 0; documents without a source count under null;
contradicting labels of a document are averaged, a tie leaves it out, null labels are
dropped; without a positive label the lexicon alone decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.leakage import fold_word
from folioforge.llm.mojibake import segments
from folioforge.session import cut_lineage

#: Labelled documents that the weights are fitted on; the first so many by a hash of the id.
MOST_LABELLED = 20_000
#: Strength of the Dirichlet prior in documents, and documents that the lexicon counts for.
PRIOR, LEXICON_DOCUMENTS = 3.0, 2.0
#: A feature weighs only from so many documents, standard errors and nats.
LEAST_DOCUMENTS, LEAST_Z, LEAST_ODDS = 2, 3.0, 1.2
#: Cost of every token, and bound of one token's score.
DRIFT, BOUND = 0.3, 3.0
#: Share of the flagged documents that may be flagged by chance.
FALSE_DISCOVERIES = 0.05
#: Folds of the labelled documents, positive ones from which labels set the cut, and the cost of an unjust accusation.
FOLDS, LEAST_LABELLED, FALSE_ALARM = 5, 20, 4.0
MASK, NUMBER, START = "<mask>", "<number>", "<start>"

# Insults, slurs for any group, and sexually explicit words, folded; the data decides what each weighs.
LEXICON = frozenset(
    # en
    "arsehole asshole bastard bitch brainless cock cretin cretins cunt dickhead dimwit fuck fucked fucking horny hardcore idiot idiots imbecile imbeciles moron morons moronic motherfucker "
    "naked nude nudes orgy parasites porn pussy scum scumbag slut subhuman swine turd twat vermin wanker whore worthless xxx "
    # de
    "abschaum arsch arschloch drecksau dreckskerl dummkopf fick ficken fotze fresse hure hurensohn missgeburt nackt nutte parasiten schlampe schwachkopf ungeziefer untermenschen verrecke verrecken wichser widerlicher "
    # fr
    "abruti baise baiser batard connard connards conne creve crever debile encule enfoire merde nique nue nues ordure pouffiasse putain pute salaud salope sousHommes vermine "
    # es
    "alimana basura cabron cabrones coger desnuda desnudas escoria follar gilipollas hijoputa idiota imbecil infrahumanos jodete maldito mierda pendejo perra plaga polla puta puto zorra".lower().split()
)

# Frequent words of each language.
FREQUENT = {
    "de": frozenset("der die das und von in den dem ein eine für mit bei als nicht im zu sich".split()),
    "en": frozenset("the of and in to was a by for with his her but never between it on that".split()),
    "es": frozenset("el la los las del y un una en de que se por con al su lo".split()),
    "fr": frozenset("le la les des du et un une sur dans qui en au ce pour avec ne".split()),
}
LEET = str.maketrans({"4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "@": "a", "$": "s"})
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
# possessive, so that no word is read twice
TOKEN = re.compile(r"[^\W_]++(?:[̀-ͯ]++[^\W_]*+|[*@$!]++[^\W_]++)*+")


def token_of(word: str, known: dict[str, str]) -> str:
    """A word folded, disguise undone; a mask for one with stars, a mark for a number."""
    if "*" in word:
        return MASK
    if word.isdigit():
        return NUMBER
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = re.sub(r"[*!]", "", word.translate(LEET))
    return fold_word(word, known)


def token_spans(text: str, known: dict[str, str] | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens and their offsets in the original text."""
    known = {}
    joined = {m.start(): m.end() for m in SPACED.finditer(text)}
    out, spans, until = [], [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if start < until:
            continue
        word = m.group()
        if start in joined:
            until = end = joined[start]
            word = re.sub(r"[^\w]|_", "", text[start:end])
        out.append(token_of(word, known))
        spans.append((start, end))
    return out, spans


def tokens_of(text: str, cache: dict[str, str]) -> list[str]:
    """The tokens of :func:`token_spans` alone; ``cache`` remembers what a word becomes."""
    if SPACED.search(text):
        return token_spans(text, cache)[0]
    out = []
    get = cache.get
    for word in TOKEN.findall(text):
        token = get(word)
        if token is None:
            if len(cache) > 500_000:
                cache.clear()
            token = cache[word] = token_of(word, {})
        out.append(token)
    return out


def language(tokens: list[str]) -> str:
    """The language whose frequent words the tokens hold most of."""
    return max(sorted(FREQUENT), key=lambda k: sum(map(FREQUENT[k].__contains__, tokens)))


def features(tokens: list[str]) -> set:
    """The tokens and adjacent pairs of a text, each once; a pair is a tuple."""
    return set(tokens).union(zip([START, *tokens], tokens))


class Scorer:
    """Segments of texts under a set of weights."""

    def __init__(self, weights: dict):
        self.weights, self.cache = weights, {}

    def token_scores(self, tokens: list[str]) -> list[float]:
        found, before = [], START
        get = self.weights.get
        for t in tokens:
            x = 0.5 * (get(t, 0.0) + get((before, t), 0.0)) - DRIFT
            found.append(max(-BOUND, min(BOUND, x)))
            before = t
        return found

    def judge(self, text: str | None) -> tuple[int, list[tuple[float, int, int]], Counter]:
        """Number of tokens, every maximal segment (score, start, end in the text), best first, and tokens by score in tenths."""
        if not text:
            return 0, [], Counter()
        tokens = tokens_of(text, self.cache)
        if self.weights.keys().isdisjoint(features(tokens)):
            return len(tokens), [], Counter({round(-10 * DRIFT): len(tokens)} if tokens else {})
        tokens, spans = token_spans(text, self.cache)
        scores = self.token_scores(tokens)
        found = [(sum(scores[a:b]), spans[a][0], spans[b - 1][1]) for a, b in segments(scores)]
        return len(tokens), sorted(found, key=lambda f: (-f[0], f[1])), Counter(round(10 * x) for x in scores)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, fold, text, positive``: at most ``most`` documents with a majority of labels."""
    majority = labels.where("label is not null").groupBy("doc_id").agg(F.avg("label").alias("share")).where("share <> 0.5")
    some = majority.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = documents.where("text is not null").select("doc_id", "text").join(some, "doc_id")
    return found.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text", (F.col("share") > 0.5).alias("positive"))


COUNTS = "fold int, language string, first string, feature string, n bigint"
#: Stands for the number of documents among the counts.
ALL = ""


def _count(texts: DataFrame, vocabulary: frozenset | None) -> DataFrame:
    """Documents of each fold and language that hold each feature, of ``texts(fold, text)``.

    ``first`` is the first token of a pair, null for a single token; rows of the single
    token ``ALL`` count documents.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        total: Counter = Counter()
        wanted = shared.value
        for batch in batches:
            for fold, text in zip(batch["fold"], batch["text"]):
                tokens = tokens_of(text, cache)
                if not tokens:
                    continue
                held = features(tokens)
                if wanted is not None:
                    held &= wanted
                spoken = language(tokens)
                total.update((fold, spoken, f) for f in held)
                total[fold, spoken, ALL] += 1
        rows = [(d, k, f[0], f[1], n) if isinstance(f, tuple) else (d, k, None, f, n) for (d, k, f), n in total.items()]
        yield pd.DataFrame(rows, columns=["fold", "language", "first", "feature", "n"])

    counted = texts.where("text is not null").select("fold", "text").mapInPandas(run, COUNTS)
    return counted.groupBy("fold", "language", "first", "feature").agg(F.sum("n").alias("n"))


def _feature(row):
    return row.feature if row.first is None else (row.first, row.feature)


def fit_weights(documents: DataFrame, sample: DataFrame) -> list[dict]:
    """Weights of the significant features: first those of all positive documents of ``sample(fold, text, positive)``, then those without each fold."""
    counted = cut_lineage(_count(sample.where("positive"), None))
    several = counted.groupBy("first", "feature").agg(F.sum("n").alias("every"))
    several = several.where((F.col("every") >= LEAST_DOCUMENTS) | (F.col("feature") == ALL) | F.col("feature").isin(sorted(LEXICON)))
    same = F.col("c.first").eqNullSafe(F.col("s.first")) & (F.col("c.feature") == F.col("s.feature"))
    rows = counted.alias("c").join(several.alias("s"), same, "left_semi").collect()
    vocabulary = frozenset(_feature(r) for r in rows if r.feature != ALL) | LEXICON
    corpus: dict[str, Counter] = {}
    for r in _count(documents.withColumn("fold", F.lit(0)), vocabulary).collect():
        corpus.setdefault(r.language, Counter())[_feature(r)] = r.n
    return [_weights([r for r in rows if r.fold != without], corpus) for without in (None, *range(FOLDS))]


def _weights(rows: list, corpus: dict[str, Counter]) -> dict:
    """Weights from the counts of positive documents against those of the corpus."""
    if not corpus:
        return {}
    held: Counter = Counter()
    positives: Counter = Counter()
    for r in rows:
        if r.feature == ALL:
            positives[r.language] += r.n
        else:
            held[_feature(r)] += r.n
    n1 = sum(positives.values())
    if not n1:  # no labels: as if one positive document had the languages of the corpus
        n1, every = 1, sum(c[ALL] for c in corpus.values())
        positives = {k: c[ALL] / every for k, c in corpus.items()}
    weights = {}
    for f in {f for f, n in held.items() if n >= LEAST_DOCUMENTS} | LEXICON:
        everywhere = sum(c[f] for c in corpus.values())
        expected = sum(n * corpus[k][f] / corpus[k][ALL] for k, n in positives.items() if k in corpus)
        known = LEXICON_DOCUMENTS if f in LEXICON else 0.0
        seen, size = held[f] + known, n1 + known
        a = PRIOR * expected / n1 + 0.05
        b = PRIOR * max(0.0, 1 - expected / n1) + 0.05
        odds = math.log((seen + a) / (size - seen + b)) - math.log((expected + a) / (max(0.0, n1 - expected) + b))
        if odds >= LEAST_ODDS and odds / math.sqrt(1 / (seen + a) + 1 / (everywhere + a)) >= LEAST_Z:
            weights[f] = odds
    return weights


def solve_lambda(histogram: list[tuple[float, int]]) -> float:
    """The positive root of ``mean(exp(lam * score)) = 1``; 1 where there is none."""
    total = sum(n for _, n in histogram)
    if not total or max(x for x, _ in histogram) <= 0 or sum(x * n for x, n in histogram) >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        if sum(n * math.exp(middle * x) for x, n in histogram) > total:
            high = middle
        else:
            low = middle
    return low


def calibrated(best: float, tokens: int, lam: float, k: float = 1.0) -> float:
    """Minus the natural logarithm of the chance of a segment as good in a text as long."""
    if best <= 0 or not tokens:
        return 0.0
    log_expected = math.log(k * tokens) - lam * best
    if log_expected < -30:
        return -log_expected
    return -math.log(max(1e-300, -math.expm1(-math.exp(log_expected))))


JUDGED = "doc_id bigint, source string, n_tokens bigint, segments array<struct<score:double,start:int,end:int>>, steps array<struct<step:int,n:bigint>>"


def judge_documents(documents: DataFrame, weights: dict) -> DataFrame:
    """Tokens, positive segments and the histogram of token scores of every document: one pass over the texts."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = []
            for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
                n, found, steps = scorer.judge(text)
                out.append((doc, source, n, [dict(zip(("score", "start", "end"), f)) for f in found], [{"step": s, "n": c} for s, c in steps.items()]))
            yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "segments", "steps"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInPandas(run, JUDGED)


def chance(score, tokens, lam: float, k: float):
    """Column: minus the natural logarithm of the chance of a segment as good in a text as long."""
    log_expected = F.log(F.lit(k) * tokens) - F.lit(lam) * score
    near = -F.log(F.greatest(F.lit(1e-300), -F.expm1(-F.exp(log_expected))))
    return F.when((score <= 0) | (tokens <= 0), 0.0).otherwise(F.when(log_expected < -30, -log_expected).otherwise(near))


def calibrate(judged: DataFrame, rounds: int = 4) -> tuple[float, float, float]:
    """``lam``, ``K`` and the score from which a document is flagged.

    Each round fits ``lam`` and ``K`` to the documents that the last one did not flag, and
    flags anew.  All are sums of a few numbers a document; the driver sees histograms only.
    """
    best = F.coalesce(F.get("segments", F.lit(0))["score"], F.lit(0.0))
    rows = judged.select("n_tokens", "steps", "segments", best.alias("best"))
    lam, k, cut = 1.0, 1.0, math.inf
    for round_ in range(rounds):
        null = rows.where(chance(F.col("best"), F.col("n_tokens"), lam, k) < cut) if round_ and cut < math.inf else rows
        steps = null.select(F.explode("steps").alias("s")).groupBy("s.step").agg(F.sum("s.n").alias("n")).collect()
        lam = solve_lambda([(r.step / 10, r.n) for r in steps])
        # K from the segments of middling score, where chance still makes many
        tokens = sum(r.n for r in steps)
        peaks = null.select(F.explode("segments").alias("s")).groupBy(F.floor(F.col("s.score") * 10).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
        k = chance_rate({r.step / 10: r.n for r in peaks}, tokens, lam)
        cut = discovery_cut(rows, lam, k)
    return lam, k, cut


def chance_rate(peaks: dict[float, int], tokens: int, lam: float) -> float:
    """``K``: segments seen at or above the upper quartile of their scores over ``tokens * exp(-lam * score)``; 1 without any."""
    total = sum(peaks.values())
    if not total or not tokens:
        return 1.0
    above = 0
    for score in sorted(peaks, reverse=True):
        above += peaks[score]
        if above * 4 >= total:
            return min(1.0, max(1e-6, above / (tokens * math.exp(-lam * score))))
    return 1.0


def discovery_cut(rows: DataFrame, lam: float, k: float, rate: float = FALSE_DISCOVERIES) -> float:
    """The least score at which at most ``rate`` of the documents at or above it are there by chance.

    Step-up over a histogram of scores in steps of 0.05; infinite where no score is high enough.
    """
    scores = rows.select(chance(F.col("best"), F.col("n_tokens"), lam, k).alias("score"))
    counts = scores.groupBy(F.least(F.floor(F.col("score") * 20), F.lit(2_000)).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, above, cut = sum(r.n for r in counts), 0, math.inf
    for r in sorted(counts, key=lambda r: -r.step):
        above += r.n
        if total * math.exp(-r.step / 20) <= rate * above:
            cut = r.step / 20
    return cut


def best_cut(scored: list[tuple[float, bool]], false_alarm: float = FALSE_ALARM) -> float:
    """The cut with the fewest weighted errors, in the middle of its gap; infinite without positives."""
    ordered = sorted(scored, key=lambda s: -s[0])
    errors = sum(p for _, p in ordered)
    best, cut = float(errors), math.inf
    for i, (score, positive) in enumerate(ordered):
        errors += -1 if positive else false_alarm
        below = ordered[i + 1][0] if i + 1 < len(ordered) else 0.0
        if score <= 0:
            break
        if below < score and errors < best:
            best, cut = errors, (score + max(0.0, below)) / 2
    return cut


def held_out_cut(sample: DataFrame, weights: list[dict], lam: float, k: float) -> float | None:
    """The cut by labelled documents, each scored by weights that did not see it; none with too few positives."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(w) for w in shared.value[1:]]
        for batch in batches:
            judged = [scorers[f].judge(t) for f, t in zip(batch["fold"], batch["text"])]
            scores = [calibrated(found[0][0], n, lam, k) if found else 0.0 for n, found, _ in judged]
            yield pd.DataFrame({"score": scores, "positive": batch["positive"]})

    rows = sample.select("fold", "text", "positive").mapInPandas(run, "score double, positive boolean").collect()
    if sum(r.positive for r in rows) < LEAST_LABELLED:
        return None
    return best_cut([(r.score, r.positive) for r in rows])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, score, n_passages, start, end, flagged`` for every document.

    ``start`` and ``end`` bound the best passage in the text; ``n_passages`` counts the
    passages that reach the cut by themselves.
    """
    sample = cut_lineage(labelled_sample(documents, labels))
    weights = fit_weights(documents, sample)
    judged = cut_lineage(judge_documents(documents, weights[0]))
    lam, k, cut = calibrate(judged)
    labelled = held_out_cut(sample, weights, lam, k)
    cut = cut if labelled is None else labelled
    first = F.get("segments", F.lit(0))
    score = chance(F.coalesce(first["score"], F.lit(0.0)), F.col("n_tokens"), lam, k)
    many = F.size(F.filter("segments", lambda s: chance(s["score"], F.col("n_tokens"), lam, k) >= F.lit(cut)))
    out = judged.select("doc_id", "source", score.alias("score"), many.alias("n_passages"), "segments")
    at = lambda c: F.when(F.col("score") > 0, first[c])
    return out.select("doc_id", "source", "score", "n_passages", at("start").alias("start"), at("end").alias("end"), (F.col("n_passages") > 0).alias("flagged"))


def rates(scored: DataFrame) -> DataFrame:
    """``source, documents, flagged, rate``; a hot source sends one row per map task."""
    counts = scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"))
    return counts.withColumn("rate", F.col("flagged") / F.col("documents"))
