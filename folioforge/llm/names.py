"""Variant spellings of names: link the spellings that mean the same person or organisation.

All work is on distinct spellings, apart from the last join with the rows.

1. A spelling's key drops case, accents, punctuation, spacing and a trailing year.  Its plain
   form has misspelt and shortened common words in their usual form, titles dropped, and
   surname and given names in order; spellings of one plain form are one class without any
   comparison.  Its core is its tokens that are not common in the collection (shares counted
   over all spellings).
2. Distinct tokens of cores meet exactly where they are alike: on the token without up to two
   letters, on either end of a long one without some, on nicknames and abbreviations.  Bands
   over all tokens would collide for a share of all pairs, which grow as the square of the
   collection, so only tokens of 24 letters and more, in which six edits are accepted, also
   meet on MinHash bands over padded q-grams, their number chosen from the collision curve.
   Cores then meet on the tokens that reach the fewest of them.
3. Plain forms of one core, or of cores whose tokens agree, meet on blocks: two letters at
   either end of the first given name, one letter where it is an initial; the letters of the
   common words of a firm.  Forms without a given name, or without common words, meet all of
   their core.  Each pair is verified once, by Monge-Elkan similarity of tokens, where
   initials, abbreviations, nicknames and typos count as close.
4. Star clustering of the verified links: the form with the fullest given name and most
   links among its unassigned neighbours becomes a centre and takes its neighbours.

Defined results: null and letterless names have no key and no row; repeated rows share their
spelling; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.canonical import fold
from folioforge.llm.mojibake import odd, one_byte_inverses
from folioforge.operators.multivalue import within_edits
from folioforge.operators.skew import hot_sums, salted_join
from folioforge.session import cut_lineage, spread

Q = 3
ROWS = 4
#: Jaccard similarity of the longest tokens that must be found, and the share of such pairs that is.
SIMILAR, RECALL = 0.5, 0.98
#: A token is common from this share of the spellings and so many imagined ones without it, so that a
#: few spellings of one name in a small collection make nothing common.
COMMON_SHARE, IMAGINED = 0.004, 2500
RARE_WEIGHT = 7.0
#: Monge-Elkan similarity from which two spellings may mean the same, and two cores.
ALIKE, CORE_ALIKE = 0.86, 0.75
#: A given name of so many letters may be an abbreviation that only its first letter shows.
SHORT = 3
YEAR = re.compile(r"[\s,;:.(\[]*\b\d{4}\b[\s.,;:\"\])]*$")

# Given names and their usual short forms and nicknames.
NICKNAMES = {
    "abraham": "abe", "albert": "al bert", "alexander": "alec alex sandy sascha xander", "alfred": "al alf fred", "andrew": "andy drew", "anthony": "tony", "antonio": "toni",
    "barbara": "babs barb", "benjamin": "ben benny", "catherine": "cathy kate kitty", "charles": "charlie chuck carlos", "christina": "chris tina", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothea": "dolly dora dot thea", "dorothy": "dolly dot dottie",
    "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "elizabeth": "bess beth betsy betty eliza lisa liz lizzie", "ernest": "ernie", "eugene": "gene",
    "florence": "flo florrie", "frances": "fanny fran", "francis": "frank", "francisco": "cisco paco pancho frank", "franklin": "frank", "frederick": "fred freddy fritz rick", "friedrich": "fritz",
    "georg": "jorg", "gertrude": "gert gertie trudy", "giovanni": "gianni nino", "giuseppe": "beppe joe peppe pino", "gregory": "greg", "guillermo": "memo",
    "harold": "hal harry", "heinrich": "heinz", "helen": "nell", "henry": "hal hank harry", "isabella": "bella ella isa izzy", "jacob": "jake", "james": "jamie jim jimmy",
    "johannes": "hans jan jo john", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy katie kay kitty",
    "lawrence": "larry", "leonard": "len lenny leo", "leopold": "leo poldi", "louis": "lou", "manuel": "manolo", "margaret": "greta maggie meg peggy rita", "martha": "patty",
    "mary": "molly polly", "matthew": "matt", "michael": "mick mickey mike", "nathaniel": "nat", "nicholas": "klaus nick nico", "ottilie": "otti tillie tilly",
    "pamela": "pam", "patricia": "pat patty", "patrick": "pat", "peter": "pete", "rebecca": "becky", "richard": "dick rich rick ricky", "robert": "bob bobby rob",
    "ronald": "ron", "rosemary": "rose", "samuel": "sam", "sarah": "sally", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy",
    "timothy": "tim", "ursula": "ulla uschi", "victoria": "tori vicki vicky", "vincent": "vince", "walter": "walt", "wilhelm": "willi", "william": "bill billy liam will willy",
    "yolanda": "yola yoli", "zachary": "zac zack zak",
}
# Words of a name that tell nobody apart.
IDLE = frozenset(
    "a and by casa co comp company da dr ed edit editeur editor et inc limited ltd messrs miss mr mrs ms of prof rev s sa sir the trans translator und y ag corp gmbh llc plc".split()
)
# Words that firms share.
FIRM = frozenset(
    "ancora bks book books bros brothers buchhandlung casa druckerei edic ediciones edicoes edition editions editora editorial forlag hist historical house imprenta imprimerie libreria librairie "
    "livraria livros pr press presse presses printers printing pub publ publisher publishers publishing sao soc societe society son sons stamperia tipografia uitgeverij univ universitaet universite "
    "university verlag verlagsbuchhandlung vlg".split()
)
# Short and other forms of the words that firms share.
SYNONYMS = {
    "bks": "books", "book": "books", "bros": "brothers", "pr": "press", "pub": "publishing", "publ": "publishing", "publisher": "publishing", "publishers": "publishing",
    "univ": "university", "hist": "historical", "soc": "society", "edic": "editions", "edicoes": "editions", "edition": "editions", "son": "sons",
    "vlg": "verlag", "verlagsbuchhandlung": "verlag",
}
# Titles and roles beside a person's name.
TITLES = frozenset("dr mr mrs ms miss prof rev sir editor ed comp compiler trans translator jr sr author".split())
# Particles of surnames.
PARTICLES = frozenset("da de del della der di du la le van vn von vom zu".split())


GIVEN = frozenset(NICKNAMES)
#: The names that a short form may stand for.
FULL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _nick in _short.split():
        FULL[_nick] = FULL.get(_nick, frozenset()) | {_name}
#: Words that count as common in any collection, and their weight where it is not measured.
KNOWN = FIRM | GIVEN | frozenset(FULL)
KNOWN_WEIGHT = 2.5


def bands(similarity: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` hashes that find ``recall`` of the pairs at ``similarity``.

    The collision curve is ``1 - (1 - s ** rows) ** bands``.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def spelling_key(form: str) -> str:
    """What remains of a spelling without case, accents, punctuation, spacing and trailing year."""
    return fold(YEAR.sub("", form)).replace(" ", "")


def tokens(form: str) -> list[str]:
    return fold(YEAR.sub("", form)).split()


def full_names(token: str) -> frozenset[str]:
    """A token and the names that it may be short for."""
    return FULL.get(token, frozenset()) | {token}


def without(token: str, most: int) -> set[str]:
    """A token without up to so many letters."""
    level = out = {token}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def edits(a: str, b: str, most: int) -> int | None:
    """The edits between two tokens, or none beyond ``most``; the letters alone rule most pairs out."""
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return None
    return next((n for n in range(most + 1) if within_edits(a, b, n)), None)


def token_likeness(a: str, b: str, shortened: bool = True) -> float:
    """1 for equal tokens, less for nickname, abbreviation, initial and typo, else 0.

    ``shortened``: whether abbreviations and initials count.
    """
    if a == b:
        return 1.0
    if full_names(a) & full_names(b):
        return 0.95
    short, long = sorted((a, b), key=len)
    if shortened and short and short[0] == long[0]:
        if len(short) == 1:
            return 0.9
        rest = iter(long)
        if len(short) <= max(5, len(long) // 2) and len(short) < len(long) - 1 and all(c in rest for c in short):
            return 0.92
    if len(a) == len(b) == 3 and sorted(a) == sorted(b):
        return 0.8
    if len(long) >= 4:
        most = max(1, len(long) // 5)
        found = edits(a, b, most)
        if found is None and ("rn" in a or "rn" in b):
            found = edits(a.replace("rn", "m"), b.replace("rn", "m"), most)
        if found is not None:
            return 1 - found / len(long)
    return 0.0


class Vocabulary:
    """The common words of a field: their weights, and what a misspelt one stands for."""

    def __init__(self, measured: dict[str, float]):
        self.weights, self.measured = {w: KNOWN_WEIGHT for w in KNOWN} | measured, measured
        # every common word under itself without up to two letters: words within as many edits share one
        self.near: dict[str, list[str]] = {}
        for w in sorted(self.weights):
            if len(w) >= 3:
                for x in without(w, 2 if len(w) >= 7 else 1):
                    self.near.setdefault(x, []).append(w)
        self.short = {"".join(sorted(w)): w for w in sorted(self.weights) if len(w) == 3}
        self.begins: dict[str, list[str]] = {}
        for w in self.weights:
            self.begins.setdefault(w[:2], []).append(w)
        self.settled: dict[str, str] = {}

    def settle(self, token: str) -> str:
        """The common word that a token misspells by one edit, two in long words, in its usual form."""
        found = self.settled.get(token)
        if found is None:
            if len(self.settled) >= 200_000:
                self.settled.clear()
            found = token if token in self.weights or token in IDLE else self._common(token)
            found = self.settled[token] = SYNONYMS.get(found, found)
        return found

    def _common(self, token: str) -> str:
        if any(w.startswith(token) for w in self.begins.get(token[:2], ())):
            return token  # an abbreviation
        if len(token) < 4:
            return self.short.get("".join(sorted(token)), token)
        most = 2 if len(token) >= 9 else 1
        found = {w for x in without(token, most) for w in self.near.get(x, ()) if len(w) >= 4}
        near = [(n, w not in self.measured, self.weights[w], w) for w in found if (n := edits(token, w, most))]
        return min(near)[3] if near else token

    def tokens(self, form: str) -> list[str]:
        return [self.settle(t) for t in tokens(form)]

    def core(self, every: list[str]) -> str:
        """The settled tokens that are not common, sorted; all of them where there is no other."""
        found = sorted({t for t in every if t not in self.weights and t not in IDLE and len(t) > 2})
        return " ".join(found or sorted(set(every)))

    def plain(self, form: str, is_person: bool) -> str:
        """The plain form: spellings that share it differ in nothing that tells anybody apart."""
        if is_person:
            surname, given = person(form)
            if surname:
                return " ".join(map(self.settle, surname)) + ", " + " ".join(map(self.settle, given))
        every = self.tokens(form)
        return " ".join(sorted(t for t in every if t not in IDLE) or sorted(every))

    def blocks(self, form: str, is_person: bool) -> tuple[list[str], list[str]]:
        """The blocks of a form as the left and as the right one of a pair.

        Two forms meet if one has nothing to block on, if both have a name or word that
        begins or ends alike, or if one has an initial that the other's name begins with.
        """
        if is_person:
            _, given = person(form)
            names = full_names(given[0]) | full_names(self.settle(given[0])) if given else frozenset()
            ends = {x for n in names if len(n) > 1 for x in ("p" + n[:2], "s" + n[-2:])}
            short = bool(given) and len(given[0]) <= SHORT
            first = {n[0] for n in names}
        else:
            every = self.tokens(form)
            core = set(self.core(every).split())
            ends = {"f" + n[0] for t in every if t not in core and t not in IDLE for n in full_names(t)}
            short, first, names = False, set(), ends
        if not names:
            return ["n", "N"], ["n", "N"]
        one = {"i" + c for c in first}
        other = {"I" + c for c in first}
        both = one | other if short else set()
        return sorted(ends | one | both | {"n"}), sorted(ends | other | both | {"N"})


def monge_elkan(a: list[str], b: list[str], weights: dict[str, float]) -> float:
    """Weighted Monge-Elkan similarity, the better of both directions; idle words are skipped.

    Only common words (those with a weight) and given names are ever shortened; a rare word
    that begins alike is another name.
    """
    a = [t for t in a if t not in IDLE or len(t) == 1] or a
    b = [t for t in b if t not in IDLE or len(t) == 1] or b

    def like(t: str, u: str) -> float:
        long = max(t, u, key=len)
        return token_likeness(t, u, long in weights or long in GIVEN)

    def one_way(x: list[str], y: list[str]) -> float:
        total = sum(weights.get(t, RARE_WEIGHT) for t in x)
        return sum(weights.get(t, RARE_WEIGHT) * max((like(t, u) for u in y), default=0.0) for t in x) / total if total else 0.0

    # the smaller side's rare tokens must all be met, so a shared common word alone links nothing
    return max(one_way(a, b), one_way(b, a))


def person(form: str) -> tuple[list[str], list[str]]:
    """Surname and given-name tokens of ``Surname, Given`` or ``Given Surname``."""
    parts = [p.split() for p in YEAR.sub("", form).split(",")]
    parts = [[w for w in p if (f := fold(w)) and f not in TITLES] for p in parts]
    parts = [p for p in parts if p]
    if not parts:
        return [], []
    if len(parts) > 1:
        surname, given = parts[0], [w for p in parts[1:] for w in p]
    else:
        words = parts[0]
        at = len(words) - 1
        while at > 1 and fold(words[at - 1]) in PARTICLES:
            at -= 1
        surname, given = words[at:], words[:at]
    return fold(" ".join(surname)).split(), fold(" ".join(given)).split()


def same_person(a: str, b: str, words: Vocabulary) -> bool:
    """Whether no given name of one contradicts the other's, position by position, as spelt or settled."""
    (_, x), (_, y) = person(a), person(b)
    return all(token_likeness(s, t) > 0 or token_likeness(words.settle(s), words.settle(t)) > 0 for s, t in zip(x, y))


def fullness(form: str) -> int:
    """2 for a whole given name, 1 for a short one, 0 for initials or none."""
    longest = max((len(t) for t in person(form)[1]), default=0)
    return 2 if longest > 4 else int(longest > 1)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def qgrams(core: str) -> set[str]:
    """Padded q-grams of each token of a core."""
    out = set()
    for token in core.split():
        padded = "\x02" * (Q - 1) + token + "\x03" * (Q - 1)
        out.update(padded[i : i + Q] for i in range(len(padded) - Q + 1))
    return out


class MinHash:
    """Band hashes of a set of q-grams; each function multiplies and mixes 64-bit hashes."""

    def __init__(self, n_bands: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n_bands = n_bands
        self.odd = rng.integers(0, 1 << 63, n_bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n_bands * ROWS, dtype=np.uint64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def signature(self, grams: set[str]) -> np.ndarray:
        x = np.array([_hash(g) for g in grams], dtype=np.uint64)
        return self.mix(self.odd[:, None] * x[None, :] + self.add[:, None]).min(axis=1)

    def bands(self, grams: set[str], salt: int = 0) -> np.ndarray:
        """One number a band; the same rows in two bands, or under two salts, give different ones."""
        low = self.signature(grams).reshape(self.n_bands, ROWS)
        mixed = np.arange(1, self.n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        for i in range(ROWS):
            mixed = self.mix(mixed + low[:, i])
        return mixed.astype(np.int64)


def common_tokens(spellings: DataFrame) -> dict[str, dict[str, float]]:
    """Weights of the common tokens of each field: ``log(spellings / spellings with it)``.

    At most tokens-a-spelling / ``COMMON_SHARE`` tokens a field can be common.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, t) for n, f in zip(batch["field_name"], batch["form"]) for t in set(tokens(f))]
            yield pd.DataFrame(rows, columns=["field_name", "token"])

    counts = spellings.select("field_name", "form").mapInPandas(split, "field_name string, token string").groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("n"))
    totals = spellings.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"))
    sure = F.col("n") >= (F.col("total") + IMAGINED) * COMMON_SHARE
    common = counts.join(F.broadcast(totals), "field_name").where(sure)  # one row a field
    out: dict[str, dict[str, float]] = {}
    for r in common.collect():
        out.setdefault(r.field_name, {})[r.token] = min(4.0, max(1.0, math.log(r.total / r.n)))
    return out


def shortened(token: str) -> set[str]:
    """A token without up to as many letters as ``token_likeness`` allows edits; tokens that near share one."""
    # two edits are allowed from ten letters of the longer token, so the shorter has eight
    most = 2 if len(token) >= 8 else 1
    return set().union(*(without(t, most) for t in {token, token.replace("rn", "m")}))


#: Edits of a token from which its ends, and from which MinHash bands, find the tokens that near.
ENDS, BANDS = 3, 6


def ends(token: str) -> Iterator[str]:
    """Both ends of a long token without some letters: tokens within three to five accepted edits share one.

    Of ``k`` edits in ``5 * k`` letters one end of half of them has at most ``k // 2``.  It is
    cut at two places, since a swap may lie across one.
    """
    # the longer of two tokens has 5 * k letters at least, the shorter up to k less
    for k in range(max(ENDS, len(token) // 5), min(BANDS, len(token) // 4 + 1)):
        cut, most = 5 * k // 2, k // 2
        for size in range(cut - 1 - most, min(cut + most, len(token)) + 1):
            for side, end in (("<", token[:size]), (">", token[-size:])):
                yield from (f"{k}{side}{x}" for x in without(end, most) if len(x) >= cut - 1 - most)


def near_keys(token: str) -> set[str]:
    """Keys of a token; tokens that :func:`token_likeness` accepts share one, but for those of ``BANDS`` edits."""
    out = shortened(token)
    if token in GIVEN or token in FULL:
        out |= {"=" + n for n in full_names(token)}
    if len(token) == 3:
        out.add("~" + "".join(sorted(token)))
    if token in GIVEN:
        out.add("." + token)
    if len(token) <= 5:
        out |= {"." + n for n in GIVEN if n[0] == token[0] and token_likeness(token, n) > 0}
    for t in {token, token.replace("rn", "m")}:
        out.update(ends(t))
    return out


def near_tokens(words: DataFrame) -> DataFrame:
    """``field_name, one, two, alone, likeness``: the pairs of distinct tokens that are alike, ``one < two``.

    ``words(field_name, token, alone)``; ``alone`` is whether both are.  Keys are one table of
    two numbers a row, joined once; its pairs are made distinct before any token is looked up.
    """
    numbered = cut_lineage(words.select("field_name", "token", "alone", F.xxhash64("field_name", "token").alias("id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHash(bands())
        for batch in batches:
            buckets, sizes = [], []
            for name, token in zip(batch["field_name"], batch["token"]):
                salt = _hash(name)
                found = [xxhash.xxh3_64_intdigest(x, salt) for x in near_keys(token)]
                if len(token) >= 4 * BANDS:
                    found.extend(hasher.bands(qgrams(token), salt).view(np.uint64).tolist())
                buckets.extend(found)
                sizes.append(len(found))
            yield pd.DataFrame({"bucket": np.array(buckets, np.uint64).view(np.int64), "id": np.repeat(batch["id"].to_numpy(np.int64), sizes)})

    # both sides of the join are one exchange, which Spark reuses
    keyed = spread(numbered).mapInPandas(run, "bucket bigint, id bigint").repartition("bucket")
    pairs = keyed.alias("a").join(keyed.alias("b"), "bucket").where("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    named = pairs.join(numbered.select("field_name", F.col("token").alias("a"), F.col("alone").alias("alone_a"), F.col("id").alias("id_a")), "id_a")
    named = named.join(numbered.select(F.col("token").alias("b"), F.col("alone").alias("alone_b"), F.col("id").alias("id_b")), "id_b")
    named = named.select("field_name", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"), F.expr("alone_a and alone_b").alias("alone"))

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([core_likeness(a, b) for a, b in zip(batch["one"], batch["two"])], float)
            yield batch.assign(likeness=found)[found > 0]

    return named.mapInPandas(alike, "field_name string, one string, two string, alone boolean, likeness double")


def core_likeness(a: str, b: str) -> float:
    """The likeness of two tokens of cores, of which only given names are ever shortened."""
    return monge_elkan([a], [b], {})


def similar_cores(cores: DataFrame) -> DataFrame:
    """``field_name, core_a, core_b`` with ``core_a < core_b``: all agreeing pairs of distinct cores.

    Cores of one token agree as their tokens do.  Of a core of ``n`` tokens that agrees with
    another, at most ``n // 4`` may have nothing alike there, so one more than these, those
    that reach the fewest cores, meet all that hold a token like them.
    """
    every = F.array_distinct(F.split("core", " "))
    told = F.filter(every, lambda t: ~t.isin(*sorted(IDLE)) | (F.length(t) == 1))
    held = cut_lineage(cores.select("field_name", "core", F.when(F.size(told) > 0, told).otherwise(every).alias("tokens")))
    each = held.select("field_name", "core", "tokens", F.explode("tokens").alias("token"))
    near = cut_lineage(near_tokens(each.groupBy("field_name", "token").agg(F.max(F.col("core") == F.col("token")).alias("alone"))))
    single = near.where(F.col("alone") & (F.col("likeness") >= CORE_ALIKE)).select("field_name", F.col("one").alias("core_a"), F.col("two").alias("core_b"))

    several = each.where(F.col("core") != F.col("token"))
    index = cut_lineage(several.select("field_name", F.col("token").alias("other"), F.col("core").alias("two")))
    sizes = index.groupBy("field_name", "other").agg(F.count(F.lit(1)).alias("n"))
    itself = sizes.select("field_name", F.col("other").alias("token"), "other")
    reach = near.select("field_name", F.col("one").alias("token"), F.col("two").alias("other"))
    reach = reach.unionByName(near.select("field_name", F.col("two").alias("token"), F.col("one").alias("other"))).unionByName(itself)
    reach = cut_lineage(reach.join(sizes, ["field_name", "other"]))
    reached = several.join(reach.groupBy("field_name", "token").agg(F.sum("n").alias("n")), ["field_name", "token"])
    fewest = F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), F.lit(1), F.floor(F.count(F.lit(1)) / 4).cast("int") + 1)
    probes = reached.groupBy("field_name", F.col("core").alias("one")).agg(fewest.alias("f")).select("field_name", "one", F.explode("f.token").alias("token"))
    probes = probes.unionByName(each.where(F.col("core") == F.col("token")).select("field_name", F.col("core").alias("one"), "token"))
    met = probes.join(reach.drop("n"), ["field_name", "token"]).join(index, ["field_name", "other"]).where("one <> two")
    met = met.select("field_name", F.least("one", "two").alias("core_a"), F.greatest("one", "two").alias("core_b")).distinct()

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[monge_elkan(a.split(), b.split(), {}) >= CORE_ALIKE for a, b in zip(batch["core_a"], batch["core_b"])]]

    return spread(met).mapInPandas(agreeing, "field_name string, core_a string, core_b string").unionByName(single)


FORMS = "field_name string, key string, form string, core string, plain string, rank int"


def plain_forms(spellings: DataFrame, shared) -> DataFrame:
    """``field_name, key, form, core, plain, rank`` of every spelling; ``shared`` has the common words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Vocabulary] = {}
        for batch in batches:
            rows = []
            for name, key, form in zip(batch["field_name"], batch["key"], batch["form"]):
                words = vocabulary(known, shared, name)
                is_person = name == PERSONS
                rows.append((name, key, form, words.core(words.tokens(form)), words.plain(form, is_person), fullness(form) if is_person else 0))
            yield pd.DataFrame(rows, columns=["field_name", "key", "form", "core", "plain", "rank"])

    return spread(spellings.select("field_name", "key", "form")).mapInPandas(run, FORMS)


#: The field whose names are persons.
PERSONS = "first_author"


def vocabulary(known: dict[str, Vocabulary], shared, name: str) -> Vocabulary:
    if name not in known:
        known[name] = Vocabulary(shared.value.get(name, {}))
    return known[name]


def met_pairs(nodes: DataFrame, shared) -> DataFrame:
    """The pairs of plain forms that are verified, each once: ``field_name, plain_a, plain_b, form_a, form_b``."""

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Vocabulary] = {}
        for batch in batches:
            found = [vocabulary(known, shared, n).blocks(f, n == PERSONS) for n, f in zip(batch["field_name"], batch["form"])]
            yield batch.assign(left=[a for a, _ in found], right=[b for _, b in found])

    schema = "field_name string, plain string, core string, form string, left array<string>, right array<string>"
    given = cut_lineage(nodes.select("field_name", "plain", "core", "form").mapInPandas(blocked, schema))
    cores = nodes.select("field_name", "core").distinct()
    groups = cut_lineage(cores.select("field_name", F.col("core").alias("core_a"), F.col("core").alias("core_b")).unionByName(similar_cores(cores)))
    one = given.select("field_name", F.col("core").alias("core_a"), F.col("plain").alias("plain_a"), F.col("form").alias("form_a"), "left")
    two = given.select("field_name", F.col("core").alias("core_b"), F.col("plain").alias("plain_b"), F.col("form").alias("form_b"), "right")
    left = groups.join(one, ["field_name", "core_a"]).withColumn("block", F.explode("left"))
    right = two.withColumn("block", F.explode("right"))
    met = left.join(right, ["field_name", "core_b", "block"])
    first = F.col("block") == F.array_min(F.array_intersect("left", "right"))
    met = met.where(first & ((F.col("core_a") != F.col("core_b")) | (F.col("plain_a") < F.col("plain_b"))))
    return met.select("field_name", "plain_a", "plain_b", "form_a", "form_b")


def links(nodes: DataFrame, shared) -> DataFrame:
    """``field_name, key_a, key_b, likeness`` of plain forms that mean the same; ``key_a < key_b``."""

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Vocabulary] = {}
        for batch in batches:
            rows = []
            for name, ka, kb, fa, fb in zip(*(batch[c] for c in ("field_name", "plain_a", "plain_b", "form_a", "form_b"))):
                words = vocabulary(known, shared, name)
                likeness = monge_elkan(words.tokens(fa), words.tokens(fb), words.weights)
                if likeness >= ALIKE and (name != PERSONS or same_person(fa, fb, words)):
                    rows.append((name, min(ka, kb), max(ka, kb), likeness))
            yield pd.DataFrame(rows, columns=["field_name", "key_a", "key_b", "likeness"])

    return spread(met_pairs(nodes, shared)).mapInPandas(verified, "field_name string, key_a string, key_b string, likeness double")


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``field_name, key, centre, links`` for every node; ``nodes(field_name, key, rank)``.

    Each round the unassigned nodes that lead all their unassigned neighbours in (rank,
    links, key) become centres and their neighbours join the leading centre.  Every round
    assigns at least the first of all, so it ends with every node in one star.
    """
    on = ["field_name", "key"]
    ends = edges.select("field_name", F.col("key_a").alias("key"), F.col("key_b").alias("other"))
    ends = cut_lineage(ends.unionByName(edges.select("field_name", F.col("key_b").alias("key"), F.col("key_a").alias("other"))))
    degree = ends.groupBy(*on).agg(F.count(F.lit(1)).alias("links"))
    led = cut_lineage(nodes.join(degree, on, "left").select(*on, F.coalesce("links", F.lit(0)).alias("links"), F.struct("rank", F.coalesce("links", F.lit(0)).alias("links"), "key").alias("lead")))
    lead = led.select(*on, "lead")
    live = cut_lineage(ends.join(lead, on).join(lead.select("field_name", F.col("key").alias("other"), F.col("lead").alias("other_lead")), ["field_name", "other"]))
    done = None
    while not live.isEmpty():
        # a node with live neighbours that leads them all is a centre
        best = live.groupBy(*on).agg(F.max("other_lead").alias("best"), F.first("lead").alias("lead"))
        centres = best.where("lead > best").select("field_name", F.col("key").alias("other"))
        joined = live.join(centres, ["field_name", "other"], "left_semi").groupBy(*on).agg(F.max("other_lead")["key"].alias("centre"))
        now = cut_lineage(joined.unionByName(centres.select("field_name", F.col("other").alias("key"), F.col("other").alias("centre"))))
        done = now if done is None else done.unionByName(now)
        gone = now.select(*on)
        live = live.join(gone, on, "left_anti").join(gone.withColumnRenamed("key", "other"), ["field_name", "other"], "left_anti")
        live = cut_lineage(live)
    if done is None:
        return led.select(*on, F.col("key").alias("centre"), "links")
    return led.join(done, on, "left").select(*on, F.coalesce("centre", "key").alias("centre"), "links")


def clusters(spellings: DataFrame) -> DataFrame:
    """``field_name, key, form, plain, centre, links`` for every spelling of ``spellings(field_name, key, form)``.

    ``centre`` names the class, ``links`` counts the verified links of the spelling's plain form.
    """
    shared = spellings.sparkSession.sparkContext.broadcast(common_tokens(spellings))
    plain = cut_lineage(plain_forms(spellings, shared))
    # the fullest spelling stands for its plain form
    best = F.max(F.struct("rank", "form", "core"))
    nodes = cut_lineage(plain.groupBy("field_name", "plain").agg(best.alias("b")).select("field_name", "plain", "b.*"))
    edges = cut_lineage(links(nodes, shared))
    stars = star_clusters(nodes.select("field_name", F.col("plain").alias("key"), "rank"), edges).withColumnRenamed("key", "plain")
    return plain.select("field_name", "key", "form", "plain").join(stars, ["field_name", "plain"])


def damaged_values(spelt: DataFrame) -> DataFrame:
    """``field_name, value`` of values that are another, twice as frequent name read in the wrong encoding.

    ``spelt(field_name, value, key, n)``, ``n`` the rows.  An exact check for letters and
    symbols that can look likely where they stand, but whose inverse is there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, value, key in zip(batch["field_name"], batch["value"], batch["key"]):
                others = {spelling_key(o) for o in one_byte_inverses(value)} - {key, ""}
                rows.extend((name, value, key, o) for o in sorted(others))
            yield pd.DataFrame(rows, columns=["field_name", "value", "key", "other"])

    support = cut_lineage(spelt.groupBy("field_name", "key").agg(F.sum("n").alias("n")))
    suspects = spelt.where(odd()).select("field_name", "value", "key").mapInPandas(run, "field_name string, value string, key string, other string")
    found = suspects.join(support, ["field_name", "key"]).join(support.select("field_name", F.col("key").alias("other"), F.col("n").alias("support")), ["field_name", "other"])
    return found.where("support >= 2 * n").select("field_name", "value").distinct()


def variant_pairs(rows: DataFrame, spelt: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """``field_name, rec_a, rec_b``: rows of one cluster in different spellings, each pair once.

    ``rows(field_name, row_id, value)``, ``spelt(field_name, value, key, n)`` with the rows
    of each value.  Only clusters of two or more spellings are joined; hot values and hot
    clusters, known from the counts, are salted.  The pairs are as many as the clusters say:
    where only the classes matter, :func:`clusters` has one row a spelling.
    """
    several = found.groupBy("field_name", "centre").agg(F.count_distinct("key").alias("n")).where("n > 1").drop("n")
    members = found.select("field_name", "key", "centre").join(several, ["field_name", "centre"])
    members = cut_lineage(spelt.select("field_name", "value", "key", "n").join(members, ["field_name", "key"]))
    hot = lambda on: hot_sums(members, on, "n")
    named = salted_join(rows.select("field_name", "row_id", "value"), members.drop("n"), ["field_name", "value"], salts=salts, hot=hot(["field_name", "value"]))
    named = cut_lineage(named.select("field_name", "centre", "row_id", "key").distinct())
    left = named.select("field_name", "centre", F.col("row_id").alias("rec_a"), F.col("key").alias("key_a"))
    right = named.select("field_name", "centre", F.col("row_id").alias("rec_b"), F.col("key").alias("key_b"))
    pairs = salted_join(left, right, ["field_name", "centre"], salts=salts, hot=hot(["field_name", "centre"])).where("rec_a < rec_b and key_a <> key_b")
    return pairs.select("field_name", "rec_a", "rec_b").distinct()
