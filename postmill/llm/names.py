"""Variant spellings of names typed by people (problem 1).

Every spelling is taken as a canonical form sent through a noisy channel: letters slip, words are
shortened, left out or change places, forms of business and remarks are added. The frequent full
forms are the candidates; each form goes to the candidate with the largest posterior, the candidate's
frequency times the likelihood of what the channel must have done to it, or is an employer of its own.
Which words are mere additions, and which are short for others, is learned from how they come and go.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.places import fold
from postmill.session import cut, small

# Forms of business, by law, of many countries, and the article.
_LEGAL = frozenset("inc incorporated llc ltd limited gmbh plc corp corporation co company ag sa sas bv nv oy ab as pty srl spa kg llp lp pbc the".split())
# Logarithms of the likelihoods of what the channel does to the words beside the distinctive one ...
SLIP, TWO_SLIPS, SHORTENED, LEFT_OUT, ADDED, REPLACED = -4.0, -7.0, -1.5, -1.0, -6.0, -13.0
# ... to the distinctive word, if it has five letters or fewer than that; to the blanks; and the likelihood of
# a form under a new employer.
DISTINCTIVE_SLIP, SHORT_SLIP, JOINED, NEW_EMPLOYER = -5.0, -7.0, -2.0, -12.0
# A form is a candidate if it has this part of the frequency of its distinctive word; so there are at most 50
# for each. Forms that none of them explains are gone through again among themselves.
CANDIDATE_SHARE = 0.02
# A phrase is an addition, a word short for another, if that shows beside so many different names at least.
LEARNED_FROM = 3
# Words that an addition has at most.
PHRASE = 3
BROADCAST_WORDS = 50_000

_BORDER = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W_]+")


def words_of(name: str) -> list[tuple[str, bool]]:
    """The folded words of a name without forms of business, and whether each could be initials."""
    words = [(w, raw.isupper() and 2 <= len(raw) <= 5) for raw in _WORD.findall(_BORDER.sub(" ", name)) for w in _WORD.findall(fold(raw))]
    return [w for w in words if w[0] not in _LEGAL] or words


def _near(a: str, b: str, most: int) -> int:
    """Slips between two words, swaps of neighbours included; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return min(row[-1], most + 1)


def _from(word: str, meant: str, aliases: frozenset = frozenset()) -> float:
    """Log-likelihood that ``meant`` is written ``word``; ``REPLACED`` if it hardly is."""
    if word == meant:
        return 0.0
    if (word, meant) in aliases:
        return SHORTENED
    if word[0] == meant[0] and len(word) < len(meant):
        letters = iter(meant)
        if all(c in letters for c in word):
            bare = [c for c in meant if c not in "aeiou"]
            if len(word) <= max(1, len(meant) * 2 // 3) or [c for c in word if c not in "aeiou"] == bare:
                return SHORTENED
    slips = _near(word, meant, 2)
    return SLIP if slips == 1 and len(meant) >= 4 else TWO_SLIPS if slips == 2 and len(meant) >= 6 else REPLACED


def channel(words: list[str], meant: list[str], aliases: frozenset = frozenset()) -> float:
    """Log-likelihood of the other words of a name, given those of its canonical form; order is free.

    A word that is there beside all that was meant is an addition; one that stands where another was
    meant is another word.
    """
    left, more, total = list(meant), 0, 0.0
    for w in sorted(words, key=len, reverse=True):
        # The most frequent form may itself be the shortened one.
        best, m = max(((max(_from(w, m, aliases), _from(m, w, aliases)), m) for m in left), default=(REPLACED, ""))
        if best > REPLACED:
            total += best
            left.remove(m)
        else:
            more += 1
    replaced = min(more, len(left))
    return total + REPLACED * replaced + ADDED * (more - replaced) + LEFT_OUT * (len(left) - replaced)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [words_of(n) for n in pdf["name"]]
        pdf = pdf.assign(words=[[w for w, _ in g] for g in got], caps=[[c for _, c in g] for g in got])
        yield pdf[[bool(g) for g in got]]


def _slip_keys(word: Column) -> Column:
    """A word and all that is left of it without one letter: words one slip apart share one of them."""
    without = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.array_distinct(F.when(F.length(word) >= 3, F.concat(F.array(word), without)).otherwise(F.array(word)))


def _additions(parsed: DataFrame) -> DataFrame:
    """Phrases of up to ``PHRASE`` words that come and go at the ends of names: the name is mostly there without them, and more often."""
    forms = parsed.groupBy(F.array_join("words", " ").alias("form"), "words").agg(F.sum("n").alias("n"))
    ends = []
    for k in range(1, PHRASE + 1):
        long, size = forms.where(F.size("words") > k), F.size("words")
        ends.append(long.select("n", F.array_join(F.slice("words", size - k + 1, k), " ").alias("phrase"), F.array_join(F.slice("words", 1, size - k), " ").alias("form")))
        ends.append(long.select("n", F.array_join(F.slice("words", 1, k), " ").alias("phrase"), F.array_join(F.slice("words", k + 1, size), " ").alias("form")))
    seen = reduce(DataFrame.unionByName, ends).join(forms.select("form", F.col("n").alias("bare")), "form", "left")
    seen = seen.groupBy("phrase").agg(F.count("*").alias("all"), F.count_if(F.col("bare") >= F.col("n")).alias("bare"))
    return seen.where((F.col("bare") >= LEARNED_FROM) & (F.col("bare") * 2 >= F.col("all"))).select("phrase")


def _without_additions(parsed: DataFrame) -> DataFrame:
    """``name, n, words, initials``: names without additions, single ones anywhere and phrases at the ends; all words where nothing is left."""
    added = small(cut(_additions(parsed)), BROADCAST_WORDS)
    single = "transform(words, (w, i) -> struct(i as at, 1 as size, w as phrase))"
    some = f"filter(sequence(2, {PHRASE}), k -> k < size(words))"
    last = f"transform({some}, k -> struct(size(words) - k as at, k as size, array_join(slice(words, size(words) - k + 1, k), ' ') as phrase))"
    first = f"transform({some}, k -> struct(0 as at, k as size, array_join(slice(words, 1, k), ' ') as phrase))"
    spans = parsed.select("name", F.explode(F.expr(f"concat({single}, {last}, {first})")).alias("s")).select("name", "s.*").join(added, "phrase", "left_semi")
    gone = spans.groupBy("name").agg(F.flatten(F.collect_set(F.expr("sequence(at, at + size - 1)"))).alias("gone"))
    kept = "filter(arrays_zip(words, caps), (w, i) -> gone is null or not array_contains(gone, i))"
    told = parsed.join(gone, "name", "left").withColumn("kept", F.expr(kept)).withColumn("kept", F.expr("if(size(kept) > 0, kept, arrays_zip(words, caps))"))
    return told.select("name", "n", F.col("kept.words").alias("words"), F.expr("size(kept) = 1 and kept[0].caps").alias("initials"))


def _aliases(forms: DataFrame) -> frozenset:
    """Short words that stand for longer ones with the same first letter: both come beside the same other words of many employers.

    Of words with few letters there are few, whatever the number of names, and each brings what it mostly stands for.
    """
    other = forms.select("mark", F.posexplode("words").alias("at", "word"), "words").where("word <> mark")
    other = other.select("mark", "word", F.array_join(F.concat(F.slice("words", 1, F.col("at")), F.slice("words", F.col("at") + 2, F.size("words"))), " ").alias("rest"))
    short = other.where(F.length("word").between(2, 4)).select("mark", "rest", F.col("word").alias("short"), F.substring("word", 1, 1).alias("letter"))
    long = other.where(F.length("word") > 4).select("mark", "rest", F.col("word").alias("long"), F.substring("word", 1, 1).alias("letter"))
    both = short.join(long, ["mark", "rest", "letter"]).groupBy("short", "long").agg(F.countDistinct("mark").alias("n")).where(F.col("n") >= LEARNED_FROM)
    best = both.groupBy("short").agg(F.max(F.struct("n", "long")).alias("b")).select("short", "b.long")
    return frozenset(tuple(r) for r in best.collect())


def _posterior(aliases: frozenset):
    """Pairs of a form and a candidate to the posterior of the candidate, where it beats a new employer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, score = [], []
            for r in pdf.itertuples():
                rest, meant = [w for w in r.words if w != r.mark], [w for w in r.c_words if w != r.c_mark]
                if r.joined:
                    ll = JOINED
                else:
                    slips = _near(r.mark, r.c_mark, 2)
                    one = DISTINCTIVE_SLIP if min(len(r.mark), len(r.c_mark)) > 4 else SHORT_SLIP
                    ll = channel(rest, meant, aliases) + (0.0 if not slips else one if slips == 1 else 2 * NEW_EMPLOYER)
                keep.append(ll > NEW_EMPLOYER)
                score.append(math.log(r.c_n) + ll)
            yield pdf.assign(score=score)[keep][["form", "c_form", "score"]]

    return run


def _meet(pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """Forms of ``pool`` beside the candidates of their distinctive word and of those one letter away."""
    asked = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns])
    keyed = lambda df, name: df.select(F.col(name), F.explode(_slip_keys(F.col(name))).alias("key"))
    near = keyed(pool.select("mark").distinct(), "mark").join(keyed(asked.select("c_mark").distinct(), "c_mark"), "key").select("mark", "c_mark").distinct()
    met = pool.join(near, "mark").join(asked, "c_mark").withColumn("joined", F.lit(False))
    run = asked.where(F.size("c_words") > 1).withColumn("mark", F.array_join("c_words", ""))
    whole = pool.where(F.size("words") == 1).join(run, "mark").withColumn("joined", F.lit(True))
    return met.unionByName(whole).where("form <> c_form")


def _frequent(pool: DataFrame) -> DataFrame:
    totals = pool.groupBy("mark").agg(F.sum("n").alias("total"))
    return pool.join(totals, "mark").where(F.col("n") >= CANDIDATE_SHARE * F.col("total")).drop("total")


def _attach(pool: DataFrame, aliases: frozenset) -> DataFrame:
    """``form, root``: the candidate that each form of ``pool`` goes to, where there is one; candidates without one are roots."""
    candidates = cut(_frequent(pool))
    # A form goes to one that ranks before it: of several words before a single one, then by frequency and length: a full form before a shortened one.
    rank = lambda c, n: F.struct((F.size(c) > 1).alias("several"), (F.col(n) * F.size(c) * F.size(c)).alias("weight"), F.col(n).alias("n"), F.size(c).alias("size"), F.length(F.array_join(c, "")).alias("letters"))
    before, own = rank("c_words", "c_n"), rank("words", "n")
    pairs = _meet(pool, candidates).where((before > own) | ((before == own) & (F.col("c_form") < F.col("form"))))
    scored = pairs.mapInPandas(_posterior(aliases), "form string, c_form string, score double")
    best = scored.groupBy("form").agg(F.max(F.struct("score", "c_form")).alias("b")).select("form", F.col("b.c_form").alias("root"))
    alone = candidates.select("form").join(best, "form", "left_anti").select("form", F.col("form").alias("root"))
    return cut(best.unionByName(alone))


def _to_roots(roots: DataFrame) -> DataFrame:
    """Each form's last root; a step doubles the way, and something rises along it, so it ends."""
    while True:
        above = roots.select(F.col("form").alias("root"), F.col("root").alias("above"))
        if roots.join(above, "root").where("root <> above").isEmpty():
            return roots
        roots = cut(roots.join(above, "root").select("form", F.col("above").alias("root")))


def _join_families(forms: DataFrame, roots: DataFrame, aliases: frozenset) -> DataFrame:
    """Roots that a slip or a shortening makes of a form of a larger family go to its root.

    Of a rare employer a variant may be as frequent as the true form, which then goes to another variant.
    """
    placed = forms.join(roots, "form")
    families = placed.groupBy("root").agg(F.sum("n").alias("family"))
    placed = cut(placed.join(families, "root"))
    larger = (F.col("c_family") > F.col("family")) | ((F.col("c_family") == F.col("family")) & (F.col("c_root") < F.col("root")))
    pairs = _meet(placed.where("form = root"), _frequent(placed)).where("not joined and root <> c_root and size(words) = size(c_words)").where(larger)
    scored = pairs.withColumn("c_n", F.col("c_family")).mapInPandas(_posterior(aliases), "form string, c_form string, score double")
    target = placed.select(F.col("form").alias("c_form"), F.col("root").alias("target"))
    best = scored.join(target, "c_form").groupBy("form").agg(F.max(F.struct("score", "target")).alias("b")).select(F.col("form").alias("root"), F.col("b.target").alias("target"))
    return cut(roots.join(best, "root", "left").select("form", F.coalesce("target", "root").alias("root")))


def link_names(names: DataFrame) -> DataFrame:
    """One row for each distinct spelling in the column ``name``: ``name, n, employer, canonical``.

    Spellings with the same ``employer`` are variants of one; ``canonical`` is the most frequent of
    them. Defined results: null, empty and blank names, and names without a letter or digit, are left
    out; spellings count exactly as stored; ties of frequency go to the smaller string; initials that
    fit several employers go to the most frequent one, those that fit none stand alone.

    Plan: rows are reduced to counted spellings first, with map-side combining, so a name that a third
    of all rows bear is one row after that, and spellings to forms. A word is distinctive if names
    begin with it more than they go on with it; that statistic is taken over all rows. Forms meet the
    candidates of their distinctive word and of those one letter away, at most ``1 / CANDIDATE_SHARE``
    each, never by words that many employers share, so the work grows with the number of forms.
    """
    counted = names.select(F.col("name").cast("string").alias("name")).where(F.col("name").isNotNull() & (F.trim("name") != ""))
    counted = counted.groupBy("name").agg(F.count("*").alias("n"))
    parsed = cut(counted.mapInPandas(_parse, "name string, n bigint, words array<string>, caps array<boolean>"))
    told = cut(_without_additions(parsed))
    full = told.where("not initials")
    placed = full.select("name", "n", "words", F.posexplode("words").alias("pos", "word"))
    heads = placed.groupBy("word").agg(F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("head"), F.sum("n").alias("all"))
    # Of words that mostly begin names the one that does so most; where there is none, the rarest word.
    share = F.col("head") / F.col("all")
    known = (share >= 0.5) & (F.length("word") > 1)
    order = F.when(known, share).when(F.length("word") > 1, -F.col("all").cast("double")).otherwise(F.lit(-1e18))
    weight = F.struct(known.alias("known"), order.alias("order"), F.col("head").alias("head"), (-F.col("pos")).alias("at"), F.col("word").alias("word"))
    marked = placed.join(heads, "word").groupBy("name").agg(F.max(weight).alias("best"), F.first("n").alias("n"), F.first("words").alias("words"))
    marked = cut(marked.select("name", "n", "words", F.col("best.word").alias("mark"), F.array_join("words", " ").alias("form")))

    forms = cut(marked.groupBy("form").agg(F.first("mark").alias("mark"), F.first("words").alias("words"), F.sum("n").alias("n")))
    aliases = _aliases(forms)
    found, pool = [], forms
    while not pool.isEmpty():  # each time every distinctive word settles its candidates at least
        found.append(_attach(pool, aliases))
        pool = cut(pool.join(found[-1], "form", "left_anti"))
    roots = reduce(DataFrame.unionByName, found) if found else forms.select("form", F.col("form").alias("root"))
    roots = _to_roots(_join_families(forms, _to_roots(roots), aliases))
    grouped = marked.join(roots, "form").select("name", "n", "mark", F.col("root").alias("employer"))

    # Initials: the likeliest employer among those with the same ones, unless they are a distinctive word themselves.
    heads = forms.join(roots, "form").groupBy("root").agg(F.sum("n").alias("total")).join(forms.select(F.col("form").alias("root"), "words", "mark"), "root")
    letters = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    likely = heads.where(F.size("words") > 1).groupBy(letters.alias("letters")).agg(F.max(F.struct("total", "root")).alias("b")).select("letters", F.col("b.root").alias("likely"))
    by_mark = forms.join(roots, "form").groupBy(F.col("mark").alias("letters")).agg(F.max_by("root", F.struct("n", "form")).alias("marked"))
    short = told.where("initials").select("name", "n", F.col("words")[0].alias("letters")).join(by_mark, "letters", "left").join(likely, "letters", "left")
    short = short.select("name", "n", F.coalesce("marked", "likely", F.concat(F.lit("initials "), "letters")).alias("employer"))

    linked = cut(grouped.drop("mark").unionByName(short))
    best = linked.groupBy("employer").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("name"))).alias("best"))
    return cut(linked.join(best, "employer").select("name", "n", "employer", F.col("best.name").alias("canonical")))


def name_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of one employer, the smaller first by code point."""
    a = linked.select("employer", F.col("name").alias("name_a"))
    b = linked.select("employer", F.col("name").alias("name_b"))
    return a.join(b, "employer").where("name_a < name_b").select("name_a", "name_b").distinct()
