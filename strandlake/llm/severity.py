"""Problem 8: how abusive, hateful or sexually explicit every document is, and the rates of every source.

The ratings of a document become a severity grade for each category: 0 none of its raters, 1 fewer than half,
2 half or more (or a single rater), 3 all of several. A cumulative-link model gives P(grade >= k) = sigmoid(w.x - t_k)
with one weight vector for all thresholds of a category; x are hashed character n-grams of one sentence, in a
form in which spellings meant to hide a word are undone. A document is as severe as its most severe sentence, so
training alternates between choosing the sentence that carries a document's grade and fitting the model, each
document being judged by a model of the others, so that wrong ratings find no support. Since that fit weighs the few
carriers up, its intercepts don't fit the corpus: slope and thresholds are fitted once more on the documents' scores by
models of the others, every sampled document counting for as many as it stands for. The expected severity, the sum of
these P(grade >= k), is the score. A category is found where P(grade >= 2) is at least half with the balanced intercepts,
under which a miss counts for more than a false find, as it should where findings are reviewed.

Training reads a bounded sample (MOST_RATED rated documents of each category, MOST_CLEAN clean ones and MOST_UNRATED
that nobody rated, nearly all of which are clean, of up to MOST_CHARS characters, the first by a hash of the id);
scoring reads all documents whole.

Defined results: null, empty and blank texts score 0; repeated rows score alike; double ratings count once; a
rating whose document is missing, or a null category, is ignored; with no ratings every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import first_by_hash, materialize, read_table
from strandlake.llm.unify import INVISIBLE, one_script

CATEGORIES = ("abusive", "hateful", "sexual")
GRADES = 3
MOST_RATED, MOST_CLEAN, MOST_UNRATED, MOST_CHARS = 2500, 3000, 4000, 4000
BUCKETS, ORDERS, CHUNK = 1 << 18, (2, 3, 4, 5, 6), 400
#: Features kept: those in two rated documents at least and this many times as common there as in clean ones.
LEAST_LIFT, ROUNDS, STEPS, RATE, DECAY = 4.0, 2, 80, 0.5, 2e-5
#: Weight of all sentences that carry a grade, as a part of that of all others.
BALANCE = 0.2
#: A grade counts in full only if the model of the other folds finds its sentence with this P(grade >= 2).
FOLDS, TRUSTED, DOUBTED = 3, 0.3, 0.02

#: Digits and signs that stand for letters inside words.
STAND_INS = str.maketrans("0134578@$", "oieastbas")
_HIDDEN = re.compile(r"(?<![\w.])(?=[a-z0-9@$]*[a-z])(?=[a-z0-9@$]*[0-9@$])[a-z0-9@$]{4,}(?!\w)")
_MAY_HIDE = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
_STARS = re.compile(r"(?<=[a-z])\*+(?=[a-z])")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-*_·]){2,}\w(?!\w)")
_IN_HAN = re.compile(r"(?<=[぀-鿿])[ \-.*_·•]+(?=[぀-鿿])")
_NUMBER = re.compile(r"[0-9]+(?:[.,:][0-9]+)*")
_UNSEEN = re.compile(f"[{INVISIBLE}\u200c\u200d\ufe00-\ufe0f]")
_OTHER_LETTER = re.compile(r"[\u0370-\u03ff\u0400-\u052f]")
_MIXED_WORD = re.compile(r"[a-z][\u0370-\u03ff\u0400-\u052f]|[\u0370-\u03ff\u0400-\u052f][a-z]")
UNIT, DOCUMENT = "\x1e", "\x1d"
#: Characters that end a sentence wherever they stand; a full stop ends one before white space.
ENDS = "\n!?。"


def plain_form(text: str) -> str:
    """Lower case, one alphabet, numbers as 0, hidden spellings undone, sentences ended by UNIT."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).lower()
        others = len(_OTHER_LETTER.findall(text))
        # look-alike letters matter in words of two alphabets, and in a text that is mostly in another one
        if others and (_MIXED_WORD.search(text) or 4 * others < len(text)):
            text = one_script(text)[0]
        text = _IN_HAN.sub("", text)
    else:
        text = text.lower()
    if "*" in text:
        text = _STARS.sub("", text)
    if _MAY_HIDE.search(text):
        text = _HIDDEN.sub(lambda m: m.group().translate(STAND_INS), text)
    text = _NUMBER.sub("0", _SPACED.sub(lambda m: re.sub(r"[ .\-*_·]", "", m.group()), text))
    for end in ENDS:
        text = text.replace(end, UNIT)
    text = text.replace(". ", f"{UNIT} ").replace(f".{UNIT}", UNIT).removesuffix(".")
    return text.replace(DOCUMENT, " ")


_letters: list[np.ndarray] = []


def without_repeats(codes: np.ndarray) -> np.ndarray:
    """The codes without letters that repeat the one before."""
    if not _letters:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in re.findall(r"[^\W\d]", every)]] = True
        _letters.append(table)
    again = (codes[1:] == codes[:-1]) & _letters[0][codes[1:]]
    return codes[np.concatenate([[True], ~again])]


def features(texts: list[str], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, unit) of each n-gram of the plain forms, of the ``kept`` buckets alone if given; unit -> document; n-grams per unit."""
    joined = "".join(f" {t}{DOCUMENT}" for t in texts).replace(UNIT, f" {UNIT} ")
    codes = without_repeats(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    document_end = codes == ord(DOCUMENT)
    ends = document_end | (codes == ord(UNIT))
    stops = np.flatnonzero(ends)
    # units before each place and, for an n-gram, at its last character: equal if it lies within one unit
    before = np.cumsum(ends, dtype=np.int32) - ends
    document = np.cumsum(document_end[stops]) - document_end[stops]
    length = np.diff(stops, prepend=-1) - 1
    size = sum(np.maximum(0, length - order + 1) for order in ORDERS)
    buckets, owners = [], []
    rolling = codes.copy()
    for order in range(2, max(ORDERS) + 1):
        rolling = rolling[:-1] * np.uint32(0x01000193)
        rolling ^= codes[order - 1 :]
        if order in ORDERS:
            mixed = (rolling ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed &= np.uint32(BUCKETS - 1)
            at = np.arange(len(mixed)) if kept is None else np.flatnonzero(kept[mixed])
            last = at + order - 1
            inside = (before[at] == before[last]) & ~ends[last]
            buckets.append(mixed[at[inside]])
            owners.append(before[at[inside]])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners).astype(np.int64), document.astype(np.int64), np.maximum(1, size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CumulativeLink:
    """Weights [features] and ordered thresholds [GRADES] of one category."""

    def __init__(self, size: int) -> None:
        self.weights, self.thresholds = np.zeros(size), np.arange(1, GRADES + 1) * 1.0

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..GRADES, one row for each score."""
        return sigmoid(scores[:, None] - self.thresholds)

    def gradient(self, scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: by score, and by threshold (one row for each score)."""
        reach = np.column_stack([np.ones(len(scores)), self.at_least(scores), np.zeros(len(scores))])
        slope = reach * (1 - reach)
        row = np.arange(len(scores))
        chance = np.maximum(reach[row, grades] - reach[row, grades + 1], 1e-9)
        by_threshold = np.zeros((len(scores), GRADES + 2))
        by_threshold[row, grades] -= slope[row, grades] / chance
        by_threshold[row, grades + 1] += slope[row, grades + 1] / chance
        return (slope[row, grades] - slope[row, grades + 1]) / chance, by_threshold[:, 1 : GRADES + 1]

    def fit(self, bucket: np.ndarray, owner: np.ndarray, value: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> None:
        """Adam on the weighted mean log likelihood, L2 on the weights."""
        moments = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros(GRADES), np.zeros(GRADES)]
        share = weight / weight.sum()
        for step in range(1, STEPS + 1):
            scores = np.bincount(owner, self.weights[bucket] * value, minlength=len(grades))
            by_score, by_threshold = self.gradient(scores, grades)
            slope_w = np.bincount(bucket, (by_score * share)[owner] * value, minlength=len(self.weights)) - DECAY * self.weights
            slope_t = (by_threshold * share[:, None]).sum(axis=0)
            for k, (parameter, slope, rate) in enumerate(((self.weights, slope_w, RATE), (self.thresholds, slope_t, RATE / 3))):
                moments[2 * k] += 0.1 * (slope - moments[2 * k])
                moments[2 * k + 1] += 0.01 * (slope**2 - moments[2 * k + 1])
                parameter += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
            self.thresholds = np.maximum.accumulate(self.thresholds + np.arange(GRADES) * 1e-3)


def calibrate(scores: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(slope, thresholds) of P(grade >= k) = sigmoid(slope * score - t_k) that fit weighted documents best.

    Adam on the slope, the first threshold and the logarithms of the gaps between thresholds, which keeps them in order.
    """
    link, share = CumulativeLink(1), weight / weight.sum()
    at = np.array([0.0, 3.0, *np.zeros(GRADES - 1)])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, 801):
        gaps = np.exp(at[2:])
        link.thresholds = at[1] + np.concatenate([[0.0], np.cumsum(gaps)])
        by_score, by_threshold = link.gradient(at[0] * scores, grades)
        slopes = (by_threshold * share[:, None]).sum(axis=0)
        tail = np.cumsum(slopes[::-1])[::-1]
        slope = np.concatenate([[(by_score * share * scores).sum(), tail[0]], tail[1:] * gaps])
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        at += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(at[0]), at[1] + np.concatenate([[0.0], np.cumsum(np.exp(at[2:]))])


class SeverityModel:
    """All categories over hashed features; ``weights`` is [BUCKETS, categories] in single precision."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(CATEGORIES)), np.float32)
        self.thresholds = np.full((len(CATEGORIES), GRADES), 30.0)
        #: Slope of each category's calibrated scores, and the score from which it is found.
        self.slopes, self.least = np.ones(len(CATEGORIES)), np.full(len(CATEGORIES), np.inf)

    def train(self, texts: list[str], grades: np.ndarray, stands_for: np.ndarray | None = None, rated: np.ndarray | None = None) -> SeverityModel:
        """``grades`` [documents, categories]; all 0 means clean. ``stands_for``: how many documents each one stands for.

        A document outside ``rated`` counts as clean, but where a model of the others finds a category in it, its grade
        is unknown and it has next to no say in the intercepts of that category.
        """
        if not len(texts) or not grades.any() or grades.any(axis=1).all():
            return self
        judged = np.ones(len(texts), bool) if rated is None else rated
        rated = grades.any(axis=1)
        forms = [plain_form(t) for t in texts]
        chunks = [(k, forms[k : k + CHUNK]) for k in range(0, len(forms), CHUNK)]
        often, seldom = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for begin, chunk in chunks:
            bucket, owner, document, _ = features(chunk)
            pairs = np.sort(document[owner] * BUCKETS + bucket)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            in_rated = rated[begin + pairs // BUCKETS]
            often += np.bincount(pairs[in_rated] % BUCKETS, minlength=BUCKETS)
            seldom += np.bincount(pairs[~in_rated] % BUCKETS, minlength=BUCKETS)
        kept = (often >= 2) & (often / rated.sum() >= LEAST_LIFT * (seldom + 1) / (~rated).sum())
        number = np.cumsum(kept) - 1
        parts, units = [], 0
        for begin, chunk in chunks:
            bucket, owner, document, size = features(chunk)
            chosen = kept[bucket]
            parts.append((number[bucket[chosen]], owner[chosen] + units, document + begin, size))
            units += len(document)
        bucket, owner, document, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        value = 1 / np.sqrt(size[owner])
        lift = np.log((often[kept] + 0.1) / rated.sum()) - np.log((seldom[kept] + 0.5) / (~rated).sum())
        scores = np.tile(np.bincount(owner, lift[bucket] * value, minlength=len(document)), (len(CATEGORIES), 1))
        trust = np.ones((len(texts), len(CATEGORIES)))
        fold = np.arange(len(texts)) % FOLDS
        featured = np.bincount(owner, minlength=len(document)) > 0

        def fit(inside: np.ndarray) -> list[CumulativeLink]:
            """Models of the documents in ``inside``, by the carriers that the scores name."""
            carriers = np.column_stack([_best_units(s, document, len(texts)) for s in scores])
            models = []
            for c in range(len(CATEGORIES)):
                unit_grade, weight = np.zeros(len(document), np.int64), np.where(rated[document], 0.0, 1.0)
                for other in range(len(CATEGORIES)):
                    has = np.flatnonzero((grades[:, other] > 0) & (grades[:, c] == 0))
                    weight[carriers[has, other]] = 3 * trust[has, other]
                has = np.flatnonzero((grades[:, c] > 0) & inside)
                weight[~inside[document]] = 0
                unit_grade[carriers[has, c]] = grades[has, c]
                own = trust[has, c]
                weight[carriers[has, c]] = own * (BALANCE * weight.sum() / max(own.sum(), 1e-9))
                models.append(CumulativeLink(int(kept.sum())))
                # sentences without a kept feature all score 0: one stands for them
                active = (weight > 0) & (featured | (unit_grade > 0))
                number_of = np.cumsum(active) - 1
                rows = active[owner]
                idle = weight[~active].sum()
                models[-1].fit(bucket[rows], number_of[owner[rows]], value[rows], np.append(unit_grade[active], 0), np.append(weight[active], idle))
            return models

        for _ in range(ROUNDS):
            new, new_trust = scores.copy(), trust.copy()
            for k in range(FOLDS):
                mine = fold == k
                for c, model in enumerate(fit(~mine)):
                    found = np.bincount(owner, model.weights[bucket] * value, minlength=len(document))
                    new[c] = np.where(mine[document], found, new[c])
                    found_here = model.at_least(found[_best_units(found, document, len(texts))])[:, 1] >= TRUSTED
                    new_trust[:, c] = np.where(mine, np.where(found_here, 1, DOUBTED), new_trust[:, c])
            scores, trust = new, new_trust
        models = fit(np.ones(len(texts), bool))
        place = np.flatnonzero(kept)
        stands_for = np.ones(len(texts)) if stands_for is None else stands_for
        for c, model in enumerate(models):
            if grades[:, c].any():
                best = scores[c][_best_units(scores[c], document, len(texts))]  # by models of the other folds
                slope, self.thresholds[c] = calibrate(best, grades[:, c], stands_for * np.where(grades[:, c] > 0, trust[:, c], np.where(judged | (trust[:, c] < 1), 1, DOUBTED)))
                self.slopes[c], self.least[c] = max(slope, 0.0), model.thresholds[1]
                self.weights[place, c] = model.weights
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each document's most severe sentence, [documents, categories]; -inf for blank texts."""
        out = np.full((len(texts), len(CATEGORIES)), -np.inf)
        some = [k for k, t in enumerate(texts) if t and not t.isspace()]
        if some:
            bucket, owner, document, size = features([plain_form(texts[k]) for k in some], self.weights.any(axis=1))
            starts = np.searchsorted(document, np.arange(len(some)))
            for c in range(len(CATEGORIES)):
                out[some, c] = np.maximum.reduceat(np.bincount(owner, self.weights[bucket, c], minlength=len(document)) / np.sqrt(size), starts)
        return out

    def reach(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) in the corpus, [documents, categories, GRADES]; 0 for blank texts."""
        with np.errstate(invalid="ignore"):
            made = sigmoid((self.slopes * scores)[:, :, None] - self.thresholds)
        return np.where(np.isfinite(scores)[:, :, None], made, 0.0)

    def found(self, scores: np.ndarray) -> np.ndarray:
        return scores >= self.least


def _best_units(scores: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
    order = np.lexsort((np.arange(len(scores)), -scores, document))
    first = np.searchsorted(document[order], np.arange(documents))
    return order[first]


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and one grade for each category."""
    votes = labels.filter("doc_id is not null and category is not null and rater is not null").select("doc_id", "rater", "category").distinct()
    made = votes.groupBy("doc_id").agg(F.countDistinct("rater").alias("raters"), *(F.sum((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES))
    grade = lambda c: F.when(F.col(c) == 0, 0).when(2 * F.col(c) < F.col("raters"), 1).when((F.col(c) < F.col("raters")) | (F.col("raters") == 1), 2).otherwise(3)
    return made.select("doc_id", *(grade(c).alias(c) for c in CATEGORIES))


def train_model(documents: DataFrame, labels: DataFrame) -> SeverityModel:
    """A model from a bounded sample of the rated documents, chosen by their ids before any text is read."""
    known = materialize(graded(labels))
    counts = known.agg(F.count(F.lit(1)).alias("rated"), F.sum((F.expr("+".join(CATEGORIES)) == 0).cast("int")).alias("clean"), *(F.sum((F.col(c) > 0).cast("int")).alias(c) for c in CATEGORIES)).first()
    number = lambda c: counts[c] or 0
    unrated = max(0, documents.count() - number("rated"))
    sample = first_by_hash(known.filter("+".join(CATEGORIES) + " = 0"), "doc_id", MOST_CLEAN, number("clean"))
    for c in CATEGORIES:
        sample = sample.unionByName(first_by_hash(known.filter(F.col(c) > 0), "doc_id", MOST_RATED, number(c)))
    others = documents.select("doc_id").join(known.select("doc_id"), "doc_id", "left_anti")
    sample = sample.withColumn("rated", F.lit(True)).unionByName(first_by_hash(others, "doc_id", MOST_UNRATED, unrated).select("doc_id", *(F.lit(0).alias(c) for c in CATEGORIES), F.lit(False).alias("rated")))
    texts = documents.filter(F.length("text").between(1, MOST_CHARS)).select("doc_id", "text")
    rows = texts.join(F.broadcast(sample.dropDuplicates(["doc_id"])), "doc_id").toPandas().sort_values("doc_id")  # MOST_* ids
    grades = rows[list(CATEGORIES)].to_numpy(np.int64).reshape(len(rows), len(CATEGORIES))
    rated, clean = rows["rated"].to_numpy(bool), ~grades.any(axis=1)
    stands_for = np.ones(len(rows))
    for stratum, size in ((~rated, unrated), (rated & clean, number("clean")), (rated & ~clean, number("rated") - number("clean"))):
        stands_for[stratum] = max(1.0, size / max(1, stratum.sum()))
    return SeverityModel().train(rows["text"].tolist(), grades, stands_for, rated)


def severity_udf(spark: SparkSession, model: SeverityModel) -> Callable[[Column], Column]:
    """A column function text -> expected severity and found of each category."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES) + ", found array<string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        scores = np.concatenate([own.scores(texts.iloc[k : k + CHUNK].tolist()) for k in range(0, len(texts), CHUNK)]) if len(texts) else np.zeros((0, len(CATEGORIES)))
        out = pd.DataFrame(own.reach(scores).sum(axis=2).round(6), columns=list(CATEGORIES))
        out["found"] = [[c for c, yes in zip(CATEGORIES, row, strict=True) if yes] for row in own.found(scores)]
        return out

    return of


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    of = severity_udf(spark, train_model(documents, read_table(spark, sf_dir, "content_labels")))
    return documents.select("doc_id", "source", of("text").alias("s")).select("doc_id", "source", "s.*")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, sf_dir).drop("found")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, share with each category and mean severity, of every source (a null source is one, too)."""
    scored = score_documents(spark, sf_dir)
    share = [F.round(F.avg(F.array_contains("found", c).cast("int")), 6).alias(f"{c}_rate") for c in CATEGORIES]
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *share, *(F.round(F.avg(c), 6).alias(f"{c}_severity") for c in CATEGORIES))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, sf_dir).select("doc_id", F.explode("found").alias("category"))
