"""Problem 4: the language of every document, and of each stretch in another language, with a confidence.

A text's probability in a language is that of its words, and a word's is the sum over all its segmentations into
pieces of a fixed public vocabulary, each segmentation having the product of the language's piece probabilities
(a forward algorithm over the piece lattice; characters outside the vocabulary are spelled in byte pieces). The
piece probabilities are learned by expectation maximisation on the labelled samples, a fixed small table.

Pieces hold no white space, and two characters side by side in no piece never share one, so the forward algorithm
factors at these places and its results are remembered by word. Each word's evidence is bounded (technical terms
and names occur in texts of any language), the sentences of a document are decoded together with a cost for each
change of language, and neighbouring sentences of one language form a stretch.

Confidence: a sentence's probability of being in a language is its evidence divided by a temperature that grows with
its number of words (words don't testify independently); the temperature's two parameters are fitted on samples that
the model of the other samples scores. A stretch's confidence is the mean of its sentences' probabilities of its
language, weighted by their words, and so falls with every doubtful sentence. A document's is the same over its whole
text, the stretches in other languages counting as not in its language.

Defined results: null and blank texts, and others without a word, have no stretch and no language; texts without a
full sentence (code, markup, bare headings) have those of their words, which p4_found leaves out, as it does records
of named fields (csv); ties go to the first language of LANGUAGES; repeated rows give repeated results; a table
without samples gives every language the same probability. Positions are code points of the stored text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import first_by_hash, read_table, tokenizer_path

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja", "ru")
#: Names of the languages in labels, beside their codes.
NAMES = {
    "english": "en", "chinese": "zh", "mandarin": "zh", "german": "de", "deutsch": "de", "french": "fr", "francais": "fr", "français": "fr",
    "spanish": "es", "espanol": "es", "español": "es", "portuguese": "pt", "portugues": "pt", "português": "pt", "japanese": "ja", "russian": "ru",
    "eng": "en", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "jpn": "ja", "rus": "ru",
}
#: Iterations of expectation maximisation, weight of the common distribution in each language's, largest evidence
#: (nats) of one word, cost of a change of language between sentences, words of a sentence that counts as full.
ITERATIONS, COMMON, MOST_EVIDENCE, CHANGE_COST, FULL_WORDS, FULL_HAN = 4, 0.1, 4.0, 5.0, 4, 6
#: The model of the samples reads this many labelled documents at most (the first by hash of the id, of those up to
#: MORE_CHARS), and those wholly in the language that their label names are added to the samples.
MORE_DOCUMENTS, MORE_CHARS = 3000, 2000
CACHE_ENTRIES = 150_000
#: Candidates for the temperature scale * words ** power, and words of the held-out pieces that they are judged on.
SCALES, POWERS, PIECE_WORDS = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0), (0.0, 0.15, 0.3, 0.45, 0.6), (1, 2, 3, 5, 8)

_RUN = re.compile(r"[぀-ヿ㐀-鿿々]+|[^\W\d_぀-ヿ㐀-鿿々]+")
_END = re.compile(r"[。！？]+[\"'”’)\]）」』]*|[.!?]+[\"'”’)\]]*(?=\s|$)|\n+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>")
_CODE = re.compile(r"[{}()\[\]=;<>_*+\"|\\]")


class _Rows(dict):
    """The row of each run in a model's table, made when it is first asked for."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> int:
        return self.model.row_of(run)


class PieceModel:
    """Piece probabilities of each language over one vocabulary, and the scores of words under them."""

    def __init__(self, pieces: list[str], weights: np.ndarray | None = None, temperature: tuple[float, float] = (1.0, 0.0)) -> None:
        self.temperature = temperature
        self.index = {p: k for k, p in enumerate(pieces)}
        self.bytes = [self.index.get(f"<0x{b:02X}>", 0) for b in range(256)]
        plain = [p for p in pieces if not re.fullmatch(r"<.*>", p)]
        self.longest = max(map(len, plain), default=1)
        self.joined = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        self.probabilities = np.full((len(pieces), len(LANGUAGES)), 1 / max(1, len(pieces))) if weights is None else weights
        self.logs = np.log(self.probabilities)
        self.table: list[np.ndarray] = []
        self.matrix = np.empty((0, len(LANGUAGES)))
        self.known = _Rows(self)
        self.parts: dict[str, np.ndarray] = {}

    def fragments(self, run: str) -> list[str]:
        """The run, in lower case and with the mark of a word's begin, cut where no piece can span."""
        word, out, begin = "▁" + run.lower(), [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.joined:
                out.append(word[begin:k])
                begin = k
        return [*out, word[begin:]]

    def lattice(self, text: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each end position, the edges (begin, pieces) that end there."""
        edges: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(text) + 1)]
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - self.longest), end):
                piece = self.index.get(text[begin:end])
                if piece is not None:
                    edges[end].append((begin, (piece,)))
            if text[end - 1] not in self.index:
                edges[end].append((end - 1, tuple(self.bytes[b] for b in text[end - 1].encode())))
        return edges

    def forward(self, edges: list, logs: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations up to each position."""
        total = np.full((len(edges), len(LANGUAGES)), -np.inf)
        total[0] = 0
        for end in range(1, len(edges)):
            ways = [total[begin] + (logs[pieces[0]] if len(pieces) == 1 else logs[list(pieces)].sum(axis=0)) for begin, pieces in edges[end]]
            total[end] = ways[0] if len(ways) == 1 else np.logaddexp.reduce(ways)
        return total

    def log_probability(self, fragment: str) -> np.ndarray:
        return self.forward(self.lattice(fragment), self.logs)[-1]

    def expected_counts(self, edges: list, times: np.ndarray, logs: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of a fragment that occurs ``times`` in each language."""
        forward = self.forward(edges, logs)
        backward = np.full_like(forward, -np.inf)
        backward[-1] = 0
        for end in range(len(edges) - 1, 0, -1):
            for begin, pieces in edges[end]:
                weight = logs[pieces[0]] if len(pieces) == 1 else logs[list(pieces)].sum(axis=0)
                posterior = np.exp(np.minimum(0, forward[begin] + weight + backward[end] - forward[-1])) * times
                for piece in pieces:
                    into[piece] += posterior
                backward[begin] = np.logaddexp(backward[begin], weight + backward[end])

    def train(self, samples: list[tuple[str, str]]) -> PieceModel:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for (language, run), times in Counter((lang, run) for lang, text in samples if lang in LANGUAGES for run in _RUN.findall((text or "").lower())).items():
            for fragment in self.fragments(run):
                counts[fragment][LANGUAGES.index(language)] += times
        if not counts:
            return self
        lattices = [(self.lattice(fragment), times) for fragment, times in counts.items()]
        size = len(self.probabilities)
        for _ in range(ITERATIONS):
            expected, logs = np.zeros_like(self.probabilities), np.log(self.probabilities)
            for edges, times in lattices:
                self.expected_counts(edges, times, logs, expected)
            own = expected / np.maximum(expected.sum(axis=0), 1e-9)
            common = 0.5 * own.mean(axis=1, keepdims=True) + 0.5 / size
            self.probabilities = (1 - COMMON) * own + COMMON * common
        self.logs = np.log(self.probabilities)
        return self

    def posterior(self, evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows of summed evidence of so many words."""
        scale, power = self.temperature
        cooled = evidence / (scale * np.maximum(words, 1) ** power)[:, None]
        likely = np.exp(cooled - cooled.max(axis=1, keepdims=True))
        return likely / likely.sum(axis=1, keepdims=True)

    def row_of(self, run: str) -> int:
        """Row of ``table`` with the bounded evidence of a run."""
        row = self.known.get(run)
        if row is None:
            evidence = np.zeros(len(LANGUAGES))
            for fragment in self.fragments(run):
                evidence += self.part_of(fragment)
            row = self.known[run] = len(self.table)
            self.table.append(evidence)
        return row

    def part_of(self, fragment: str) -> np.ndarray:
        """The bounded evidence of a fragment, remembered: runs of Chinese and Japanese share most of theirs."""
        part = self.parts.get(fragment)
        if part is None:
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            logs = self.log_probability(fragment)
            part = self.parts[fragment] = np.maximum(logs - logs.max(), -MOST_EVIDENCE)
        return part

    def evidence(self) -> np.ndarray:
        """``table`` as a matrix, of which the rows known so far are kept."""
        if len(self.matrix) != len(self.table):
            self.matrix = np.concatenate([self.matrix, np.array(self.table[len(self.matrix) :])])
        return self.matrix


def held_out_pieces(samples: list[tuple[str | None, str | None]], pieces: list[str], folds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence, words, language) of short pieces of the samples, each scored by a model of the other folds."""
    evidence, words, truth = [], [], []
    known = [(label, _RUN.findall(text)) for label, text in samples if label in LANGUAGES and text]
    for fold in range(folds):
        model = PieceModel(pieces).train([(label, " ".join(runs)) for k, (label, runs) in enumerate(known) if k % folds != fold])
        for label, runs in known[fold::folds]:
            for length in PIECE_WORDS:
                for begin in range(0, len(runs) - length + 1, 3 * length):
                    rows = [model.row_of(r) for r in runs[begin : begin + length]]
                    evidence.append(model.evidence()[rows].sum(axis=0))
                    words.append(length)
                    truth.append(LANGUAGES.index(label))
    return np.array(evidence).reshape(len(truth), len(LANGUAGES)), np.array(words, np.int64), np.array(truth, np.int64)


def fit_temperature(evidence: np.ndarray, words: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The candidate temperature under which the held-out pieces' true languages are most likely."""
    model = PieceModel([])

    def loss(candidate: tuple[float, float]) -> float:
        model.temperature = candidate
        return -float(np.log(np.maximum(model.posterior(evidence, words)[np.arange(len(truth)), truth], 1e-12)).mean())

    return min(((s, p) for s in SCALES for p in POWERS), key=loss) if len(truth) else (1.0, 0.0)


def sentences_of(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(begin, end, runs, whether a full sentence may be in it) of each sentence with words."""
    out = []
    clean = _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text
    ends = [(m.end(), m.group()[0] != "\n") for m in _END.finditer(clean)]
    begin = 0
    for end, closed in [*ends, (len(clean), False)]:
        part, at, begin = clean[begin:end], begin, end
        runs = _RUN.findall(part)
        if not runs:
            continue
        han = 0 if part.isascii() else sum([len(r) for r in runs if "぀" <= r[0] <= "鿿"])
        full = (len(runs) >= FULL_WORDS or han >= FULL_HAN) and (closed or len(runs) >= 2 * FULL_WORDS or han >= 2 * FULL_HAN)
        inner = part.strip()
        if full:
            code = len(_CODE.findall(part))
            full = inner[0] != "#" and (code <= 2 or closed and code * 12 <= sum(map(len, runs)))
        at += part.index(inner[0])
        out.append((at, at + len(inner), runs, full))
    return out


def decode(scores: np.ndarray) -> np.ndarray:
    """The best language of each sentence, when a change between neighbours costs CHANGE_COST."""
    best, back = scores[0], []
    for row in scores[1:]:
        jump = best.max() - CHANGE_COST
        back.append(np.where(best >= jump, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, jump) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def stretches(model: PieceModel, texts: list[str | None], any_words: bool = False) -> list[list[dict]]:
    """The stretches of each text: begin, end, language, confidence and number of full sentences.

    A text without a full sentence has none, or, with ``any_words``, those of its words.
    """
    documents = [sentences_of(t) if t and not t.isspace() else [] for t in texts]
    if not any_words:
        documents = [d if any([s[3] for s in d]) else [] for d in documents]
    rows: list[int] = []
    cuts: list[int] = []
    for document in documents:
        for sentence in document:
            cuts.append(len(rows))
            rows += map(model.known.__getitem__, sentence[2])
    if not cuts:
        return [[] for _ in documents]
    scores = np.add.reduceat(model.evidence()[rows], cuts, axis=0)
    full = np.array([s[3] for d in documents for s in d])
    # what can't hold a full sentence (headings, code) has a tenth of the say
    said = np.where(full[:, None], scores, scores * 0.1)
    likely = said.argmax(axis=1)
    paths, begins, at = [], [], 0
    for document in documents:
        own = likely[at : at + len(document)]
        path = own if len(document) < 2 or (own == own[0]).all() else decode(said[at : at + len(document)])
        if document:
            begins += [at, *(np.flatnonzero(path[1:] != path[:-1]) + (at + 1)).tolist()]
            paths.append(path)
        at += len(document)
    return _joined(model, documents, np.concatenate(paths), scores, begins)


def _joined(model: PieceModel, documents: list[list], path: np.ndarray, scores: np.ndarray, begins: list[int]) -> list[list[dict]]:
    """Neighbouring sentences of one language as one stretch; ``begins`` are the first sentences of all stretches."""
    words = np.array([len(s[2]) for d in documents for s in d])
    sure = model.posterior(scores, words)[np.arange(len(path)), path]
    confidence = np.round(np.add.reduceat(sure * words, begins) / np.add.reduceat(words, begins), 4).tolist()
    languages, ends = path[begins].tolist(), [*begins[1:], len(path)]
    results, at, k = [], 0, 0
    for document in documents:
        out, last = [], at + len(document)
        while k < len(begins) and begins[k] < last:
            some = document[begins[k] - at : ends[k] - at]
            out.append({
                "start_pos": some[0][0], "end_pos": some[-1][1], "lang": LANGUAGES[languages[k]], "full_sentences": sum([s[3] for s in some]), "confidence": confidence[k],
            })
            k += 1
        results.append(out)
        at = last
    return results


_models: dict[str, PieceModel] = {}


def confirmed(model: PieceModel, labelled: list[tuple[str | None, str | None]]) -> list[tuple[str, str]]:
    """The labelled texts that the model, too, finds to be wholly in the language of their label."""
    found = stretches(model, [t for _, t in labelled])
    return [(label, text) for (label, text), parts in zip(labelled, found, strict=True) if label and text and {p["lang"] for p in parts} == {label}]


def stretches_udf(spark: SparkSession, samples: DataFrame, more: DataFrame | None = None, folder: str | None = None, any_words: bool = False, calibrated: bool = True) -> Callable[[Column], Column]:
    """A column function text -> stretches, trained on ``samples`` (lang, sample_text): a fixed table of a few hundred rows.

    ``more`` (label, text), of at most MORE_DOCUMENTS rows, adds words that the short samples lack.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model", folder))
    pieces = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    labelled = [(normal_label(r.lang), r.sample_text) for r in samples.select("lang", "sample_text").collect()]
    model = PieceModel(pieces).train(labelled)
    if more is not None:
        model = PieceModel(pieces).train(labelled + confirmed(model, [(r.label, r.text) for r in more.select("label", "text").collect()]))
    temperature = fit_temperature(*held_out_pieces(labelled, pieces)) if calibrated else (1.0, 0.0)
    shared, key = spark.sparkContext.broadcast((pieces, model.probabilities, temperature)), uuid.uuid4().hex

    @F.pandas_udf("array<struct<start_pos bigint, end_pos bigint, lang string, full_sentences int, confidence double>>")
    def of(texts: pd.Series) -> pd.Series:
        own = _models.get(key)
        if own is None or len(own.table) > CACHE_ENTRIES:
            _models.clear()
            own = _models[key] = PieceModel(*shared.value)
        return pd.Series(stretches(own, texts.tolist(), any_words), dtype=object)

    return of


def normal_label(label: str | None) -> str | None:
    """The language that a label names, whatever its spelling or region; None if it says nothing."""
    first = re.split(r"[-_\s(/]", (label or "").strip().lower())[0]
    return NAMES.get(first, first if first in LANGUAGES else None)


def label_column(label: Column) -> Column:
    """``normal_label`` as a column."""
    first = F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[-_\s(/]")[0]
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair)), first), F.when(first.isin(*LANGUAGES), first))


def labelled_texts(spark: SparkSession, sf_dir: str, records: bool = True) -> DataFrame:
    """src, doc_key, label and text of both tables, with or without records of named fields (csv), which hold no sentences."""
    documents = read_table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("doc_key"), label_column(F.col("lang")).alias("label"), "text")
    catalog = read_table(spark, sf_dir, "catalog_documents")
    if not records:
        catalog = catalog.filter("coalesce(file_type, '') <> 'csv'")
    return documents.unionByName(catalog.select(F.lit("catalog_documents").alias("src"), F.col("doc_id").alias("doc_key"), label_column(F.col("language")).alias("label"), F.col("body").alias("text")))


def with_languages(spark: SparkSession, sf_dir: str, every: bool = True) -> DataFrame:
    """src, doc_key, label, stretches of each text and ``languages``, those with a full sentence.

    ``every`` row and word, or only texts that can hold a full sentence.
    """
    texts = labelled_texts(spark, sf_dir, records=every)
    chosen = first_by_hash(texts.filter((F.col("src") == "documents") & F.col("label").isNotNull()).select("doc_key"), "doc_key", MORE_DOCUMENTS)
    more = texts.filter((F.col("src") == "documents") & (F.length("text") <= MORE_CHARS)).join(chosen, "doc_key", "left_semi").orderBy("doc_key")
    of = stretches_udf(spark, read_table(spark, sf_dir, "language_samples"), more, any_words=every, calibrated=every)  # p4_found gives no confidence
    found = texts.select("src", "doc_key", "label", of("text").alias("stretches"))
    whole = F.filter("stretches", lambda s: s["full_sentences"] > 0)
    return found.withColumn("languages", F.array_distinct(F.transform(whole, lambda s: s["lang"])))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_languages(spark, sf_dir).select("src", "doc_key", F.posexplode("stretches").alias("segment_no", "s"))
    return made.select("src", "doc_key", "segment_no", "s.start_pos", "s.end_pos", "s.lang", "s.confidence")


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language (that of most of its characters), its confidence and whether it is mixed."""
    made = with_languages(spark, sf_dir)
    own = lambda name: F.filter("stretches", lambda s: s["lang"] == name)
    total = lambda name, part: F.aggregate(own(name), F.lit(0.0), lambda n, s: n + part(s))
    length = lambda s: (s["end_pos"] - s["start_pos"]).cast("double")
    names = F.array_distinct(F.transform("stretches", lambda s: s["lang"]))
    best = F.array_max(F.transform(names, lambda n: F.struct(total(n, length).alias("chars"), total(n, lambda s: length(s) * s["confidence"]).alias("sure"), n.alias("lang"))))
    every = F.aggregate("stretches", F.lit(0.0), lambda n, s: n + length(s))
    confidence = F.round(best["sure"] / every, 4)
    return made.select("src", "doc_key", "label", best["lang"].alias("lang"), confidence.alias("confidence"), (F.size("languages") > 1).alias("mixed"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each row whose label is missing or wrong, or whose text is in several languages."""
    made = with_languages(spark, sf_dir, every=False)
    right = (F.size("languages") == 1) & (F.col("languages")[0] == F.col("label"))
    return made.filter(~F.coalesce(right, F.lit(False))).select("src", "doc_key", F.explode("languages").alias("lang"))
