"""Toxicity by weak supervision.

Voters look at a text's words: a few lexicons vote when one of their words occurs, and patterns when
several do. The words are those that labels find typical of toxic documents; no word is given. Words are counted by label over all
labelled documents, and every word that passes a test joins the lexicon: it is in more than 9 toxic
documents for a clean one, and its count is beyond chance at some rate of false discoveries
(Benjamini and Hochberg's steps over the words of some least number of documents, that by which most pass).
Words are dealt to the lexicons in turn, so that voters stay few however many words there are, and each
holds words of all languages: lexicons of one language each would not be independent given the class.
The rate and the number of lexicons are those of ``CHOICES`` by which posteriors fit labels best in ``FOLDS`` folds of
the labelled documents, each judged by words, votes and rates learned from the others.

A generative label model takes the votes' first and second moments over all documents: covariances of
voters that are independent given the class factor into accuracies (the triplet identity), what the
factors leave over is correlation, and correlated voters share one weight. The given labels are one more
voter, present on some documents, whose accuracy is estimated alike from the moments over those; labels
also give the share of toxic documents. The model's posteriors, not labels, are the targets of a linear
classifier over votes and hashed word frequencies; that classifier scores all documents.

Bounds: the linear classifier alone is trained on a sample of at most ``SAMPLE`` labelled documents (of
any, where none is labelled), the smallest by a hash of doc_id. The driver gets their features, at most
``WIDTH`` a document however long it is, beside the learned words and a few thousand sums.

Defined cases: a null or empty text gets the classifier's bias; without labels of both kinds the
posterior is the share of toxic ones, as there are no words; a null doc_id is scored and never learned from;
repeated rows get equal scores, and of rows of one doc_id the least text is in the sample; of equal
counts of words the order is that of their fingerprints; a very long text is scored whole; empty tables
of documents or labels are allowed, the first giving no rows; labels with nulls or of unknown documents
aren't learned from; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import store
from sievework.llm import textkit as K
from sievework.llm.language import held_out

#: Labelled documents that the linear classifier is trained on at most.
SAMPLE = 6000
#: No label is held for truer than 1 less this.
TRUST = 0.02
#: Rates of false discoveries, and lexicons that words are dealt to, to choose from.
CHOICES = tuple((rate, voters) for rate in (0.02, 0.1) for voters in (6, 12, 24))
FOLDS = 3
#: Hashed word features.
WIDTH = 1 << 14
#: The score from which a document counts as toxic.
THRESHOLD = 0.7
PATTERNS = ("two_insults", "three_insults", "insult_density", "second_person_insult")

_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_YOU = ("you", "your", "youre")


def name_of(word: str) -> int:
    """The fingerprint of a lower-cased word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(K.RangeHash(raw).of(np.array([0]), np.array([len(raw)]))[0])


YOU = np.array(sorted(name_of(w) for w in _YOU), np.uint64)


def block_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of each word: runs of letters and of bytes outside ASCII, A-Z lowered."""
    buf = K.LOWER[buf]
    start, end = K.runs(_WORD[buf], off)
    return K.owner(off, start), K.RangeHash(buf).of(start, end)


def _isin(names: np.ndarray, sorted_names: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return sorted_names[place] == names


@dataclass
class Lexicon:
    """Sorted fingerprints, the lexicon of each, and the number of lexicons."""

    names: np.ndarray
    voter: np.ndarray
    size: int

    @classmethod
    def of(cls, learned: list[int], size: int) -> Lexicon:
        """Words by rank, dealt in turn."""
        names = np.array(learned, np.uint64)
        order = np.argsort(names)
        return cls(names[order], order % size, size)

    def hits(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that it holds, their places in it)."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        at = np.flatnonzero(self.names[place] == names)
        return at, place[at]


def votes(doc: np.ndarray, names: np.ndarray, n: int, lexicon: Lexicon, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """n x (voters and patterns) matrix of 0 and 1."""
    out = np.zeros((n, lexicon.size + len(PATTERNS)), np.float32)
    hit, place = found or lexicon.hits(names)
    out[doc[hit], lexicon.voter[place]] = 1
    insults = K.per_doc(doc[hit], n)
    words = np.maximum(K.per_doc(doc, n), 1)
    near = hit[hit > 0]
    led = near[(doc[near - 1] == doc[near]) & _isin(names[near - 1], YOU)] if len(near) else near
    out[:, -4] = insults >= 2
    out[:, -3] = insults >= 3
    out[:, -2] = (insults > 0) & (insults * 100 >= words)
    out[:, -1] = K.per_doc(doc[led], n) > 0
    return out


def features(doc: np.ndarray, names: np.ndarray, n: int, ballots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, feature, weight) of word frequencies, and the votes."""
    words = np.maximum(K.per_doc(doc, n), 1)
    return doc.astype(np.int32), (names >> np.uint64(50)).astype(np.int32) % WIDTH, (10.0 / words[doc]).astype(np.float32), ballots


def _moments_kernel(lexicon: Lexicon):
    """Sums of products of votes, with a leading 1, and a last column for the label where rows have one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows, buf, off in K.blocks(batches):
            n = len(off) - 1
            columns = [np.ones(n, np.float32), votes(*block_words(buf, off), n, lexicon)]
            if "toxic" in rows.schema.names:
                columns.append(rows.column("toxic").to_numpy(zero_copy_only=False) == 1)
            ballots = np.column_stack(columns).astype(np.float64)
            total = ballots.T @ ballots + (0 if total is None else total)
        if total is not None:
            at = np.flatnonzero(total)
            yield K.table(at=at.astype(np.int32), x=total.ravel()[at])

    return kernel


def _moments(df: DataFrame, lexicon: Lexicon, size: int) -> np.ndarray:
    out = np.zeros(size * size)
    for r in K.map_blocks(df, _moments_kernel(lexicon), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(size, size)


def _counts_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label by word and fold."""
    for rows, buf, off in K.blocks(batches):
        doc, names = block_words(buf, off)
        toxic, fold = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "fold"))
        order = np.lexsort((names, doc))
        doc, names = doc[order], names[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (names[1:] != names[:-1])
        doc, names = doc[new], names[new]
        cells = fold[doc].astype(np.int64) * 2 + (toxic[doc] == 1)
        unique, which = np.unique(names, return_inverse=True)
        counts = np.bincount(which * 2 * FOLDS + cells, minlength=2 * FOLDS * len(unique)).reshape(-1, 2 * FOLDS) if len(unique) else np.zeros((0, 2 * FOLDS), np.int64)
        columns = {f"{kind}{k}": counts[:, 2 * k + bad].astype(np.int64) for k in range(FOLDS) for kind, bad in (("toxic", 1), ("clean", 0))}
        yield K.table(name=unique.view(np.int64), **columns)


@dataclass
class LabelModel:
    """Voting rates given either class, the share of toxic documents, and a weight for each voter; ``marker``
    are the rates at which a toxic label is given to clean and to toxic documents."""

    prior: float
    rates: np.ndarray
    weights: np.ndarray
    marker: tuple[float, float] = (0.5, 0.5)

    def posterior(self, ballots: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """The chance that a document is toxic by its votes, and by its label where it has one."""
        for_one = np.log(self.rates[:, 1] / self.rates[:, 0])
        against = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        odds = np.log(self.prior / (1 - self.prior)) + ballots @ (self.weights * for_one) + (1 - ballots) @ (self.weights * against)
        if labels is not None:
            clean, toxic = self.marker
            odds = odds + np.where(labels == 1, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean)))
        return 1 / (1 + np.exp(-odds.clip(-40, 40)))


def voting_gaps(moments: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and covariances of votes, and how much oftener each votes for toxic documents than for clean ones.

    Voters that are independent given the class obey cov_ij cov_ik / cov_jk = prior (1 - prior) gap_i^2, for
    any j and k; the median of these triplets stands.
    """
    total = max(moments[0, 0], 1.0)
    mean = moments[0, 1:] / total
    cov = moments[1:, 1:] / total - np.outer(mean, mean)
    m = len(mean)
    gap = np.zeros(m)
    upper = np.triu(np.ones((m, m), bool), 1)
    for i in range(m):
        with np.errstate(divide="ignore", invalid="ignore"):
            of_pairs = np.outer(cov[i], cov[i]) / cov
        fits = upper & (cov > 1e-9) & np.outer(cov[i] > 0, cov[i] > 0)
        fits[i], fits[:, i] = False, False
        gap[i] = np.sqrt(np.median(of_pairs[fits]) / (prior * (1 - prior))) if fits.any() else 0.0
    # No voter's rates leave 0 to 1, and a voter that no pair speaks for is worth nothing.
    return mean, cov, np.minimum(gap, np.minimum(mean / prior, (1 - mean) / (1 - prior)).clip(0, 1))


def fit_label_model(moments: np.ndarray, prior: float, labelled: np.ndarray | None = None) -> LabelModel:
    """moments: sums of products of votes, with a leading 1, over all documents; prior: the share of toxic
    ones; labelled: the same sums over labelled documents, with the label as a last voter.

    What any voter is worth, the label among them, follows from how votes coincide.
    """
    prior = float(np.clip(prior, 0.005, 0.5))
    mean, cov, gap = voting_gaps(moments, prior)
    rates = np.stack((mean - prior * gap, mean + (1 - prior) * gap), 1).clip(1e-4, 1 - 1e-4)
    # What covariances hold beyond the class's part, as correlations; partners share their weight.
    gap = rates[:, 1] - rates[:, 0]
    deviation = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    rest = (cov - prior * (1 - prior) * np.outer(gap, gap)) / np.outer(deviation, deviation)
    np.fill_diagonal(rest, 0)
    weights = 1 / (1 + np.where(rest > 0.1, rest, 0).sum(axis=1))
    weights[gap <= 0] = 0
    model = LabelModel(prior, rates, weights)
    if labelled is not None:
        mean, _, gap = voting_gaps(labelled, prior)
        model.marker = tuple(float(np.clip(x, TRUST, 1 - TRUST)) for x in (mean[-1] - prior * gap[-1], mean[-1] + (1 - prior) * gap[-1]))
    return model


@dataclass
class Linear:
    """A linear classifier over hashed word frequencies and votes."""

    words: np.ndarray
    votes: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, ballots: np.ndarray) -> np.ndarray:
        odds = np.bincount(doc, self.words[feature] * weight, len(ballots)) if len(doc) else np.zeros(len(ballots))
        odds = odds + ballots @ self.votes + self.bias
        return 1 / (1 + np.exp(-odds.clip(-40, 40)))


def fit_linear(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, ballots: np.ndarray, target: np.ndarray, rounds: int = 100) -> Linear:
    """Logistic regression on soft labels by gradient steps with momentum."""
    # Both classes weigh alike, so a score is the chance where toxic documents are as many as clean ones.
    toxic = float(np.clip(target.mean() if len(target) else 0.5, 0.005, 0.995))
    share = (target / toxic + (1 - target) / (1 - toxic)) / 2 / max(len(target), 1)
    model = Linear(np.zeros(WIDTH), np.zeros(ballots.shape[1]), 0.0)
    speed = [np.zeros(WIDTH), np.zeros(ballots.shape[1]), 0.0]
    for _ in range(rounds if len(target) else 0):
        off = (model.score(doc, feature, weight, ballots) - target) * share
        slopes = (np.bincount(feature, off[doc] * weight, WIDTH) + 1e-3 * model.words, ballots.T @ off + 1e-5 * model.votes, float(off.sum()))
        for i, (slope, rate) in enumerate(zip(slopes, (1.0, 4.0, 4.0), strict=True)):
            speed[i] = 0.9 * speed[i] - rate * slope
        model = Linear(model.words + speed[0], model.votes + speed[1], model.bias + speed[2])
    return model


def evidence(toxic: float, clean: float, prior: float) -> float:
    """-ln of a bound (Chernoff's; for clean = 0 the value itself) of the chance that so many of the
    documents that hold a word are toxic, when the word has nothing to do with it."""
    n = toxic + clean
    if toxic <= n * prior:
        return 0.0
    return toxic * math.log(toxic / (n * prior)) + (clean * math.log(clean / (n * (1 - prior))) if clean else 0.0)


def typical_shapes(shapes: dict[tuple[int, int], int], totals: dict[int, int], prior: float, rate: float = 0.1) -> list[tuple[int, int]]:
    """The (toxic, clean) whose words are typical, most evidence first. shapes: words by (toxic, clean),
    of the candidates; totals: words by documents, of all."""
    ranked = sorted(((evidence(*shape, prior), shape, n) for shape, n in shapes.items()), reverse=True)
    order = np.array(sorted(totals), np.int64)
    tests = np.cumsum([totals[x] for x in order.tolist()][::-1])[::-1].tolist()
    best: tuple[int, list[tuple[int, int]]] = (0, [])
    # How many documents hold a word says nothing of its label, so any least number keeps the rate.
    for least, n_tests in zip(order.tolist(), tests, strict=True):
        found, passed, kept = 0, 0, 0
        own = [(value, shape, n) for value, shape, n in ranked if sum(shape) >= least]
        for i, (value, _, n) in enumerate(own):
            found += n
            if value >= math.log(n_tests / rate / found):
                passed, kept = found, i + 1
        if passed > best[0]:
            best = (passed, [shape for _, shape, _ in own[:kept]])
        if -least * math.log(prior) >= math.log(n_tests / rate):
            break  # every pure word passes from here on
    return best[1]


def word_counts(labelled: DataFrame) -> DataFrame:
    """A row for each word: toxic and clean documents of each fold that hold it."""
    columns = [f"{kind}{k}" for k in range(FOLDS) for kind in ("toxic", "clean")]
    counted = K.map_blocks(labelled.select("text", "toxic", "fold"), _counts_kernel, "name long, " + ", ".join(f"{c} long" for c in columns))
    return store.written(counted.groupBy("name").agg(*[F.sum(c).alias(c) for c in columns]), "words")


def typical_words(words: DataFrame, n: dict[tuple[int, bool], int], rates: list[float], without: int | None = None) -> dict[float, list[int]]:
    """Fingerprints of all words that are typical of toxic documents, most evidence first, for each rate of false
    discoveries; n: documents by fold and label; ``without``: a fold that is left out."""
    folds = [k for k in range(FOLDS) if k != without]
    toxic, clean = (sum(n.get((k, bad), 0) for k in folds) for bad in (True, False))
    if not toxic or not clean:
        return {rate: [] for rate in rates}
    prior = toxic / (toxic + clean)
    total = lambda kind: sum((F.col(f"{kind}{k}") for k in folds[1:]), F.col(f"{kind}{folds[0]}")).alias(kind)
    words = words.select("name", total("toxic"), total("clean")).where("toxic + clean > 0")
    candidates = words.where("toxic > 9 * clean")
    shapes = {(r["toxic"], r["clean"]): r["n"] for r in candidates.groupBy("toxic", "clean").agg(F.count("*").alias("n")).collect()}
    totals = {r["total"]: r["n"] for r in words.groupBy(F.least(F.col("toxic") + F.col("clean"), F.lit(100_000)).alias("total")).agg(F.count("*").alias("n")).collect()}
    kept = {rate: {shape: i for i, shape in enumerate(typical_shapes(shapes, totals, prior, rate))} for rate in rates}
    if not any(kept.values()):
        return {rate: [] for rate in rates}
    some = labels_frame(words, sorted(set().union(*kept.values())))
    found = [((r["toxic"], r["clean"]), r["name"]) for r in candidates.join(F.broadcast(some), ["toxic", "clean"]).collect()]
    return {rate: [int(np.int64(name).view(np.uint64)) for _, name in sorted((rank[shape], name) for shape, name in found if shape in rank)] for rate, rank in kept.items()}


def labels_frame(words: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    return words.sparkSession.createDataFrame(shapes, "toxic long, clean long")


def _folds_kernel(lexicons: dict[tuple[float, int], list[int]], models: list[LabelModel] | None):
    """For each choice, over documents whose fold the words weren't learned from: sums of products of votes, with a leading 1
    and the label as last voter; or, given models, the sum of posteriors' log losses."""
    ready = {key: Lexicon.of(words, 1) for key, words in lexicons.items()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        ranks = {key: {int(x): i for i, x in enumerate(words)} for key, words in lexicons.items()}
        order = {key: np.array([ranks[key][int(x)] for x in ready[key].names], np.int64) for key in ready}
        for rows, buf, off in K.blocks(batches):
            doc, names = block_words(buf, off)
            toxic, fold = rows.column("toxic").to_numpy(zero_copy_only=False) == 1, rows.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                own = np.flatnonzero(fold == k)
                if not len(own):
                    continue
                place = np.full(len(off) - 1, -1)
                place[own] = np.arange(len(own))
                mine = place[doc] >= 0
                d, w = place[doc[mine]], names[mine]
                hits = {rate: ready[rate, k].hits(w) for rate in {r for r, _ in CHOICES}}
                for i, (rate, size) in enumerate(CHOICES):
                    lexicon = Lexicon(ready[rate, k].names, order[rate, k] % size, size)
                    ballots = votes(d, w, len(own), lexicon, hits[rate]).astype(np.float64)
                    if models is None:
                        x = np.column_stack((np.ones(len(own)), ballots, toxic[own]))
                        sums[i] = sums.get(i, 0) + x.T @ x
                    else:
                        p = models[i].posterior(ballots).clip(1e-9, 1 - 1e-9)
                        sums[i] = sums.get(i, 0) - np.log(np.where(toxic[own], p, 1 - p)).sum(keepdims=True)
        for i, x in sums.items():
            at = np.flatnonzero(x)
            yield K.table(choice=np.full(len(at), i, np.int32), at=at.astype(np.int32), x=x.ravel()[at])

    return kernel


def choose(labelled: DataFrame, words: DataFrame, n: dict[tuple[int, bool], int], prior: float) -> tuple[float, int]:
    """The choice of the least log loss over folds; of equal ones the first."""
    rates = sorted({r for r, _ in CHOICES})
    lexicons = {(rate, k): found for k in range(FOLDS) for rate, found in typical_words(words, n, rates, k).items()}
    rows = labelled.select("text", "toxic", "fold")
    schema = "choice int, at int, x double"
    sums = [np.zeros((v + len(PATTERNS) + 2) ** 2) for _, v in CHOICES]
    for r in K.map_blocks(rows, _folds_kernel(lexicons, None), schema).groupBy("choice", "at").agg(F.sum("x").alias("x")).collect():
        sums[r["choice"]][r["at"]] = r["x"]
    models = []
    for x in sums:
        side = math.isqrt(len(x))
        models.append(fit_label_model(x.reshape(side, side)[:-1, :-1], prior))
    losses = {r["choice"]: r["x"] for r in K.map_blocks(rows, _folds_kernel(lexicons, models), schema).groupBy("choice").agg(F.sum("x").alias("x")).collect()}
    return CHOICES[min(range(len(CHOICES)), key=lambda i: (round(losses.get(i, math.inf), 6), i))]


def _features_kernel(lexicon: Lexicon):
    """Sparse features and votes of each document, as bytes: at most ``WIDTH`` features, however long it is."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches):
            n = len(off) - 1
            doc, names = block_words(buf, off)
            ballots = votes(doc, names, n, lexicon).astype(np.uint8)
            doc, feature, weight, _ = features(doc, names, n, ballots)
            cells, which = np.unique(doc.astype(np.int64) * WIDTH + feature, return_inverse=True)
            weight = np.bincount(which, weight, len(cells)).astype(np.float32) if len(cells) else np.zeros(0, np.float32)
            bounds = np.searchsorted(cells, np.arange(n + 1) * WIDTH).tolist()
            feature = (cells % WIDTH).astype(np.int32)
            pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield K.table(
                doc_id=rows.column("doc_id"),
                toxic=rows.column("toxic"),
                features=pa.array([feature[a:b].tobytes() for a, b in pairs], pa.binary()),
                weights=pa.array([weight[a:b].tobytes() for a, b in pairs], pa.binary()),
                ballots=pa.array([x.tobytes() for x in ballots], pa.binary()),
            )

    return kernel


@dataclass
class Fitted:
    lexicon: Lexicon
    labels: LabelModel
    linear: Linear


def fit(docs: DataFrame, labels: DataFrame) -> Fitted:
    """Fit on ``labels`` (doc_id, toxic) and ``docs`` (doc_id, text)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Labels grow with the corpus, so the join has one form at all sizes: texts that may be labelled are dealt once.
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    labelled = store.written(docs.join(known.hint("merge"), "doc_id").select("doc_id", "text", "toxic", fold.alias("fold")), "labelled")
    n = {(r["fold"], r["toxic"]): r["n"] for r in labelled.groupBy("fold", (F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(v for (_, bad), v in n.items() if bad == kind) for kind in (True, False))
    prior = toxic / (toxic + clean) if toxic and clean else 0.0
    found, voters = [], CHOICES[0][1]
    if prior:
        words = word_counts(labelled)
        rate, voters = choose(labelled, words, n, prior)
        found = typical_words(words, n, [rate])[rate]
        store.discard(words)
    lexicon = Lexicon.of(found, voters)
    m = lexicon.size + len(PATTERNS) + 1
    judged = _moments(labelled.select("text", "toxic"), lexicon, m + 1) if prior else None
    model = fit_label_model(_moments(docs.select("text"), lexicon, m), prior, judged)
    rows = labelled if prior else docs.where("doc_id IS NOT NULL").withColumn("toxic", F.lit(None).cast("int"))
    few = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("doc_id", "row.*")  # a row for each id
    rows = K.map_blocks(sample, _features_kernel(lexicon), "doc_id long, toxic int, features binary, weights binary, ballots binary").orderBy("doc_id").collect()
    count = [len(r["features"]) // 4 for r in rows]
    feature, weight = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("features", np.int32), ("weights", np.float32)))
    ballots = np.frombuffer(b"".join(r["ballots"] for r in rows), np.uint8).reshape(len(rows), m - 1).astype(np.float32)
    target = model.posterior(ballots, np.array([r["toxic"] for r in rows]) if prior else None)
    store.discard(labelled)
    return Fitted(lexicon, model, fit_linear(np.repeat(np.arange(len(rows)), count), feature, weight, ballots, target))


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id and score of every document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches):
            n = len(off) - 1
            doc, names = block_words(buf, off)
            yield K.table(doc_id=rows.column("doc_id"), score=fitted.linear.score(*features(doc, names, n, votes(doc, names, n, fitted.lexicon))))

    return K.map_blocks(docs.select("doc_id", "text"), kernel, "doc_id long, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; learned from labels of documents that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(3, 1))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
