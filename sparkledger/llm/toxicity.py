"""Toxic texts by weak supervision.

1. Voters: lexicons mined from labelled rows (words and word beginnings that toxic
   texts hold far more often, dealt to several voters), a fixed lexicon, and patterns
   (capitals, exclamation marks, symbols, repeated words). Each says yes or no.
2. Label model: the voters' means and joint frequencies over *all* texts. If one hidden
   label explains them, the covariance of two voters is the product of their lifts;
   pairs that stray from that are correlated. Lifts (so accuracies) are fitted on the
   other pairs, and correlated voters share their say in the posterior.
3. A logistic regression on the mined words and word beginnings, each on its own, and on
   the votes is trained on the posterior labels, and scores every text.

Labels serve to mine the lexicons, to set the share of toxic texts and to start the
fit. Mining and training use at most SAMPLE_ROWS labelled rows (those of the smallest
id hash); the label model covers all texts. Null texts count as empty; empty texts get
the score of a text without features. Without labels, or with labels of one kind only,
every score is the share of toxic labels (0 for none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .arrays import Words, lists, mix, pieces, signed

SAMPLE_ROWS = 20_000
PREFIX_BYTES = 5
LEXICON_SIZE = 600
#: A mined entry occurs in this many toxic texts and has this log odds ratio.
LEAST_TEXTS, LEAST_ODDS = 4, 3.0
WORD_VOTERS, PREFIX_VOTERS = 5, 3
#: Correlation beyond what the hidden label explains.
CORRELATED = 0.15

# Insults that stand on their own.
INSULTS = "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown imbecile jerk bastard idiota estúpido imbécil crétin abruti dummkopf trottel vollidiot".split()

PATTERNS = ("insult", "capitals", "exclaims", "symbols", "repeats")
VOTERS = WORD_VOTERS + PREFIX_VOTERS + len(PATTERNS) + 1


class _Text:
    """Words and word beginnings of a batch, as hashes with the text they stand in."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, lower=True, letters=True)
        self.doc = np.repeat(np.arange(len(self.words)), self.words.counts)
        self.word = self.words.hash
        begins = self.words.hash_until(np.minimum(self.words.start + PREFIX_BYTES, self.words.end))
        self.prefix = mix(begins + np.uint64(1))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, entry) pairs, each once; entries are words and word beginnings."""
        doc, entry = np.tile(self.doc, 2), np.concatenate([self.word, self.prefix])
        order = np.lexsort((entry, doc))
        doc, entry = doc[order], entry[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (entry[1:] != entry[:-1])
        return doc[new], entry[new]

    def holding(self, entries: np.ndarray, mined: np.ndarray) -> np.ndarray:
        """How many words of each text are among ``mined`` (sorted)."""
        if not len(mined):
            return np.zeros(len(self.words), dtype=np.int64)
        at = np.minimum(np.searchsorted(mined, entries), len(mined) - 1)
        return np.bincount(self.doc[mined[at] == entries], minlength=len(self.words))

    def share(self, marked: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Share of each text's bytes in ``of`` that are in ``marked``."""
        both = []
        for table in (marked, of):
            sums = np.concatenate([[0], np.cumsum(table[self.words.data])])
            both.append(sums[self.words.offsets[1:]] - sums[self.words.offsets[:-1]])
        return both[0] / np.maximum(1, both[1])


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LETTER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_EXCLAIM, _SYMBOL, _ANY = _bytes("!"), _bytes("#$%&*"), np.ones(256, dtype=np.int64)


class Lexicons:
    """Mined entries by voter, and the fixed lexicon; all as sorted hashes."""

    def __init__(self, words: np.ndarray, prefixes: np.ndarray):
        self.words = [np.sort(words[k::WORD_VOTERS]) for k in range(WORD_VOTERS)]
        self.prefixes = [np.sort(prefixes[k::PREFIX_VOTERS]) for k in range(PREFIX_VOTERS)]
        self.entries = np.sort(np.concatenate([words, prefixes]))
        self.fixed = np.sort(Words(pa.array(INSULTS), lower=True, letters=True).hash)

    def votes(self, text: _Text) -> np.ndarray:
        """Texts x VOTERS, 1 for yes."""
        found = [text.holding(text.word, x) for x in self.words] + [text.holding(text.prefix, x) for x in self.prefixes]
        again = np.zeros(len(text.doc), dtype=np.int64)
        again[1:] = (text.word[1:] == text.word[:-1]) & (text.doc[1:] == text.doc[:-1])
        repeats = np.bincount(text.doc, weights=again, minlength=len(text.words)) / np.maximum(1, text.words.counts)
        yes = [x > 0 for x in found]
        yes += [text.holding(text.word, self.fixed) > 0, text.share(_UPPER, _LETTER) > 0.5, text.share(_EXCLAIM, _ANY) > 0.05, text.share(_SYMBOL, _ANY) > 0.05, repeats > 0.2]
        yes += [np.sum(found, axis=0) > 1]
        return np.stack(yes, axis=1).astype(np.float64)


class LabelModel:
    """Chance of a yes from each voter for toxic and other texts, and its say among correlated voters."""

    def __init__(self, mean: np.ndarray, joint: np.ndarray, share: float, lift: np.ndarray):
        """``lift``: first guess of P(yes | toxic) - P(yes | other)."""
        spread = joint - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        part = np.sqrt(share * (1 - share))
        v = lift * part
        plain = ~np.eye(len(mean), dtype=bool)
        for _ in range(50):
            stray = np.abs(spread - np.outer(v, v)) / np.outer(scale, scale)
            use = plain & (stray <= CORRELATED)
            target, weight = spread * use, use @ (v * v)
            v = np.where(weight > 1e-12, 0.5 * v + 0.5 * (target @ v) / np.maximum(weight, 1e-12), v)
            v = np.clip(v, -scale, scale)
        self.correlated = plain & (np.abs(spread - np.outer(v, v)) / np.outer(scale, scale) > CORRELATED)
        lift = v / part
        self.toxic = np.clip(mean + (1 - share) * lift, 1e-4, 1 - 1e-4)
        self.other = np.clip(mean - share * lift, 1e-4, 1 - 1e-4)
        self.say = 1 / (1 + self.correlated.sum(axis=1))
        self.prior = np.log(share / (1 - share))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.toxic / self.other), np.log((1 - self.toxic) / (1 - self.other))
        return 1 / (1 + np.exp(-np.clip(self.prior + votes @ (self.say * yes) + (1 - votes) @ (self.say * no), -30, 30)))


def _features(text: _Text, lexicons: Lexicons, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: mined entries, then the votes."""
    doc, entry = text.distinct()
    mined = lexicons.entries
    at = np.searchsorted(mined, entry)
    hit = np.zeros(len(entry), dtype=bool)
    hit[at < len(mined)] = mined[at[at < len(mined)]] == entry[at < len(mined)]
    said, voter = np.nonzero(votes)
    return np.concatenate([doc[hit], said]), np.concatenate([at[hit], voter + len(mined)])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, is_word, toxic, texts): a task's counts of texts with each entry."""
    for batch in pieces(batches):
        text = _Text(batch.column(0))
        toxic = batch.column(1).to_numpy()
        doc, entry = text.distinct()
        keys, at = np.unique(entry, return_inverse=True)
        n, hits = np.bincount(at), np.bincount(at, weights=toxic[doc]).astype(np.int64)
        word = np.isin(keys, text.word)
        yield pa.record_batch([pa.array(signed(keys)), pa.array(word), pa.array(hits), pa.array(n)], names=["entry", "is_word", "toxic", "texts"])


class ToxicityModel:
    """Lexicons and one weight for each feature; ``base`` is the score without any."""

    def __init__(self, lexicons: Lexicons, weights: np.ndarray, base: float):
        self.lexicons, self.weights, self.base = lexicons, weights, base

    def scores(self, texts: pa.Array) -> np.ndarray:
        text = _Text(texts)
        doc, feature = _features(text, self.lexicons, self.lexicons.votes(text))
        total = self.base + np.bincount(doc, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """``labels`` holds the rows that may be learned from (doc_id, label 0/1)."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    wanted = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = stage_table(texts.join(F.broadcast(wanted), "doc_id").select("text", "toxic"), "toxic-sample")
    total, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    share = (toxic or 0) / max(1, total)
    if share in (0, 1):
        empty = np.zeros(0, dtype=np.uint64)
        return ToxicityModel(Lexicons(empty, empty), np.zeros(VOTERS), 30.0 if share else -30.0)

    counts = sample.mapInArrow(_mine, "entry long, is_word boolean, toxic long, texts long").groupBy("entry").agg(F.max("is_word").alias("is_word"), F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(float(toxic)) + 1)) - F.log((F.col("texts") - F.col("toxic") + 0.5) / (F.lit(float(total - toxic)) + 1))
    mined = counts.withColumn("odds", odds).filter((F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS))
    best = mined.orderBy(F.desc("odds"), "entry").limit(LEXICON_SIZE).collect()
    hashes = lambda word: np.array([r.entry for r in best if r.is_word == word], dtype=np.int64).view(np.uint64)
    lexicons = Lexicons(hashes(True), hashes(False))
    size = len(lexicons.entries) + VOTERS

    context = docs.sparkSession.sparkContext
    shared = context.broadcast(lexicons)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((VOTERS + 1, VOTERS + 1))
        for batch in pieces(batches):
            votes = shared.value.votes(_Text(batch.column(0)))
            votes = np.concatenate([votes, np.ones((len(votes), 1))], axis=1)
            sums += votes.T @ votes
        yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.reshape(-1))], names=["cell", "n"])

    def all_moments(rows: DataFrame) -> np.ndarray:
        cells = rows.select("text").mapInArrow(moments, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((VOTERS + 1) ** 2)
        for r in cells:
            out[r.cell] = r.n
        return out.reshape(VOTERS + 1, VOTERS + 1) / max(1.0, out[-1])

    every, guilty, clean = all_moments(texts), all_moments(sample.filter("toxic = 1")), all_moments(sample.filter("toxic = 0"))
    model = LabelModel(every[-1, :-1], every[:-1, :-1], share, guilty[-1, :-1] - clean[-1, :-1])
    beliefs = context.broadcast(model)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text = _Text(batch.column(0))
            votes = shared.value.votes(text)
            doc, feature = _features(text, shared.value, votes)
            order = np.lexsort((feature, doc))
            columns = lists(feature[order].astype(np.int32), np.bincount(doc, minlength=len(votes)), pa.int32())
            yield pa.record_batch([columns, pa.array(beliefs.value.posterior(votes))], names=["at", "p"])

    vector = F.udf(lambda at: SparseVector(size, at, [1.0] * len(at)), VectorUDT())
    soft = stage_table(sample.select("text").mapInArrow(examples, "at array<int>, p double"), "toxic-examples")
    sides = soft.select(vector("at").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("side"))
    rows = sides.select("features", "side.label", "side.weight").filter("weight > 0")
    fitted = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=60).fit(rows)
    return ToxicityModel(lexicons, np.asarray(fitted.coefficients.toArray()), float(fitted.intercept))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.record_batch([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
