"""Language of every text: script ranges, per-word scores, Viterbi over the words.

A word here is a maximal run of letters. The script of its letters leaves only
the languages that were seen in that script; every remaining language scores
the word by its character trigrams (word edges included). Viterbi with a
penalty for each switch then labels every word, and neighbouring words of one
label form a span, so a text that mixes languages gets several spans.

* text null or without a letter: ``und``, score 0, no spans;
* nothing learned (no row with text and language): ``und`` everywhere;
* a script no language was seen in: all languages stay candidates;
* ties: the language that sorts first.

``keep_learned`` also rejects texts that are in no learned language: most letters
are of a script no language was seen in, or the trigrams of the labels explain the
letters no better than a background, the chain of letter pairs of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import pieces, runs

UNKNOWN = "und"
#: log2 of the trigram buckets a model has: with the number of languages, the bound of its size.
BUCKET_BITS = 16
#: Cost of a switch of language, in nats.
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.001
#: Share of the background in a label's trigrams: one trigram speaks for or against a text by at most its log.
BACKGROUND_SHARE = 0.05
#: A text is not rejected on less evidence than this, in nats in all and for each letter.
LEAST_EVIDENCE, LEAST_MEAN = 12.0, 0.01
_STEP = 1 << 20

# First and last code point of the scripts' main blocks (Unicode block chart).
SCRIPTS = {
    "Latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x0530, 0x058F)],
    "Hebrew": [(0x0590, 0x05FF)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Sinhala": [(0x0D80, 0x0DFF)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Lao": [(0x0E80, 0x0EFF)],
    "Tibetan": [(0x0F00, 0x0FFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0xFF66, 0xFF9D)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER_SCRIPT = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """For every code point 0 (not a letter) or the number of its script."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = OTHER_SCRIPT
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            part = out[low : high + 1]
            part[part > 0] = number
    return out


class _Letters:
    """Words (runs of letters) of some texts laid end to end, each text closed by a line break."""

    def __init__(self, texts: list[str | None]):
        joined = "".join(f"{t.lower()}\n" if t else "\n" for t in texts)
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.script = _script_of()[self.code]
        letter = self.script > 0
        ahead = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
        self.start = np.flatnonzero(letter & ~ahead)
        self.end = np.flatnonzero(~letter & ahead)  # every text ends in a line break
        closes = np.flatnonzero(self.code == 10) if len(texts) != 1 else np.array([len(self.code) - 1])
        if len(closes) != len(texts):  # line breaks inside the texts
            closes = np.cumsum([len(t.lower()) + 1 if t else 1 for t in texts]) - 1
        self.first = np.searchsorted(self.start, np.concatenate([[0], closes + 1]))

    def slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that hold about _STEP characters."""
        a = 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _STEP, side="right")))
            yield a, b
            a = b

    def _keys(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For words a to b: keys of each code point's predecessor, itself and its successor, places of the letters, where each word's begin."""
        low, high = self.start[a], self.end[b - 1]
        code = np.zeros(high - low + 2, dtype=np.uint64)
        code[1:-1] = np.where(self.script[low:high] > 0, self.code[low:high], 0)
        lengths = self.end[a:b] - self.start[a:b]
        at = runs(self.start[a:b] - low, lengths)
        keys = [code[:-2] * np.uint64(0x9E3779B97F4A7C15), code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F), code[2:] * np.uint64(0x165667B19E3779F9)]
        return keys, at, np.cumsum(lengths) - lengths

    def buckets(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets of words a to b, one for each letter, and where each word's begin."""
        (before, here, behind), at, begin = self._keys(a, b)
        return _bucket(before + here + behind, at), begin

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of each letter of words a to b with its predecessor, alone, and with its successor."""
        (before, here, behind), at, _ = self._keys(a, b)
        return _bucket(before + here, at), _bucket(here, at), _bucket(here + behind, at)


def _bucket(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    key = key ^ (key >> np.uint64(29))
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ``_Letters.pairs`` of a task's texts, added up before they leave the task."""
    size = 1 << BUCKET_BITS
    total = np.zeros(3 * size, dtype=np.int64)
    for batch in pieces(batches):
        letters = _Letters(batch.column(0).to_pylist())
        for a, b in letters.slices():
            for k, bucket in enumerate(letters.pairs(a, b)):
                total[k * size : (k + 1) * size] += np.bincount(bucket, minlength=size)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of a task's texts by language, added up before they leave the task."""
    size = 1 << BUCKET_BITS
    counts: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            letters = _Letters([t for t, x in zip(texts, langs) if x == lang])
            total = counts.setdefault(lang, np.zeros(size + OTHER_SCRIPT + 1, dtype=np.int64))
            total[size:] += np.bincount(letters.script, minlength=OTHER_SCRIPT + 1)
            for a, b in letters.slices():
                total[:size] += np.bincount(letters.buckets(a, b)[0], minlength=size)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "slot", "n"])


class LanguageModel:
    """Log probability of every trigram bucket, and the scripts, by language. At most 2^BUCKET_BITS numbers a language.

    ``seen``: scripts of some language; ``unseen``: log probability of a bucket without a count, by language.
    """

    def __init__(self, langs: list[str], scores: np.ndarray, candidates: np.ndarray, seen: np.ndarray, unseen: np.ndarray):
        self.langs, self.scores, self.candidates, self.seen, self.unseen = langs, scores, candidates, seen, unseen


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from every row with text and language; counts cover them all."""
    rows = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .filter("text is not null and lang is not null")
        .mapInArrow(_count, "lang string, slot long, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs, size = sorted(rows["lang"].unique()), 1 << BUCKET_BITS
    table = np.zeros((len(langs), size + OTHER_SCRIPT + 1))
    if langs:
        table[np.searchsorted(langs, rows["lang"]), rows["slot"]] = rows["n"]
    grams, scripts = table[:, :size], table[:, size + 1 :]
    known = max(1, int((grams.sum(axis=0) > 0).sum()))
    size_of = grams.sum(axis=1, keepdims=True) + SMOOTHING * known
    scores = np.log((grams + SMOOTHING) / size_of)
    candidates = np.ones((OTHER_SCRIPT + 1, len(langs)), dtype=bool)
    candidates[1:] = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    seen = candidates.any(axis=1)
    candidates[~seen] = True
    return LanguageModel(langs, scores.T.astype(np.float32).copy(), candidates, seen, np.log(SMOOTHING / size_of[:, 0]))


def learn_background(docs: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """What a letter is worth in the chain of letter pairs of all languages together, learned from the rows ``learn`` takes.

    Three rows of 2^BUCKET_BITS logs, to be added for each letter: of its pair with the
    letter before, less of itself, of its pair with the letter behind.
    """
    rows = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .filter("text is not null and lang is not null")
        .select("text")
        .mapInArrow(_count_pairs, "slot long, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros(3 << BUCKET_BITS)
    counts[rows["slot"]] = rows["n"]
    before, here, behind = counts.reshape(3, -1)
    logs = lambda n: np.log(n + SMOOTHING)
    out = np.stack([logs(before) - np.log(max(1.0, before.sum()) + SMOOTHING * max(1, (before > 0).sum())), -logs(here), logs(behind)])
    return out.astype(np.float32)


def _viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts advance side by side, the longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begins, longest = first[:-1][order], counts[order]
    n_langs = scores.shape[1]
    stays = np.ones((len(scores), n_langs), dtype=bool)
    jump = np.zeros(len(scores), dtype=np.int16)
    best = np.zeros((len(order), n_langs), dtype=np.float64)
    active = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")
    for step, n in enumerate(active):
        at = begins[:n] + step
        if step:
            top = best[:n].argmax(axis=1)
            change = best[np.arange(n), top][:, None] - penalty
            stays[at] = best[:n] >= change
            jump[at] = top
            best[:n] = np.maximum(best[:n], change)
        best[:n] += scores[at]
    label = np.zeros(len(scores), dtype=np.int16)
    if not len(active):
        return label
    now = best.argmax(axis=1).astype(np.int16)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = begins[:n] + step
        label[at] = now[:n]
        now[:n] = np.where(stays[at, now[:n]], now[:n], jump[at])
    return label


def _labelled(letters: _Letters, model: LanguageModel, penalty: float) -> np.ndarray:
    scores = np.empty((len(letters.start), len(model.langs)), dtype=np.float32)
    for a, b in letters.slices():
        bucket, begin = letters.buckets(a, b)
        scores[a:b] = np.add.reduceat(model.scores[bucket], begin, axis=0)
        scores[a:b][~model.candidates[letters.script[letters.start[a:b]]]] = -1e6
    return _viterbi(scores, letters.first, penalty)


def _judge(model: LanguageModel, penalty: float, texts: list[str | None]):
    """For every text: language, score, number of spans; spans as arrays."""
    letters = _Letters(texts)
    n, k = len(texts), len(model.langs)
    doc = np.repeat(np.arange(n), np.diff(letters.first))
    size = letters.end - letters.start
    label = _labelled(letters, model, penalty) if k else np.zeros(len(size), dtype=np.int16)
    share = np.zeros((n, max(k, 1)))
    np.add.at(share, (doc, label), size)
    total = share.sum(axis=1)
    known = (total > 0) & (k > 0)
    winner = share.argmax(axis=1)
    langs = [model.langs[w] if ok else UNKNOWN for w, ok in zip(winner, known)]
    score = np.where(known, share.max(axis=1) / np.maximum(total, 1), 0.0)
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(opens) if k else np.zeros(0, dtype=np.int64)
    closes = np.append(at[1:], len(doc))[: len(at)]
    base = letters.first[:-1][doc[at]] if len(at) else at
    spans = {"doc": doc[at], "start": at - base, "end": closes - base, "lang": [model.langs[x] for x in label[at]] if k else []}
    return langs, score, spans


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with lang_pred (the language of most letters), lang_score (its share
    of the letters) and lang_spans (first word, end, language; words counted as runs
    of letters). Columns of these names are replaced; all others pass through."""
    out = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_spans")]
    kept = docs.select(*[f.name for f in out])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches):
        for batch in pieces(batches, text):
            langs, score, spans = _judge(shared.value, penalty, batch.column(batch.schema.get_field_index(text)).to_pylist())
            offsets = np.searchsorted(spans["doc"], np.arange(batch.num_rows + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(spans["start"], pa.int32()), pa.array(spans["end"], pa.int32()), pa.array(spans["lang"], pa.string())], fields=list(span))
            more = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_spans"])

    more = T.StructType.fromDDL("lang_pred string, lang_score double, lang_spans array<struct<start:int,end:int,lang:string>>")
    schema = T.StructType([*out, *more.fields])
    return kept.mapInArrow(run, schema)


def _is_learned(model: LanguageModel, background: np.ndarray, min_score: float, penalty: float, texts: list[str | None]) -> np.ndarray:
    """For every text whether its letters are in the learned languages, each word read in the language of its label."""
    letters = _Letters(texts)
    n, k = len(texts), len(model.langs)
    if not k or not len(letters.start):
        return np.zeros(n, dtype=bool)
    doc = np.repeat(np.arange(n), np.diff(letters.first))
    size = letters.end - letters.start
    label = _labelled(letters, model, penalty)
    better = np.zeros(len(size))
    strange = np.zeros(len(size), dtype=np.int64)
    for a, b in letters.slices():
        bucket, begin = letters.buckets(a, b)
        lang = np.repeat(label[a:b], size[a:b])
        # Without the smoothing, so that what was never seen has no share. Even chances for all buckets are the least background.
        own = np.exp(model.scores[bucket, lang]) - np.exp(model.unseen)[lang]
        chain = np.exp(sum(part[at] for part, at in zip(background, letters.pairs(a, b))))
        ratio = np.maximum(own, 0) / np.maximum(chain, 0.5**BUCKET_BITS)
        better[a:b] = np.add.reduceat(np.minimum(np.log(BACKGROUND_SHARE + (1 - BACKGROUND_SHARE) * ratio), -np.log(BACKGROUND_SHARE)), begin)
        at = runs(letters.start[a:b], size[a:b])
        strange[a:b] = np.add.reduceat((~model.seen[letters.script[at]]).astype(np.int64), begin)
    total = np.bincount(doc, size, n)
    gain = np.bincount(doc, better, n)
    explained = gain >= -np.maximum(LEAST_EVIDENCE, LEAST_MEAN * total)
    share = np.bincount(doc * k + label, size, n * k).reshape(n, k).max(axis=1)
    return (total > 0) & (share >= min_score * total) & (2 * np.bincount(doc, strange, n) <= total) & explained


def keep_learned(
    docs: DataFrame, model: LanguageModel, background: np.ndarray, min_score: float = 1 / 3, text: str = "text", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """Rows of ``docs`` whose text is in the languages that were learned; columns unchanged.

    ``background`` is of ``learn_background`` over the rows of the model. Rejected are the
    texts that ``keep_identified`` rejects, those with more than half of their letters in
    scripts no language was seen in, and those whose letters the background explains
    better than their labels do. A label's rows are taken at their word: what one of
    them alone holds counts as seen, which matters only in tables of few letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(_is_learned(*shared.value, min_score, penalty, batch.column(batch.schema.get_field_index(text)).to_pylist())))

    return docs.mapInArrow(run, docs.schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 1 / 3, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Rows of ``docs`` whose text has a language that holds at least ``min_score`` of its letters; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            langs, score, _ = _judge(shared.value, penalty, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, score)]))

    return docs.mapInArrow(run, docs.schema)
