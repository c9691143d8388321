"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words (runs of letters, lower-cased). The probabilities are
fitted by expectation maximisation (forward-backward counts) on training texts.

Training texts are a bounded sample: the ``per_language`` documents of each language with the
smallest hash of doc_id, whole texts. Tasks count their words; only the counts of the sample's
distinct words come to the driver, never texts. All languages with a training document count;
they are fitted and scored ``AT_ONCE`` at a time. Prediction reads the text alone, and all of it.

Words are scored once a task and looked up again (at most ``WORDS`` words are held, fewer with
many languages, then the table starts anew). Runs of more than ``LONGEST`` letters are scored in
pieces of that length, and every letter's probability is multiplied by ``SCALE``, which is taken
out of the logarithm again: a run of letters that no training text has (1e-12 each) doesn't
underflow, and one of probability 1 doesn't overflow.

Defined cases: null text, or text without a letter (Unicode category L; digits, fractions and
Roman numeral signs are none), is ``und`` with score 0; without any training document every text
is ``und``; ties go to the first language by name; rows may repeat, and each row of a doc_id in
the sample counts; a null doc_id is not held out; very long texts are counted word by word; an
empty table gives an empty table; ``confident`` keeps further columns of any name, ``predict``
ignores them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow
from nearfield.llm.word_bpe import vocabulary

PIECES = "piece_bpe_32k.model"
PER_LANGUAGE, AT_ONCE, ROUNDS = 300, 50, 2
LONGEST, WORDS = 48, 200_000
SCALE = 2.0**20  # a power of two, so that products stay exact; of LONGEST + 1 letters below 2**1024
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"  # begins a word in the vocabulary
#: words of evidence that a score of a long text stands for
EVIDENCE = 20


def vocabulary_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark of a word's begin."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in pieces if LETTERS.fullmatch(p.removeprefix(MARK)) or p == MARK})


class Pieces:
    """Ids of pieces: 0 is no piece, 1 any other single character, then the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.id = {p: i + 2 for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.scale = SCALE ** np.minimum([0, 1, *map(len, pieces)], LONGEST + 1)[:, None].astype(float)

    def grid(self, words: list[str]) -> np.ndarray:
        """Piece ids [end, length, word] of marked words of one length."""
        n, most, get = len(words[0]), self.longest, self.id.get
        spans = [(i - k, i) for i in range(1, n + 1) for k in range(1, most + 1) if k <= i]
        flat = np.array([get(w[a:b], 0) for w in words for a, b in spans], np.int32).reshape(len(words), -1)
        out = np.zeros((n + 1, most + 1, len(words)), np.int32)
        for c, (a, b) in enumerate(spans):
            out[b, b - a] = np.where(flat[:, c] > 0, flat[:, c], 1) if b - a == 1 else flat[:, c]
        return out


def _forward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha [position, word, language]; p [piece, language] with p[0] = 0."""
    n, most, m = grid.shape[0] - 1, grid.shape[1] - 1, grid.shape[2]
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1
    for i in range(1, n + 1):
        for k in range(1, min(i, most) + 1):
            if grid[i, k].any():
                alpha[i] += alpha[i - k] * p[grid[i, k]]
    return alpha


def _backward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    n, most, m = grid.shape[0] - 1, grid.shape[1] - 1, grid.shape[2]
    beta = np.zeros((n + 1, m, p.shape[1]))
    beta[n] = 1
    for i in range(n, 0, -1):
        for k in range(1, min(i, most) + 1):
            if grid[i, k].any():
                beta[i - k] += beta[i] * p[grid[i, k]]
    return beta


def split_words(text: str) -> list[str]:
    """Runs of letters, lower-cased. ``LETTERS`` also takes characters with a numeric value that are no digits."""
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    if any(len(w) > LONGEST for w in found):
        return [w[a : a + LONGEST] for w in found for a in range(0, len(w), LONGEST)]
    return found


def _by_length(words) -> dict[int, list[str]]:
    out = defaultdict(list)
    for w in words:
        out[len(w)].append(w)
    return out


class Model:
    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log likelihood [word, language], in the order given."""
        out = np.zeros((len(words), len(self.languages)))
        at = {w: i for i, w in enumerate(words)}
        scaled = [(k, self.p[:, k : k + AT_ONCE] * self.pieces.scale) for k in range(0, len(self.languages), AT_ONCE)]
        for group in _by_length(words).values():
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                grid, to = self.pieces.grid([MARK + w for w in part]), np.array([at[w] for w in part])
                for k, p in scaled:
                    out[to, k : k + AT_ONCE] = np.log(_forward(grid, p)[-1]) - (grid.shape[0] - 1) * np.log(SCALE)
        return out


def fit(samples: list[tuple[str, str]], pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """A model of (language, text) samples."""
    return fit_counts(((lang, w, c) for lang, text in samples for w, c in [(None, 0), *Counter(split_words(text)).items()]), pieces, rounds)


def fit_counts(words, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """A model of (language, word, count); a null word only names its language."""
    words = list(words)
    languages = sorted({lang for lang, *_ in words})
    place = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for lang, w, c in words:
        if w is not None:
            counts[w][place[lang]] += c
    size = len(pieces.id) + 2
    length = np.array([0, 1, *map(len, pieces.id)])
    p = np.repeat(0.02 ** np.minimum(length, 4)[:, None].astype(float) ** 0.5, len(languages), axis=1)
    parts = [g[a : a + 4096] for g in _by_length(sorted(counts)).values() for a in range(0, len(g), 4096)]
    for _ in range(rounds):
        p[0] = 0
        p /= p.sum(axis=0)
        q = p * pieces.scale
        expected = np.full((size, len(languages)), 0.01)
        for part in parts:  # grids are made anew each round: those of all words would take many times the words
            grid, c = pieces.grid([MARK + w for w in part]), np.array([counts[w] for w in part])
            alpha, beta = _forward(grid, q), _backward(grid, q)
            share = c / np.maximum(alpha[-1], 1e-300)
            for i in range(1, grid.shape[0]):
                for k in range(1, min(i, grid.shape[1] - 1) + 1):
                    ids = grid[i, k]
                    on = np.flatnonzero(ids)
                    if len(on):
                        np.add.at(expected, ids[on], alpha[i - k][on] * q[ids[on]] * beta[i][on] * share[on])
        p = expected
    p[0] = 0
    return Model(pieces, languages, p / p.sum(axis=0))


def training_counts(docs: DataFrame, languages: list[str], per_language: int = PER_LANGUAGE) -> list[tuple]:
    """(lang, word, count) over the ``per_language`` documents of each of ``languages`` with the smallest hashes,
    and a null word for each language."""
    named = docs.where(F.col("lang").isin(languages) & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    ids = named.select("lang", "doc_id", F.xxhash64("doc_id").alias("order")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    chosen = ids.select("doc_id", "lang")
    same = (named["doc_id"].eqNullSafe(chosen["doc_id"])) & (named["lang"] == chosen["lang"])
    texts = named.join(F.broadcast(chosen), same, "left_semi").select("lang", "text")

    def count(batches):
        for batch in batches:
            total: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total.setdefault(lang, Counter({None: 1})).update(split_words(text))
            rows = [(lang, w, c) for lang, own in total.items() for w, c in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words = map_arrow(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = words.toArrow()  # in one job, where an iterator would run one for each partition
    return sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True), key=lambda r: (r[0], r[1] is not None, r[1]))


class Scorer:
    """Scores texts; looks words up that were scored before."""

    def __init__(self, model: Model | None):
        self.model, self.index, self.scores = model, {}, np.zeros((0, 0))

    def _learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.index)
        if len(self.index) + len(new) > WORDS // -(-len(self.model.languages) // AT_ONCE):
            self.index, self.scores, new = {}, np.zeros((0, 0)), sorted(words)
        if new:
            got = self.model.word_scores(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, got]) if len(self.scores) else got

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text."""
        counted = [Counter(split_words(t)) if t and self.model else Counter() for t in texts]
        if self.model:
            self._learn({w for c in counted for w in c})
        pred, sure = [], []
        for c in counted:
            if not c:
                pred.append("und")
                sure.append(0.0)
                continue
            many = np.fromiter(c.values(), float, len(c))
            total = many @ self.scores[np.fromiter(map(self.index.__getitem__, c), np.int64, len(c))]
            k = int(total.argmax())
            pred.append(self.model.languages[k])
            sure.append(float(1 / np.exp((total - total[k]) * min(1.0, EVIDENCE / many.sum())).sum()))
        return pred, sure


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            for rows in tg.blocks(batch, "text", 2 << 20):
                pred, sure = score(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learned(docs: DataFrame, train, per_language: int = PER_LANGUAGE) -> Model | None:
    docs = docs.where(train)
    languages = sorted(r.lang for r in docs.where("lang is not null and text is not null").select("lang").distinct().collect())
    pieces, parts = Pieces(vocabulary_pieces(vocabulary(PIECES))) if languages else None, []
    for k in range(0, len(languages), AT_ONCE):
        if counts := training_counts(docs, languages[k : k + AT_ONCE], per_language):
            parts.append(fit_counts(counts, pieces))
    return Model(pieces, [x for m in parts for x in m.languages], np.concatenate([m.p for m in parts], axis=1)) if parts else None


def confident(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language can't be told: no letters, or a score under ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, F.lit(True)))

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            for rows in tg.blocks(batch, "text", 2 << 20):
                pred, sure = score(rows.column("text").to_pylist())
                yield rows.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, sure, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, learned(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLE_SQL = None
