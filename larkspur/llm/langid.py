"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Piece
probabilities are learned from expected counts over all segmentations (forward and backward), ROUNDS times, on a
sample of about SAMPLE texts of each language chosen by a hash of their id.

Words are runs of letters of any length, lower-cased, with the vocabulary's mark of a word's start; in scripts without
spaces a word may be a whole sentence, and all its segmentations are summed. Forward and backward values are scaled
anew every few characters, so that no length underflows. A text's probability does not depend on other texts.

Defined results: null text and text without a letter are `und` with score 0, as are all texts where nothing can be
learned; ties go to the language that sorts first; repeated rows score alike; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, crc_column, crc_text, id_text, scratch, table, written

SAMPLE, ROUNDS, SMOOTH, LANGUAGES = 2000, 2, 0.1, 256
MEMORY, KEPT, CELLS = 32 << 20, 48, 2_000_000  # bytes of remembered words, the longest of them, values worked on at once
FOLDS, HELD = 4, 2
#: Of documents to keep: the least share of a language, the least share that corrects a given one, and how far below the
#: sample's rarest hundredth the mean log probability of a letter may be.
LEAST, SURE, RARE, MARGIN = 0.5, 0.9, 0.01, 3.0
_START, _letters = "▁", re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return _letters.findall(text.lower())


def by_length(words: list[str], columns: int) -> Iterator[list[str]]:
    """The words in groups of like length, each of at most CELLS values or one word."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        most = max(1, min(20_000, CELLS // (columns * (len(words[at]) + 16))))
        some = [w for w in words[at : at + most] if len(w) <= 2 * len(words[at]) + 16]
        yield some
        at += len(some)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isascii() and re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


class Pieces:
    """The pieces of a vocabulary file as arcs over a word."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        #: Matches give the piece's length and number; number 0 is any character that is no piece.
        self.matcher = ahocorasick.Automaton()
        self.longest = 1
        for n, i in enumerate(plain, 1):
            piece = model.id_to_piece(i)
            self.longest = max(self.longest, len(piece))
            self.matcher.add_word(piece, len(piece) << 16 | n)
        self.matcher.make_automaton()
        self.size = len(plain) + 1

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end, piece of each arc, ordered by end and then by word; the words' lengths."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = "".join([f"{_START}{w}\n" for w in words])
        found = np.fromiter(itertools.chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
        last, length, piece = found[:, 0], found[:, 1] >> 16, found[:, 1] & 0xFFFF
        first = np.concatenate([[0], np.cumsum(size + 1)])
        none = np.ones(len(text), bool)
        none[last[length == 1]] = False
        none[first[1:] - 1] = False
        if none.any():
            none = np.flatnonzero(none)
            last, length, piece = (np.concatenate(x) for x in ((last, none), (length, np.ones_like(none)), (piece, np.zeros_like(none))))
            order = np.argsort(last, kind="stable")
            last, length, piece = last[order], length[order], piece[order]
        word = np.repeat(np.arange(len(words)), size + 1)[last]
        end = last - first[word] + 1
        order = np.argsort(end.astype(np.min_scalar_type(int(end.max(initial=0)))), kind="stable")
        word, end = word[order], end[order]
        return word, end - length[order], end, piece[order], size

    def forward(self, arcs, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, characters read, language] and the logarithm of its scale; p[piece, language]."""
        word, start, end, piece, size = arcs
        alpha = np.zeros((len(size), int(size.max(initial=0)) + 1, p.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[:, 0] = 1
        bounds = np.searchsorted(end, np.arange(1, alpha.shape[1] + 1))
        for e in range(1, alpha.shape[1]):
            s = slice(bounds[e - 1], bounds[e])
            w = word[s]
            if not len(w):
                continue
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            to = w[first]
            alpha[to, e] = np.add.reduceat(alpha[w, start[s]] * p[piece[s]], first, axis=0)
            if e > self.longest:
                scale[to, e] = scale[to, e - 1]
            if e % self.longest == 0 and e + 1 < alpha.shape[1]:
                _rescale(alpha, scale, slice(e - self.longest + 1, e + 1))
        return alpha, scale

    def log_prob(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Of each word, in each language."""
        at = {}
        out = np.zeros((len(words), p.shape[1]))
        for i, w in enumerate(words):
            at.setdefault(w, i)
        for some in by_length(list(at), p.shape[1]):
            arcs = self.arcs(some)
            k = np.arange(len(some))
            alpha, scale = self.forward(arcs, p)
            out[[at[w] for w in some]] = np.log(np.maximum(alpha[k, arcs[4]], 1e-300)) + scale[k, arcs[4]]
        return out[[at[w] for w in words]]

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of the words; one column of p."""
        arcs = word, start, end, piece, size = self.arcs(words)
        alpha, scale = (x[:, :, 0] for x in self.forward(arcs, p))
        beta, scale_b = np.zeros(alpha.shape), np.zeros(alpha.shape)
        row = np.arange(len(words))
        beta[row, size] = 1
        order = np.lexsort((word, -start))
        word_b, start_b, end_b, piece_b = word[order], start[order], end[order], piece[order]
        bounds = np.searchsorted(-start_b, -np.arange(alpha.shape[1]), "left"), np.searchsorted(-start_b, -np.arange(alpha.shape[1]), "right")
        for at in range(alpha.shape[1] - 2, -1, -1):
            lo, hi = bounds[0][at], bounds[1][at]
            w = word_b[lo:hi]
            if not len(w):
                continue
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            to = w[first]
            beta[to, at] = np.add.reduceat(p[piece_b[lo:hi], 0] * beta[w, end_b[lo:hi]], first)
            scale_b[to, at] = scale_b[to, at + 1]
            if at % self.longest == 0:
                _rescale(beta[:, :, None], scale_b[:, :, None], slice(at, at + self.longest))
        total = np.log(np.maximum(alpha[row, size], 1e-300)) + scale[row, size]
        share = alpha[word, start] * p[piece, 0] * beta[word, end] * np.exp(scale[word, start] + scale_b[word, end] - total[word])
        return np.bincount(piece, counts[word] * share, minlength=self.size)


def _rescale(values: np.ndarray, scale: np.ndarray, window: slice) -> None:
    """The largest value of each word's window becomes 1; nothing further back is read any more. Values past a word's end are zero and stay."""
    top = values[:, window].max(axis=1, keepdims=True)
    top[top == 0] = 1
    values[:, window] /= top
    scale[:, window] += np.log(top)


_pieces: dict[str | None, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    """One per process."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _uniform(size: int) -> np.ndarray:
    return np.full((size, 1), 1 / size)


def learn(labelled: DataFrame, path: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, floors: bool = False) -> tuple:
    """Languages (the LANGUAGES most frequent), and the probabilities p[piece, language]. labelled: doc_id, text, lang, with lang not null.

    floors: also, for each language, the mean log probability of a letter that only RARE of the sample's texts are below.
    """
    spark = labelled.sparkSession
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(totals)
    size = pieces(path).size
    if not langs:
        return ([], np.zeros((size, 0)), np.zeros(0))[: 2 + floors]
    part = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, int(min(1.0, sample / n) * 1_000_000))])
    chosen = written(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part[F.col("lang")]).select("text", "lang"), "langid-sample")
    p = np.repeat(_uniform(size), len(langs), axis=1)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(p)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            own, counts = pieces(path), {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                of = counts.setdefault(lang, {})
                for w in words_of(text):
                    of[w] = of.get(w, 0) + 1
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for lang, of in counts.items():
                k = langs.index(lang)
                total = np.zeros(own.size)
                for some in by_length(list(of), 1):
                    total += own.expected(some, np.array([of[w] for w in some], float), held.value[:, k : k + 1])
                x = np.flatnonzero(total)
                out = [np.concatenate(y) for y in zip(out, (np.full(len(x), k), x, total[x]))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["lang", "piece", "n"])

        found = by_batch(chosen, run, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most languages x pieces rows
        counts = np.full((size, len(langs)), SMOOTH)
        counts[found["piece"], found["lang"]] += found["n"]
        p = counts / counts.sum(axis=0)
    if not floors:
        return langs, p
    held = spark.sparkContext.broadcast((langs, p))

    def usual(batch: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        at = [langs.index(x) for x in batch.column("lang").to_pylist()]
        mean = [s[k] / max(n, 1) for k, (s, n) in zip(at, scorer.each(batch.column("text").to_pylist()))]
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(mean, pa.float64())], ["lang", "mean"])

    lowest = by_batch(chosen, usual, "lang long, mean double", lambda: Scorer(*held.value, path)).groupBy("lang").agg(F.percentile("mean", RARE).alias("mean")).collect()
    floor = np.full(len(langs), -np.inf)
    for r in lowest:  # a row per language
        floor[r["lang"]] = r["mean"]
    return langs, p, floor


class Scorer:
    """Texts to languages; remembers words, a bounded number of bytes of them."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str | None = None):
        self.langs, self.p, self.pieces = langs, p, pieces(path)
        self.at: dict[str, int] = {}
        self.most = max(1000, min(500_000, MEMORY // (8 * max(1, len(langs)))))
        self.log = np.zeros((self.most, len(langs)))

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.array([s for s, _ in self.each(texts)]).reshape(len(texts), -1)

    def each(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Of each text the log probability in each language and the number of letters."""
        words = [words_of(t) for t in texts]
        distinct = dict.fromkeys(itertools.chain.from_iterable(words))
        long = {w for w in distinct if len(w) > KEPT}
        for w in long:
            del distinct[w]
        new = [w for w in distinct if w not in self.at]
        if len(self.at) + len(new) > len(self.log):
            self.at, new = {}, list(distinct)
            self.log = np.zeros((max(self.most, len(new)), len(self.langs)))
        if new:
            n = len(self.at)
            self.log[n : n + len(new)] = self.pieces.log_prob(new, self.p)
            self.at.update(zip(new, range(n, n + len(new))))
        out, at = [], self.at.__getitem__
        for ws in words:
            if long and not long.isdisjoint(ws):
                known = self.log[[at(w) for w in ws if w not in long]].sum(axis=0) + self.pieces.log_prob([w for w in ws if w in long], self.p).sum(axis=0)
            else:
                known = self.log[[*map(at, ws)]].sum(axis=0)
            out.append((known, len("".join(ws))))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share among the languages' probabilities."""
        return [(lang, share) for lang, share, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, its share, and the mean log probability of a letter in it."""
        known = [t if has_letter(t) and self.langs else "" for t in texts]
        out: list[tuple[str, float, float]] = []
        # A few texts at a time, so that the words of one go are bounded by the longest text.
        for i in range(0, len(known), 64):
            some = known[i : i + 64]
            for t, (s, n) in zip(some, self.each(some)):
                if not t or not len(s):
                    out.append(("und", 0.0, -np.inf))
                    continue
                k = int(np.argmax(s))
                out.append((self.langs[k], float(1 / np.exp(s - s[k]).sum()), float(s[k] / max(n, 1))))
        return out


def fitted(docs: DataFrame, path: str | None = None, floors: bool = False) -> tuple:
    """learn() from the documents outside the held-out fold; its sample goes at the end."""
    with scratch(docs.sparkSession):
        return learn(learned_from(docs), path, floors=floors)


def learned_from(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents outside the held-out fold whose language is given."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(crc_column() % FOLDS != HELD)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    langs, p = model or fitted(docs, path)
    held = docs.sparkSession.sparkContext.broadcast((langs, p))

    def run(batch: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        lang, score = zip(*scorer.predict(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([crc_text(x) % FOLDS == HELD for x in ids]), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return by_batch(id_text(docs), run, "doc_id long, held_out boolean, lang_pred string, score double", lambda: Scorer(*held.value, path))


def known_language(docs: DataFrame, least: float = LEAST, sure: float = SURE, margin: float = MARGIN, wanted: list[str] | None = None, path: str | None = None) -> DataFrame:
    """docs in a known language, all columns as they are but lang, which is filled in where it is null and corrected where the predicted one has a share of `sure` or more.

    Documents go whose language is `und`, has a share under `least`, is none of `wanted`, or whose letters are less likely
    in it, by more than `margin` in the mean log probability, than those of all but RARE of the sample's texts: these are
    in no language that was learned.
    """
    langs, p, floor = fitted(docs, path, True)
    held = docs.sparkSession.sparkContext.broadcast((langs, p))
    lowest = {lang: x - margin for lang, x in zip(langs, floor.tolist())}
    names = docs.columns

    def run(batch: pa.RecordBatch, scorer: Scorer) -> pa.RecordBatch:
        found = scorer.judge(batch.column(names.index("text")).to_pylist())
        given = batch.column(names.index("lang")).to_pylist()
        lang = [x if g is None or share >= sure else g for g, (x, share, _) in zip(given, found)]
        keep = [x != "und" and share >= least and mean >= lowest[x] and (wanted is None or x in wanted) for x, share, mean in found]
        columns = list(batch.columns)
        columns[names.index("lang")] = pa.array(lang, pa.string())
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return by_batch(docs, run, docs.schema, lambda: Scorer(*held.value, path))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
