"""Reading level by familiar words: the share of words outside a list of frequent ones, and the length of sentences.

The list is derived from the corpus: in how many documents each word occurs, counted by language over all documents
(each partition counts its own, so only distinct words are shuffled). Familiar are the words that at least
``FAMILIAR_SHARE`` of a language's documents hold, so the list and the published score are the same whether or not anyone
rated a document. Japanese and Chinese, which write no spaces, are cut where the kind of script changes and runs of
ideographs into pairs.

How much an unfamiliar word or a longer sentence adds differs between languages and corpora, so where documents have
been rated, a list's size and the formula's weights are fitted by least squares for each language, on a bounded sample of
rated documents, and give ``level``; the published score stands beside it.

Texts are cut into words by arrays of code points, a batch at a time (see ``letters``); words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.letters import Block, Hashes, Words, block, mixed, pieces, words
from quire.llm.visual_text import row_chunks
from quire.session import shipped

FAMILIAR_SHARE = 0.2
LIST_SIZES = (30, 50, 70, 100, 200, 300, 600, 1200, 3000)
RATED_SAMPLE = 20_000
LEAST_RATED = 40
MIN_DOCUMENTS = 3
MAX_LANGUAGES = 200
FLUSH_WORDS = 500_000
FOLDS = 2
# The published familiar-word formula: 0.1579 a percent of unfamiliar words, 0.0496 a word of sentence length, and 3.6365
# once more than five percent are unfamiliar.
PER_UNFAMILIAR, PER_WORD, HARD, HARD_FROM = 0.1579, 0.0496, 3.6365, 5.0
LEVEL_SCHEMA = "doc_id long, lang string, n_words long, n_sentences long, unfamiliar_share double, sentence_length double, difficulty double, level double"
COUNT_SCHEMA = "lang string, word string, n_documents long"


def words_of(text: str) -> list[str]:
    """Words of one text in lower case."""
    b = block([text], compatible=False)
    w = words(b)
    return ["".join(map(chr, b.points[i:j])) for i, j in zip(w.start.tolist(), w.stop.tolist())]


def sentences(b: Block, w: Words) -> np.ndarray:
    """Sentences of each row of a block, by closing marks and line ends: pieces that hold a word."""
    if not len(w.start):
        return np.zeros(b.n, "int64")
    piece = pieces(b).piece[w.start]
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    return np.bincount(w.row[first], minlength=b.n)


def count_sentences(text: str) -> int:
    """Sentences of one text."""
    b = block([text], compatible=False)
    return int(sentences(b, words(b))[0])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n in row_chunks(batch.column("text")):
            if n:
                yield batch.slice(lo, n)


def _word_counts(documents: DataFrame) -> DataFrame:
    """``COUNT_SCHEMA`` over all documents; the empty word counts a language's documents with a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}  # (language, hash) -> word, documents

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([seen[k][0] for k in keys], pa.string()), pa.array([seen[k][1] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in COUNT_SCHEMA.split(", ")])

        for batch in _chunks(batches):
            b = block(batch.column("text").to_pylist(), compatible=False)
            w = words(b)
            if not len(w.start):
                continue
            langs = batch.column("lang").to_pylist()
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            lang = np.array([code[x] for x in langs], "int64")
            h = Hashes(b.points).of(w.start, w.stop)
            with np.errstate(over="ignore"):
                once = np.unique(mixed(h + w.row.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                key, first, n = np.unique(mixed(h[once]) ^ lang[w.row[once]].astype("uint64"), return_index=True, return_counts=True)
            at = once[first]
            text = b.points.astype("uint32").tobytes().decode("utf-32-le")
            names = list(code)
            for lang_code, own, i, j, k in zip(lang[w.row[at]].tolist(), h[at].tolist(), w.start[at].tolist(), w.stop[at].tolist(), n.tolist()):
                held = seen.get((names[lang_code], own))
                if held is None:
                    seen[(names[lang_code], own)] = [text[i:j], k]
                else:
                    held[1] += k
            for lang_code, k in enumerate(np.bincount(lang[np.unique(w.row)], minlength=len(code)).tolist()):
                if k:
                    seen.setdefault((names[lang_code], -1), ["", 0])[1] += k
            if len(seen) > FLUSH_WORDS:
                yield flush()
        if seen:
            yield flush()

    parts = shipped(documents.select("text", "lang")).mapInArrow(count, COUNT_SCHEMA)
    return parts.groupBy("lang", "word").agg(F.sum("n_documents").alias("n_documents"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """``lang, word, n_documents`` over all documents ``text, lang``; documents without a language are counted under null."""
    return _word_counts(documents).where("word <> ''")


def familiar_words(counts: DataFrame, most: int = max(LIST_SIZES), min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, word, n_documents, place`` of the ``most`` words of each language that most documents hold; ties go to the smaller word.

    The empty word is always listed, before the others. Every task first keeps its own ``most`` words of a language, so
    what is ranked in one task does not grow with the vocabulary.
    """
    order = Window.partitionBy("lang").orderBy(F.col("word") != "", F.desc("n_documents"), "word")
    held = counts.where((F.col("word") == "") | (F.col("n_documents") >= min_documents))
    ranked = held.withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most + 1).withColumn("place", F.col("place") - 1)


def difficulty(unfamiliar: float | np.ndarray, sentence_length: float | np.ndarray) -> float | np.ndarray:
    """The formula's score; about 4 and below is easy, 10 and above hard."""
    percent = 100 * unfamiliar
    return PER_UNFAMILIAR * percent + PER_WORD * sentence_length + HARD * (percent > HARD_FROM)


class Lists:
    """Familiar words of all languages by hash, with the places of the words and the size of the fixed list."""

    def __init__(self, rows: list[tuple[str | None, str, int, int]], share: float = FAMILIAR_SHARE) -> None:
        by: dict[str | None, list[tuple]] = {}
        totals: dict[str | None, int] = {}
        for lang, word, n, place in rows:
            if word:
                by.setdefault(lang, []).append((word, n, place))
            else:
                totals[lang] = n
        self.hashes, self.places, self.fixed = {}, {}, {}
        for lang, held in by.items():
            b = block([w for w, _, _ in held], compatible=False)
            ends = np.flatnonzero(b.points == 0)
            h = Hashes(b.points).of(np.concatenate([[0], ends[:-1] + 1]), ends)
            order = np.argsort(h)
            self.hashes[lang], self.places[lang] = h[order], np.array([p for _, _, p in held], "int64")[order]
            self.fixed[lang] = sum(n >= share * totals.get(lang, 0) for _, n, _ in held)
        self.languages = sorted(x for x in by if x is not None) or list(by)

    def place(self, lang: str | None, h: np.ndarray) -> np.ndarray:
        """Place of each word in a language's list, a place past all lists for others."""
        known = self.hashes.get(lang)
        far = max(LIST_SIZES) + 1
        if known is None or not len(known):
            return np.full(len(h), far)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, self.places[lang][at], far)


class Measures:
    """Words, sentences, language and unfamiliar shares (one of the fixed list, then one a list size) of some texts."""

    def __init__(self, texts: list[str | None], langs: list[str | None], lists: Lists) -> None:
        b = block(texts, compatible=False)
        w = words(b)
        n = b.n
        self.n_words, self.n_sentences = np.bincount(w.row, minlength=n), sentences(b, w)
        h = Hashes(b.points).of(w.start, w.stop)
        self.lang = list(langs)
        lone = np.array([not x for x in langs], bool)
        if lone.any() and len(lists.languages) > 1:  # a text without a language has the one whose list holds most of its words
            part = lone[w.row]
            held = np.stack([np.bincount(w.row[part], lists.place(x, h[part]) <= max(LIST_SIZES), n) for x in lists.languages])
            for i in np.flatnonzero(lone & (held.max(0) > 0)).tolist():
                self.lang[i] = lists.languages[int(held[:, i].argmax())]
        sizes = np.array(LIST_SIZES)
        self.shares = np.ones((n, len(sizes) + 1))
        code = {x: i for i, x in enumerate(dict.fromkeys(self.lang))}
        owner = np.array([code[x] for x in self.lang], "int64")
        total = np.maximum(self.n_words, 1)
        for x, i in code.items():
            part = owner[w.row] == i
            place, row = lists.place(x, h[part]), w.row[part]
            per = np.bincount(row * (len(sizes) + 1) + np.searchsorted(sizes, place), minlength=n * (len(sizes) + 1)).reshape(n, -1)
            rows = owner == i
            self.shares[rows, 1:] = (1 - np.cumsum(per[:, :-1], 1) / total[:, None])[rows]
            self.shares[rows, 0] = (1 - np.bincount(row[place <= lists.fixed.get(x, 0)], minlength=n) / total)[rows]
        self.length = self.n_words / np.maximum(self.n_sentences, 1)


def _weigh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    used = [0, 1, 2]
    while True:
        own = np.zeros(3)
        own[used] = np.linalg.lstsq(x[:, used], y, rcond=None)[0]
        wrong = [k for k in used[1:] if own[k] < 0]
        if not wrong:
            return own
        used.remove(min(wrong, key=lambda k: own[k] * x[:, k].std()))


def _best(held: list[dict]) -> tuple[int, list[float]]:
    y = np.array([r["rating"] for r in held])
    best = None
    for i in reversed(range(len(LIST_SIZES))):  # of equally good lists the longest
        x = np.array([[1.0, r["shares"][i], r["sentence_length"]] for r in held])
        error = float(np.mean((x[1::2] @ _weigh(x[::2], y[::2]) - y[1::2]) ** 2))
        if best is None or error < best[0] - 1e-9:
            best = (error, i, _weigh(x, y).tolist())
    return best[1], best[2]


def fit_weights(rows: list[dict], least: int = LEAST_RATED) -> dict[str | None, tuple[int, list[float]]]:
    """By language: the place of the list size and the weights (constant, unfamiliar share, sentence length) that fit the ratings best.

    Each size's weights are fitted on every other document and judged on the rest. An unfamiliar word or a longer sentence
    never makes a text easier: where least squares would have it so, that measure gets no weight. Languages with fewer
    than ``least`` rated documents have the weights of all languages together, under the key ``""``.
    """
    by: dict[str | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        by.setdefault(r["lang"], []).append(r)
    out = {lang: _best(held) for lang, held in by.items() if len(held) >= least}
    if sum(map(len, by.values())) >= 4:
        out[""] = _best([r for held in by.values() for r in held])
    return out


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """``rated, rating``: the mean level of each rated document. Ratings delivered twice count once, null ones not at all."""
    once = ratings.where(F.col("reading_level").isNotNull()).select("doc_id", "rater_id", "reading_level").distinct()
    return once.groupBy(F.col("doc_id").alias("rated")).agg(F.avg("reading_level").alias("rating"))


def _measured(documents: DataFrame, ratings: DataFrame | None, rated_sample: int, min_documents: int, least_rated: int) -> DataFrame:
    """Rows of ``reading_levels`` with ``held_out_level``, the level under weights fitted without the document and the half of the rated ones that goes with it."""
    most = (max(LIST_SIZES) + 1) * MAX_LANGUAGES
    listed = familiar_words(_word_counts(documents), min_documents=min_documents).limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    context = documents.sparkSession.sparkContext
    lists = context.broadcast(Lists([tuple(r) for r in listed]))
    texts = documents.select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")

    weights: list[dict] = [{}] * (FOLDS + 1)
    if ratings is not None:
        chosen = mean_ratings(ratings).orderBy(F.xxhash64("rated"), "rated").limit(rated_sample)
        rated = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("rated")).select("doc_id", "text", "lang", "rating", fold.alias("fold"))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _chunks(batches):
                m = Measures(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), lists.value)
                kept = np.flatnonzero(m.n_words > 0)
                at = pa.array(kept)
                out = [batch.column("doc_id").take(at), batch.column("rating").take(at), batch.column("fold").take(at), pa.array([m.lang[i] for i in kept], pa.string()), pa.array(m.length[kept]), pa.array(m.shares[kept, 1:].tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "rating", "fold", "lang", "sentence_length", "shares"])

        fitted = shipped(rated).mapInArrow(sample, "doc_id long, rating double, fold int, lang string, sentence_length double, shares array<double>").collect()
        once = [r.asDict() for r in {r["doc_id"]: r for r in fitted}.values()]
        weights = [fit_weights([r for r in once if r["fold"] != k], least_rated) for k in range(FOLDS)] + [fit_weights(once, least_rated)]
    fit = context.broadcast(weights)
    schema = f"{LEVEL_SCHEMA}, held_out_level double"
    names = [c.split()[0] for c in schema.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            m = Measures(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), lists.value)
            own = m.n_words > 0
            folds = batch.column("fold").to_numpy()
            levels = []
            for k in (np.full(len(folds), FOLDS), folds):
                level = np.full(len(own), np.nan)
                for i in np.flatnonzero(own).tolist():
                    known = fit.value[k[i]]
                    best = known.get(m.lang[i]) or known.get("")
                    if best:
                        size, (base, per_share, per_word) = best
                        level[i] = min(5.0, max(1.0, base + per_share * m.shares[i, size + 1] + per_word * m.length[i]))
                levels.append(level)
            share = m.shares[:, 0]
            out = [batch.column("doc_id"), pa.array(m.lang, pa.string()), pa.array(m.n_words), pa.array(m.n_sentences)]
            out += [pa.array(np.where(own, x, np.nan), pa.float64(), from_pandas=True) for x in (share, m.length, difficulty(share, m.length), *levels)]
            yield pa.RecordBatch.from_arrays(out, names)

    return shipped(texts.withColumn("fold", fold)).mapInArrow(measure, schema).distinct()


def reading_levels(documents: DataFrame, ratings: DataFrame | None = None, rated_sample: int = RATED_SAMPLE, min_documents: int = MIN_DOCUMENTS, least_rated: int = LEAST_RATED) -> DataFrame:
    """A row of ``LEVEL_SCHEMA`` for every distinct document; texts without a word (null and empty too) have null measures.

    ``difficulty`` is the published formula's score under the fixed list, the same with and without ``ratings``; ``level``
    is the fitted one between 1 and 5, null where nothing was rated. A language with fewer than ``least_rated`` rated
    documents takes the weights of all languages together. A document without a language takes the one whose list holds
    most of its words, null if none does. The lists, ``max(LIST_SIZES)`` words a language and at most ``MAX_LANGUAGES``
    languages, are broadcast; a corpus with more languages is refused. An empty table gives no rows; extra columns are
    not read.
    """
    return _measured(documents, ratings, rated_sample, min_documents, least_rated).drop("held_out_level")


def held_out_levels(documents: DataFrame, ratings: DataFrame, rated_sample: int = RATED_SAMPLE, min_documents: int = MIN_DOCUMENTS, least_rated: int = LEAST_RATED) -> DataFrame:
    """``reading_levels`` in which ``level`` comes from weights fitted on the other half of the rated documents."""
    rows = _measured(documents, ratings, rated_sample, min_documents, least_rated)
    return rows.withColumn("level", F.col("held_out_level")).drop("held_out_level")


def _correlation(a: str, b: str) -> Column:
    """Correlation of two columns, null where one of them is constant."""
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.round(F.try_divide(F.covar_pop(a, b), spread), 4)


def level_agreement(levels: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per language: rated documents and the correlation of the level and of each measure with the mean rating."""
    mean = mean_ratings(ratings)
    held = levels.where(F.col("difficulty").isNotNull()).join(mean, F.col("doc_id") == F.col("rated"))
    measures = ("level", "difficulty", "unfamiliar_share", "sentence_length")
    return held.groupBy("lang").agg(F.count("*").alias("n_documents"), *[_correlation(m, "rating").alias(f"{m}_correlation") for m in measures])
