"""Language identification as multilingual mixture inference (operator 6).

Learning: letter trigrams per language, counted over all labelled documents that are not held out.  Prediction: the words
of a text are drawn from a mixture of languages; expectation-maximisation estimates the proportions from the words'
n-gram likelihoods.  The language set grows from the best single language one by one while the likelihood, less half the
logarithm of the number of words for each further proportion, gets better.  The prediction is the largest proportion in
the chosen set, the score that proportion.

The model is one array of 64 ** 3 numbers (1 MB) for each language and is broadcast; at most ``LANGUAGES`` languages.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts where nothing was
learned; ties go to the smaller language by code point; null doc_id is not held out and not learned from; repeated rows
are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import pieces, stored
from factorframe.llm.symbols import BITS, points, table

LANGUAGES = 1000
GRAMS = 1 << (3 * BITS)
#: Added to every count.
PRIOR = 0.1
#: Bytes of text that are counted or judged at once: bounds the arrays (characters x languages) that a task holds.
PIECE = 500_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram code of each letter and word end; where each word begins among them; row of each word."""
    codes, before = points(data)
    symbol = table(True)[codes]
    is_letter = symbol > 0
    if not is_letter.any():
        return (np.zeros(0, np.int64),) * 3
    begins = is_letter.copy()
    begins[1:] &= symbol[:-1] == 0
    heads = before[offsets[:-1]]
    heads = heads[heads < len(codes)]
    begins[heads] = is_letter[heads]
    at = np.flatnonzero(is_letter)
    word = np.cumsum(begins[at]) - 1
    n_words = word[-1] + 1
    seq = np.zeros(len(at) + 2 * n_words + 2, dtype=np.int64)  # two blanks before each word; the first of the next closes it
    seq[np.arange(len(at)) + 2 * (word + 1)] = symbol[at]
    code = (seq[:-2] << (2 * BITS)) | (seq[1:-1] << BITS) | seq[2:]
    place = np.flatnonzero(begins[at]) + 2 * np.arange(n_words)  # code[place]: blank, blank, first letter
    lengths = np.diff(np.append(np.flatnonzero(begins[at]), len(at)))
    keep = np.ones(len(code), dtype=bool)
    keep[place[1:] - 1] = False  # letter, blank, blank
    starts = np.cumsum(np.append(0, lengths[:-1] + 1))
    rows = np.searchsorted(before[offsets], at[begins[at]], "right") - 1
    return code[keep][:int(starts[-1] + lengths[-1] + 1)], starts, rows


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of code point and the log likelihood of each trigram, from rows (text, lang)."""

    def run(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, data, offsets in pieces(batch.column("text"), PIECE):
                code, starts, rows = grams(data, offsets)
                if not len(starts):
                    continue
                names = sorted(set(langs[at:at + len(offsets) - 1]))
                index = np.array([names.index(x) for x in langs[at:at + len(offsets) - 1]])
                lang = np.repeat(index[rows], np.diff(np.append(starts, len(code))))
                for i, name in enumerate(names):
                    own = np.bincount(code[lang == i], minlength=GRAMS)
                    counts[name] = counts[name] + own if name in counts else own
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "gram", "n"])

    counted = stored(docs.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted((r[0] for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect()), key=lambda x: x.encode())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    model = np.zeros((GRAMS, max(1, len(langs))), dtype=np.float32)
    found = counted.toArrow()  # at most 64 ** 3 rows a language
    index = {x: i for i, x in enumerate(langs)}
    names = np.array([index[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
    model[found.column("gram").to_numpy(), names] = found.column("n").to_numpy()
    return langs, np.log((model + PRIOR) / (model.sum(0) + PRIOR * GRAMS)).astype(np.float32)


def _fit(like: np.ndarray, top: np.ndarray, first: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each text; like: words x languages, scaled by ``top`` (log); allowed: texts x languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(turns):
        r = like * np.repeat(share, sizes, axis=0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(r, first, axis=0) / sizes[:, None]
    seen = (like * np.repeat(share, sizes, axis=0)).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(seen, 1e-30)) + top, first)


def infer(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Chosen sets and proportions (texts x languages) from log likelihoods of words; ``first``: first word of each text."""
    n, k = len(first), scores.shape[1]
    top = scores.max(1)
    like = np.exp(scores - top[:, None])
    single = np.add.reduceat(scores, first, axis=0)
    best = single.argmax(1)
    chosen = np.zeros((n, k), dtype=np.float32)
    chosen[np.arange(n), best] = 1
    share, value = chosen.copy(), single[np.arange(n), best]
    if k == 1:
        return chosen, share
    wide, most = _fit(like, top, first, sizes, np.ones((n, k), np.float32), turns)
    price = 0.5 * np.log(np.maximum(sizes, 2))
    active = most - value > price
    while active.any():
        rows = np.flatnonzero(active)
        words = np.repeat(active, sizes)
        trial = chosen[rows].copy()
        trial[np.arange(len(rows)), np.where(trial > 0, -1, wide[rows]).argmax(1)] = 1
        sub = sizes[rows]
        got, new = _fit(like[words], top[words], np.append(0, np.cumsum(sub)[:-1]), sub, trial, turns)
        better = new - value[rows] > price[rows]
        keep = rows[better]
        chosen[keep], share[keep], value[keep] = trial[better], got[better], new[better]
        active[:] = False
        active[keep] = (chosen[keep].sum(1) < k) & (most[keep] - value[keep] > price[keep])
    return chosen, share


def _judged(column, langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, list[str]]:
    """Language, score and chosen set of each text of an Arrow column."""
    n = len(column)
    names, scores, sets = ["und"] * n, np.zeros(n), [""] * n
    for at, data, offsets in pieces(column, PIECE) if langs else ():
        code, starts, rows = grams(data, offsets)
        if not len(starts):
            continue
        words = np.add.reduceat(model[code], starts, axis=0)
        own, first, sizes = np.unique(rows, return_index=True, return_counts=True)
        chosen, share = infer(words, first, sizes)
        for row, c, s in zip(own, chosen, share):
            names[at + row], scores[at + row] = langs[int(s.argmax())], min(1.0, float(s.max()))
            sets[at + row] = " ".join(x for x, y in zip(langs, c) if y)
    return names, scores, sets


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set) from rows (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores, sets = _judged(batch.column("text"), langs, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def _learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    known = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull()
    return learn(docs.where(known & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages for each row of ``docs`` (doc_id, text, lang)."""
    langs, model = _learned(docs)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), langs, model)


def in_a_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a main language: texts without one (``und``, or no language with a share of ``least``) go."""
    langs, model = _learned(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores, _ = _judged(batch.column("text"), langs, sent.value)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
